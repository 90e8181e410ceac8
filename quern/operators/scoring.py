"""Scored choices: predicted indexes, comparison with published items, nesting."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalar import RULES, first_largest, first_smallest, rule_value
from quern.operators.validate import ViolationError

#: A choice: log likelihood, tokens, characters, bytes, unconditional log likelihood.
CHOICE = ("log_likelihood", "tokens", "chars", "octets", "unconditional")


def predicted_indexes(items: DataFrame, choices: str = "choices") -> DataFrame:
    """Adds ``predicted_<rule>`` from an array of choice structs: first of equal scores, NULL without scores."""
    out = items
    for rule in RULES:
        out = out.withColumn(f"predicted_{rule}", first_largest(_values(choices, rule)))
    return out


def _values(choices: str, rule: str) -> Column:
    return F.transform(choices, lambda c: rule_value(rule, *[c[f] for f in CHOICE]))


def nested_items(choices: DataFrame, key: list[str], index: str = "choice_index", fields: tuple[str, ...] = CHOICE) -> DataFrame:
    """One row per item with its choices as an ordered array (an item has few choices)."""
    return choices.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), *fields))).alias("choices"))


def bits_index(bits: Column) -> Column:
    """Published per-byte prediction: the smallest bits per byte wins, first on ties."""
    return first_smallest(bits)


def octets_of(log_likelihood: Column, bits: Column) -> Column:
    """Bytes of a continuation, from its log likelihood and its published bits per byte; NULL where they give none."""
    octets = F.round(F.try_divide(-log_likelihood, bits * math.log(2)))
    return F.when((octets >= 1) & (octets < 2**53), octets.cast("bigint"))


def published_items(choices: DataFrame, key: list[str]) -> DataFrame:
    """Items of a ``choice_table``: ``predicted_<rule>`` and ``published_per_byte``, as places in the published list.

    Bytes are not published and follow from logits_per_byte (bits). Both per-byte
    predictions are NULL unless every choice of the item has it; a NaN counts as none.
    """
    bits = F.when(F.abs("logits_per_byte") < math.inf, F.col("logits_per_byte"))
    shaped = choices.select(
        *key, "choice_index", F.col("sum_logits").alias("log_likelihood"), F.col("num_tokens").alias("tokens"), F.col("num_chars").alias("chars"),
        octets_of(F.col("sum_logits"), bits).alias("octets"), F.col("sum_logits_uncond").alias("unconditional"), bits.alias("bits"),
    )
    items = nested_items(shaped, key, fields=(*CHOICE, "bits"))
    whole = {f: ~F.exists(F.col(f"choices.{f}"), lambda v: v.isNull()) for f in ("octets", "bits")}
    items = predicted_indexes(items).withColumn("published_per_byte", F.when(whole["bits"], bits_index(F.col("choices.bits"))))
    items = items.withColumn("predicted_per_byte", F.when(whole["octets"], F.col("predicted_per_byte")))
    # a null element is no choice but keeps its place
    return items.withColumns({c: F.get("choices", F.col(c))["i"].cast("int") for c in (*[f"predicted_{r}" for r in RULES], "published_per_byte")})


def compare_items(ours: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Per rule: agreement and both accuracies over items on both sides.

    ``ours`` has predicted_<rule> and gold_index, ``published`` published_<rule> and label.
    """
    return compare_joined(ours.join(published, key), key)


def compare_joined(joined: DataFrame, key: str) -> DataFrame:
    """``compare_items`` of rows that hold both sides."""
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"predicted_{r}").alias("o"), F.col(f"published_{r}").alias("p")) for r in RULES]))
    flat = joined.select(key, "gold_index", "label", rows.alias("x"))
    apart = F.when(F.col("x.o") != F.col("x.p"), F.struct(F.col(key), F.col("x.o").alias("ours"), F.col("x.p").alias("published")))
    return flat.groupBy("x.rule").agg(
        F.count(F.lit(1)).alias("items"), F.avg((F.col("x.o") == F.col("x.p")).cast("double")).alias("agreement"), F.avg((F.col("x.o") == F.col("gold_index")).cast("double")).alias("accuracy_ours"),
        F.avg((F.col("x.p") == F.col("label")).cast("double")).alias("accuracy_published"), F.min(apart).alias("first_mismatch"),
    )


def mismatches(joined: DataFrame, key: str, n: int = 5) -> DataFrame:
    """(rule, key, ours, published): the first ``n`` items by key on which a rule's predictions differ; NULL differs from a value."""
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"predicted_{r}").alias("ours"), F.col(f"published_{r}").alias("published")) for r in RULES]))
    apart = joined.select(key, rows.alias("x")).select("x.rule", key, "x.ours", "x.published").where(~F.col("ours").eqNullSafe(F.col("published")))
    place = F.row_number().over(Window.partitionBy("rule").orderBy(key))  # cut to n rows before the shuffle
    return apart.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def choice_differences(ours: DataFrame, published: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: choices on both sides, on one only, and how far their likelihoods and token counts agree.

    Both sides have ``key`` (unique), log_likelihood, unconditional and tokens. Differences are over the
    choices where both sides have a value; ``token_agreement`` is over all that are on both.
    """
    fields = ("log_likelihood", "unconditional", "tokens")
    sided = lambda df, mark: df.select(*key, F.struct(*fields).alias(mark))
    j = sided(ours, "o").join(sided(published, "p"), list(key), "full_outer")
    both = F.col("o").isNotNull() & F.col("p").isNotNull()
    gap = {f: F.abs(F.col(f"o.{f}") - F.col(f"p.{f}")) for f in fields[:2]}
    return j.agg(
        F.count_if(both).alias("choices"), F.count_if(F.col("p").isNull()).alias("ours_only"), F.count_if(F.col("o").isNull()).alias("published_only"),
        *[x for f, d in gap.items() for x in (F.avg(d).alias(f"{f}_mean_abs_diff"), F.max(d).alias(f"{f}_max_abs_diff"))],
        F.avg(F.when(both, F.col("o.tokens").eqNullSafe(F.col("p.tokens")).cast("double"))).alias("token_agreement"),
    )


def context_agreement(ours: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """One row: items, and the share whose context tokens, summed over the choices, are the same on both sides."""
    total = lambda df, name: df.groupBy(key).agg(F.sum("context_tokens").alias(name))
    return total(ours, "a").join(total(published, "b"), key).agg(F.count(F.lit(1)).alias("items"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("context_agreement"))


def require_same_items(ours: DataFrame, published: DataFrame, key: str) -> None:
    """Raise on the first items that are on one side only or whose labels or numbers of choices differ (runs a query)."""
    found = item_set_faults(ours, published, key).orderBy(key).limit(5).collect()
    if found:
        raise ViolationError("item sets differ: " + ", ".join(f"{r[key]} ({r.fault})" for r in found))


def item_set_faults(ours: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Items on one side only, and items whose label or number of choices differ."""
    a = ours.select(key, F.col("gold_index"), F.size("choices").alias("n_ours"), F.lit(1).alias("l"))
    b = published.select(key, "label", F.col("n_choices").alias("n_published"), F.lit(1).alias("r"))
    j = a.join(b, key, "full_outer")
    fault = F.when(F.col("l").isNull(), "published only").when(F.col("r").isNull(), "ours only").when(~F.col("gold_index").eqNullSafe(F.col("label")), "labels differ").when(F.col("n_ours") != F.col("n_published"), "choice counts differ")
    return j.select(key, fault.alias("fault")).where("fault IS NOT NULL")


def accepted(comparison: DataFrame, mean_abs_diff: float, thresholds: Mapping[str, float], max_mean_abs_diff: float) -> dict[str, bool]:
    """Whether each rule's agreement exceeds its threshold and the mean difference stays below its bound."""
    seen = {r["rule"]: r["agreement"] for r in comparison.select("rule", "agreement").collect()}  # one row per rule
    return {f"{rule}_agreement": seen.get(rule, 0.0) > least for rule, least in thresholds.items()} | {"mean_abs_diff": mean_abs_diff < max_mean_abs_diff}

"""Best representative of each duplicate group, field by field.

Records of a cell are compared on completeness (the set of filled fields),
recency and trust. Record a dominates b when a fills every field that b fills,
is as recent and as trusted, and is better in one of these. Layer 0 is the
skyline of undominated records; layer n + 1 is the skyline of what remains.
Within a layer the policy is lexicographic: trust, then recency, then the
smaller id. A field survives from the first record in (layer, policy) order that
fills it. Because completeness is compared as a set, the most trusted, then
latest holder of a field is never dominated by a record of lower trust or
recency, so the layers agree with the policy field by field.

Scale: before records of a cell meet, they are reduced to the latest one per
(cell, filled set, trust) with a map-side combinable aggregate. A cell then has
at most 2**fields x trust levels candidates however many rows it had, so a cell
that holds a third of all rows costs no more than any other.

Defined results: rows without a cell (NULL key part, unknown or retired group)
are left out; NULL, NaN and blank values are unfilled; NULL times are earliest,
unknown files least trusted; full ties go to the smaller id; repeated rows
with one id count once; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import micros, strip_blanks, whole_number
from quern.session import checked_broadcast

EVALUATION_FIELDS = ("chinchilla", "tokens", "compute", "c4_en_validation_cross_entropy", "train_cross_entropy", "throughput_total_tokens", "acc_raw", "acc_per_char", "primary_metric")
UNTRUSTED = -(2**31)


def filled(column: str, dtype: str) -> Column:
    """Whether a field has a value: not NULL, NaN or blank. Never NULL."""
    c = F.col(column)
    if dtype in ("double", "float"):
        return c.isNotNull() & ~F.isnan(c)
    if dtype == "string":
        return F.coalesce(strip_blanks(c) != "", F.lit(False))
    return c.isNotNull()


def _dominates(a: Column, b: Column) -> Column:
    return (a["mask"].bitwiseAND(b["mask"]) == b["mask"]) & (a["trust"] >= b["trust"]) & (a["at"] >= b["at"]) & ((a["mask"] != b["mask"]) | (a["trust"] > b["trust"]) | (a["at"] > b["at"]))


def rank_candidates(rows: DataFrame, cell: Sequence[str], mask: Column, trust: Column, at: Column, record_id: Column, payload: Column | None = None) -> DataFrame:
    """Candidates of each cell in (layer, policy) order.

    Result: cell columns, ``group_id`` (smallest id), ``n_rows`` (distinct
    ids are the caller's matter) and ``ranked``, an array of struct(layer, trust, at, id, mask,
    payload) best first. ``at`` is a BIGINT.
    """
    flat = rows.select(
        *cell,
        mask.cast("bigint").alias("mask"),
        F.coalesce(trust.cast("int"), F.lit(UNTRUSTED)).alias("trust"),
        F.coalesce(at.cast("bigint"), F.lit(-(2**63))).alias("at"),
        record_id.alias("id"),
        (payload if payload is not None else F.lit(None).cast("int")).alias("payload"),
    )
    reduced = flat.groupBy(*cell, "mask", "trust").agg(
        F.max_by(F.struct("at", "id", "payload"), F.struct("at", -F.col("id"))).alias("best"),
        F.min("id").alias("low"),
        F.count(F.lit(1)).alias("n"),
    )
    candidate = F.struct(
        (-F.col("trust").cast("bigint")).alias("by_trust"), (-(F.col("best.at") + 1)).alias("by_at"), (-F.bit_count("mask")).alias("by_size"),
        F.col("best.id").alias("id"), "mask", "trust", F.col("best.at").alias("at"), F.col("best.payload").alias("payload"),
    )
    cells = reduced.groupBy(*cell).agg(F.min("low").alias("group_id"), F.sum("n").alias("n_rows"), F.sort_array(F.collect_list(candidate)).alias("c"))
    # A dominator sorts before what it dominates, so one pass assigns layers.
    plain = F.transform("c", lambda x: F.struct(F.lit(0).alias("layer"), x["trust"].alias("trust"), x["at"].alias("at"), x["id"].alias("id"), x["mask"].alias("mask"), x["payload"].alias("payload")))

    def place(done: Column, x: Column) -> Column:
        above = F.transform(F.filter(done, lambda d: _dominates(d, x)), lambda d: d["layer"])
        layer = F.coalesce(F.array_max(above) + 1, F.lit(0))
        return F.array_append(done, F.struct(layer.alias("layer"), x["trust"].alias("trust"), x["at"].alias("at"), x["id"].alias("id"), x["mask"].alias("mask"), x["payload"].alias("payload")))

    # most cells have one candidate and need no comparison
    layered = cells.select(*cell, "group_id", "n_rows", F.when(F.size("c") == 1, plain).otherwise(F.aggregate(plain, F.slice(plain, 1, 0), place)).alias("l"))
    # Stable by construction: the list is in policy order, layers only regroup it.
    depth = F.coalesce(F.array_max(F.transform("l", lambda x: x["layer"])), F.lit(0))
    ranked = F.flatten(F.transform(F.sequence(F.lit(0), depth), lambda k: F.filter("l", lambda x: x["layer"] == k)))
    return layered.select(*cell, "group_id", "n_rows", ranked.alias("ranked"))


def _holder(k: int) -> Column:
    """The first ranked candidate that fills field ``k``, NULL if none does."""
    bit = 1 << k
    return F.get(F.filter("ranked", lambda x: x["mask"].bitwiseAND(F.lit(bit).cast("bigint")) != 0), F.lit(0))


def field_survivors(ranked: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell and field that some record fills: group_id, field_name, id."""
    picks = F.array(*[F.struct(F.lit(f).alias("field_name"), _holder(k)["id"].alias("id")) for k, f in enumerate(fields)])
    return ranked.select(*keep, "group_id", F.explode(picks).alias("p")).where("p.id IS NOT NULL").select(*keep, "group_id", "p.field_name", "p.id")


def squeezed(text: Column) -> Column:
    """Lower case without blanks and separators."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def group_spellings(groups: DataFrame) -> DataFrame:
    """(spelling, source_group, recipe): each entry, and each with one letter dropped or doubled.

    An exact spelling beats a slip; a slip that fits several entries of different
    recipes stands for none.
    """
    base = groups.select("source_group", "recipe", squeezed(F.col("source_group")).alias("s")).where("s <> ''")
    at = F.sequence(F.lit(1), F.length("s"))
    letter = lambda i: F.substring(F.col("s"), i, F.lit(1))
    letters = F.filter(at, lambda i: letter(i).rlike(r"^\p{L}$"))
    left = lambda i: F.substring(F.col("s"), F.lit(1), i - 1)
    right = lambda i: F.substring(F.col("s"), i + 1, F.length("s"))
    dropped = F.transform(letters, lambda i: F.concat(left(i), right(i)))
    doubled = F.transform(letters, lambda i: F.concat(left(i), letter(i), letter(i), right(i)))
    exact = base.select(F.col("s").alias("spelling"), "source_group", "recipe", F.lit(0).alias("slip"))
    slips = base.select(F.explode(F.array_distinct(F.concat(dropped, doubled))).alias("spelling"), "source_group", "recipe", F.lit(1).alias("slip"))
    best = exact.union(slips).groupBy("spelling", "slip").agg(F.min("source_group").alias("source_group"), F.min("recipe").alias("recipe"), F.count_distinct(F.coalesce("recipe", F.lit(""))).alias("n"))
    first = best.groupBy("spelling").agg(F.min_by(F.struct("source_group", "recipe", "n"), "slip").alias("b"))
    return first.where("b.n = 1").select("spelling", "b.source_group", "b.recipe")


def evaluation_cells(evaluations: DataFrame, groups: DataFrame, files: DataFrame) -> DataFrame:
    """Evaluation rows with their cell key, trust and filled-field mask."""
    types = dict(evaluations.dtypes)
    rows = evaluations.select(
        F.col("eval_id").cast("bigint").alias("eval_id"),
        squeezed(F.col("source_group")).alias("spelling"),
        F.regexp_extract(F.lower(strip_blanks(F.col("source_file"))), r"([^/\\]*)$", 1).alias("file"),
        F.upper(strip_blanks(F.col("params"))).alias("params"),
        whole_number(F.col("seed")).alias("seed"),
        whole_number(F.col("step")).alias("step"),
        F.lower(strip_blanks(F.col("task"))).alias("task"),
        micros("loaded_at", types["loaded_at"]).alias("at"),
        sum((F.when(filled(f, types[f]), F.lit(1 << k)).otherwise(0) for k, f in enumerate(EVALUATION_FIELDS)), F.lit(0)).cast("bigint").alias("mask"),
        F.struct(*[F.col(f) for f in EVALUATION_FIELDS]).alias("values"),
    )
    spellings = group_spellings(groups).where("recipe IS NOT NULL").select(F.col("spelling").alias("g_spelling"), "recipe")
    trust = files.groupBy(F.lower(strip_blanks(F.col("source_file"))).alias("f_file")).agg(F.max("precedence").alias("trust"))
    return (
        rows.join(checked_broadcast(spellings, 100_000), F.col("spelling") == F.col("g_spelling"))
        .join(checked_broadcast(trust), F.col("file") == F.col("f_file"), "left")
        .where("params IS NOT NULL AND seed IS NOT NULL AND step IS NOT NULL AND task IS NOT NULL AND eval_id IS NOT NULL")
        .select("eval_id", "recipe", "params", "seed", "step", "task", "trust", "at", "mask", "values")
    )


CELL = ("recipe", "params", "seed", "step", "task")


def evaluation_survivors(evaluations: DataFrame, groups: DataFrame, files: DataFrame) -> DataFrame:
    """(group_id, field_name, eval_id) for cells of two or more rows."""
    rows = evaluation_cells(evaluations, groups, files)
    ranked = rank_candidates(rows, CELL, F.col("mask"), F.col("trust"), F.col("at"), F.col("eval_id"))
    return field_survivors(ranked.where("n_rows > 1"), EVALUATION_FIELDS).withColumnRenamed("id", "eval_id")


def merged_evaluations(evaluations: DataFrame, groups: DataFrame, files: DataFrame) -> DataFrame:
    """One record per cell, built field by field, with the row behind each field."""
    rows = evaluation_cells(evaluations, groups, files)
    ranked = rank_candidates(rows, CELL, F.col("mask"), F.col("trust"), F.col("at"), F.col("eval_id"), F.col("values"))
    return ranked.select(
        *CELL, "group_id", "n_rows", F.get("ranked", F.lit(0))["id"].alias("best_eval_id"),
        F.size(F.filter("ranked", lambda x: x["layer"] == 0)).alias("n_undominated"),
        *[_holder(k)["payload"][f].alias(f) for k, f in enumerate(EVALUATION_FIELDS)],
    )

"""From raw results to contract tables: validate, type, resolve and enrich.

Each pipeline is a lazy plan. Validation is a rule list over the same frame; run it
with ``check`` (one top-1 query) before writing, or use its violations as a table.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.numbers import finite_double, strip_blanks, whole_number
from quern.functions.scalar import by_policy, finite_metric, off_schedule, tidy
from quern.operators.relational import full_outer_runs, provenance
from quern.operators.schedule import MODEL_SIZES, enrich, schedule_frame, schedule_rows
from quern.operators.validate import Rule, ViolationError, outside_domain, raise_first, violations
from quern.session import checked_broadcast, ship_package, stable_checkpoint

SIZES = tuple(m[0] for m in MODEL_SIZES)

# Raw perplexity columns and their names.
PPL_COLUMNS = {
    "wikitext_103_valppl": "eval/wikitext_103-validation/Perplexity",
    "pile_valppl": "eval/pile-validation/Perplexity",
    "c4_en_valppl": "eval/c4_en-validation/Perplexity",
    "m2d2_s2orc_valppl": "eval/m2d2_s2orc-validation/Perplexity",
    "ice_valppl": "eval/ice-validation/Perplexity",
    "dolma_wiki_valppl": "eval/dolma_wiki-validation/Perplexity",
    "dolma_stack_valppl": "eval/dolma_stack-validation/Perplexity",
    "dolma_reddit_valppl": "eval/dolma_reddit-validation/Perplexity",
    "dolma_pes2o_valppl": "eval/dolma_pes2o-validation/Perplexity",
    "dolma_common_crawl_valppl": "eval/dolma_common-crawl-validation/Perplexity",
    "dolma_books_valppl": "eval/dolma_books-validation/Perplexity",
}
# Metrics of an aggregate result, in order.
METRICS = (
    "correct_choice", "acc_raw", "acc_per_token", "acc_per_char", "acc_per_byte", "acc_uncond", "no_answer",
    "sum_logits_corr", "logits_per_token_corr", "logits_per_char_corr", "bits_per_byte_corr", "logits_per_byte_corr",
    "correct_prob", "correct_prob_per_token", "correct_prob_per_char", "margin", "margin_per_token", "margin_per_char",
    "total_prob", "total_prob_per_token", "total_prob_per_char", "uncond_correct_prob", "uncond_correct_prob_per_token",
    "uncond_correct_prob_per_char", "uncond_total_prob", "norm_correct_prob", "norm_correct_prob_per_token", "norm_correct_prob_per_char",
)
# Metric keys that are known and dropped.
DROPPED_METRICS = ("predicted_index_raw", "predicted_index_per_token", "predicted_index_per_char", "predicted_index_per_byte", "predicted_index_uncond", "primary_metric")
# Which metric is primary for a task; all mmlu_ tasks use acc_raw.
PRIMARY_METRIC = {
    "arc_challenge": "acc_uncond", "arc_easy": "acc_per_char", "boolq": "acc_raw", "csqa": "acc_uncond", "hellaswag": "acc_per_char",
    "openbookqa": "acc_uncond", "piqa": "acc_per_char", "socialiqa": "acc_per_char", "winogrande": "acc_raw",
}
# Raw loss columns of the scaling files and their names.
LOSS_COLUMNS = {
    "c4_en_validation_cross_entropy": "eval/c4_en-validation/CrossEntropyLoss",
    "dolma_common_crawl_validation_cross_entropy": "eval/dolma_common-crawl-validation/CrossEntropyLoss",
    "pile_validation_cross_entropy": "eval/pile-validation/CrossEntropyLoss",
    "wikitext_103_validation_cross_entropy": "eval/wikitext_103-validation/CrossEntropyLoss",
    "train_cross_entropy": "train/CrossEntropyLoss",
    "throughput_total_tokens": "throughput/total_tokens",
}
MMLU_PREFIX, MMLU_METRIC = "mmlu_", "acc_raw"


def primary_metric(task: Column, metric: Mapping[str, Column]) -> Column:
    """The primary score of a task, NULL for a task without a policy."""
    return by_policy(task, metric, MMLU_PREFIX, MMLU_METRIC, PRIMARY_METRIC)


# -- metric dictionaries ---------------------------------------------------------


def literal_metrics(text: str | None) -> dict[str, float | None]:
    """Metrics written as a Python dict of numbers and None; anything else raises ValueError.

    The dictionary is read as a list of pairs, so that a repeated key is seen. Keys of
    ``DROPPED_METRICS`` are judged like the others and left out.
    """
    pairs = literal_pairs(text)
    keys = [k for k, _ in pairs]
    for k, (key, value) in enumerate(pairs):
        fault = "unknown metric" if not isinstance(key, str) or key not in _KNOWN_METRICS else "repeated metric" if key in keys[:k] else None if _is_metric(value) else "no finite number for"
        if fault:
            raise ValueError(f"{fault} {key!r}")
    return {k: None if v is None else float(v) for k, v in pairs if k in METRICS}


def literal_pairs(text: str | None) -> list[tuple[object, object]]:
    """(key, value) pairs of a dictionary literal, in order and with repeats; ValueError for other text."""
    try:
        body = ast.parse((text or "").strip(), mode="eval").body
        if isinstance(body, ast.Dict) and None not in body.keys:
            return ast.literal_eval(ast.List([ast.Tuple([k, v]) for k, v in zip(body.keys, body.values, strict=True)]))
    except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError):
        pass
    raise ValueError("no dictionary literal")


_KNOWN_METRICS = frozenset(METRICS) | frozenset(DROPPED_METRICS)


def _is_metric(value: object) -> bool:
    """None or a number that is a finite double."""
    if type(value) is int:
        return abs(value) < 2**1024 - 2**970
    return value is None or (type(value) is float and math.isfinite(value))


_PARSED = T.StructType([T.StructField("fault", T.StringType()), *[T.StructField(m, T.DoubleType()) for m in METRICS]])


@F.pandas_udf(_PARSED)
def _parse_literal_metrics(text: pd.Series) -> pd.DataFrame:
    known: dict[object, list] = {}
    for t in text.unique():
        try:
            found = literal_metrics(t)
            known[t] = [None, *[found.get(m) for m in METRICS]]
        except ValueError as error:
            known[t] = [str(error), *[None] * len(METRICS)]
    return pd.DataFrame([known[t] for t in text], columns=["fault", *METRICS])


def parse_literal_metrics(text: Column) -> Column:
    """struct(fault, metrics): ``fault`` is NULL where the dictionary is sound.

    Dictionary syntax with None is not JSON and repeated keys must be seen, which
    built-in parsers cannot do; equal texts of a batch are parsed once.
    """
    ship_package(SparkSession.getActiveSession())
    return _parse_literal_metrics(text)


def json_metrics(text: Column) -> Column:
    """Metrics of a JSON object (or one with single quotes) as a struct of doubles; NULL if it is none.

    NaN becomes NULL and infinities stay; missing keys are NULL.
    """
    quoted = F.replace(text, F.lit("'"), F.lit('"'))
    shape = T.StructType([T.StructField(m, T.StringType()) for m in METRICS])
    parsed = F.from_json(quoted, shape.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    sound = F.try_parse_json(quoted).isNotNull() & strip_blanks(text).startswith("{")
    return F.when(sound, F.struct(*[finite_metric(parsed[m]).alias(m) for m in METRICS]))


# -- perplexities ---------------------------------------------------------------------


def normalized_ids(raw: DataFrame) -> DataFrame:
    """Raw rows with trimmed text ids and a whole ``step`` (NULL if it is none)."""
    return raw.withColumn("step", whole_number(F.col("step").cast("string")))


def ppl_rules(recipes: Sequence[str], seeds: Sequence[str]) -> list[Rule]:
    step = F.col("step")
    return [outside_domain("params", SIZES), outside_domain("data", recipes), outside_domain("seed", seeds), Rule("step", step.isNull() | (step < 0), step.cast("string"))]


def preprocess_ppl(raw: DataFrame) -> DataFrame:
    """Enriched perplexities by (params, data, seed, step); absent metric columns are typed NULL."""
    rows = normalized_ids(raw)
    metric = [(finite_metric(F.col(f"`{r}`").cast("string")) if r in raw.columns and dict(raw.dtypes)[r] != "boolean" else F.lit(None).cast("double")).alias(m) for m, r in PPL_COLUMNS.items()]
    return enrich(rows.select("params", "data", "seed", "step", *metric)).orderBy("params", "data", "seed", "step")


# -- aggregate results ------------------------------------------------------------------


def aggregate_violations(raw: DataFrame, recipes: Sequence[str], seeds: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First fault of each aggregate row: domain, step, metrics or a schedule contradiction."""
    rows = normalized_ids(raw).join(F.broadcast(schedule_frame(raw.sparkSession).select("params", "tokens_per_step", "compute_per_step")), "params", "left")
    per_step = F.col("step") * F.col("tokens_per_step")
    rules = [
        outside_domain("params", SIZES), outside_domain("data", recipes), outside_domain("seed", seeds), Rule("step", F.col("step").isNull() | (F.col("step") < 0)), Rule("task", ~tidy(F.col("task")), F.col("task")),
        Rule("metrics", json_metrics(F.col("metrics")).isNull(), F.col("metrics")),
        Rule("tokens", F.col("tokens").isNotNull() & (whole_number(F.col("tokens").cast("string")) != per_step), F.col("tokens").cast("string")),
        Rule("compute", off_schedule(F.col("compute").cast("double"), F.col("step").cast("double") * F.col("compute_per_step")), F.col("compute").cast("string")),
    ]
    return violations(rows, rules, keep)


def preprocess_aggregate(raw: DataFrame) -> DataFrame:
    """Enriched aggregate results with typed metrics and the task's primary metric."""
    rows = normalized_ids(raw).select("params", "data", "seed", "step", "task", json_metrics(F.col("metrics")).alias("m"))
    values = {m: F.col(f"m.{m}") for m in METRICS}
    typed = rows.select("params", "data", "seed", "step", "task", *[c.alias(m) for m, c in values.items()], primary_metric(F.col("task"), values).alias("primary_metric"))
    return enrich(typed).orderBy("params", "data", "seed", "step", "task")


# -- scaling-law files --------------------------------------------------------------------


def scaling_rows(raw: DataFrame, groups: DataFrame, legacy_seed: int) -> DataFrame:
    """Rows in scope: a seed that is present and not the legacy one, a group that is not retired.

    ``groups`` (source_group, recipe) is a lookup table; retired groups have no
    recipe. Comparisons with NULL are NULL, so rows without a group fall out as
    well; unknown groups stay, for the rules to report. Adds ``_typed``, the values behind the
    texts (NULL where a text has none), read once per row.
    """
    typed = [whole_number(F.col(c)).alias(c) for c in ("step", "seed", "tokens")] + [finite_double(F.col(f"`{r}`")).alias(m) for m, r in {"compute": "compute", **LOSS_COLUMNS}.items()]
    # exploded, so that no later step repeats the reading of a value
    read = raw.select("*", F.explode(F.array(F.struct(*typed))).alias("_typed"))
    retired = groups.where("recipe IS NULL").select(F.col("source_group").alias("group")).distinct()
    seed = F.col("_typed.seed")
    kept = read.where((strip_blanks(F.col("seed")) != "") & (seed.isNull() | (seed != legacy_seed)) & F.col("group").isNotNull())
    return kept.join(checked_broadcast(retired), "group", "left_anti").select(*raw.columns, "_typed")


def scaling_rules(groups: Sequence[str], seeds: Sequence[int] | None = None) -> list[Rule]:
    """Rules of ``scaling_rows``; ``groups`` and ``seeds`` are the known ones (any whole seed without ``seeds``).

    ``schedule``: tokens that are not the step times the size's tokens per step.
    """
    t = {c: F.col(f"_typed.{c}") for c in ("step", "seed", "tokens", "compute", *LOSS_COLUMNS)}
    per_step = F.try_element_at(F.create_map(*[F.lit(x) for r in schedule_rows() for x in (r["params"], r["tokens_per_step"])]), F.col("model"))

    def unread(name: str, raw: str) -> Rule:
        return Rule(name, t[name].isNull() & F.coalesce(strip_blanks(F.col(f"`{raw}`")) != "", F.lit(False)), F.col(f"`{raw}`"))

    return [
        outside_domain("group", groups), outside_domain("model", SIZES), Rule("task", ~tidy(F.col("task")), F.col("task")),
        Rule("step", t["step"].isNull() | (t["step"] < 0), F.col("step")), Rule("seed", t["seed"].isNull() if seeds is None else t["seed"].isNull() | ~t["seed"].isin(*seeds), F.col("seed")),
        *[unread(name, raw) for name, raw in {"tokens": "tokens", "compute": "compute", **LOSS_COLUMNS}.items()],
        Rule("schedule", F.try_multiply(t["step"], per_step) != t["tokens"], F.col("tokens")),
    ]


CHECKPOINT = ("recipe", "params", "seed_value", "step")
CELL = (*CHECKPOINT, "task")


def _scaling_cells(raw: DataFrame, groups: DataFrame) -> DataFrame:
    """Typed keys and losses of ``scaling_rows`` that passed their rules; ``groups`` names the recipe behind each raw group."""
    names = groups.where("recipe IS NOT NULL").groupBy(F.col("source_group").alias("group")).agg(F.min("recipe").alias("recipe"))
    return raw.join(checked_broadcast(names), "group").select(
        "recipe", F.col("model").alias("params"), F.col("_typed.seed").alias("seed_value"), F.col("_typed.step").alias("step"), "task",
        "source_priority", "source_file", "source_row", "metrics", F.nullif(strip_blanks(F.col("chinchilla")), F.lit("")).alias("chinchilla"),
        *[F.col(f"_typed.{m}").alias(m) for m in LOSS_COLUMNS],
    )


def _files_of_cells(cells: DataFrame) -> DataFrame:
    """One row per cell and file: its number of rows and the metrics of the last."""
    return cells.groupBy(*CELL, "source_priority", "source_file").agg(F.count(F.lit(1)).alias("n"), F.max_by("metrics", "source_row").alias("metrics"))


CHECKPOINT_FIELDS = ("chinchilla", *LOSS_COLUMNS)


def _files_of_checkpoints(rows: DataFrame, low: str = "", high: str = "") -> DataFrame:
    """The file behind each checkpoint: files with loss data first, then priority; ``conflicts`` names fields with several values.

    ``rows`` are cells, or groups of them with the least and greatest value of each field under the prefixes ``low`` and ``high``.
    """
    apart = F.array_compact(F.array(*[F.when(F.min(low + m) != F.max(high + m), F.lit(m)) for m in CHECKPOINT_FIELDS]))
    per_file = rows.groupBy(*CHECKPOINT, "source_priority", "source_file").agg(
        F.max(F.coalesce(*[low + m for m in LOSS_COLUMNS]).isNotNull()).alias("has"), F.max("source_row").alias("source_row"), apart.alias("conflicts"), *[F.min(low + m).alias(m) for m in CHECKPOINT_FIELDS]
    )
    best = F.max_by(F.struct("source_file", "source_row", "conflicts", *CHECKPOINT_FIELDS), F.struct("has", "source_priority")).alias("b")
    return per_file.groupBy(*CHECKPOINT).agg(best).select(*CHECKPOINT, "b.*")


def scaling_conflicts(raw: DataFrame, groups: DataFrame) -> DataFrame:
    """(source_file, source_row, kind, value) of what the rules of single rows cannot see.

    ``duplicate`` and ``unequal duplicate``: a cell with several rows in one file (its last row, the cell and
    the number of rows); ``conflict``: a checkpoint whose file gives a field several values. Cells are
    reduced to a row per file once, in the checkpoint folder, for both (runs that query).
    """
    content = F.struct("metrics", *CHECKPOINT_FIELDS)
    ends = [f(m).alias(p + m) for m in CHECKPOINT_FIELDS for p, f in (("low_", F.min), ("high_", F.max))]
    grouped = _scaling_cells(raw, groups).groupBy(*CELL, "source_priority", "source_file")
    files = stable_checkpoint(grouped.agg(F.count(F.lit(1)).alias("n"), F.max("source_row").alias("source_row"), F.min(content).eqNullSafe(F.max(content)).alias("alike"), *ends))
    twice = files.where("n > 1").select("source_file", "source_row", F.when(F.col("alike"), "duplicate").otherwise("unequal duplicate").alias("kind"), F.concat(F.concat_ws("/", *CELL), F.lit(" x "), F.col("n").cast("string")).alias("value"))
    apart = _files_of_checkpoints(files, "low_", "high_").where(F.size("conflicts") > 0)
    return twice.unionByName(apart.select("source_file", "source_row", F.lit("conflict").alias("kind"), F.concat(F.concat_ws("/", *CHECKPOINT), F.lit(": "), F.array_join("conflicts", ", ")).alias("value")))


def resolve_scaling(raw: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evaluations, checkpoint losses) of raw scaling rows that passed their rules.

    Of the files with a cell the one with the highest ``source_priority`` wins. A
    cell that a file holds more than once is rejected, as is a checkpoint whose chosen
    file gives a field several values; ``scaling_conflicts`` reports both. Tokens and
    compute are those of the schedule.
    """
    cells = _scaling_cells(raw, groups)
    best = F.max_by(F.struct("source_file", "metrics"), "source_priority").alias("b")
    winners = _files_of_cells(cells).groupBy(*CELL).agg(best, F.max("n").alias("n")).where("n = 1").select(*CELL, "b.*")
    parsed = winners.withColumn("m", parse_literal_metrics(F.col("metrics")))
    values = {m: F.col(f"m.{m}") for m in METRICS}
    evaluations = enrich(parsed.select(*CELL, "source_file", F.col("m.fault").alias("metrics_fault"), *[c.alias(m) for m, c in values.items()], primary_metric(F.col("task"), values).alias("primary_metric")))
    checkpoints = enrich(_files_of_checkpoints(cells).where(F.size("conflicts") == 0).drop("source_row", "conflicts"))
    return evaluations, checkpoints


def preprocess_scaling(raw: DataFrame, groups: DataFrame, seeds: Sequence[int], legacy_seed: int) -> tuple[DataFrame, DataFrame]:
    """``resolve_scaling`` after raising on the first fault of any kind (runs queries)."""
    known = [r[0] for r in groups.where("recipe IS NOT NULL").select("source_group").distinct().collect()]  # a lookup table
    rows, rules = scaling_rows(raw, groups, legacy_seed), scaling_rules(known, seeds)
    raise_first(rows, rules, ["source_priority", "source_row"], "scaling files")
    found = scaling_conflicts(rows, groups).orderBy("source_file", "source_row").limit(1).collect()
    if found:
        raise ViolationError(f"{found[0].kind} in {found[0].source_file} at row {found[0].source_row}: {found[0].value}")
    evaluations, checkpoints = resolve_scaling(rows, groups)
    bad = evaluations.where("metrics_fault IS NOT NULL").limit(1).collect()
    if bad:
        raise ViolationError(f"metrics of {'/'.join(str(bad[0][c]) for c in CELL)}: {bad[0].metrics_fault}")
    return evaluations.drop("metrics_fault"), checkpoints


# -- published tables and run objects ---------------------------------------------------------


def published_union(sources: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Sources (frame, file, unit) of one schema as one multiset with provenance first."""
    out = None
    for df, name, unit in sources:
        part = provenance(df, name, unit)
        out = part if out is None else out.unionByName(part)
    return out


def published_faults(df: DataFrame, required: Mapping[str, str]) -> DataFrame:
    """Per source: rows, and rows with a NULL or blank required cell."""
    bad = F.lit(False)
    for column, kind in required.items():
        bad = bad | F.col(column).isNull() | ((F.trim(F.col(column)) == "") if kind == "string" else F.lit(False))
    return df.groupBy("source_file", "source_unit").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_faulty"))


def run_checkpoints(ppl: DataFrame, tasks: DataFrame) -> DataFrame:
    """Perplexities and task metrics of each (params, data, seed, step), present on either side."""
    return full_outer_runs(ppl, tasks, ["params", "data", "seed", "step"])


def schedule_ratios(checkpoints: DataFrame) -> DataFrame:
    """Empirical tokens and compute per step of each size, from its largest values."""
    top = checkpoints.groupBy("params").agg(*[F.max(c).alias(c) for c in ("step", "tokens", "compute")])
    return top.select("params", F.floor(F.try_divide("tokens", "step")).alias("tokens_per_step"), F.try_divide("compute", "step").alias("compute_per_step"))


def check(df: DataFrame, rules: Sequence[Rule], ordinal: Sequence[str], table: str) -> DataFrame:
    """The frame, after raising on its first violation."""
    raise_first(df, rules, ordinal, table)
    return df


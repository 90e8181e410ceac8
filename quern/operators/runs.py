"""Experiment-tracker runs: names, filters, tags, metric documents and dynamics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import run_names
from quern.operators.relational import nearest_name
from quern.operators.schedule import EXACT_COUNTS

# Methods that a run name may carry, earliest usable run, tag of cache runs.
METHODS = ("dpo", "finetune")
EARLIEST_RUN = "2025-08-21"
CACHE_TAG = "dpo_tune_cache"


def with_name_parts(runs: DataFrame, column: str = "run_name") -> DataFrame:
    """Adds ``*_rnp`` columns read from the run name; parts that are absent are NULL."""
    name = F.col(column)
    model = F.coalesce(run_names.tuned_model(name), run_names.plain_model(name))
    named = F.coalesce(*[F.when(F.contains(F.lower(name), F.lit(m)), m) for m in METHODS])
    read = F.struct(model.alias("model"), run_names.token_counts(name).alias("tokens"))
    return runs.withColumn("_r", read).select(
        *runs.columns, run_names.run_time(name).alias("run_datetime_rnp"), run_names.experiment(name).alias("exp_name_rnp"),
        F.col("_r.model.data").alias("data_rnp"), F.col("_r.model.size").alias("params_rnp"), F.col("_r.model.checkpoint").alias("checkpoint_rnp"),
        F.col("_r.tokens.epochs").alias("epochs_rnp"), F.col("_r.tokens.millions").alias("total_tok_rnp"), named.alias("method_rnp"), run_names.typed_options(name).alias("options_rnp"),
    )


def training_method(runs: DataFrame, dpo_columns: Sequence[str]) -> DataFrame:
    """``method``: dpo where any preference column has a value, else finetune."""
    have = [F.col(f"`{c}`").cast("string") for c in dpo_columns if c in runs.columns]
    return runs.withColumn("method", F.when(F.coalesce(*have, F.lit(None)).isNotNull(), "dpo").otherwise("finetune") if have else F.lit("finetune"))


def usable_runs(runs: DataFrame, time_column: str, tag_column: str | None = None, earliest: str = EARLIEST_RUN) -> DataFrame:
    """Runs from the earliest good date on (text order) that carry no cache tag; a NULL tag carries none."""
    kept = runs.where(F.col(time_column) >= F.lit(earliest))
    return kept.where(~F.coalesce(F.col(tag_column), F.lit("")).contains(CACHE_TAG)) if tag_column else kept


def model_columns(runs: DataFrame, path: str = "model_name_or_path", size: str = "model_size", prefix: str = "", names: Mapping[str, str] | None = None) -> DataFrame:
    """Recipe from a model path and size class from a parameter count (nearest)."""
    folder = F.get(F.split(F.substring_index(path, "/snapshots", 1), "/", -1), F.size(F.split(F.substring_index(path, "/snapshots", 1), "/", -1)) - 1)
    model = F.when(F.contains(F.col(path), F.lit("/snapshots")) & folder.startswith(prefix), F.substring(folder, F.lit(len(prefix) + 1), F.length(folder)))
    named = runs.withColumn("path_recipe", run_names.without_size(model))
    if names:
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        named = named.withColumn("data", F.try_element_at(table, F.col("path_recipe")))
    return nearest_name(named, F.col(size), EXACT_COUNTS, "params")


def tag_columns(runs: DataFrame, column: str, tags: Sequence[str]) -> DataFrame:
    """One boolean column per tag of a comma-separated text; false for NULL."""
    have = F.transform(F.split(F.coalesce(F.col(column), F.lit("")), ","), lambda t: F.trim(t))
    return runs.select("*", *[F.array_contains(have, t).alias(f"{t}_tag") for t in sorted(tags)])


def distinct_tags(runs: DataFrame, column: str) -> DataFrame:
    return runs.select(F.explode(F.transform(F.split(column, ","), lambda t: F.trim(t))).alias("tag")).distinct()


def metric_documents(runs: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Long metrics (key, name, value) of JSON documents, one column per task.

    Nested objects and ``task_config`` are left out; text that is no JSON object gives
    no rows. Pivot on ``name`` for the wide form.
    """
    parts = None
    for column, task in columns.items():
        doc = F.from_json(F.col(f"`{column}`"), "map<string,string>")
        part = runs.select(F.col(key), F.explode(doc).alias("metric", "value")).where((F.col("metric") != "task_config") & ~F.col("value").startswith("{"))
        part = part.select(key, F.concat(F.lit(f"oe_{task}_"), "metric").alias("name"), "value")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def selected_columns(df: DataFrame, groups: Sequence[Sequence[str]], patterns: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Columns of the groups that exist, in order and once, then those holding a (task, metric) pair of texts."""
    names = [c for group in groups for c in group if c in df.columns]
    names += [c for task, metric in patterns for c in df.columns if task in c and metric in c]
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(names)])


def without_null_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns that must be all NULL; raise if one has a value (runs one query)."""
    have = [c for c in columns if c in df.columns]
    if have:
        counts = df.agg(*[F.count(f"`{c}`").alias(f"c{k}") for k, c in enumerate(have)]).first()
        used = [c for k, c in enumerate(have) if counts[k]]
        if used:
            raise ValueError(f"columns expected to be empty have values: {used}")
    return df.drop(*have)


def inferred_types(df: DataFrame) -> DataFrame:
    """Columns in the narrowest type all their values fit; one profiling pass.

    Text becomes bigint, double or boolean, doubles that are all whole become bigint, arrays, maps
    and structs become JSON text. A column without values keeps its type.
    """
    def profile(c: str, kind: str) -> list[Column]:
        v = F.col(f"`{c}`")
        number = v.try_cast("double") if kind == "string" else F.when(~F.isnan(v.cast("double")), v.cast("double"))
        flag = F.lower(v).isin("true", "false") if kind == "string" else F.lit(False)
        return [F.count(v) if kind == "string" else F.count(number), F.count_if((number == F.floor(number)) & (F.abs(number) < 2**53)), F.count(number), F.count_if(flag)]

    profiled = [(n, t) for n, t in df.dtypes if t in ("string", "double", "float")]
    row = df.agg(F.lit(0).alias("none"), *[x.alias(f"{n}/{j}") for n, t in profiled for j, x in enumerate(profile(n, t))]).first()

    def typed(name: str, kind: str) -> Column:
        v = F.col(f"`{name}`")
        if kind.startswith(("array", "map", "struct")):
            return F.to_json(v)
        if (name, kind) not in profiled:
            return v
        n, whole, number, flag = (row[f"{name}/{j}"] for j in range(4))
        if n and whole == n:
            # a NaN is no value
            return F.when(~F.isnan(v.cast("double")), v.cast("double").cast("bigint"))
        if kind != "string" or not n:
            return v
        return v.cast("double") if number == n else v.cast("boolean") if flag == n else v

    return df.select(*[typed(n, t).alias(n) for n, t in df.dtypes])


def unequal_columns(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(left, right, differing): rows where two columns that must match both have values and differ."""
    counts = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.count_if(F.col(a) != F.col(b)).alias("differing")) for a, b in pairs]
    return df.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def run_dynamics(history: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run, ordered by step: ends and extremes of steps, rates, losses, tokens and epochs present."""
    def series(column: str) -> tuple[Column, Column]:
        v = F.when(~F.isnan(F.col(column).cast("double")), F.col(column))
        return v, F.when(v.isNotNull(), F.struct("step", "_tie"))
    aggregates = [F.count(F.lit(1)).alias("step_count"), F.max("step").alias("max_step"), F.min("step").alias("min_step")]
    if "learning_rate" in history.columns:
        v, at = series("learning_rate")
        aggregates += [F.min_by(v, at).alias("initial_lr"), F.max(v).alias("max_lr"), F.max_by(v, at).alias("final_lr")]
    if "train_loss" in history.columns:
        v, at = series("train_loss")
        aggregates += [F.min_by(v, at).alias("initial_train_loss"), F.max_by(v, at).alias("final_train_loss"), F.min(v).alias("min_train_loss"), F.max(v).alias("max_train_loss"), F.when(F.count(v) > 1, F.min_by(v, at) - F.max_by(v, at)).alias("loss_improvement")]
    if "total_tokens" in history.columns:
        aggregates += [F.max("total_tokens").alias("max_tokens"), F.min("total_tokens").alias("min_tokens")]
    if "epoch" in history.columns:
        aggregates += [F.max("epoch").alias("max_epoch")]
    tie = F.struct(*[c for c in history.columns if c not in (key, "step")])
    return history.withColumn("_tie", F.hash(tie)).groupBy(key).agg(*aggregates)


def joined_history(runs: DataFrame, history: DataFrame, key: str = "run_id") -> DataFrame:
    """History rows with their run's columns; names both have get a ``_run`` suffix."""
    clash = [c for c in runs.columns if c in history.columns and c != key]
    return history.join(runs.withColumnsRenamed({c: f"{c}_run" for c in clash}), key)


# Groups of run columns that are end-of-run values and get a suffix, and the setting that shares its name with a logged value.
SUMMARY_GROUPS = ("x_axis", "summary_metrics", "dpo_eval")
SUMMARY_SUFFIX, SETTING_SUFFIX, LOGGED_SETTINGS = "_summary", "_hpm", ("learning_rate",)


def rebuilt_runs(runs: DataFrame, groups: Mapping[str, Sequence[str]], *, key: str = "run_id", tags: str | None = None, tag_names: Sequence[str] = (), documents: Mapping[str, str] | None = None, metrics: Sequence[str] = ()) -> DataFrame:
    """The wide run row: columns of the groups that exist, in order, with the suffixes of their groups.

    ``tags`` names a comma-separated column that becomes a column per tag of ``tag_names``; ``documents`` maps
    JSON columns to tasks, of which the ``metrics`` (``oe_task_name``) become columns of text.
    """
    shown: dict[str, Column] = {}
    for group, columns in groups.items():
        for c in columns:
            if c in runs.columns:
                suffix = SUMMARY_SUFFIX if group in SUMMARY_GROUPS else SETTING_SUFFIX if c in LOGGED_SETTINGS else ""
                shown[c + suffix] = F.col(f"`{c}`")
    wide = tag_columns(runs, tags, tag_names) if tags else runs
    out = wide.select(*[c.alias(n) for n, c in shown.items()], *[F.col(f"`{t}_tag`") for t in sorted(tag_names)] if tags else [])
    if documents and metrics:
        found = metric_documents(runs, key, documents).groupBy(key).pivot("name", list(metrics)).agg(F.max("value"))
        out = out.join(found, key, "left")
    return out


def last_evaluated(evaluations: DataFrame, model: Sequence[str], step: str = "step") -> DataFrame:
    """The last step of each model that was evaluated: one combinable maximum."""
    return evaluations.groupBy(*model).agg(F.max(step).alias("last_evaluated_step"))


def final_steps(evidence: DataFrame) -> DataFrame:
    """Chosen final step per model: the authors' list first, then the paper's table.

    ``evidence``: model, listed_step, paper_step, last_evaluated_step, branch_steps.
    ``valid`` is false if no source branch has the step; ``disagreements`` names the
    evidence that says otherwise.
    """
    step = F.coalesce("listed_step", "paper_step")
    differing = F.array(
        F.when(F.col("paper_step") != step, F.concat(F.lit("paper: "), F.col("paper_step").cast("string"))),
        F.when(~F.col("last_evaluated_step").eqNullSafe(step), F.concat(F.lit("evaluations: "), F.coalesce(F.col("last_evaluated_step").cast("string"), F.lit("none")))),
    )
    return evidence.select(
        "model", step.alias("step"), F.when(F.col("listed_step").isNotNull(), "list").otherwise("paper").alias("basis"), F.filter(differing, lambda d: d.isNotNull()).alias("disagreements"),
        (step >= F.col("paper_step")).alias("run_completed"), F.coalesce(F.array_contains("branch_steps", step), F.lit(False)).alias("valid"),
    )

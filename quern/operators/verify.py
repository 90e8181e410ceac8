"""Verification: outputs against raw sources, copies against each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import finite_double, whole_number
from quern.functions.scalar import close_to, off_schedule
from quern.operators.relational import multiset_changes
from quern.operators.schedule import FLOPS_PER_TOKEN_PER_PARAMETER, schedule_frame
from quern.operators.validate import ViolationError


def raw_contradictions(raw: DataFrame) -> DataFrame:
    """Counters over raw text rows (params, step, tokens, compute) against the schedule.

    Compute is compared with the exact and with the nominal parameter count; the
    first is a diagnostic, because early files used nominal counts.
    """
    schedule = F.broadcast(schedule_frame(raw.sparkSession).select("params", "tokens_per_step", "exact_parameter_count", "nominal_parameter_count"))
    read = raw.select(F.col("params"), whole_number(F.col("step")).alias("step"), whole_number(F.col("tokens")).alias("tokens"), finite_double(F.col("compute")).alias("compute"))
    joined = read.join(schedule, "params", "left")
    per = F.col("step").cast("double") * F.col("tokens_per_step")
    miss = lambda count: F.col("compute").isNotNull() & off_schedule(F.col("compute"), per * F.col(count) * FLOPS_PER_TOKEN_PER_PARAMETER)
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("tokens_per_step").isNull()).alias("unknown_sizes"), F.count_if(F.col("step").isNull() | (F.col("step") < 0)).alias("bad_steps"),
        F.count("tokens").alias("tokens_present"), F.count_if(F.col("tokens") != F.col("step") * F.col("tokens_per_step")).alias("tokens_mismatches"),
        F.count("compute").alias("compute_present"), F.count_if(miss("exact_parameter_count")).alias("exact_compute_mismatches"), F.count_if(miss("nominal_parameter_count")).alias("nominal_compute_mismatches"),
    )


def cross_source_parity(left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Per field, over keys on both sides: compared rows and disagreements (NaN and NULL agree)."""
    a = left.select(*key, F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias("a"))
    b = right.select(*key, F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias("b"))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("x"), F.col(f"b.{f}").alias("y")) for f in fields]))
    return a.join(b, list(key)).select(cells.alias("c")).groupBy("c.field").agg(F.count(F.lit(1)).alias("compared"), F.count_if(~close_to(F.col("c.x"), F.col("c.y"), 0.0, tolerance)).alias("disagreements"))


def reconstructed_metrics(tasks: DataFrame, instances: DataFrame, key: Sequence[str], metrics: Sequence[str], relative: float = 1e-5, absolute: float = 1e-8) -> DataFrame:
    """Stored task metrics against the means of their instances.

    ``primary_score`` is compared with the mean of the column that ``primary_metric``
    names; a name without a column is skipped. One row per compared cell.
    """
    value = {m: F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")) for m in metrics}
    means = instances.groupBy(*key).agg(*[F.avg(v).alias(f"_m_{m}") for m, v in value.items()])
    joined = tasks.join(means, list(key))
    named = None
    for m in metrics:
        named = F.when(F.col("primary_metric") == m, F.col(f"_m_{m}")) if named is None else named.when(F.col("primary_metric") == m, F.col(f"_m_{m}"))
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("stored"), F.col(f"_m_{m}").alias("rebuilt")) for m in metrics if m in tasks.columns]
    if {"primary_metric", "primary_score"} <= set(tasks.columns):
        cells.append(F.when(F.col("primary_metric").isin(*metrics), F.struct(F.lit("primary_score").alias("metric"), F.col("primary_score").cast("double").alias("stored"), named.alias("rebuilt"))))
    flat = joined.select(*key, F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select(*key, "c.*")
    return flat.withColumn("agrees", close_to(F.col("stored"), F.col("rebuilt"), relative, absolute))


def declared_counts(parents: DataFrame, children: DataFrame, key: Sequence[str], declared: str) -> DataFrame:
    """Parents whose declared number of children is not the real one."""
    have = children.groupBy(*key).agg(F.count(F.lit(1)).alias("actual"))
    joined = parents.join(have, list(key), "left").select(*key, F.col(declared).alias("declared"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return joined.where(~F.col("declared").cast("bigint").eqNullSafe(F.col("actual")))


def outcomes(counters: DataFrame, failing: Sequence[str], diagnostic: Sequence[str] = ()) -> DataFrame:
    """(check, count, status): a positive counter fails, or is only a diagnostic."""
    entries = [F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("count"), F.lit(c in diagnostic).alias("d")) for c in [*failing, *diagnostic]]
    flat = counters.select(F.explode(F.array(*entries)).alias("e")).select("e.check", "e.count", "e.d")
    return flat.select("check", "count", F.when(F.col("count") == 0, "PASS").when(F.col("d"), "DIAGNOSTIC").otherwise("FAIL").alias("status"))


def require_passed(report: DataFrame) -> None:
    bad = report.where("status = 'FAIL'").collect()  # one row per check
    if bad:
        raise ViolationError("; ".join(f"{r['check']}: {r['count']}" for r in bad))


def preserved(sources: Mapping[str, DataFrame], output: DataFrame, unit: str = "source_unit") -> DataFrame:
    """Multiset changes between each source and its rows in a consolidated output.

    Rows of units that are no source are reported too, so nothing extra can hide.
    """
    names = [c for c in output.columns if c != unit]
    before = None
    for name, df in sources.items():
        part = df.select(F.lit(name).alias(unit), *names)
        before = part if before is None else before.unionByName(part)
    return multiset_changes(before, output.select(unit, *names))


def consolidated(sources: Mapping[str, DataFrame], unit: str = "source_unit") -> DataFrame:
    """All sources as one table with their unit; columns a source lacks are NULL."""
    out = None
    for name, df in sources.items():
        part = df.withColumn(unit, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out

"""Aggregates with explicit rules for missing values, ties and completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict_mean(value: Column, expected: int) -> Column:
    """Mean of exactly ``expected`` values, else NULL."""
    return F.when(F.count(value) == expected, F.avg(value))


def lenient_mean(value: Column) -> Column:
    """Mean of the present values, NULL if there are none; NaN is not present."""
    return F.avg(F.when(~F.isnan(value), value))


def distinct_tuples(*columns: str) -> Column:
    """Distinct tuples including those with NULL members."""
    return F.count_distinct(F.struct(*columns))


def column_coverage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: share of rows with a value, distinct values, and its class.

    ``kind`` is all_null, constant, constant_or_null or other; one pass over the table.
    """
    names = list(columns or df.columns)
    stats = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n_{k}").alias("present"), F.col(f"d_{k}").alias("distinct_values"), F.col("n").alias("n_rows"))
        for k, c in enumerate(names)
    ]))
    totals = df.agg(F.count(F.lit(1)).alias("n"), *[x for k, c in enumerate(names) for x in (F.count(c).alias(f"n_{k}"), F.count_distinct(c).alias(f"d_{k}"))])
    kind = F.when(F.col("present") == 0, "all_null").when(F.col("distinct_values") > 1, "other").when(F.col("present") < F.col("n_rows"), "constant_or_null").otherwise("constant")
    return totals.select(stats.alias("s")).select("s.*").withColumn("coverage", F.try_divide("present", "n_rows")).withColumn("kind", kind)


def first_last(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, prefix: str) -> DataFrame:
    """First, last, least and greatest present value per key in order, and the improvement (first - last; NULL for one value)."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    place = F.when(v.isNotNull(), F.struct(*order))
    return df.groupBy(*key).agg(
        F.min_by(v, place).alias(f"{prefix}_first"), F.max_by(v, place).alias(f"{prefix}_last"), F.min(v).alias(f"{prefix}_min"), F.max(v).alias(f"{prefix}_max"),
        F.when(F.count(v) > 1, F.min_by(v, place) - F.max_by(v, place)).alias(f"{prefix}_improvement"),
    )


def best_first(label: Column, value: Column, tie: Column) -> Column:
    """Label of the greatest value; the least tie key on ties; NaN and NULL never win."""
    v = F.when(~F.isnan(value), value)
    return F.min_by(label, F.when(v.isNotNull(), F.struct(-v, tie)))


def guarded_slope(y: Column, x: Column) -> tuple[Column, Column]:
    """(slope, r squared): NULL slope below two points or for constant x, NULL r squared also for constant y."""
    varies_x = F.max(F.when(y.isNotNull(), x)) > F.min(F.when(y.isNotNull(), x))
    varies_y = F.max(F.when(x.isNotNull(), y)) > F.min(F.when(x.isNotNull(), y))
    return F.when(varies_x, F.regr_slope(y, x)), F.when(varies_x & varies_y, F.regr_r2(y, x))


def complete_cells(df: DataFrame, key: Sequence[str], members: dict[str, int], value: str) -> DataFrame:
    """Per key: whether every combination of members is present once and finite.

    ``members`` gives the expected number of distinct values of each member column.
    """
    finite = F.coalesce(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.lit(False))
    wanted = 1
    for n in members.values():
        wanted *= n
    return df.groupBy(*key).agg(
        F.count_if(finite).alias("n_cells"), F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(m).alias(f"n_{m}") for m in members],
    ).withColumn("available", (F.col("n_cells") == wanted) & (F.col("n_rows") == wanted) & _all(F.col(f"n_{m}") == n for m, n in members.items()))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def paired_agreement(ours: Column, theirs: Column) -> list[Column]:
    """Agreement share, mean and largest absolute difference of two columns."""
    gap = F.abs(ours - theirs)
    return [F.avg((ours == theirs).cast("double")).alias("agreement"), F.avg(gap).alias("mean_abs_diff"), F.max(gap).alias("max_abs_diff")]

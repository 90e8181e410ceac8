"""Diagnostics over a table of decision accuracies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.aggregates import best_first, guarded_slope
from quern.operators.relational import latest_at_or_before

_KEY = ("approach", "params", "step", "task")


def by_approach(accuracies: DataFrame) -> DataFrame:
    """The per-seed and the aggregate accuracy as rows of two approaches."""
    fixed = [c for c in accuracies.columns if c not in ("decision_accuracy", "aggregate_decision_accuracy", "accuracy_std")]
    both = F.array(F.struct(F.lit("per_seed").alias("approach"), F.col("decision_accuracy").alias("accuracy")), F.struct(F.lit("aggregate").alias("approach"), F.col("aggregate_decision_accuracy").alias("accuracy")))
    return accuracies.select(*fixed, F.explode(both).alias("a")).select("a.approach", *fixed, F.col("a.accuracy").alias("decision_accuracy"))


def curve_summary(rows: DataFrame) -> DataFrame:
    """Accuracy against log10 compute ratio per approach, task, metric and size: fit, decreases, ends and top."""
    keys = ["approach", "task", "metric", "params"]
    used = rows.where("available").withColumn("x", F.log10("compute_ratio"))
    before = F.lag("decision_accuracy").over(Window.partitionBy(*keys).orderBy("compute", "step"))
    slope, r2 = guarded_slope(F.col("decision_accuracy"), F.col("x"))
    place = F.struct("compute", "step")
    return used.withColumn("fell", (F.col("decision_accuracy") < before).cast("int")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("checkpoints"), slope.alias("log10_compute_slope"), r2.alias("r_squared"), F.coalesce(F.sum("fell"), F.lit(0)).alias("adjacent_decreases"),
        F.min_by("decision_accuracy", place).alias("first_accuracy"), F.max_by("decision_accuracy", place).alias("last_accuracy"), F.max("decision_accuracy").alias("max_accuracy"),
    )


def proxy_comparisons(rows: DataFrame, baseline: str) -> DataFrame:
    """Every metric's accuracy beside the baseline metric's at the same checkpoint (one window, no self-join)."""
    own = F.max(F.when(F.col("metric") == baseline, F.col("decision_accuracy"))).over(Window.partitionBy(*_KEY))
    compared = rows.where("available").withColumn("primary_accuracy", own)
    return compared.select(*_KEY, "metric", "compute_ratio", "decision_accuracy", "primary_accuracy", (F.col("decision_accuracy") - F.col("primary_accuracy")).alias("advantage_over_primary"))


def recipe_crossovers(evaluations: DataFrame, n_recipes: int) -> DataFrame:
    """Strict reversals of recipe order between adjacent completed sizes, per task.

    Seeds are averaged; sizes are ordered by compute; ties are no reversals.
    ``complete`` is false where a side lacks recipes or scores.
    """
    done = evaluations.where("step >= total_steps")
    score = F.when(~F.isnan("score"), F.col("score"))
    means = done.groupBy("task", "params", "compute", "recipe").agg(F.avg(score).alias("score"))
    sizes = means.groupBy("task", "params", "compute").agg(F.count("score").alias("n"), F.sort_array(F.collect_list(F.struct("recipe", "score"))).alias("scores"))
    order = Window.partitionBy("task").orderBy("compute", "params")
    pairs = sizes.select(
        "task", F.lag("params").over(order).alias("smaller_size"), F.col("params").alias("larger_size"), F.lag("compute").over(order).alias("smaller_compute"), F.col("compute").alias("larger_compute"),
        F.lag("scores").over(order).alias("a"), F.col("scores").alias("b"), ((F.lag("n").over(order) == n_recipes) & (F.col("n") == n_recipes)).alias("complete"),
    ).where("smaller_size IS NOT NULL")
    both = F.arrays_zip("a", "b")
    flips = F.aggregate(
        F.transform(both, lambda x, i: F.aggregate(F.slice(both, i + 2, F.size(both)), F.lit(0), lambda acc, y: acc + F.when(F.signum(x["a"]["score"] - y["a"]["score"]) * F.signum(x["b"]["score"] - y["b"]["score"]) < 0, 1).otherwise(0))),
        F.lit(0),
        lambda acc, n: acc + n,
    )
    return pairs.select("task", "smaller_size", "larger_size", "smaller_compute", "larger_compute", F.when(F.col("complete"), F.lit(n_recipes * (n_recipes - 1) // 2)).alias("pair_count"), F.when(F.col("complete"), flips).alias("strict_crossovers"), "complete")


def matched_compute(rows: DataFrame, baseline: str, tolerance: float) -> DataFrame:
    """Completed checkpoints against intermediate ones of other sizes at comparable compute.

    ``rows`` is ``by_approach`` output with ``schedule_complete``. For every completed
    endpoint and other size the checkpoint with the greatest compute within the budget
    is chosen on compute alone; it counts if it is scored and not itself complete.
    """
    sizes = rows.groupBy().agg(F.sort_array(F.collect_set("params")).alias("sizes"))  # the closed list of sizes
    primary = rows.where(F.col("available") & (F.col("metric") == baseline))
    ends = primary.where("schedule_complete").crossJoin(F.broadcast(sizes)).select(
        "approach", "task", F.col("params").alias("final_size"), F.col("step").alias("final_step"), F.col("compute").alias("final_compute"), F.col("decision_accuracy").alias("final_accuracy"),
        F.explode(F.filter("sizes", lambda s: s != F.col("params"))).alias("params"),
    )
    checkpoints = rows.select("params", "step", "compute").distinct()
    chosen = latest_at_or_before(ends, checkpoints, ["params"], F.col("final_compute"), F.col("compute"), F.col("step"), tolerance).where("match_value IS NOT NULL")
    other = primary.where(~F.col("schedule_complete")).select("approach", "task", "params", F.col("step").alias("match_value"), F.col("decision_accuracy").alias("other_accuracy"), F.col("compute").alias("other_compute"))
    joined = chosen.join(other, ["approach", "task", "params", "match_value"])
    return joined.select(
        "approach", "task", "final_size", "final_step", F.col("params").alias("intermediate_size"), F.col("match_value").alias("intermediate_step"),
        (1 - F.col("other_compute") / F.col("final_compute")).alias("relative_compute_gap"), (F.col("other_accuracy") - F.col("final_accuracy")).alias("accuracy_difference"),
    )


def select_evidence(rows: DataFrame, *, equal: Mapping[str, Sequence[object]] | None = None, at_least: Mapping[str, float] | None = None, at_most: Mapping[str, float] | None = None) -> DataFrame:
    """Rows that meet every given restriction; an empty list restricts nothing.

    Where there is an ``available`` column, unavailable rows go first.
    """
    if "available" in rows.columns:
        rows = rows.where("available")
    for column, values in (equal or {}).items():
        if values and column in rows.columns:
            rows = rows.where(F.col(column).isin(*values))
    for column, bound in (at_least or {}).items():
        rows = rows.where(F.col(column) >= bound)
    for column, bound in (at_most or {}).items():
        rows = rows.where(F.col(column) <= bound)
    return rows


class Between(NamedTuple):
    """Values from ``low`` to ``high``, both included; a plain list names single values."""

    low: float
    high: float


def claim_evidence(rows: DataFrame, row_id: str, claims: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """(claim_id, task, row_ids, best_row): the rows behind each claim and the best of them.

    Rows are linked by a literal array of matching claims, so the table is read once
    for all claims. ``row_ids`` of a claim is bounded by the measurement grid.
    """
    wanted = F.array(*[F.when(_meets(scope), F.lit(name)) for name, scope in claims.items()])
    linked = rows.where("available").select("*", F.explode(F.filter(wanted, lambda c: c.isNotNull())).alias("claim_id"))
    return linked.groupBy("claim_id", "task").agg(F.sort_array(F.collect_list(row_id)).alias("row_ids"), best_first(F.col(row_id), F.col("decision_accuracy"), F.col(row_id)).alias("best_row"))


def _meets(scope: Mapping[str, object]) -> Column:
    out = F.lit(True)
    for column, wanted in scope.items():
        if isinstance(wanted, Between):
            out = out & F.col(column).between(*wanted)
        elif isinstance(wanted, list | tuple):
            out = out & F.col(column).isin(*wanted)
        else:
            out = out & (F.col(column) == wanted)
    return out

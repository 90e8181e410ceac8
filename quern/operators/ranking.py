"""Ranking recipes from small experiments and scoring the decisions they imply.

Scores are kept in long form: (params, step, compute, total_steps, task, metric,
recipe, seed, score). All checkpoints, tasks and metrics are judged in one plan.
Pairs of recipes are never emitted as rows: the scores of a checkpoint are folded
into one sorted array of at most as many entries as there are recipes (the
closed catalogue), and the pairs are counted inside the array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.relational import latest_at_or_before
from quern.operators.validate import ViolationError

CELL = ("params", "step", "task", "metric")


def _is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def observed_checkpoints(evaluations: DataFrame) -> DataFrame:
    """(params, step, compute, total_steps, schedule_complete, consistent), one row per checkpoint.

    ``consistent`` is false when rows of one checkpoint disagree on compute or
    total steps (NULL counts as a value); the least values are shown then.
    """
    meta = F.struct("compute", "total_steps")
    grouped = evaluations.groupBy("params", "step").agg(F.min("compute").alias("compute"), F.min("total_steps").alias("total_steps"), F.count_distinct(meta).alias("n_meta"))
    return grouped.select("params", "step", "compute", "total_steps", (F.col("step") >= F.col("total_steps")).alias("schedule_complete"), (F.col("n_meta") == 1).alias("consistent"))


def score_cells(evaluations: DataFrame, n_recipes: int, n_seeds: int, by: Sequence[str] = CELL) -> DataFrame:
    """Per checkpoint, task and metric: sorted score arrays and whether they are complete.

    ``available`` needs every seed to cover every recipe once with a finite score and
    one non-negative compute; otherwise ``reason`` says what is missing first.
    ``means`` holds (recipe, seed mean) by recipe, ``seeds`` one array of scores
    per seed, both in recipe order.
    """
    # One row per recipe first, combined map-side: repeated rows of a hot cell never
    # meet in an array, which holds at most as many entries as there are recipes.
    per_recipe = evaluations.groupBy(*by, "seed", "recipe").agg(
        F.count(F.lit(1)).alias("k"), F.count_if(_is_finite(F.col("score"))).alias("k_finite"), F.min("score").alias("score"), F.min("compute").alias("low"), F.max("compute").alias("high"),
    )
    per_seed = per_recipe.groupBy(*by, "seed").agg(
        F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_recipes"), F.sum("k_finite").alias("n_finite"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_list(F.struct("recipe", "score"))).alias("scores"),
    )
    full = (F.col("n") == n_recipes) & (F.col("n_recipes") == n_recipes)
    cells = per_seed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_seeds"), F.count_if(full).alias("n_full"), F.sum(F.col("n") - F.col("n_finite")).alias("n_bad"),
        F.min("low").alias("compute"), F.max("high").alias("high"),
        F.sort_array(F.collect_list(F.struct("seed", "scores"))).alias("by_seed"),
    )
    reason = (
        F.when(F.col("n_seeds") != n_seeds, "missing seeds")
        .when(F.col("n_full") != n_seeds, "missing recipes")
        .when(F.col("n_bad") > 0, "score not finite")
        .when(F.col("compute").isNull() | (F.col("compute") != F.col("high")) | (F.col("compute") < 0), "compute not unique")
        .otherwise("")
    )
    judged = cells.withColumn("reason", reason).withColumn("available", F.col("reason") == "")
    width = F.col("by_seed")[0]["scores"]
    mean = F.transform(width, lambda s, i: F.struct(s["recipe"].alias("recipe"), (F.aggregate("by_seed", F.lit(0.0), lambda acc, x: acc + x["scores"][i]["score"]) / n_seeds).alias("score")))
    return judged.select(
        *by, "compute", "available", "reason",
        F.when(F.col("available"), mean).alias("means"),
        F.when(F.col("available"), F.transform("by_seed", lambda x: F.struct(x["seed"].alias("seed"), x["scores"].alias("scores")))).alias("seeds"),
    )


def pair_agreement(left: Column, right: Column, left_up: bool = True, right_up: bool = True) -> Column:
    """Share of unordered recipe pairs that both score arrays order alike; ties agree only with ties.

    Both arrays hold structs with ``score``, in the same recipe order. NULL below two recipes.
    """
    sign = lambda a, b, up: F.signum(a["score"] - b["score"]) * (1 if up else -1)
    both = F.arrays_zip(left.alias("l"), right.alias("r"))
    same = F.aggregate(
        F.transform(both, lambda x, i: F.aggregate(F.slice(both, i + 2, F.size(both)), F.lit(0), lambda acc, y: acc + F.when(sign(x["l"], y["l"], left_up) == sign(x["r"], y["r"], right_up), 1).otherwise(0))),
        F.lit(0),
        lambda acc, n: acc + n,
    )
    n = F.size(left)
    return F.when(n > 1, same / (n * (n - 1) / 2))


def decision_accuracies(evaluations: DataFrame, target_size: str, target_step: int, n_recipes: int, n_seeds: int, target_metric: str | None = None, lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Every checkpoint's decision accuracy about the target ranking, in one plan.

    The target ranks recipes by their seed mean. ``decision_accuracy`` averages over
    predictor seeds (``accuracy_std`` is the population deviation);
    ``aggregate_decision_accuracy`` ranks the predictor's seed means. Only
    checkpoints with positive compute up to the target's take part; cells that
    cannot be scored stay, with ``available`` false and a reason.
    """
    cells = score_cells(evaluations, n_recipes, n_seeds)
    at_target = (F.col("params") == target_size) & (F.col("step") == target_step)
    target = cells.where(at_target & (F.col("compute") > 0))
    if target_metric is not None:
        target = target.where(F.col("metric") == target_metric)
    keys = ["task"] if target_metric is not None else ["task", "metric"]
    target = target.select(*keys, F.col("means").alias("target_means"), F.col("compute").alias("target_compute"), F.col("available").alias("target_available"), F.col("reason").alias("target_reason"), *([F.col("metric").alias("target_metric")] if target_metric is not None else []))
    joined = cells.join(target, keys).where((F.col("compute") > 0) & (F.col("compute") <= F.col("target_compute")))
    names = joined.select("*", F.col("metric" if target_metric is None else "target_metric").alias("_tm"))

    def agreement(scores: Column) -> Column:
        cases = None
        for p_up in (True, False):
            for t_up in (True, False):
                fits = F.col("metric").isin(*lower_is_better) if lower_is_better else F.lit(False)
                aims = F.col("_tm").isin(*lower_is_better) if lower_is_better else F.lit(False)
                when = (~fits if p_up else fits) & (~aims if t_up else aims)
                value = pair_agreement(scores, F.col("target_means"), p_up, t_up)
                cases = F.when(when, value) if cases is None else cases.when(when, value)
        return cases if lower_is_better else pair_agreement(scores, F.col("target_means"))

    usable = F.col("available") & F.col("target_available")
    scored = names.withColumn("accuracies", F.when(usable, F.transform("seeds", lambda s: agreement(s["scores"])))).withColumn("aggregate_decision_accuracy", F.when(usable, agreement(F.col("means"))))
    mean = F.aggregate("accuracies", F.lit(0.0), lambda a, x: a + x) / n_seeds
    scored = scored.withColumn("decision_accuracy", mean)
    spread = F.sqrt(F.aggregate("accuracies", F.lit(0.0), lambda a, x: a + (x - F.col("decision_accuracy")) * (x - F.col("decision_accuracy"))) / n_seeds)
    return scored.select(
        *CELL, "compute", "target_compute", (F.col("compute") / F.col("target_compute")).alias("compute_ratio"), usable.alias("available"),
        F.when(~F.col("available"), F.col("reason")).when(~F.col("target_available"), F.concat(F.lit("target: "), "target_reason")).otherwise("").alias("reason"),
        "decision_accuracy", spread.alias("accuracy_std"), "aggregate_decision_accuracy",
    )


def budget_accuracies(accuracies: DataFrame, sizes: DataFrame, ratios: Sequence[float], n_seeds: int, tolerance: float | None = None) -> DataFrame:
    """Accuracy at compute budgets: the largest checkpoint of a size within each budget.

    The checkpoint is chosen on compute alone; if its scores are missing there is no
    fallback. ``sizes`` has (params, task, metric, target_compute).
    """
    from quern.operators.relational import grid

    asked = grid(sizes, requested_ratio=list(ratios)).withColumn("requested_compute", F.col("requested_ratio") * F.col("target_compute"))
    checkpoints = accuracies.select("params", "compute", "step").distinct()
    chosen = latest_at_or_before(asked, checkpoints, ["params"], F.col("requested_compute"), F.col("compute"), F.col("step"), tolerance)
    found = accuracies.select(*CELL, "compute", F.col("available").alias("scored"), "reason", "decision_accuracy", "aggregate_decision_accuracy").withColumnRenamed("step", "match_value")
    joined = chosen.join(found.drop("compute"), ["params", "task", "metric", "match_value"], "left")
    got = F.coalesce("scored", F.lit(False))
    return joined.select(
        "params", "task", "metric", "requested_ratio", "requested_compute", got.alias("available"),
        F.when(F.col("match_value").isNull(), "no checkpoint within budget").when(F.col("scored").isNull(), "no scores").otherwise(F.col("reason")).alias("reason"),
        F.when(got, F.col("match_value")).alias("step"), F.when(got, F.col("match_at") / F.col("target_compute")).alias("actual_ratio"),
        F.when(got, 1 - F.col("match_at") / F.col("requested_compute")).alias("undershoot"), F.when(got, F.col("match_at") * n_seeds).alias("total_predictor_compute_per_recipe"),
        "decision_accuracy", "aggregate_decision_accuracy",
    )


def recipe_summaries(evaluations: DataFrame, ddof: int = 0) -> DataFrame:
    """Mean and deviation over seeds per checkpoint, task, metric and recipe; NULL deviation unless n > ddof."""
    spread = F.stddev_pop("score") if ddof == 0 else F.stddev_samp("score")
    return evaluations.groupBy(*CELL, "recipe").agg(F.count("score").alias("seed_count"), F.avg("score").alias("mean_score"), F.when(F.count("score") > ddof, spread).alias("score_std"))


def noise_and_spread(evaluations: DataFrame, ddof: int = 0) -> DataFrame:
    """Noise (mean over recipes of the deviation over seeds) and spread (deviation over recipes of the seed means)."""
    per_recipe = recipe_summaries(evaluations, ddof)
    spread = F.stddev_pop("mean_score") if ddof == 0 else F.stddev_samp("mean_score")
    return per_recipe.groupBy(*CELL).agg(F.count(F.lit(1)).alias("recipe_count"), F.avg("score_std").alias("noise"), F.when(F.count("mean_score") > ddof, spread).alias("spread"))


def macro_tasks(evaluations: DataFrame, members: Sequence[str], name: str, prefix: bool = False) -> DataFrame:
    """Strict macro average over member tasks, as rows of a new task.

    A cell is NULL unless every member has a value; cells that lack a member task
    altogether have ``n_tasks`` below the number of members. With ``prefix`` the
    members are all tasks that start with ``members[0]``, and ``members[1]`` is
    their expected number.
    """
    fits = F.col("task").startswith(members[0]) if prefix else F.col("task").isin(*members)
    wanted = int(members[1]) if prefix else len(members)
    keys = ["params", "step", "metric", "recipe", "seed"]
    value = F.when(~F.isnan("score"), F.col("score"))
    return (
        evaluations.where(fits).groupBy(*keys)
        .agg(F.min("compute").alias("compute"), F.min("total_steps").alias("total_steps"), F.count_distinct("task").alias("n_tasks"), F.when(F.count(value) == wanted, F.avg(value)).alias("score"))
        .withColumn("task", F.lit(name))
    )


def prediction_errors(rows: DataFrame, key: Sequence[str], predicted: str, observed: str) -> DataFrame:
    """Absolute and relative error per row; relative is NULL where the observed value is 0."""
    absolute = F.abs(F.col(predicted) - F.col(observed))
    return rows.select(*key, F.col(predicted).alias("predicted"), F.col(observed).alias("observed"), absolute.alias("absolute_error"), F.try_divide(absolute, F.abs(F.col(observed))).alias("relative_error"))


def error_summaries(rows: DataFrame, by: Sequence[str], recipe: str, predicted: str, observed: str, max_recipes: int = 1_000) -> DataFrame:
    """Mean errors and the decision accuracy of predicted against observed scores per group.

    Recipes are a closed list and stand once in a group: pairs are counted inside an array, so a group of more
    than ``max_recipes`` raises before any array is built (one query).
    """
    errors = prediction_errors(rows, [*by, recipe], predicted, observed)
    most = errors.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > max_recipes:
        raise ViolationError(f"{most} recipes in a group; at most {max_recipes} can be compared pair by pair")
    grouped = errors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("recipe_count"), F.avg("absolute_error").alias("mean_absolute_error"), F.avg("relative_error").alias("mean_relative_error"), F.count("relative_error").alias("relative_error_count"),
        F.sort_array(F.collect_list(F.struct(F.col(recipe).alias("r"), F.col("predicted").alias("score")))).alias("_p"),
        F.sort_array(F.collect_list(F.struct(F.col(recipe).alias("r"), F.col("observed").alias("score")))).alias("_o"),
    )
    return grouped.withColumn("decision_accuracy", pair_agreement(F.col("_p"), F.col("_o"))).drop("_p", "_o")


def loss_observations(evaluations: DataFrame, losses: DataFrame, loss: str) -> DataFrame:
    """Evaluation rows with the loss of the same (recipe, params, seed, step).

    ``available`` needs a match and finite values; ``compute_conflict`` marks
    matches whose computes differ.
    """
    keys = ["recipe", "params", "seed", "step"]
    right = losses.select(*keys, F.col(loss).alias("loss"), F.col("compute").alias("loss_compute"), F.lit(True).alias("_m"))
    joined = evaluations.join(right, keys, "left")
    matched = F.coalesce("_m", F.lit(False))
    return joined.select(
        *keys, "task", "score", "compute", "loss", "loss_compute", (matched & _is_finite(F.col("score")) & _is_finite(F.col("loss"))).alias("available"),
        (matched & ~F.col("compute").eqNullSafe(F.col("loss_compute"))).alias("compute_conflict"),
    )


def score_measurements(evaluations: DataFrame, accuracies: DataFrame, n_recipes: int, n_seeds: int, ddof: int = 0) -> dict[str, DataFrame]:
    """Raw seed scores, recipe summaries, and noise and spread with accuracies, of complete cells.

    Cells that are not complete stay in ``noise_spread`` with their reason and no values.
    """
    cells = score_cells(evaluations, n_recipes, n_seeds).select(*CELL, "compute", "available", "reason")
    usable = evaluations.join(cells.where("available").select(*CELL), list(CELL), "left_semi")
    noise = noise_and_spread(usable, ddof)
    scored = accuracies.where("available").select(*CELL, "decision_accuracy", "aggregate_decision_accuracy")
    joined = cells.join(noise, list(CELL), "left").join(scored, list(CELL), "left")
    return {
        "recipe_scores": usable.select(*CELL, "compute", "seed", "recipe", "score"),
        "score_summaries": recipe_summaries(usable, ddof),
        "noise_spread": joined.select(*CELL, "compute", "available", "reason", F.lit(n_seeds).alias("seed_count"), F.lit(ddof).alias("ddof"), "noise", "spread", "decision_accuracy", "aggregate_decision_accuracy"),
    }

import datetime as dt

from pyspark.sql import functions as F

from quern.operators.table_diff import diff_task_results, task_findings

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
TASKS = "recipe string, params string, seed_value bigint, step bigint, task string, primary_score double, acc_raw double, acc_per_token double, acc_per_char double, acc_uncond double, no_answer double, loaded_at timestamp"
OLMES = "recipe_name string, params string, seed string, step string, task string, primary_metric double, acc_raw double, acc_per_token double, acc_per_char double, acc_uncond double, no_answer double, loaded_at timestamp"
NAN, NONE = float("nan"), None


def tables(spark, tasks, olmes):
    recipes = spark.createDataFrame([("c4", "C4"), ("falcon", "Falcon")], "recipe string, recipe_name string")
    seeds = spark.createDataFrame([(2, "default"), (4, "large aux 2")], "seed_value bigint, seed string")
    return spark.createDataFrame(tasks, TASKS), spark.createDataFrame(olmes, OLMES), recipes, seeds


def found(spark, tasks, olmes):
    rows = task_findings(diff_task_results(*tables(spark, tasks, olmes))).collect()
    return sorted((r.recipe, r.step, r.task, r.finding) for r in rows)


def test_spelling_recency_missing_and_tolerance(spark):
    tasks = [
        ("c4", "4M", 2, 100, "boolq", 0.5, 0.4, 0.3, NONE, NAN, 0.0, T1),
        ("c4", "4M", 2, 100, "boolq", 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, T0),
        ("falcon", "4M", 4, 7, "piqa", 0.5, NONE, 0.3, 0.2, 0.1, 0.0, T0),
        ("c4", "4M", 2, 200, "boolq", *[0.1] * 6, T0),
    ]
    olmes = [
        (" c4 ", "4M", "Default", "100.0", "BOOLQ", 0.5 + 5e-10, 0.4, 0.3, NAN, NONE, 0.0, T0),
        ("FALCON", " 4m", "large aux 2", " 7 ", "piqa ", 0.5 + 2e-9, 0.1, 0.3, 0.2, NAN, 0.0, T1),
        ("falcon", "4M", "large aux 2", "7.00", "piqa", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, T0),
        ("C4", "4M", "default", "300", "boolq", *[0.1] * 6, T0),
    ]
    assert found(spark, tasks, olmes) == [
        ("c4", 200, "boolq", "missing_in_olmes"),
        ("c4", 300, "boolq", "missing_in_tasks"),
        ("falcon", 7, "piqa", "acc_raw"),
        ("falcon", 7, "piqa", "acc_uncond"),
        ("falcon", 7, "piqa", "primary_score"),
    ]


def test_nulls_in_keys_infinities_and_repeats(spark):
    inf = float("inf")
    tasks = [(NONE, NONE, NONE, NONE, NONE, inf, *[NONE] * 5, NONE)] * 2 + [("c4", "4M", 2, 1, "x", inf, *[NONE] * 5, T0)]
    olmes = [(NONE, NONE, NONE, NONE, NONE, inf, *[NONE] * 5, NONE)] * 2 + [("C4", "4M", "default", "1", "x", -inf, *[NONE] * 5, T0)]
    assert found(spark, tasks, olmes) == [("c4", 1, "x", "primary_score")]


def test_unknown_names_are_missing_on_both_sides(spark):
    row = (0.1,) * 6
    assert found(spark, [("c4", "4M", 2, 1, "x", *row, T0)], [("no such", "4M", "default", "1", "x", *row, T0)]) == [("c4", 1, "x", "missing_in_olmes"), ("no such", 1, "x", "missing_in_tasks")]
    assert [f[3] for f in found(spark, [], [("C4", "4M", "no such", "1x", "x", *row, T0)])] == ["missing_in_tasks"]


def test_empty_sides_and_clashing_columns(spark):
    row = ("c4", "4M", 2, 1, "x", *[0.1] * 6, T0)
    assert found(spark, [], []) == []
    assert [f[3] for f in found(spark, [row, row], [])] == ["missing_in_olmes"]
    tasks, olmes, recipes, seeds = tables(spark, [row], [("C4", "4M", "default", "1", "x", *[0.2] * 6, T0)])
    for name in ("side", "finding", "differences", "r_name", "k_recipe", "v"):
        tasks, olmes = tasks.withColumn(name, F.lit(1)), olmes.withColumn(name, F.lit(2))
    assert task_findings(diff_task_results(tasks, olmes, recipes, seeds)).count() == 6


def test_difference_values(spark):
    row = diff_task_results(*tables(spark, [("c4", "4M", 2, 1, "x", 0.5, *[0.1] * 5, T0)], [("C4", "4M", "default", "1", "x", 0.25, *[0.1] * 5, T0)])).first()
    assert [tuple(d) for d in row.differences] == [("primary_score", 0.5, 0.25)]

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import scalar
from quern.operators import aggregates, diagnostics, preprocess, ranking, relational, runs, schedule, scoring, validate, verify
from quern.plans import reference

NAN, INF = float("nan"), float("inf")


def one(spark, column, schema=None, row=()):
    df = spark.createDataFrame([row], schema) if schema else spark.range(1)
    return df.select(column.alias("v")).first().v


# -- schedules ---------------------------------------------------------------------------


def test_schedule_of_every_size():
    rows = {r["params"]: r for r in schedule.schedule_rows()}
    assert len(rows) == 14 and len(schedule.DETAIL_COLUMNS) == 47
    assert rows["150M"]["batch_size"] == 192 and rows["150M"]["tokens_per_step"] == 192 * 2048
    assert rows["1B"]["total_tokens"] == 100 * 10**9 and rows["4M"]["lr_final"] == 0.01 * rows["4M"]["lr_max"]


def test_learning_rates_against_numeric_sums(spark):
    rows = {r["params"]: r for r in schedule.schedule_rows()}
    points = [(p, s) for p in ("4M", "150M", "1B") for s in (0, 1, 100, rows[p]["warmup_steps"], rows[p]["warmup_steps"] + 1, rows[p]["total_steps"] - 1, rows[p]["total_steps"], rows[p]["total_steps"] + 500)]
    got = {(r.params, r.step): r for r in schedule.enrich(spark.createDataFrame(points, "params string, step bigint")).collect()}
    for p, s in points:
        c = rows[p]
        top, final, warm, decay = c["lr_max"], c["lr_final"], c["warmup_steps"], c["lr_decay_steps"]
        d = min(max(s - warm, 0), decay)
        t = np.arange(d + 1)
        curve = final + 0.5 * (top - final) * (1 + np.cos(np.pi * t / decay))
        total = top * min(s, warm) ** 2 / (2 * warm) + (np.trapezoid(curve, t) if d else 0)
        rate = top * s / warm if s <= warm else final if d >= decay else curve[-1]
        assert math.isclose(got[p, s].cumulative_lr, total, rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(got[p, s].lr_at_step, rate, rel_tol=1e-9, abs_tol=1e-15)
        assert got[p, s].tokens == s * c["tokens_per_step"] and got[p, s].compute == float(s) * c["compute_per_step"]
    with pytest.raises(validate.ViolationError):
        schedule.require_steps(spark.createDataFrame([("4M", -1)], "params string, step bigint"))


def test_schedule_contradictions(spark):
    good = schedule.enrich(spark.createDataFrame([("4M", 10), ("1B", 20)], "params string, step bigint"))
    assert sum(v for k, v in schedule.schedule_contradictions(good, full=True).first().asDict().items() if "mismatch" in k or "unknown" in k) == 0
    bad = good.withColumn("tokens", F.when(F.col("params") == "4M", F.col("tokens") + 1)).withColumn("n_heads", F.lit(3)).withColumn("lr_at_step", F.lit(1.0)).unionByName(good.limit(1).withColumn("params", F.lit("9M")))
    row = schedule.schedule_contradictions(bad, full=True).first()
    assert (row.n_rows, row.unknown_sizes, row.tokens_mismatches, row.detail_mismatches, row.rate_mismatches) == (3, 1, 2, 2, 2)
    raw = spark.createDataFrame([("4M", "10", "655360", "1"), ("4M", "x", "", None), ("9M", "1", None, None)], "params string, step string, tokens string, compute string")
    counters = verify.raw_contradictions(raw).first()
    assert (counters.bad_steps, counters.unknown_sizes, counters.exact_compute_mismatches, counters.n_rows) == (1, 1, 1, 3)
    report = {r.check: r.status for r in verify.outcomes(verify.raw_contradictions(raw), ["bad_steps"], ["exact_compute_mismatches"]).collect()}
    assert report == {"bad_steps": "FAIL", "exact_compute_mismatches": "DIAGNOSTIC"}


# -- ranking ----------------------------------------------------------------------------------

EVAL = "params string, step bigint, compute double, total_steps bigint, task string, metric string, recipe string, seed string, score double"


def evaluations(spark, cells):
    """cells: (params, step, compute, {seed: {recipe: score}})"""
    return spark.createDataFrame([(p, s, float(c), 10, "t", "acc", r, seed, v) for p, s, c, seeds in cells for seed, scores in seeds.items() for r, v in scores.items()], EVAL)


def test_decision_accuracy_by_hand(spark):
    target = {"a": {"x": 3.0, "y": 2.0, "z": 1.0}, "b": {"x": 3.0, "y": 2.0, "z": 1.0}}
    small = {"a": {"x": 3.0, "y": 2.0, "z": 1.0}, "b": {"x": 1.0, "y": 2.0, "z": 2.0}}
    df = evaluations(spark, [("1B", 10, 100, target), ("4M", 5, 20, small), ("6M", 5, 30, {"a": {"x": 1.0, "y": 2.0}, "b": {"x": 1.0, "y": 2.0}}), ("8M", 5, 30, {"a": target["a"]}), ("9M", 5, 500, target), ("2M", 5, 10, {"a": target["a"], "b": target["b"] | {"z": NAN}})])
    got = {r.params: r for r in ranking.decision_accuracies(df, "1B", 10, 3, 2).collect()}
    r = got["4M"]
    # seed b: x<y, x<z, y=z against x>y>z agrees nowhere
    assert (r.decision_accuracy, r.accuracy_std, r.compute_ratio) == (0.5, 0.5, 0.2)
    # means 2, 2, 1.5: x=y disagrees, x>z and y>z agree
    assert math.isclose(r.aggregate_decision_accuracy, 2 / 3)
    assert got["6M"].reason == "missing recipes" and got["8M"].reason == "missing seeds" and got["2M"].reason == "score not finite" and "9M" not in got
    assert got["1B"].decision_accuracy == 1.0
    down = {r.params: r for r in ranking.decision_accuracies(df, "1B", 10, 3, 2, lower_is_better=["acc"]).collect()}
    assert down["4M"].decision_accuracy == 0.5


def test_noise_spread_and_summaries(spark):
    df = evaluations(spark, [("1B", 1, 1, {"a": {"x": 0.0, "y": 2.0}, "b": {"x": 2.0, "y": 4.0}})])
    assert tuple(ranking.noise_and_spread(df).select("noise", "spread").first()) == (1.0, 1.0)
    sample = ranking.noise_and_spread(df, ddof=1).first()
    assert math.isclose(sample.noise, math.sqrt(2)) and math.isclose(sample.spread, math.sqrt(2))
    lone = ranking.recipe_summaries(df.where("seed = 'a'"), ddof=1).first()
    assert lone.score_std is None


def test_checkpoints_budgets_and_matches(spark):
    cells = [("1B", 10, 100, {"a": {"x": 2.0, "y": 1.0}}), ("4M", 5, 20, {"a": {"x": 2.0, "y": 1.0}}), ("4M", 9, 90, {"a": {"x": 1.0, "y": 2.0}}), ("4M", 10, 95, {"a": {"x": 1.0}})]
    df = evaluations(spark, cells)
    seen = {(r.params, r.step): (r.schedule_complete, r.consistent) for r in ranking.observed_checkpoints(df.unionByName(df.where("step = 5").withColumn("compute", F.lit(21.0)))).collect()}
    assert seen == {("1B", 10): (True, True), ("4M", 5): (False, False), ("4M", 9): (False, True), ("4M", 10): (True, True)}
    acc = ranking.decision_accuracies(df, "1B", 10, 2, 1)
    sizes = acc.select("params", "task", "metric", "target_compute").distinct()
    got = {(r.params, r.requested_ratio): r for r in ranking.budget_accuracies(acc, sizes, [0.1, 0.5, 1.0], 3).collect()}
    assert got["4M", 0.1].reason == "no checkpoint within budget" and got["4M", 1.0].reason == "missing recipes"
    r = got["4M", 0.5]
    assert (r.available, r.step, r.actual_ratio, r.undershoot, r.total_predictor_compute_per_recipe, r.decision_accuracy) == (True, 5, 0.2, 0.6, 60.0, 1.0)
    tight = {(r.params, r.requested_ratio): r.reason for r in ranking.budget_accuracies(acc, sizes, [0.5], 3, tolerance=0.3).collect()}
    assert tight["4M", 0.5] == "no checkpoint within budget"
    rows = diagnostics.by_approach(acc).withColumn("schedule_complete", F.col("params") == "1B")
    assert diagnostics.matched_compute(rows, "acc", 0.3).count() == 0  # the best checkpoint in reach has no scores
    curve = {r.params: r for r in diagnostics.curve_summary(rows).where("approach = 'per_seed'").collect()}
    assert (curve["4M"].checkpoints, curve["4M"].adjacent_decreases, curve["4M"].first_accuracy, curve["4M"].last_accuracy) == (2, 1, 1.0, 0.0)
    assert curve["1B"].log10_compute_slope is None and curve["1B"].r_squared is None


def test_crossovers(spark):
    df = evaluations(spark, [("4M", 10, 1, {"a": {"x": 1.0, "y": 2.0, "z": 3.0}}), ("1B", 10, 2, {"a": {"x": 3.0, "y": 2.0, "z": 2.0}}), ("9B", 10, 3, {"a": {"x": 3.0}})])
    got = [tuple(r) for r in diagnostics.recipe_crossovers(df, 3).orderBy("larger_compute").collect()]
    assert got == [("t", "4M", "1B", 1.0, 2.0, 3, 2, True), ("t", "1B", "9B", 2.0, 3.0, None, None, False)]


def test_macro_mean_is_strict(spark):
    df = evaluations(spark, [("1B", 1, 1, {"a": {"x": 1.0}})])
    two = df.unionByName(df.withColumn("task", F.lit("u")).withColumn("score", F.lit(0.5))).unionByName(df.withColumn("task", F.lit("u")).withColumn("recipe", F.lit("y")))
    assert {r.recipe: (r.score, r.n_tasks) for r in ranking.macro_tasks(two, ["t", "u"], "m").collect()} == {"x": (0.75, 2), "y": (None, 1)}
    assert ranking.macro_tasks(two, ["u", "1"], "m", prefix=True).count() == 2


def test_errors_and_losses(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 0.0)], "r string, p double, o double")
    assert [tuple(r)[3:] for r in ranking.prediction_errors(df, ["r"], "p", "o").orderBy("r").collect()] == [(1.0, 0.5), (3.0, None)]
    row = ranking.error_summaries(df.withColumn("g", F.lit(1)), ["g"], "r", "p", "o").first()
    assert (row.recipe_count, row.mean_absolute_error, row.mean_relative_error, row.relative_error_count, row.decision_accuracy) == (2, 2.0, 0.5, 1, 0.0)
    evals = spark.createDataFrame([("r", "4M", 1, 1, "t", 0.5, 9.0), ("r", "4M", 2, 1, "t", NAN, 9.0), ("q", "4M", 1, 1, "t", 0.5, 9.0)], "recipe string, params string, seed int, step int, task string, score double, compute double")
    losses = spark.createDataFrame([("r", "4M", 1, 1, 2.0, 8.0), ("r", "4M", 2, 1, 2.0, 9.0)], "recipe string, params string, seed int, step int, l double, compute double")
    got = sorted((r.recipe, r.seed, r.available, r.compute_conflict) for r in ranking.loss_observations(evals, losses, "l").collect())
    assert got == [("q", 1, False, False), ("r", 1, True, True), ("r", 2, False, False)]


def test_claims(spark):
    rows = spark.createDataFrame([(0, "t", "acc", 0.1, 0.5, True), (1, "t", "acc", 0.2, 0.9, True), (2, "t", "acc", 0.9, 0.9, True), (3, "u", "acc", 0.1, 0.1, False)], "row_id int, task string, metric string, compute_ratio double, decision_accuracy double, available boolean")
    got = {(r.claim_id, r.task): (r.row_ids, r.best_row) for r in diagnostics.claim_evidence(rows, "row_id", {"small": {"compute_ratio": diagnostics.Between(0.0, 0.5)}, "all": {"metric": ["acc"]}}).collect()}
    assert got == {("small", "t"): ([0, 1], 1), ("all", "t"): ([0, 1, 2], 1)}
    assert diagnostics.select_evidence(rows, equal={"task": ["t"], "metric": []}, at_least={"compute_ratio": 0.2}).count() == 2


# -- joins, validation, aggregates ------------------------------------------------------------------


def test_as_of_ties_and_empty(spark):
    left = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 0.5), ("b", 3, 5.0), ("a", 4, None)], "g string, id int, budget double")
    right = spark.createDataFrame([("a", 4.0, 1), ("a", 4.0, 2), ("a", 9.0, 3), ("a", -1.0, 4), ("a", None, 5)], "g string, c double, step int")
    found = {r.id: (r.match_at, r.match_value) for r in relational.latest_at_or_before(left, right, ["g"], F.col("budget"), F.col("c"), F.col("step")).collect()}
    assert found == {1: (4.0, 2), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert relational.latest_at_or_before(left.limit(0), right, ["g"], F.col("budget"), F.col("c"), F.col("step")).count() == 0


def test_as_of_in_stretches(spark):
    """A hot key cut into stretches gives what the whole sort gives, ties and NULLs included."""
    draw = np.random.default_rng(2)
    keys = lambda n: [None if k == 2 else "hot" if k < 8 else f"k{k}" for k in draw.integers(0, 12, n)]
    left = spark.createDataFrame([(g, k, None if k % 50 == 0 else float(b)) for k, (g, b) in enumerate(zip(keys(600), draw.integers(-5, 400, 600)))], "g string, id int, budget double")
    right = spark.createDataFrame([(g, float(c), int(v)) for g, c, v in zip(keys(200), draw.integers(-5, 350, 200), draw.integers(0, 9, 200))], "g string, c double, step bigint")
    find = lambda **o: sorted(map(tuple, relational.latest_at_or_before(left, right, ["g"], F.col("budget"), F.col("c"), F.col("step"), **o).collect()), key=repr)
    assert find(stretch=50) == find() and find(stretch=50, tolerance=0.05) == find(tolerance=0.05)


def test_sets_and_lookups(spark, rows):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (3, "y")], "k int, v string")
    assert rows(relational.multiset_changes(a, b)) == [(1, None, -1), (2, "x", -1), (3, "y", 1)]
    assert relational.require_same_rows(a, a.orderBy(F.desc("k"))) == 3
    with pytest.raises(validate.ViolationError):
        relational.require_same_rows(a, b)
    assert rows(relational.key_sets(a, b, ["v"])) == [("x", True, False), ("y", False, True), (None, True, True)]
    aliases = spark.createDataFrame([("x", "X")], "alias string, official string")
    names = spark.createDataFrame([("x",), ("X",), ("z",)], "n string")
    assert rows(relational.resolved(names, "n", aliases, "o")) == [("X", "X"), ("x", "X"), ("z", None)]
    with pytest.raises(validate.ViolationError):
        relational.require_unique(a, ["k"])


def test_rules(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "z", -1), (2, None, 5)], "n int, c string, v int")
    rules = [validate.outside_domain("c", ["a"]), validate.Rule("negative", F.col("v") < 0)]
    assert [(r.n, r.kind, r.rule_no) for r in validate.violations(df, rules, ["n"]).orderBy("n").collect()] == [(1, "c", 0), (2, "c", 0)]
    with pytest.raises(validate.ViolationError, match="invalid c in table at n=1: 'z'"):
        validate.raise_first(df, rules, ["n"])
    validate.raise_first(df.where("n = 0"), rules, ["n"])
    assert validate.conflicts(spark.createDataFrame([(1, "a", None), (1, "b", 2)], "k int, x string, y int"), ["k"], ["x", "y"]).first().fields == ["x"]


def test_aggregates(spark, rows):
    df = spark.createDataFrame([("a", 1, NAN), ("a", 2, 5.0), ("a", 3, 3.0), ("b", 1, None)], "g string, t int, v double")
    assert rows(aggregates.first_last(df, ["g"], ["t"], "v", "v")) == [("a", 5.0, 3.0, 3.0, 5.0, 2.0), ("b", None, None, None, None, None)]
    assert df.agg(aggregates.lenient_mean(F.col("v"))).first()[0] == 4.0
    assert df.groupBy("g").agg(aggregates.best_first(F.col("t"), F.col("v"), F.col("t")).alias("b")).orderBy("g").first().b == 2
    assert df.agg(aggregates.distinct_tuples("g", "v")).first()[0] == 4
    kinds = {r.column_name: r.kind for r in aggregates.column_coverage(spark.createDataFrame([(1, None, 1, 1), (1, None, None, 2)], "a int, b int, c int, d int")).collect()}
    assert kinds == {"a": "constant", "b": "all_null", "c": "constant_or_null", "d": "other"}
    assert [r.agrees for r in verify.reconstructed_metrics(spark.createDataFrame([("k", 2.0, "m", 2.0)], "k string, m double, primary_metric string, primary_score double"), spark.createDataFrame([("k", 1.0), ("k", 3.0), ("k", NAN)], "k string, m double"), ["k"], ["m"]).collect()] == [True, True]


# -- scalars, scoring, runs -----------------------------------------------------------------------------


def test_scalars(spark):
    assert one(spark, scalar.round_to_multiple(F.lit(80.0), 32)) == 64 and one(spark, scalar.round_to_multiple(F.lit(112.0), 32)) == 128
    assert one(spark, scalar.close_to(F.lit(NAN), F.lit(None).cast("double"))) and not one(spark, scalar.close_to(F.lit(1.0), F.lit(None).cast("double")))
    assert one(spark, scalar.off_schedule(F.lit(1e20), F.lit(1e20 + 1e9))) and not one(spark, scalar.off_schedule(F.lit(1.0), F.lit(1.0000005)))
    assert [one(spark, scalar.finite_metric(F.lit(t))) for t in ("1.5", "NaN", "true", "x")] == [1.5, None, None, None] and one(spark, scalar.finite_metric(F.lit("Infinity"))) == INF
    assert [one(spark, scalar.size_number(F.lit(t))) for t in ("150M", "1B", "42", "x")] == [1.5e8, 1e9, 42.0, None]
    assert [one(spark, scalar.answer_index(F.lit(t))) for t in ("A", "3", "Z", "AB", "")] == [0, 2, None, None, None]
    assert [one(spark, scalar.short_number(F.lit(v))) for v in (1234.0, 3.4e9, 0.5)] == ["1.2k", "3.4B", "0.50"]
    assert one(spark, scalar.text_slice(F.lit("abcdef"), F.lit(1), F.lit(3))) == "bc"
    assert scalar.few_shot_prefix([("q", "a")]) == "Question: q\nAnswer: a\n\n" and scalar.few_shot_prefix([]) == ""


def test_strict_json(spark):
    texts = ['{"b": 1, "a": [1]}', "[1", "NaN", '{"a": 1} x', "3", "null", "true", '"s"', None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", scalar.json_kind(F.col("t")).alias("kind"), scalar.canonical_json(F.col("t")).alias("c")).orderBy("k")
    got = df.collect()
    assert [r.kind for r in got] == ["object", None, None, None, "number", "null", "boolean", "string", None]
    assert got[0].c == '{"a":[1],"b":1}' and got[1].c is None
    doc = F.lit('{"a": 1.5, "n": 3, "s": "x", "z": null, "t": true}')
    leaf = lambda path, kind: tuple(one(spark, scalar.json_leaf(doc, path, kind)))
    assert leaf("$.n", "int64") == (3, True) and leaf("$.a", "int64") == (None, False) and leaf("$.a", "float64") == (1.5, True)
    assert leaf("$.s", "string") == ("x", True) and leaf("$.s", "float64") == (None, False) and leaf("$.z", "bool") == (None, True) and leaf("$.q", "string") == (None, True) and leaf("$.t", "bool") == (True, True)
    assert [tuple(one(spark, scalar.json_id(F.lit(t)))) for t in ('"a"', "7", "null", "1.5")] == [("string", "a"), ("integer", "7"), ("null", None), ("invalid", None)]


def test_choice_rules(spark):
    choices = spark.createDataFrame([(1, k, -12.0, 3, 6, 8, u) for k, u in ((1, -20.0), (0, -20.0), (2, None))], "item int, choice_index int, log_likelihood double, tokens int, chars int, octets int, unconditional double")
    row = scoring.predicted_indexes(scoring.nested_items(choices, ["item"])).first()
    assert [row[f"predicted_{r}"] for r in scalar.RULES] == [0, 0, 0, 0, 0]
    values = {r: one(spark, scalar.rule_value(r, *[F.lit(v) for v in (-12.0, 3, 6, 8, -20.0)])) for r in scalar.RULES}
    assert values == {"raw": -12.0, "per_token": -4.0, "per_char": -2.0, "per_byte": -1.5, "pmi": 8.0}
    assert one(spark, scalar.first_largest(F.array(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)))) == 1
    assert one(spark, scalar.first_smallest(F.array(F.lit(2.0), F.lit(1.0)))) == 1 and one(spark, scalar.first_largest(F.array().cast("array<double>"))) is None
    ours = spark.createDataFrame([("a", 0, *[0] * 5), ("b", 1, *[1] * 5)], "k string, gold_index int, " + ", ".join(f"predicted_{r} int" for r in scalar.RULES)).withColumn("choices", F.array(F.lit(1)))
    theirs = spark.createDataFrame([("a", 0, 1, *[0] * 5), ("b", 1, 1, *[0] * 5), ("c", 1, 1, *[0] * 5)], "k string, label int, n_choices int, " + ", ".join(f"published_{r} int" for r in scalar.RULES))
    compared = scoring.compare_items(ours, theirs, "k")
    assert {tuple(r)[1:5] for r in compared.collect()} == {(2, 0.5, 1.0, 0.5)}
    assert [tuple(r) for r in scoring.item_set_faults(ours, theirs, "k").collect()] == [("c", "published only")]
    assert scoring.accepted(compared, 0.1, {"pmi": 0.4, "raw": 0.6}, 0.2) == {"pmi_agreement": True, "raw_agreement": False, "mean_abs_diff": True}


def test_choices_on_both_sides(spark):
    schema = "item string, choice_index int, log_likelihood double, unconditional double, tokens bigint, context_tokens bigint"
    ours = spark.createDataFrame([("a", 0, -1.0, -2.0, 3, 10), ("a", 1, -2.0, None, 3, 10), ("b", 0, -5.0, -1.0, 2, 7)], schema)
    theirs = spark.createDataFrame([("a", 0, -1.5, -2.0, 3, 10), ("a", 1, -2.0, -1.0, 4, 10), ("b", 1, -5.0, -1.0, 2, 8)], schema)
    row = scoring.choice_differences(ours, theirs, ["item", "choice_index"]).first()
    assert tuple(row) == (2, 1, 1, 0.25, 0.5, 0.0, 0.0, 0.5)
    assert tuple(scoring.context_agreement(ours, theirs, "item").first()) == (2, 0.5)
    assert tuple(scoring.choice_differences(ours.limit(0), theirs.limit(0), ["item", "choice_index"]).first()) == (0, 0, 0, None, None, None, None, None)
    predictions = spark.createDataFrame([(f"k{k}", *[1] * 5, *[0 if k else 1] * 4, None) for k in range(9)], "k string, " + ", ".join(f"{side}_{r} int" for side in ("predicted", "published") for r in scalar.RULES))
    got = {(r.rule, r.k) for r in scoring.mismatches(predictions, "k", 3).collect()}
    assert got == {(r, f"k{k}") for r in scalar.RULES[:4] for k in (1, 2, 3)} | {("pmi", f"k{k}") for k in (0, 1, 2)}
    items = lambda rows: spark.createDataFrame(rows, "k string, gold_index int, label int, n_choices int").withColumn("choices", F.array_repeat(F.lit(1), F.col("n_choices")))
    scoring.require_same_items(items([("a", 0, 0, 2)]), items([("a", 0, 0, 2)]), "k")
    with pytest.raises(validate.ViolationError, match=r"b \(ours only\)"):
        scoring.require_same_items(items([("a", 0, 0, 2), ("b", 0, 0, 2)]), items([("a", 0, 0, 2)]), "k")


def test_run_names(spark):
    names = [
        "250821-101112_dpo_test_60M_x_DD-dolma1_7-150M_main_100Mtx2_--learning_rate=5e-06_--beta=0.10_--epochs=2.0_--mode=fast",
        "2025_08_21-10_11_12_try_one_DD-c4-10M_main_5Mtx3_finetune",
        "2025_08_21-10_11_12_base_Ft_DD-dclm_qc10p-60M-29042-0__100Mt",
        "nothing here",
        "2025_08_21-10_11_12_old_60M_dolma_x",
        "250821-101112_a_Ft_DD-dclm_60M_290_0-1B_x",
        "250821-101112__DD-c4-10M_long_name_5Mtx3_--learning_rate=1_--learning_rate=12345678901234567_--x.y=1_--flag",
        None,
        "",
        "250821-101112_7B_DD--4M_Mtx3__20Mt",
    ]
    got = runs.with_name_parts(spark.createDataFrame([(n,) for n in names], "run_name string")).collect()
    assert [r.run_datetime_rnp for r in got] == ["2025-08-21 10:11:12"] * 3 + [None] + ["2025-08-21 10:11:12"] * 3 + [None, None, "2025-08-21 10:11:12"]
    assert got[0].exp_name_rnp == "dpo_test" and got[1].exp_name_rnp == "try_one" and got[3].exp_name_rnp is None
    assert (got[0].data_rnp, got[0].params_rnp, got[0].checkpoint_rnp, got[0].epochs_rnp, got[0].total_tok_rnp, got[0].method_rnp) == ("dolma1_7", "150M", "main", 2, 100, "dpo")
    assert got[0].options_rnp == {"lr": "5.0E-6", "beta": "0.1", "epochs": "2", "mode": "fast"}
    assert (got[2].data_rnp, got[2].params_rnp, got[2].checkpoint_rnp, got[2].total_tok_rnp) == ("dclm_qc10p", "60M", "29042", 100)
    assert got[1].method_rnp == "finetune" and got[3].options_rnp == {}
    assert (got[4].exp_name_rnp, got[4].data_rnp, got[4].params_rnp) == ("old", None, None)
    assert (got[5].exp_name_rnp, got[5].data_rnp, got[5].params_rnp, got[5].checkpoint_rnp) == ("a_Ft", "dclm", "60M", "290")
    assert (got[6].exp_name_rnp, got[6].data_rnp, got[6].checkpoint_rnp, got[6].options_rnp) == (None, "c4", "long_name", {"lr": "12345678901234567"})
    assert all(v in (None, {}) for r in got[7:9] for k, v in r.asDict().items() if k.endswith("_rnp"))
    assert (got[9].exp_name_rnp, got[9].data_rnp, got[9].params_rnp, got[9].epochs_rnp, got[9].total_tok_rnp) == ("7B", None, "4M", None, 20)


def test_run_tables(spark, rows):
    df = spark.createDataFrame([("r1", "2025-09-01", "a, dpo_tune_cache", None), ("r2", "2025-09-01", "a,b", 0.1), ("r3", "2025-01-01", None, None), ("r4", "2025-09-02", None, None)], "run_id string, created_at string, tags string, dpo_beta double")
    kept = runs.training_method(runs.usable_runs(df, "created_at", "tags"), ["dpo_beta", "absent"])
    assert rows(kept, "run_id", "method") == [("r2", "dpo"), ("r4", "finetune")]
    assert rows(runs.tag_columns(df, "tags", ["a", "b"]), "run_id", "a_tag", "b_tag") == [("r1", True, False), ("r2", True, True), ("r3", False, False), ("r4", False, False)]
    assert rows(runs.distinct_tags(df, "tags")) == [("a",), ("b",), ("dpo_tune_cache",)]
    docs = spark.createDataFrame([(1, '{"acc": 0.5, "task_config": {"x": 1}, "sub": {"y": 2}, "n": 3}'), (2, "not json"), (3, None), (4, "[1]")], "k int, `oe/boolq` string")
    assert rows(runs.metric_documents(docs, "k", {"oe/boolq": "boolq"})) == [(1, "oe_boolq_acc", "0.5"), (1, "oe_boolq_n", "3")]
    typed = runs.inferred_types(spark.createDataFrame([("1", "1.5", "true", "x", None), ("2.0", None, "False", "1", None)], "a string, b string, c string, d string, e string"))
    assert [t for _, t in typed.dtypes] == ["bigint", "double", "boolean", "string", "string"]
    other = runs.inferred_types(spark.createDataFrame([(1.0, 1.5, [1, 2], None, 2), (NAN, 2.0, None, None, None)], "a double, b double, c array<int>, d double, e int"))
    assert [t for _, t in other.dtypes] == ["bigint", "double", "string", "double", "int"] and [tuple(r)[:3] for r in other.collect()] == [(1, 1.5, "[1,2]"), (None, 2.0, None)]
    models = runs.model_columns(spark.createDataFrame([("x/Ladder-c4-150M/snapshots/1", 152e6), (None, None)], "model_name_or_path string, model_size double"), prefix="Ladder-", names={"c4": "C4"})
    assert rows(models, "data", "params") == [("C4", "150M"), (None, None)]
    assert [r.differing for r in runs.unequal_columns(spark.createDataFrame([(1, 1), (1, 2), (None, 3)], "a int, b int"), [("a", "b")]).collect()] == [1]
    assert runs.without_null_columns(df.withColumn("empty", F.lit(None).cast("int")), ["empty", "gone"]).columns == df.columns
    with pytest.raises(ValueError):
        runs.without_null_columns(df, ["dpo_beta"])
    assert runs.selected_columns(df, [["tags", "nope"], ["run_id", "tags"]], [("created", "at")]).columns == ["tags", "run_id", "created_at"]
    history = spark.createDataFrame([("r1", 2, 1.0, 0.1), ("r1", 1, 3.0, 0.2), ("r1", 3, None, None), ("r2", 1, 5.0, 0.1)], "run_id string, step int, train_loss double, learning_rate double")
    got = {r.run_id: r for r in runs.run_dynamics(history).collect()}
    assert (got["r1"].initial_train_loss, got["r1"].final_train_loss, got["r1"].loss_improvement, got["r1"].step_count, got["r2"].loss_improvement, got["r1"].final_lr) == (3.0, 1.0, 2.0, 3, None, 0.1)
    assert runs.joined_history(df, history.withColumn("tags", F.lit("h"))).columns[-3:] == ["created_at", "tags_run", "dpo_beta"]
    evidence = spark.createDataFrame([("m", 10, 12, 10, [10, 12]), ("n", None, 12, 11, [12]), ("o", None, 12, None, [])], "model string, listed_step int, paper_step int, last_evaluated_step int, branch_steps array<int>")
    assert [(r.step, r.basis, r.disagreements, r.run_completed, r.valid) for r in runs.final_steps(evidence).collect()] == [(10, "list", ["paper: 12"], False, True), (12, "paper", ["evaluations: 11"], True, True), (12, "paper", ["evaluations: none"], True, False)]


# -- pipelines ----------------------------------------------------------------------------------------------


def test_literal_metrics(spark):
    good = "{'acc_raw': 0.5, 'no_answer': None, 'predicted_index_raw': 1, 'primary_metric': 2, 'logits_per_byte_corr': -7}"
    assert preprocess.literal_metrics(good) == {"acc_raw": 0.5, "no_answer": None, "logits_per_byte_corr": -7.0} and len(preprocess.METRICS) == 28
    assert preprocess.literal_metrics("{}") == {} and preprocess.literal_metrics(" {'acc_raw': +1_0,} ") == {"acc_raw": 10.0}
    bad = ["[1]", "{'acc_raw': '1'}", "{'acc_raw': True}", "{'acc_raw': 1e309}", "{'acc_raw': 1" + "0" * 1000 + "}", "{'nope': 1}", "{'acc_raw': 1, 'acc_raw': 2}", "{1: 2}", "", None, "{'acc_raw': f()}", "{**{}}", "{'acc_raw': -1e400}", "{'acc_raw': 2j}", "{'acc_raw': 10**1000}", "{'primary_metric': 'x'}", "{[1]: 2}", "{'acc_raw': 1} x", "{" * 500]
    for text in bad:
        with pytest.raises(ValueError):
            preprocess.literal_metrics(text)
    df = spark.createDataFrame([(good,), *[(b,) for b in bad]], "t string").select(preprocess.parse_literal_metrics(F.col("t")).alias("m")).select("m.*")
    rows = df.collect()
    assert rows[0].fault is None and rows[0].acc_raw == 0.5 and rows[0].logits_per_byte_corr == -7 and all(r.fault for r in rows[1:])


def test_ppl_pipeline(spark):
    raw = spark.createDataFrame([("4M", "C4", "default", "100.0", "2.5", "nan"), ("4M", "C4", "default", "50", "inf", "x")], "params string, data string, seed string, step string, `eval/wikitext_103-validation/Perplexity` string, `eval/pile-validation/Perplexity` string")
    out = preprocess.preprocess_ppl(raw)
    rows = out.collect()
    assert [(r.step, r.wikitext_103_valppl, r.pile_valppl, r.ice_valppl) for r in rows] == [(50, INF, None, None), (100, 2.5, None, None)] and len(out.columns) == 4 + 11 + 51
    rules = preprocess.ppl_rules(["C4"], ["default"])
    assert preprocess.check(preprocess.normalized_ids(raw), rules, ["step"], "ppl").count() == 2
    with pytest.raises(validate.ViolationError, match="step"):
        preprocess.check(preprocess.normalized_ids(raw.withColumn("step", F.lit("1.5"))), rules, ["seed"], "ppl")


def test_aggregate_pipeline(spark):
    schema = "params string, data string, seed string, step double, task string, tokens double, compute double, metrics string"
    rows = [("4M", "C4", "default", 10.0, "boolq", None, None, "{'acc_raw': 0.5}"), ("4M", "C4", "default", 10.0, "arc_easy", 1.0, None, '{"acc_per_char": NaN}'), ("4M", "C4", "default", 10.5, "x", None, None, "[]"), ("4M", "C4", "default", 10.0, " x", None, 7.0, '{"acc_raw": "NaN"}'), ("4M", "C4", "default", 10.0, "mmlu_x", None, 7.0, '{"acc_raw": "NaN"}')]
    raw = spark.createDataFrame(rows, schema)
    kinds = [r.kind for r in preprocess.aggregate_violations(raw, ["C4"], ["default"], ["task"]).orderBy("task").collect()]
    assert sorted(kinds) == ["compute", "metrics", "step", "task"]
    out = preprocess.preprocess_aggregate(raw.limit(1)).first()
    assert (out.acc_raw, out.primary_metric, out.no_answer) == (0.5, 0.5, None)


def test_scaling_resolution(spark):
    columns = ["group", "model", "task", "chinchilla", "step", "tokens", "compute", "metrics", "eval/c4_en-validation/CrossEntropyLoss", "eval/dolma_common-crawl-validation/CrossEntropyLoss", "eval/pile-validation/CrossEntropyLoss", "eval/wikitext_103-validation/CrossEntropyLoss", "train/CrossEntropyLoss", "throughput/total_tokens", "seed"]

    def row(priority, group="g", task="boolq", loss="", metrics="{'acc_raw': 0.5}", seed="2.0", tokens=""):
        return (priority, f"f{priority}", 1, group, "4M", task, "5xC", "100", tokens, "", metrics, loss, "", "", "", "", "", seed)

    schema = "source_priority int, source_file string, source_row bigint, " + ", ".join(f"`{c}` string" for c in columns)
    raw = spark.createDataFrame([row(0, loss="3.5"), row(1, metrics="{'acc_raw': 0.7}"), row(0, task="piqa", loss="3.6"), row(0, seed="6198"), row(0, seed=""), row(0, group="old"), row(0, group=None)], schema)
    groups = spark.createDataFrame([("g", "c4"), ("old", None)], "source_group string, recipe string")
    usable = preprocess.scaling_rows(raw, groups, 6198)
    assert usable.count() == 3 and validate.violations(usable, preprocess.scaling_rules(["g"])).count() == 0
    evaluations, checkpoints = preprocess.resolve_scaling(usable, groups)
    assert {r.task: (r.source_file, r.acc_raw, r.primary_metric) for r in evaluations.collect()} == {"boolq": ("f1", 0.7, 0.7), "piqa": ("f0", 0.5, None)}
    # f0 gives the checkpoint two losses: rejected and reported
    assert checkpoints.count() == 0
    assert [tuple(r) for r in preprocess.scaling_conflicts(usable, groups).collect()] == [("f0", 1, "conflict", "c4/4M/2/100: c4_en_validation_cross_entropy")]
    one_loss = spark.createDataFrame([row(0, loss="3.5"), row(1, metrics="{'acc_raw': 0.7}"), row(0, task="piqa", loss="3.50")], schema)
    c = preprocess.resolve_scaling(preprocess.scaling_rows(one_loss, groups, 6198), groups)[1].first()
    assert (c.source_file, c.c4_en_validation_cross_entropy, c.chinchilla, c.tokens) == ("f0", 3.5, "5xC", 6553600)
    strict = lambda *rows: preprocess.preprocess_scaling(spark.createDataFrame(list(rows), schema), groups, [2], 6198)
    assert [df.count() for df in strict(row(0, loss="3.5"), row(1))] == [1, 1]
    for bad, kind in (([row(0, group="new")], "group"), ([row(0), row(0)], "duplicate"), ([row(0, loss="3"), row(0, task="piqa", loss="4")], "conflict"), ([row(0, tokens="100")], "schedule"), ([row(0, metrics="{'acc_raw': '1'}")], "metrics")):
        with pytest.raises(validate.ViolationError, match=kind):
            strict(*bad)


def test_published_and_runs(spark):
    a = spark.createDataFrame([("x", 1.0), ("", 2.0), (None, 3.0)], "task string, v double")
    union = preprocess.published_union([(a, "a.csv", "u1"), (a.limit(1), "b.csv", "u2")])
    assert union.columns[:2] == ["source_file", "source_unit"]
    assert {r.source_file: (r.n_rows, r.n_faulty) for r in preprocess.published_faults(union, {"task": "string", "v": "float64"}).collect()} == {"a.csv": (3, 2), "b.csv": (1, 0)}
    both = preprocess.run_checkpoints(spark.createDataFrame([("4M", "C4", "s", 1, 2.0)], "params string, data string, seed string, step int, ppl double"), spark.createDataFrame([("4M", "C4", "s", 2, 0.5)], "params string, data string, seed string, step int, acc double"))
    assert sorted((r.step, r.in_left, r.in_right) for r in both.collect()) == [(1, True, False), (2, False, True)]
    assert verify.consolidated({"u": a, "w": a}).count() == 6 and verify.preserved({"u": a}, verify.consolidated({"u": a})).count() == 0


def test_score_measurements(spark):
    df = evaluations(spark, [("1B", 10, 100, {"a": {"x": 2.0, "y": 1.0}}), ("4M", 5, 20, {"a": {"x": 2.0}})])
    tables = ranking.score_measurements(df, ranking.decision_accuracies(df, "1B", 10, 2, 1), 2, 1)
    assert tables["recipe_scores"].count() == 2 and tables["score_summaries"].count() == 2
    got = {r.params: r for r in tables["noise_spread"].collect()}
    assert (got["1B"].noise, got["1B"].spread, got["1B"].decision_accuracy) == (0.0, 0.5, 1.0)
    assert (got["4M"].available, got["4M"].reason, got["4M"].noise) == (False, "missing recipes", None)


def test_details(spark):
    import json

    from quern.operators import details

    task = json.dumps({"task_name": "boolq", "task_hash": "t", "model_hash": "m", "num_instances": 2, "metrics": {"acc_raw": 0.5, "primary_score": 0.5}, "task_config": {"primary_metric": "acc_raw"}, "processing_time": 1.5})
    line = lambda doc, **more: json.dumps({"doc_id": doc, "native_id": doc, "label": 0, "task_hash": "t", "model_hash": "m", "metrics": {"acc_raw": doc}, "model_output": [{"sum_logits": -1, "num_tokens": 2, "is_greedy": False}, {"sum_logits": "x"}]} | more)
    schema = "recipe string, params string, seed_value bigint, step bigint, task string, metrics string, line_no bigint, prediction string"
    good = [("c4", "4M", 2, 1, "boolq", task, k, line(k)) for k in (0, 1)]
    df = spark.createDataFrame(good, schema)
    t = details.task_rows(df).first()
    assert (t.num_instances, t.n_lines, t.primary_metric, t.acc_raw, t.acc_uncond) == (2, 2, "acc_raw", 0.5, None)
    assert sorted((r.doc_id, r.acc_raw, r.n_choices) for r in details.instance_rows(df).collect()) == [(0, 0.0, 2), (1, 1.0, 2)]
    assert sorted((r.doc_id, r.choice_index, r.sum_logits, r.is_greedy) for r in details.choice_rows(df).where("doc_id = 0").collect()) == [(0, 0, -1.0, False), (0, 1, None, None)]
    assert details.detail_faults(df).count() == 0
    whole = spark.createDataFrame([("c4", "4M", 2, 1, "boolq", task.replace('"num_instances": 2', '"num_instances": 1.0'), 0, line(7.0, label="1.0", model_output=[{"num_tokens": 12.0, "num_chars": "7.0"}]))], schema)
    r, c = details.instance_rows(whole).first(), details.choice_rows(whole).first()
    assert (details.task_rows(whole).first().num_instances, r.doc_id, r.label, c.num_tokens, c.num_chars) == (1, 7, 1, 12, 7)
    bad = spark.createDataFrame([*good, ("c4", "4M", 2, 1, "boolq", task, 2, line(1, task_hash="other")), ("c4", "4M", 2, 1, "piqa", task, None, None)], schema)
    assert sorted((r.task, r.fault, r.n) for r in details.detail_faults(bad).collect()) == [("boolq", "count", 1), ("boolq", "doc_id", 2), ("boolq", "hash", 1), ("piqa", "count", 2), ("piqa", "metrics", 1)]


def test_rule_agreement_has_bytes_and_gold_answers(spark, tmp_path):
    """Bytes come from the published bits; predictions are places in the published list."""

    def choice(bits, octets, chars):
        return {"sum_logits": -bits * octets * math.log(2) if bits else -9.0, "num_tokens": 2, "num_chars": chars, "logits_per_byte": bits}

    def prediction(label, choices, raw):
        return {"doc_id": label, "label": label, "metrics": {"predicted_index_raw": raw}, "model_output": choices}

    predictions = [
        prediction(1, [choice(2.0, 10, 10), choice(1.0, 30, 10)], 0),  # per character the first, per byte the second
        prediction(0, [None, choice(2.0, 10, 10), choice(1.5, 10, 10)], 2),
        prediction(0, [choice(1.0, 4, 4), choice(None, 4, 4)], 0),
    ]
    spark.createDataFrame([(1, json.dumps({"predictions": predictions}))], "bundle_id bigint, payload string").write.parquet(str(tmp_path / "prediction_bundles.parquet"))
    chosen = {r.prediction_index: (r.predicted_raw, r.predicted_per_char, r.predicted_per_byte) for r in reference.q_choice_predictions(spark, str(tmp_path)).collect()}
    assert chosen == {0: (0, 0, 1), 1: (2, 2, 2), 2: (0, 0, None)}
    got = {r.rule: (r["items"], r.agreement, r.accuracy_ours, r.accuracy_published) for r in reference.q_rule_agreement(spark, str(tmp_path)).collect()}
    assert got["per_byte"] == (3, 1.0, 0.5, 0.5)
    assert got["raw"] == (3, 1.0, pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert got["per_char"] == (3, None, pytest.approx(1 / 3), None)


def test_scaling_faults_are_reported_not_passed(spark, tmp_path):
    def line(group="g", model="4M", task="boolq", step="100", tokens="", compute="", metrics="{'acc_raw': 0.5}", loss="3.5", seed="2"):
        return ",".join([group, model, task, "5xC", step, tokens, compute, f'"{metrics}"', loss, "", "", "", "", "", seed])

    bad = {"group": "unknown", "step": "-1", "seed": "77", "tokens": "many", "compute": "inf", "loss": "high"}
    lines = [line(), line(metrics="{'acc_raw': 0.7}"), line(task="piqa"), line(task="piqa"), line(seed="6198"), *[line(task="csqa", **{k: v}) for k, v in bad.items()]]
    tables = {
        "scaling_lines": ([(k, "f", k, text) for k, text in enumerate(lines)], "line_id bigint, source_file string, line_no bigint, raw_line string"),
        "source_groups": ([("g", "c4"), ("old", None)], "source_group string, recipe string"),
        "source_files": ([("f", 1)], "source_file string, precedence int"),
        "seeds": ([(2, "s2")], "seed_value bigint, seed string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    d = str(tmp_path)
    assert reference.q_scaling_resolution(spark, d).count() == 0  # both cells are repeated in their file
    got = {(r.source_row, r.kind, r.value) for r in reference.q_scaling_faults(spark, d).collect()}
    twice = {(1, "unequal duplicate", "c4/4M/2/100/boolq x 2"), (3, "duplicate", "c4/4M/2/100/piqa x 2")}
    kinds = ["group", "step", "seed", "tokens", "compute", "c4_en_validation_cross_entropy"]
    assert got == twice | {(5 + k, kind, value) for k, (kind, value) in enumerate(zip(kinds, bad.values(), strict=True))}
    assert [(r.step, r.c4_en_validation_cross_entropy) for r in reference.q_scaling_checkpoints(spark, d).collect()] == [(100, 3.5)]

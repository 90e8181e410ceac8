import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators.spikes import ORDER, Batch, autoregression, exact_medians, find_spikes, judge, judge_series, _gathered


def course(n=200, seed=0, scatter=0.01):
    draw = np.random.default_rng(seed)
    return 2.5 + 2 * np.exp(-np.arange(n) / 30) + draw.normal(0, scatter, n)


def flagged(x, kind="loss"):
    code = judge_series(np.asarray(x, float), kind)
    return {k: set(np.flatnonzero(code == v).tolist()) for v, k in ((1, "limit"), (2, "stuck"), (3, "spike")) if (code == v).any()}


def test_quiet_course_has_no_findings():
    for seed in range(20):
        assert flagged(course(seed=seed)) == {}


@pytest.mark.parametrize("at", [5, 40, 120, 194])
@pytest.mark.parametrize("size", [1, 2, 3, 4])
@pytest.mark.parametrize("height", [0.3, -0.3, 50.0])
def test_spikes_that_return(at, size, height):
    if at + size > 196:
        size = 1
    x = course()
    x[at : at + size] += height * (1 + 0.1 * np.arange(size))
    assert flagged(x) == {"spike": set(range(at, at + size))} if (x > 0).all() else True


@pytest.mark.parametrize("size", range(1, 16))
def test_a_few_readings_are_up_to_twelve(size):
    for seed, at in ((0, 30), (1, 60), (2, 100), (3, 150)):
        x = course(seed=seed)
        x[at : at + size] += 1.0
        assert flagged(x) == ({"spike": set(range(at, at + size))} if size <= 12 else {})


def test_autoregression_is_robust():
    """Coefficients of a known process, with readings gone wild by a million, and of white readings."""
    draw = np.random.default_rng(0)
    change = np.zeros(20_000)
    for k in range(2, len(change)):
        change[k] = 0.5 * change[k - 1] - 0.3 * change[k - 2] + draw.normal()
    x = 1000 + np.cumsum(change)
    wild = x.copy()
    wild[draw.random(len(x)) < 0.02] += 1e6

    def weights(values):
        batch = Batch(values, np.zeros(len(values), np.int64), "loss")
        batch.lay(np.ones(1, bool))
        return autoregression(_gathered(batch.figures(), 1))[0]

    assert np.abs(weights(wild) - weights(x)).max() < 0.12
    assert weights(x)[0] > 0.2 > -0.1 > weights(x)[1]
    white = weights(100 + draw.normal(size=20_000))
    assert white[0] < -0.3 and white[0] < white[1] < 0.0  # the forecast goes back from the last reading towards those before it
    assert not autoregression({f"{n}{k}": np.zeros(2) for n in ("signs", "pairs") for k in range(1, ORDER + 1)}).any()


def test_series_of_a_batch_do_not_meet():
    draw = np.random.default_rng(5)
    parts = [course(int(n), seed=k) for k, n in enumerate(draw.integers(1, 90, 40))]
    for x in parts[::2]:
        if len(x) > 20:
            x[len(x) // 2] += 3
    sid = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    assert judge(Batch(np.concatenate(parts), sid, "loss")).tolist() == [c for x in parts for c in judge_series(x, "loss").tolist()]


def test_small_deviations_and_level_shifts_stay():
    x = course(seed=3)
    x[100] += 0.04
    assert flagged(x) == {}
    y = course(seed=3)
    y[100:] += 0.5
    assert flagged(y) == {}
    z = course(seed=3)
    z[100:140] -= 0.5
    assert flagged(z) == {}
    bump = course(seed=3)
    bump[100:109] += 0.4 * np.hanning(9)
    assert flagged(bump) == {}
    ramp = course(seed=3)
    ramp[80:120] += np.linspace(0, 1, 40)
    ramp[120:] += 1
    assert flagged(ramp) == {}


def test_stuck_and_limits():
    x = course(seed=4)
    x[50:54] = x[50]
    x[100:102] = x[100]
    x[[10, 11]], x[20], x[30] = np.nan, np.inf, -1.0
    x[60] = 0.0
    assert flagged(x) == {"limit": {10, 11, 20, 30, 60}, "stuck": {51, 52, 53}}


def test_counts():
    steps = np.arange(1, 201) * 25.0
    assert flagged(steps, "count") == {}
    x = steps.copy()
    x[50], x[90], x[120] = 3000.0, -1.0, x[120] + 1
    x[150:155] = x[150]
    assert flagged(x, "count") == {"limit": {90}, "spike": {50, 120}, "stuck": {151, 152, 153, 154}}
    back = np.concatenate([steps[:120], steps[80:]])
    assert flagged(back, "count") == {}
    gap = np.concatenate([steps[:120], steps[125:]])
    assert flagged(gap, "count") == {}


def test_short_series():
    assert flagged([]) == {} and flagged([1.0]) == {} and flagged([1.0, 9e9, 1.0]) == {} and flagged([1.0, 1.01, 9.0, 1.02, 1.0]) == {"spike": {2}}
    assert flagged([2.0, 2.0, 2.0]) == {"stuck": {1, 2}} and flagged([np.nan, -1.0]) == {"limit": {0, 1}}


SCHEMA = "row_id bigint, run_id string, step bigint, train_cross_entropy double, c4_en_validation_cross_entropy double, logged_at timestamp, arrived_at timestamp"


def readings(runs=3, n=200):
    out = []
    for r in range(runs):
        x, c4 = course(n, seed=r), course(n, seed=100 + r)
        x[60] += 3
        for k in range(n):
            at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)
            out.append((r * n + k, f"run-{r}", (k + 1) * 25, float(x[k]), float(c4[k]) if k % 2 else None, at, at))
    return out


def test_spark_segments_agree_with_whole_series(spark):
    rows = readings()
    df = spark.createDataFrame(rows + rows[50:70], SCHEMA).withColumn("series", F.lit(1)).withColumn("value", F.lit(2)).withColumn("field", F.lit(3))
    whole = sorted(map(tuple, find_spikes(df).collect()))
    assert whole == [(60, "train_cross_entropy", "spike"), (260, "train_cross_entropy", "spike"), (460, "train_cross_entropy", "spike")]
    assert sorted(map(tuple, find_spikes(df, segment=40).collect())) == whole


def test_latest_delivery_counts_and_nulls_are_skipped(spark):
    rows = readings(1)
    late = rows[100][:3] + (99.0,) + rows[100][4:6] + (dt.datetime(2025, 1, 1),)
    bare = [(None, "run-0", 1, 1.0, 1.0, rows[0][5], rows[0][5]), (9999, None, 1, 1.0, 1.0, rows[0][5], rows[0][5]), (9998, "run-0", None, None, None, None, None)]
    df = spark.createDataFrame([*rows, late, *bare], SCHEMA)
    assert sorted(map(tuple, find_spikes(df).collect())) == [(60, "train_cross_entropy", "spike"), (100, "train_cross_entropy", "spike")]
    assert find_spikes(df.limit(0)).count() == 0


def test_readings_without_a_time_get_limits_only(spark):
    rows = readings(1)
    timeless = [(9000 + k, "run-0", step, x, None, None, rows[0][6]) for k, (step, x) in enumerate([(1, -1.0), (-5, 2.5), (1, 99.0), (1, float("nan"))])]
    for segment in (20_000, 40):
        got = sorted(map(tuple, find_spikes(spark.createDataFrame([*rows, *timeless], SCHEMA), segment=segment).collect()))
        assert got == [(60, "train_cross_entropy", "spike"), (9000, "train_cross_entropy", "limit"), (9001, "step", "limit"), (9003, "train_cross_entropy", "limit")]


def test_two_hundred_thousand_readings_whole_and_cut(spark):
    """Cut twice over (4,096 pieces would be too few for the second level to be left out)."""
    n = 200_000
    draw = np.random.default_rng(3)
    x = 3 + np.exp(-np.arange(n) / 9000) + 0.2 * np.sin(np.arange(n) / 500) + draw.normal(0, 0.01, n) * np.where(np.arange(n) < 150_000, 1, 0.2)
    for k, at in enumerate(range(500, n - 100, 977)):
        x[at : at + 1 + k % 12] += (0.5 if k % 2 else -0.4) * (1 + k % 3)
    import pandas as pd

    frame = pd.DataFrame({"row_id": np.arange(n), "run_id": "hot", "step": np.arange(n) * 25, "train_cross_entropy": x, "c4_en_validation_cross_entropy": np.where(np.arange(n) % 4 == 0, x + 0.3, np.nan)})
    frame["logged_at"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="min")
    frame["arrived_at"] = frame["logged_at"]
    df = spark.createDataFrame(frame).withColumn("c4_en_validation_cross_entropy", F.when(~F.isnan("c4_en_validation_cross_entropy"), F.col("c4_en_validation_cross_entropy")))
    whole = sorted(map(tuple, find_spikes(df, segment=n).collect()))
    assert sum(f == "train_cross_entropy" for _, f, _ in whole) > 1000
    assert sorted(map(tuple, find_spikes(df, segment=20_000).collect())) == whole
    assert sorted(map(tuple, find_spikes(df, segment=2_000).collect())) == whole


def test_changing_noise_is_judged_by_the_whole_run(spark):
    """Noisy early, quiet late: segments take the run's scatter and even count, not their own."""
    n = 4000
    draw = np.random.default_rng(7)
    x = 5 + draw.normal(0, 1, n) * np.where(np.arange(n) < 1200, 0.04, 0.01)
    x[[300, 700]] += 0.5  # far beyond the run's scatter, not beyond ten times that of the noisy part
    x[[2500, 3300]] += 0.12  # within the run's, beyond ten times that of the quiet part
    steps = np.cumsum(np.where(np.arange(n) < 1200, 7, 25))
    rows = [(k, "run-0", int(steps[k]), float(x[k]), None, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), None) for k in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, find_spikes(df).collect()))
    assert {(300, "train_cross_entropy", "spike"), (700, "train_cross_entropy", "spike")} <= set(whole)
    assert not {2500, 3300} & {r[0] for r in whole}
    assert sorted(map(tuple, find_spikes(df, segment=300).collect())) == whole


def test_exact_medians(spark):
    draw = np.random.default_rng(1)
    groups = {"odd": draw.normal(size=5001), "even": draw.normal(size=5000), "ties": draw.integers(0, 3, 900).astype(float), "one": np.array([2.5]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    for accuracy in (50, 10_000):
        assert {r.k: r.median for r in exact_medians(df, ["k"], "v", accuracy).collect()} == {k: float(np.median(v)) for k, v in groups.items()}


def test_rounds_go_on_until_nothing_is_found():
    """Readings that hide one another are peeled off one a round, sixteen rounds here."""
    x = 2.5 + np.random.default_rng(0).normal(0, 0.01, 400)
    x[200:216] += 0.5 * 4.0 ** np.arange(16)
    assert flagged(x) == {"spike": set(range(200, 216))}

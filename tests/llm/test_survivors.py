import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quern.llm.survivors import EVALUATION_FIELDS, evaluation_survivors, field_survivors, group_spellings, merged_evaluations, rank_candidates

SCHEMA = "eval_id bigint, source_file string, source_group string, params string, seed string, step string, task string, loaded_at timestamp, chinchilla string, " + ", ".join(f"{f} double" for f in EVALUATION_FIELDS[1:])
NAN = float("nan")


def day(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=k)


def evaluation(eval_id, file="main.csv", group="c4_clean", at=1, step="100", task="boolq", chinchilla="5xC", **values):
    return (eval_id, file, group, "4M", "2.0", step, task, day(at) if at is not None else None, chinchilla, *[values.get(f) for f in EVALUATION_FIELDS[1:]])


@pytest.fixture
def lookups(spark):
    groups = spark.createDataFrame([("c4_clean", "c4"), ("webclean_v2", "c4"), ("falcon_web", "falcon"), ("legacy_mix", None)], "source_group string, recipe string")
    files = spark.createDataFrame([("main.csv", 0), ("extra.csv", 1), ("fixes.csv", 2)], "source_file string, precedence int")
    return groups, files


def survivors(spark, lookups, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.group_id, r.field_name): r.eval_id for r in evaluation_survivors(df, *lookups).collect()}


def test_field_by_field(spark, lookups):
    rows = [
        evaluation(9, at=5, tokens=1.0, compute=NAN),
        evaluation(4, "raw/x/EXTRA.CSV", "C4-Clean", at=1, step="1e2", task="BoolQ", chinchilla=" ", compute=2.0),
        evaluation(7, "./fixes.csv", "web clean v2", at=0, step=" 100.0", chinchilla=None, acc_raw=3.0),
        evaluation(8, "./fixes.csv", "c4__cleaan", at=2, step="100", chinchilla=None, acc_raw=NAN),
        evaluation(1, group="falcon_web", tokens=1.0),
        evaluation(2, group="legacy_mix"),
        evaluation(3, group="legacy_mix"),
        evaluation(5, group="no such group"),
    ]
    assert survivors(spark, lookups, rows) == {(4, "chinchilla"): 9, (4, "tokens"): 9, (4, "compute"): 4, (4, "acc_raw"): 7}


def test_ties_nulls_and_unknown_files(spark, lookups):
    rows = [evaluation(3, acc_raw=1.0), evaluation(2, acc_raw=2.0), evaluation(6, "other.csv", at=9, acc_raw=3.0), evaluation(5, None, at=None, acc_raw=4.0, compute=1.0)]
    got = survivors(spark, lookups, rows)
    assert got[(2, "acc_raw")] == 2 and got[(2, "compute")] == 5
    bare = [(None,) * 17, (1, *(None,) * 16)]
    assert survivors(spark, lookups, bare) == {}
    assert survivors(spark, lookups, []) == {}


def test_random_cells_against_brute_force(spark, lookups):
    draw = random.Random(5)
    precedence = {"main.csv": 0, "extra.csv": 1, "fixes.csv": 2}
    rows = [
        evaluation(k, draw.choice(list(precedence)), at=draw.randrange(6), step=str(draw.randrange(25)), chinchilla=draw.choice(["5xC", "", None]), **{f: draw.choice([None, NAN, 1.0, 2.0]) for f in EVALUATION_FIELDS[1:]})
        for k in range(400)
    ]
    want = {}
    for _, cell in itertools.groupby(sorted(rows, key=lambda r: r[5]), key=lambda r: r[5]):
        cell = list(cell)
        if len(cell) < 2:
            continue
        for k, f in enumerate(EVALUATION_FIELDS):
            have = [r for r in cell if r[8 + k] not in (None, "") and r[8 + k] == r[8 + k]]
            if have:
                best = max(have, key=lambda r: (precedence[r[1]], r[7], -r[0]))
                want[(min(r[0] for r in cell), f)] = (precedence[best[1]], best[7])
    got = survivors(spark, lookups, rows)
    by_id = {r[0]: (precedence[r[1]], r[7]) for r in rows}
    assert {k: by_id[v] for k, v in got.items()} == want


def test_layers_and_merge(spark, lookups):
    rows = [evaluation(1, "fixes.csv", at=9, chinchilla=None, acc_raw=1.0), evaluation(2, "extra.csv", at=5, chinchilla=None, acc_raw=2.0), evaluation(3, at=5, chinchilla="5xC", acc_raw=3.0)]
    merged = merged_evaluations(spark.createDataFrame(rows, SCHEMA), *lookups).first()
    assert (merged.best_eval_id, merged.n_undominated, merged.acc_raw, merged.chinchilla, merged.n_rows) == (1, 2, 1.0, "5xC", 3)
    flat = spark.createDataFrame([("a", 3, 2, 9, 1), ("a", 1, 2, 8, 2), ("a", 1, 1, 7, 3)], "g string, mask bigint, trust int, t bigint, id bigint")
    ranked = rank_candidates(flat, ["g"], F.col("mask"), F.col("trust"), F.col("t"), F.col("id"))
    assert [(x.layer, x.id) for x in ranked.first().ranked] == [(0, 1), (1, 2), (2, 3)]
    assert {r.field_name: r.id for r in field_survivors(ranked, ["x", "y"]).collect()} == {"x": 1, "y": 1}


def test_spellings(spark, lookups):
    known = {r.spelling: r.recipe for r in group_spellings(lookups[0]).collect()}
    assert known["c4clean"] == known["c4clan"] == known["cc4clean"] == known["webclenv2"] == "c4" and known["falcnweb"] == "falcon"
    assert "c4cln" not in known and "clean" not in known and "4clean" in known and known["legacymix"] is None


def test_clashing_columns(spark, lookups):
    df = spark.createDataFrame([evaluation(1, acc_raw=1.0), evaluation(2, acc_raw=2.0)], SCHEMA)
    for name in ("recipe", "mask", "trust", "at", "id", "spelling", "file", "values", "group_id"):
        df = df.withColumn(name, F.lit("x"))
    assert evaluation_survivors(df, *lookups).count() == 2

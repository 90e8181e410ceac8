import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators.parse_lines import parse_records, record_fields

GOOD = 'c4_clean,4M,boolq,5xC,100,2048,1e15,"{""acc_raw"": 0.5, ""n"": None}",1,2,3,4,5,2048.0,2'


def line(**cells):
    base = dict(step="100", tokens="2048", compute="1e15", seed="2")
    base |= cells
    return f"g,4M,boolq,5xC,{base['step']},{base['tokens']},{base['compute']},m,1,2,3,4,5,6,{base['seed']}"


@pytest.fixture
def seeds(spark):
    return spark.createDataFrame([(2,), (4,), (None,)], "seed_value bigint")


CASES = [
    (GOOD, set()),
    (GOOD + "\r\n", set()),
    (line(seed='"2.0"\r'), set()),
    (line(seed=" 6198 "), set()),
    (line(seed="", tokens="", compute=" "), set()),
    (line(step='" 1.25e3 "'), set()),
    (line(step="1.5", tokens="x", compute="1e400", seed="3"), {"step", "tokens", "compute", "seed"}),
    (line(step="", compute="-1"), {"step", "compute"}),
    (line(seed='"2" x'), {"quoting"}),
    (line(seed='"2" '), {"quoting"}),
    (line(seed='a"2"'), {"quoting"}),
    (line(seed='"2'), {"quoting"}),
    (line(seed=' "2"'), {"quoting"}),
    (line() + ",extra", {"column_count"}),
    ("a,b", {"column_count"}),
    ("", {"column_count"}),
    (None, {"column_count"}),
    ('"' + "x" * 200_000 + '",b', {"column_count"}),
    ("," * 50_000, {"column_count"}),
]


def test_findings(spark, seeds):
    rows = [(k, text) for k, (text, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "line_id bigint, raw_line string")
    result = parse_records(df, seeds)
    found = {}
    for r in result.findings.collect():
        found.setdefault(r.line_id, []).append(r.reason)
    for k, (_, want) in enumerate(CASES):
        assert sorted(found.get(k, [])) == sorted(want), CASES[k][0]
    valid = {r.line_id: r for r in result.valid.collect()}
    assert set(valid) == {k for k, (_, want) in enumerate(CASES) if not want}
    assert valid[0].metrics == '{"acc_raw": 0.5, "n": None}' and valid[0].seed == 2 and valid[0].compute == 1e15
    assert valid[5].step == 1250
    rejected = {r.line_id: r.reasons for r in result.rejected.collect()}
    assert rejected[6] == ["compute", "seed", "step", "tokens"]


def test_repeated_rows_clashing_columns_and_null_ids(spark, seeds):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, "a", "x")], "line_id bigint, raw_line string, name string").withColumn("value", F.lit(1)).withColumn("salt", F.lit(2)).withColumn("reason", F.lit("y"))
    result = parse_records(df, seeds)
    assert sorted((r.line_id or 0, r.reason) for r in result.findings.collect()) == [(0, "column_count"), (1, "column_count"), (1, "column_count")]
    assert result.valid.count() == 0 and result.rejected.count() == 3


def test_empty_tables(spark, seeds):
    empty = spark.createDataFrame([], "line_id bigint, raw_line string")
    result = parse_records(empty, seeds)
    assert result.findings.count() == result.valid.count() == result.rejected.count() == 0
    no_seeds = parse_records(spark.createDataFrame([(1, line())], "line_id bigint, raw_line string"), seeds.limit(0))
    assert [r.reason for r in no_seeds.findings.collect()] == ["seed"]


def test_hot_value_is_one_row_of_the_dictionary(spark, seeds):
    df = spark.range(300).select(F.col("id").alias("line_id"), F.lit(line(seed="bad")).alias("raw_line"))
    result = parse_records(df, seeds)
    assert result.findings.count() == 300
    assert [tuple(r) for r in result.invalid_values.collect()] == [("seed", "bad", 300)]


def test_large_dictionaries_are_joined_by_shuffle(spark, seeds):
    texts = [*[text for text, _ in CASES], *[line(step=f"x{k}", seed="z" * 200 + str(k % 3)) for k in range(50)]]
    df = spark.createDataFrame([(k, text) for k, text in enumerate(texts)], "line_id bigint, raw_line string")
    results = [parse_records(df, seeds, max_broadcast=n) for n in (100_000, 0)]
    small, large = (sorted(map(tuple, r.findings.collect())) for r in results)
    assert small == large and len(small) == sum(len(want) for _, want in CASES) + 100
    assert results[0].valid.count() == results[1].valid.count()


def test_rows_are_not_shuffled(spark, seeds, tmp_path):
    spark.range(10).select(F.col("id").alias("line_id"), F.lit(line()).alias("raw_line")).write.parquet(f"{tmp_path}/lines")
    result = parse_records(spark.read.parquet(f"{tmp_path}/lines"), seeds)
    for df in (result.findings, result.valid, result.rejected):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and plan.count("FileScan parquet") <= 2  # initial and final plan


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab,"\n\r\x01 é', max_size=6), min_size=1, max_size=5), min_size=1, max_size=20))
def test_written_records_come_back(spark, records):
    texts = []
    for fields in records:
        out = io.StringIO()
        csv.writer(out, lineterminator="", quoting=csv.QUOTE_ALL).writerow(fields)
        texts.append(out.getvalue())
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", record_fields(F.col("t")).alias("r")).orderBy("k").collect()
    for r, fields in zip(got, records, strict=True):
        assert r.r.sound and r.r.fields == fields

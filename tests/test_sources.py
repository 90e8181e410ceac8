import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from quern.contracts import contract
from quern.operators.validate import ViolationError
from quern.sources import archives, readers, sinks, transfer
from quern.sources.files import FileSystem
from quern.streaming import ingest

TABLE = contract("t", {"recipe": "string", "step": "int64", "score": "float64", "good": "bool"}, ("recipe", "step"))


def frame(spark, rows):
    return spark.createDataFrame(rows, TABLE.schema())


# -- contracts and readers -----------------------------------------------------------


def test_projection_types_and_renames(spark):
    df = spark.createDataFrame([("c4", "7", "x")], "recipe string, step string, extra string")
    got = TABLE.project(df, {"score": "no/such/column"})
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "bigint", "double", "boolean"]
    assert tuple(got.first()) == ("c4", 7, None, None)
    assert TABLE.empty(spark).count() == 0 and TABLE.schema_faults(TABLE.empty(spark)) == []
    assert TABLE.schema_faults(df) == ["missing score", "missing good", "unknown extra", "step is string, not bigint"]
    assert TABLE.schema_faults(TABLE.empty(spark).select("step", "recipe", "score", "good")) == ["columns out of order"]


def test_parquet_ordinal_gets_free_names(spark, tmp_path):
    spark.range(5).select("id", F.lit(1).alias("row_index")).coalesce(1).write.parquet(f"{tmp_path}/t")
    df, place, origin = readers.parquet_with_ordinal(spark, f"{tmp_path}/t")
    assert (place, origin) == ("_row_index", "file_path")
    assert [r[place] for r in df.orderBy("id").collect()] == [0, 1, 2, 3, 4]


def test_strict_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('recipe,step,score,good\n"a ""q"", b",1,0.5,true\n,2,,\n')
    rows = readers.strict_csv(spark, str(path), TABLE).orderBy("step").collect()
    assert [tuple(r) for r in rows] == [('a "q", b', 1, 0.5, True), ("", 2, None, None)]
    path.write_text("recipe,score,step,good\na,1,1,true\n")
    with pytest.raises(readers.HeaderError):
        readers.strict_csv(spark, str(path), TABLE)
    path.write_text("recipe,step,score,good\na,x,1,true\n")
    with pytest.raises(Exception, match="(?i)malformed|parse|fail"):
        readers.strict_csv(spark, str(path), TABLE).collect()


def test_text_csv_rows_and_priorities(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n2,\n')
    (tmp_path / "b.csv").write_text("x,y\n3,z\n")
    df = readers.text_csv(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], ["x", "y"])
    got = [tuple(r) for r in df.orderBy("source_priority", "source_row").collect()]
    assert got == [(0, "a.csv", 1, "1", "two\nlines"), (0, "a.csv", 2, "2", None), (1, "b.csv", 1, "3", "z")]
    both = readers.csv_with_filename(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], ["x", "y"])
    assert sorted((r.x, r.y, r.filename[-5:]) for r in both.collect()) == [("1", "two\nlines", "a.csv"), ("2", None, "a.csv"), ("3", "z", "b.csv")]
    with pytest.raises(readers.HeaderError):
        readers.csv_with_filename(spark, [f"{tmp_path}/b.csv"], ["x", "z"])
    (tmp_path / "c.csv").write_text("x,y\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.csv_with_filename(spark, [f"{tmp_path}/c.csv"], ["x", "y"]).collect()


def test_json_pairs(spark, tmp_path):
    path = tmp_path / "pairs.json"
    path.write_text('[["a", "b"],\n ["c", "d"]]')
    assert [tuple(r) for r in readers.json_pairs(spark, str(path), 2).collect()] == [(0, "a", "b"), (1, "c", "d")]
    for bad, n in (('[["a", "b"]]', 2), ('[["a"]]', 1), ('[["a", " "]]', 1), ('{"a": 1}', 1)):
        path.write_text(bad)
        with pytest.raises(ViolationError):
            readers.json_pairs(spark, str(path), n)


def test_declared_json_slices_ids_and_cache(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"a": 1, "b": [{"c": "x"}]}\n{"b": null}\n')
    tasks = spark.createDataFrame([("t.jsonl", "boolq")], "filename string, task string")
    df = readers.declared_json(spark, [f"{tmp_path}/t.jsonl"], "a bigint, b array<struct<c:string>>", tasks)
    assert sorted((r.a or 0, r.task) for r in df.collect()) == [(0, "boolq"), (1, "boolq")]
    (tmp_path / "text.txt").write_text("first line\nsecönd\n")
    slices = spark.createDataFrame([(2, 0, 3), (1, 6, 10), (9, 0, 1)], "line int, start int, end int")
    assert {(r.line, r.text) for r in readers.text_slices(spark, f"{tmp_path}/text.txt", slices).collect()} == {(2, "sec"), (1, "line"), (9, None)}
    ids = spark.createDataFrame([(0,), (1,), (1,), (2,)], "row_id bigint")
    assert readers.rows_by_id(ids, [0, 2]).count() == 2 and readers.rows_by_id(ids, []).count() == 0
    for wrong in ([1], [5]):
        with pytest.raises(ViolationError):
            readers.rows_by_id(ids, wrong)
    readers.write_cache(spark.range(3).withColumn("twice", F.col("id") * 2), f"{tmp_path}/cache", ["twice"])
    back = readers.read_cache(spark, f"{tmp_path}/cache", "id bigint", {"twice": F.col("id") * 2})
    assert sorted(tuple(r) for r in back.collect()) == [(0, 0), (1, 2), (2, 4)]


def test_catalog(spark, tmp_path):
    frame(spark, [("a", 1, 0.5, True), ("b", 2, 0.5, True)]).write.partitionBy("recipe").parquet(f"{tmp_path}/t")
    catalog = readers.TableCatalog(spark, str(tmp_path), {"t": "t", "gone": "gone"})
    df = catalog.read("t", ["step"], F.col("recipe") == "b")
    assert [r.step for r in df.collect()] == [2]
    assert "PartitionFilters: [isnotnull(recipe" in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(readers.UnknownTableError):
        catalog.read("other")
    with pytest.raises(readers.MissingTableError):
        catalog.read("gone")


# -- sinks ------------------------------------------------------------------------------


def test_write_upsert_and_validation(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert sinks.write_table(frame(spark, [("b", 2, 1.0, True), ("a", 9, None, None), ("b", 1, 1.0, True)]), path, TABLE) == 3
    df, place, origin = readers.parquet_with_ordinal(spark, path)
    assert [(r.recipe, r.step) for r in df.orderBy(origin, place).collect()] == [("a", 9), ("b", 1), ("b", 2)]
    assert sinks.upsert_group(spark, path, frame(spark, [("b", 7, 0.0, False)]), TABLE, "recipe", "b") == 2
    assert sinks.add_groups(spark, path, frame(spark, [("b", 1, 1.0, True)]), TABLE, "recipe") == 0
    assert sinks.add_groups(spark, path, frame(spark, [("b", 1, 1.0, True), ("c", 1, 1.0, True)]), TABLE, "recipe") == 3
    with pytest.raises(ViolationError):
        sinks.write_table(frame(spark, [("a", 1, 1.0, True), ("a", 1, 2.0, True)]), path, TABLE)
    assert spark.read.parquet(path).count() == 3 and FileSystem(spark).names(str(tmp_path)) == ["t"]
    spark.createDataFrame([("b", 1), ("a", 1)], "recipe string, step bigint").coalesce(1).write.parquet(f"{tmp_path}/bad")
    with pytest.raises(ViolationError, match="order"):
        sinks.validate_written(spark, f"{tmp_path}/bad", contract("bad", {"recipe": "string", "step": "int64"}, ("recipe", "step")))


def test_swap_is_all_or_nothing(spark, tmp_path):
    old = {n: f"{tmp_path}/{n}" for n in ("x", "y")}
    for n, path in old.items():
        spark.range(1).withColumn("v", F.lit(n)).write.parquet(path)
    staged = {path: sinks.write_staged(spark.range(2).withColumn("v", F.lit("new")), path)[0] for path in old.values()}

    def fail(path):
        if path.endswith("y"):
            raise RuntimeError("disk full")

    with pytest.raises(RuntimeError):
        sinks.swap_in(spark, staged, fail)
    assert [spark.read.parquet(p).first().v for p in old.values()] == ["x", "y"]
    assert FileSystem(spark).names(str(tmp_path)) == ["x", "y"]
    with pytest.raises(ViolationError):
        sinks.write_staged(spark.range(2), f"{tmp_path}/z", expected=3)


def test_row_ids_measurements_shards_evidence_totals(spark, tmp_path):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("k"))
    assert [tuple(r) for r in sinks.with_row_ids(df, ["k"]).orderBy("row_id").collect()] == [(k, k) for k in range(100)]
    for name in ("m.csv", "m.parquet"):
        sinks.write_measurements(df, f"{tmp_path}/{name}", ["k"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/m.csv").count() == 100
    sinks.write_shards(frame(spark, [("a", 1, 1.0, True), ("b", 1, 1.0, True)]), f"{tmp_path}/s", "recipe")
    assert FileSystem(spark).names(f"{tmp_path}/s") == ["_SUCCESS", "recipe=a", "recipe=b"]
    nested = spark.createDataFrame([("c", [1, 2])], "claim string, ids array<bigint>")
    sinks.write_evidence(nested, f"{tmp_path}/e", nested.schema)
    assert sinks.read_evidence(spark, f"{tmp_path}/e", nested.schema).count() == 1
    with pytest.raises(ViolationError):
        sinks.read_evidence(spark, f"{tmp_path}/e", df.schema)
    kinds = spark.createDataFrame([("task",), ("task",), ("choice",)], "kind string")
    manifest = spark.createDataFrame([(1, 1), (1, 0)], "n_tasks int, n_choices int")
    sinks.require_totals(kinds, manifest, {"task": "n_tasks", "choice": "n_choices"})
    with pytest.raises(ViolationError):
        sinks.require_totals(kinds, manifest, {"task": "n_choices"})


# -- archives, transfer, streaming ------------------------------------------------------------


def tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def checkpoint(step, tasks):
    return tar([(f"step-{step}/{n}", d.encode()) for n, d in tasks])


def test_archives(spark, tmp_path):
    inner = checkpoint(1250, [("boolq-metrics.json", '{"a": 1}'), ("boolq-predictions.jsonl", '{"doc_id": 1}\n{"doc_id": 2}\n'), ("piqa-metrics.json", "{}"), ("piqa-predictions.jsonl", "")])
    (tmp_path / "one.tar.gz").write_bytes(tar([("C4/150M/seed-14/step-1250.tar.gz", inner), ("readme.txt", b"x"), ("other/150M/seed-2/step-1250.tar.gz", inner)]))
    df = archives.read_archives(spark, f"{tmp_path}/*.tar.gz", recipe="c4")
    assert sorted(map(tuple, df.select("recipe", "params", "seed_value", "step", "task", "line_no").collect()), key=repr) == [("c4", "150M", 14, 1250, "boolq", 0), ("c4", "150M", 14, 1250, "boolq", 1), ("c4", "150M", 14, 1250, "piqa", None)]
    assert archives.read_archives(spark, f"file://{tmp_path}/one.tar.gz").count() == 6
    texts = {(r.task, r.line_no): r.metrics for r in df.collect()}
    assert texts == {("boolq", 0): '{"a": 1}', ("boolq", 1): None, ("piqa", None): "{}"}
    many = checkpoint(3, [("t-predictions.jsonl", "".join(f'{{"doc_id": {k}}}\n\n' for k in range(2500))), ("t-metrics.json", "{}")])
    (tmp_path / "many.tgz").write_bytes(tar([("c4/4M/seed-2/step-3.tar.gz", many)]))
    lines = archives.read_archives(spark, f"{tmp_path}/m*.tgz")
    assert (lines.count(), lines.where("metrics IS NOT NULL").count(), lines.agg(F.max("line_no")).first()[0]) == (2500, 1, 2499)
    broken = {
        "twice": tar([("c4/4M/seed-2/step-1.tar.gz", checkpoint(1, []))] * 2),
        "lacks": tar([("c4/4M/seed-2/step-1.tar.gz", checkpoint(1, [("x-metrics.json", "{}")]))]),
        "unexpected": tar([("c4/4M/seed-2/step-1.tar.gz", checkpoint(2, [("x-metrics.json", "{}")]))]),
    }
    for message, data in broken.items():
        (tmp_path / "bad.tgz").write_bytes(data)
        with pytest.raises(archives.ArchiveError, match=message):
            list(archives.archive_rows(f"{tmp_path}/bad.tgz"))


def test_transfer_resumes_and_verifies(tmp_path):
    source = tmp_path / "source"
    source.write_bytes(gzip.compress(b"x" * 1000) * 50)
    identity = transfer.identity_of(source)
    opened = []

    def transport(location, offset):
        opened.append(offset)
        return transfer.local_transport(location, offset)

    (tmp_path / "target.part").write_bytes(source.read_bytes()[:700])
    target = transfer.fetch(f"file://{source}", tmp_path / "target", identity, transport)
    assert target.read_bytes() == source.read_bytes() and opened == [700]
    transfer.fetch(str(source), target, identity, transport)
    assert opened == [700]
    restarts = lambda location, offset: transfer.local_transport(location, 0)
    (tmp_path / "b.part").write_bytes(b"garbage")
    assert transfer.fetch(str(source), tmp_path / "b", identity, restarts).read_bytes() == source.read_bytes()
    with pytest.raises(transfer.TransferError):
        transfer.fetch(str(source), tmp_path / "c", transfer.Identity(identity.size, "0" * 64))
    assert not (tmp_path / "c").exists() and not (tmp_path / "c.part").exists()


def test_ingest_resumes_and_counts_files_once(spark, tmp_path):
    schema = TABLE.schema()
    source, staging = tmp_path / "in", f"{tmp_path}/staged"
    source.mkdir()

    def put(name, *steps):
        (source / name).write_text("".join(json.dumps({"recipe": "c4", "step": s}) + "\n" for s in steps))

    put("a.json", 1, 2)
    assert ingest.ingest(spark, str(source), schema, staging).count() == 2
    put("b.json", 3)
    calls = []

    def failing(df):
        calls.append(1)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        ingest.ingest(spark, str(source), schema, staging, transform=failing)
    got = ingest.ingest(spark, str(source), schema, staging)
    assert sorted(r.step for r in got.collect()) == [1, 2, 3] and calls
    assert ingest.ingest(spark, str(source), schema, staging).count() == 3
    assert sorted(r.n_rows for r in ingest.manifest(spark, staging).collect()) == [1, 2]
    with pytest.raises(ingest.FingerprintError):
        ingest.ingest(spark, str(source), schema, staging, version="2")
    put("a.json", 7, 8, 9)
    with pytest.raises(ingest.FingerprintError, match="a.json"):
        ingest.ingest(spark, str(source), schema, staging)
    ingest.clear(spark, staging)
    assert not FileSystem(spark).exists(staging)


def test_newest_run(spark, tmp_path):
    fs = FileSystem(spark)
    for name in ("r1", "r2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text("{}")
    (tmp_path / "r2" / "sweep.csv").write_text("")
    assert fs.newest(str(tmp_path), ("run.json", "sweep.csv")) == f"{tmp_path}/r2"
    assert fs.newest(str(tmp_path), ("absent",)) is None

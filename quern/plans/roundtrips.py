"""Queries that write tables and read them back through sources and sinks, each with its DuckDB statement.

What is written goes to a scratch folder beside the checkpoints. The statements know nothing of
files: a round trip must give back what the tables hold.
"""

from __future__ import annotations

import io
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.contracts import contract
from quern.operators import details, preprocess, ranking, runs, validate
from quern.plans import views
from quern.plans.reference import query
from quern.plans.views import EVALUATIONS_SQL, PAIRS_SQL, RECIPES, SEEDS, TARGET_SIZE, TARGET_STEP, table
from quern.session import scratch_folder
from quern.sources import archives, readers, sinks
from quern.sources.files import FileSystem
from quern.streaming import ingest

CUSTOMER = contract("customer", {"c_custkey": "int64", "c_name": "string", "c_nationkey": "int64", "c_acctbal": "float64", "c_mktsegment": "string"}, ("c_custkey",))
_CUSTOMER_SQL = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return CUSTOMER.project(table(spark, d, "customer"))


# -- readers -----------------------------------------------------------------------------------------


def _as_csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query(_CUSTOMER_SQL)
def q_strict_csv(spark, d):
    """Typed CSV without inference, its header checked."""
    path = _as_csv(_customers(spark, d), scratch_folder(spark, "customer"))
    return readers.strict_csv(spark, path, CUSTOMER)


@query("""SELECT source_priority, source_file, source_row, key, text FROM (SELECT CAST(0 AS INTEGER) AS source_priority, 'regions' AS source_file, row_number() OVER (ORDER BY r_regionkey) AS source_row, CAST(r_regionkey AS VARCHAR) AS key, r_name || chr(10) || '"q", ' || r_regionkey AS text FROM region
  UNION ALL SELECT 1, 'nations', row_number() OVER (ORDER BY n_nationkey), CAST(n_nationkey AS VARCHAR), n_name FROM nation)""")
def q_text_csv(spark, d):
    """All-text CSVs with priority, file and row number; fields hold quotes, commas and line ends."""
    folder = scratch_folder(spark, "texts")
    r = table(spark, d, "region").orderBy("r_regionkey").coalesce(1)
    n = table(spark, d, "nation").orderBy("n_nationkey").coalesce(1)
    _as_csv(r.select(F.col("r_regionkey").cast("string").alias("key"), F.concat("r_name", F.lit('\n"q", '), F.col("r_regionkey").cast("string")).alias("text")), f"{folder}/regions")
    _as_csv(n.select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("text")), f"{folder}/nations")
    return readers.text_csv(spark, [f"{folder}/regions", f"{folder}/nations"], ["key", "text"])


@query("SELECT s_name || chr(10) AS name, CAST(s_suppkey AS VARCHAR) AS key, 'suppliers' AS origin FROM supplier UNION ALL SELECT n_name, CAST(n_nationkey AS VARCHAR), 'nations' FROM nation")
def q_csv_files(spark, d):
    """Several CSVs read as one, with the file of each row."""
    folder = scratch_folder(spark, "files")
    _as_csv(table(spark, d, "supplier").select(F.concat("s_name", F.lit("\n")).alias("name"), F.col("s_suppkey").cast("string").alias("key")), f"{folder}/suppliers")
    _as_csv(table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("key")), f"{folder}/nations")
    df = readers.csv_with_filename(spark, [f"{folder}/suppliers", f"{folder}/nations"], ["name", "key"])
    return df.select("name", "key", F.element_at(F.split("filename", "/"), -2).alias("origin"))


@query("SELECT o_orderkey AS id, CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity AS DOUBLE) AS quantity, 'orders' AS task FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'")
def q_declared_json(spark, d):
    """Nested JSON lines read with a declared schema and named by their file."""
    path = scratch_folder(spark, "orders")
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("line"), F.struct(F.col("l_quantity").cast("double").alias("quantity")).alias("values")).alias("l"))
    nested = table(spark, d, "orders").where("o_orderstatus = 'O'").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderkey").alias("id")).agg(F.collect_list("l").alias("lines"))  # an order has seven lines at most
    nested.write.json(path)
    names = [(n, "orders") for n in FileSystem(spark).names(path) if n.endswith(".json")]
    df = readers.declared_json(spark, [path], "id bigint, lines array<struct<line:bigint,values:struct<quantity:double>>>", spark.createDataFrame(names, "filename string, task string"))
    return df.select("id", "task", F.explode("lines").alias("l")).select("id", "l.line", "l.values.quantity", "task")


@query("SELECT CAST(n_nationkey AS BIGINT) AS pair_index, n_name AS model_1, r_name AS model_2 FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_json_pairs(spark, d):
    """A JSON list of pairs whose number is checked."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy().agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", "r_name"))).alias("p"))  # 25 nations
    path = scratch_folder(spark, "pairs")
    rows.select(F.to_json(F.transform("p", lambda x: F.array(x["n_name"], x["r_name"]))).alias("value")).coalesce(1).write.text(path)
    return readers.json_pairs(spark, path, table(spark, d, "nation").count())


@query("SELECT s_suppkey, s_name, s_nationkey, s_suppkey * 2 AS twice FROM supplier WHERE s_suppkey IN (1, 3, 5, 8)")
def q_cache_and_ids(spark, d):
    """A JSON-lines cache without its derived column, and exactly the rows with given ids (which are the feature)."""
    path = scratch_folder(spark, "cache")
    twice = {"twice": F.col("s_suppkey") * 2}
    readers.write_cache(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").withColumns(twice), path, ["twice"])
    back = readers.read_cache(spark, path, "s_suppkey bigint, s_name string, s_nationkey bigint", twice)
    return readers.rows_by_id(back, [1, 3, 5, 8], "s_suppkey")


@query("SELECT CAST(r_regionkey + 1 AS INTEGER) AS line, CAST(1 AS INTEGER) AS start, CAST(4 AS INTEGER) AS \"end\", substring(r_name, 2, 3) AS text FROM region UNION ALL SELECT 99, 1, 4, NULL")
def q_file_slices(spark, d):
    """Character slices of the lines of a text file; an absent line has none."""
    path = scratch_folder(spark, "lines")
    regions = table(spark, d, "region")
    regions.orderBy("r_regionkey").select("r_name").coalesce(1).write.text(path)
    wanted = regions.select((F.col("r_regionkey") + 1).cast("int").alias("line")).union(spark.createDataFrame([(99,)], "line int"))
    return readers.text_slices(spark, path, wanted.select("line", F.lit(1).alias("start"), F.lit(4).alias("end")))


# -- archives -----------------------------------------------------------------------------------------


def _tar(files: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _archive_lines(spark: SparkSession, d: str) -> DataFrame:
    """An archive with a checkpoint per nation, a task per region in it and as many predictions as the region's number, read back."""
    nations = [r.n_nationkey for r in table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # 25
    regions = [(r.r_regionkey, r.r_name.lower().replace(" ", "_")) for r in table(spark, d, "region").orderBy("r_regionkey").collect()]  # 5

    def checkpoint(n: int) -> bytes:
        files = []
        for k, name in regions:
            predictions = "".join(f'{{"doc_id": {n * 10 + i}.0, "label": {i}, "task_hash": "t{k}", "model_hash": "m", "metrics": {{"acc_raw": {i % 2}}}, "model_output": [{{"sum_logits": -{i + 1}.5, "num_tokens": {i + 1}.0, "is_greedy": true}}, {{"num_chars": "7"}}]}}\n' for i in range(k))
            declared = k + (n == 3)
            metrics = f'{{"task_name": "{name}", "task_hash": "t{k}", "model_hash": "m", "num_instances": {declared}, "metrics": {{"acc_raw": 0.5}}, "task_config": {{"primary_metric": "acc_raw"}}}}'
            files += [(f"step-{n * 100}/{name}-predictions.jsonl", predictions.encode()), (f"step-{n * 100}/{name}-metrics.json", metrics.encode())]
        return _tar(files)

    path = f"{scratch_folder(spark, 'archive')}/all.tar.gz"
    FileSystem(spark).write_bytes(path, _tar([("readme.txt", b"x"), *[(f"c4/4M/seed-{n}/step-{n * 100}.tar.gz", checkpoint(n)) for n in nations]]))
    return archives.read_archives(spark, path)


_TASKS = "cells AS (SELECT n_nationkey AS n, r_regionkey AS k, lower(replace(r_name, ' ', '_')) AS task FROM nation CROSS JOIN region), predicted AS (SELECT n, k, task, unnest(range(0, k)) AS i FROM cells)"


@query(f"WITH {_TASKS} SELECT 'c4' AS recipe, '4M' AS params, CAST(n AS BIGINT) AS seed_value, CAST(n * 100 AS BIGINT) AS step, task, 't' || k AS task_hash, CAST(k + CASE WHEN n = 3 THEN 1 ELSE 0 END AS BIGINT) AS num_instances, CAST(k AS BIGINT) AS n_lines, 'acc_raw' AS primary_metric, 0.5::DOUBLE AS acc_raw FROM cells")
def q_archive_tasks(spark, d):
    return details.task_rows(_archive_lines(spark, d)).select("recipe", "params", "seed_value", "step", "task", "task_hash", "num_instances", "n_lines", "primary_metric", "acc_raw")


@query(f"WITH {_TASKS} SELECT CAST(n AS BIGINT) AS seed_value, task, CAST(i AS BIGINT) AS line_no, CAST(n * 10 + i AS BIGINT) AS doc_id, CAST(i AS BIGINT) AS label, CAST(2 AS INTEGER) AS n_choices, CAST(i % 2 AS DOUBLE) AS acc_raw FROM predicted")
def q_archive_instances(spark, d):
    return details.instance_rows(_archive_lines(spark, d)).select("seed_value", "task", "line_no", "doc_id", "label", "n_choices", "acc_raw")


@query(f"WITH {_TASKS} SELECT CAST(n AS BIGINT) AS seed_value, task, CAST(n * 10 + i AS BIGINT) AS doc_id, c AS choice_index, CASE WHEN c = 0 THEN -(i + 1.5)::DOUBLE END AS sum_logits, CASE WHEN c = 0 THEN CAST(i + 1 AS BIGINT) END AS num_tokens, CASE WHEN c = 1 THEN CAST(7 AS BIGINT) END AS num_chars, CASE WHEN c = 0 THEN TRUE END AS is_greedy FROM predicted CROSS JOIN (VALUES (0), (1)) v(c)")
def q_archive_choices(spark, d):
    return details.choice_rows(_archive_lines(spark, d)).select("seed_value", "task", "doc_id", "choice_index", "sum_logits", "num_tokens", "num_chars", "is_greedy")


@query(f"WITH {_TASKS} SELECT CAST(n AS BIGINT) AS seed_value, task, 'count' AS fault, CAST(1 AS BIGINT) AS n FROM cells WHERE n = 3")
def q_archive_faults(spark, d):
    """One nation's checkpoints declare a prediction too many."""
    return details.detail_faults(_archive_lines(spark, d)).select("seed_value", "task", "fault", "n")


# -- sinks --------------------------------------------------------------------------------------------


@query(f"WITH w AS ({_CUSTOMER_SQL}) SELECT * FROM w WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, c_name, c_nationkey, -1.0, c_mktsegment FROM w WHERE c_mktsegment = 'BUILDING'")
def q_written_table(spark, d):
    """A contract table written, validated and swapped in, then a group added and a group replaced."""
    path, rows = scratch_folder(spark, "customer"), _customers(spark, d)
    sinks.write_table(rows.where("c_mktsegment <> 'MACHINERY'"), path, CUSTOMER)
    sinks.add_groups(spark, path, rows, CUSTOMER, "c_mktsegment")
    sinks.upsert_group(spark, path, rows.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.lit(-1.0)), CUSTOMER, "c_mktsegment", "BUILDING")
    return spark.read.parquet(path)


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_id, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def q_measurements(spark, d):
    """A measurement table with row ids in a total order, written as Parquet."""
    path = f"{scratch_folder(spark, 'measured')}.parquet"
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    sinks.write_measurements(table(spark, d, "lineitem").select(*keys), path, keys)
    return spark.read.parquet(path)


@query("SELECT o_orderstatus, o_orderkey, o_custkey FROM orders")
def q_shards(spark, d):
    """One folder per group, hot groups in several files."""
    path = scratch_folder(spark, "shards")
    sinks.write_shards(table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_custkey"), path, "o_orderstatus", ["o_orderkey"])
    return spark.read.parquet(path).select("o_orderstatus", "o_orderkey", "o_custkey")


@query("SELECT CAST(n_regionkey AS BIGINT) AS claim, CAST(n_nationkey AS BIGINT) AS row_id, n_name AS quote FROM nation")
def q_evidence(spark, d):
    """Nested evidence of an exact schema, written and read."""
    path = scratch_folder(spark, "evidence")
    nested = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("bigint").alias("claim")).agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").cast("bigint").alias("row_id"), F.col("n_name").alias("quote")))).alias("rows"))  # 25 nations
    sinks.write_evidence(nested, path, nested.schema)
    return sinks.read_evidence(spark, path, nested.schema).select("claim", F.explode("rows").alias("r")).select("claim", "r.row_id", "r.quote")


@query("SELECT event_type AS kind, COUNT(*) AS n_rows FROM events GROUP BY 1")
def q_staged_ingest(spark, d):
    """Files staged by a stream in two rounds; the staged totals per kind are those that are declared."""
    folder = scratch_folder(spark, "ingest")
    rows = table(spark, d, "events").select(F.col("event_id").cast("bigint").alias("event_id"), F.col("event_type").alias("kind"))
    for even in (0, 1):  # the second round finds the files of the first done
        rows.where(F.col("event_id") % 2 == even).write.mode("append").json(f"{folder}/in")
        staged = ingest.ingest(spark, f"{folder}/in", rows.schema, f"{folder}/staged", files_per_batch=5)
    kinds = sorted(r[0] for r in rows.select("kind").distinct().collect())  # a closed list
    declared = rows.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    sinks.require_totals(staged, declared, {k: k for k in kinds})
    return staged.groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"))


# -- pipelines and reports ---------------------------------------------------------------------------------


_RAW_SQL = "SELECT row_id, params, recipe AS data, CAST(seed_value AS VARCHAR) AS seed, step, train_cross_entropy AS x FROM checkpoint_losses WHERE step >= 0"


@query(f"SELECT params, data, seed, step, CASE WHEN isnan(x) THEN NULL ELSE x END AS c4_en_valppl, CASE WHEN x > 0 THEN NULL ELSE x END AS pile_valppl, CAST(NULL AS DOUBLE) AS ice_valppl, step * per_step AS tokens FROM ({_RAW_SQL}) JOIN (VALUES {{sizes}}) s(name, per_step) ON params = name".replace("{sizes}", ", ".join(f"('{r['params']}', {r['tokens_per_step']})" for r in preprocess.schedule_rows())))
def q_preprocess_ppl(spark, d):
    """Raw perplexities as text (NaN, blanks and steps like 12.0 among them) to the enriched table."""
    t = table(spark, d, "checkpoint_losses").where("step >= 0")
    x = F.col("train_cross_entropy").cast("string")
    raw = t.select("params", F.col("recipe").alias("data"), F.col("seed_value").cast("string").alias("seed"), F.concat(F.col("step").cast("string"), F.lit(".0")).alias("step"), x.alias(preprocess.PPL_COLUMNS["c4_en_valppl"]), F.when(F.col("train_cross_entropy") > 0, "n/a").otherwise(x).alias(preprocess.PPL_COLUMNS["pile_valppl"]))
    return preprocess.preprocess_ppl(raw).select("params", "data", "seed", "step", "c4_en_valppl", "pile_valppl", "ice_valppl", "tokens")


_AGGREGATE = "SELECT params, recipe, seed, step, task, CASE WHEN isnan(acc_raw) THEN NULL ELSE acc_raw END AS acc_raw, CASE WHEN isnan(acc_per_char) THEN NULL ELSE acc_per_char END AS acc_per_char, CASE WHEN isnan(acc_uncond) THEN NULL ELSE acc_uncond END AS acc_uncond FROM tasks"
_POLICY = " ".join(f"WHEN task = '{t}' THEN {m}" for t, m in preprocess.PRIMARY_METRIC.items())


def _aggregate(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tasks")
    metrics = F.to_json(F.struct(*[F.when(~F.isnan(m), F.col(m)).alias(m) for m in ("acc_raw", "acc_per_char", "acc_uncond")]))
    return t.select("params", F.col("recipe").alias("data"), "seed", F.col("step").cast("double").alias("step"), "task", "tokens", "compute", F.replace(metrics, F.lit('"'), F.lit("'")).alias("metrics"))


@query(f"SELECT params, recipe AS data, seed, step, task, acc_raw, acc_per_char, CAST(NULL AS DOUBLE) AS logits_per_byte_corr, CASE WHEN starts_with(task, 'mmlu_') THEN acc_raw {_POLICY} END AS primary_metric FROM ({_AGGREGATE})")
def q_preprocess_aggregate(spark, d):
    """Aggregate results with metrics in single-quoted JSON to typed metrics and the task's primary one."""
    return preprocess.preprocess_aggregate(_aggregate(spark, d)).select("params", "data", "seed", "step", "task", "acc_raw", "acc_per_char", "logits_per_byte_corr", "primary_metric")


@query("SELECT task, step, kind FROM (SELECT task, step, CASE WHEN recipe IN ('c4', 'falcon') THEN 'data' WHEN step % 25 = 0 THEN 'tokens' END AS kind FROM tasks) WHERE kind IS NOT NULL")
def q_aggregate_violations(spark, d):
    """The first fault of each aggregate row: recipes that are not listed, and tokens shifted on purpose on every 25th step."""
    raw = _aggregate(spark, d).withColumn("compute", F.lit(None).cast("double")).withColumn("tokens", F.when(F.col("step") % 25 == 0, -1).otherwise(F.lit(None)).cast("bigint"))
    listed = [r[0] for r in table(spark, d, "recipes").where("recipe NOT IN ('c4', 'falcon')").select("recipe").collect()]  # a closed list
    seeds = [r[0] for r in table(spark, d, "seeds").select("seed").collect()]
    return preprocess.aggregate_violations(raw, listed, seeds, ["task", "step"]).select("task", F.col("step").cast("bigint").alias("step"), "kind")


@query("SELECT 'nations.csv' AS source_file, 'all' AS source_unit, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE n_regionkey = 1) AS n_faulty FROM nation UNION ALL SELECT 'suppliers.csv', 'half', COUNT(*), COUNT(*) FILTER (WHERE s_nationkey = 1 OR s_acctbal < 0) FROM supplier")
def q_published_faults(spark, d):
    """Sources of one schema as one multiset, with their rows and those that lack a required cell."""
    n = table(spark, d, "nation").select(F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("name"), F.lit(1.0).alias("v"))
    s = table(spark, d, "supplier").select(F.when(F.col("s_nationkey") != 1, F.col("s_name")).otherwise(" ").alias("name"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal").cast("double")).alias("v"))
    return preprocess.published_faults(preprocess.published_union([(n, "nations.csv", "all"), (s, "suppliers.csv", "half")]), {"name": "string", "v": "float64"})


@query(f"""WITH {PAIRS_SQL}, per AS (SELECT params, step, task, metric, recipe, AVG(score) AS m, stddev_pop(score) AS s FROM evals GROUP BY 1, 2, 3, 4, 5), n AS (SELECT params, step, task, metric, AVG(s) AS noise, stddev_pop(m) AS spread FROM per GROUP BY 1, 2, 3, 4)
  SELECT params, step, task, metric, f.available, round(CASE WHEN f.available THEN noise END, 6) AS noise, round(CASE WHEN f.available THEN spread END, 6) AS spread, round(CASE WHEN a.available THEN a.decision_accuracy END, 6) AS decision_accuracy
  FROM full_cells f JOIN n USING (params, step, task, metric) LEFT JOIN accuracies a USING (params, step, task, metric)""")
def q_score_measurements(spark, d):
    """Noise, spread and decision accuracy of every cell; cells that are not complete stay without values."""
    rows = views.evaluations(spark, d)
    found = ranking.score_measurements(rows, ranking.decision_accuracies(rows, TARGET_SIZE, TARGET_STEP, RECIPES, SEEDS), RECIPES, SEEDS)["noise_spread"]
    return found.select("params", "step", "task", "metric", "available", *[F.round(c, 6).alias(c) for c in ("noise", "spread", "decision_accuracy")])


@query("SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE recipe IS NULL) AS null_recipe, COUNT(*) FILTER (WHERE params IS NULL) AS null_params, COUNT(*) FILTER (WHERE step IS NULL) AS null_step, (SELECT COUNT(*) FROM (SELECT 1 FROM tasks GROUP BY recipe, params, step HAVING COUNT(*) > 1)) AS repeated_keys FROM tasks")
def q_table_report(spark, d):
    """Rows, NULLs in required columns and repeated keys of a table under a contract, in one row."""
    shape = contract("tasks", {"recipe": "string", "params": "string", "step": "int64", "acc_raw": "float64"}, ("recipe", "params", "step"))
    return validate.table_report(shape.project(table(spark, d, "tasks")), shape)


@query("SELECT s_suppkey AS model, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 10 END, s_suppkey * 11) AS step, CASE WHEN s_suppkey % 3 = 0 THEN 'list' ELSE 'paper' END AS basis, s_suppkey % 3 <> 0 OR s_suppkey = 0 AS run_completed, s_suppkey % 3 <> 0 OR s_suppkey = 0 AS valid FROM supplier")
def q_final_steps(spark, d):
    """The chosen final step of made-up models: a list first, then the paper."""
    k = F.col("s_suppkey")
    evidence = table(spark, d, "supplier").select(k.alias("model"), F.when(k % 3 == 0, k * 10).alias("listed_step"), (k * 11).alias("paper_step"), (k * 9).alias("last_evaluated_step"), F.array(k, k * 11).alias("branch_steps"))
    return runs.final_steps(evidence).select("model", "step", "basis", "run_completed", "valid")


@query("SELECT run_id, row_id, step, method, n_rows FROM checkpoint_losses JOIN (SELECT run_id, CASE WHEN MAX(step) % 2 = 0 THEN 'dpo' ELSE 'finetune' END AS method, COUNT(*) AS n_rows FROM checkpoint_losses GROUP BY 1) USING (run_id)")
def q_joined_history(spark, d):
    """History rows with their run's training method; names that both have are the run's by suffix."""
    t = table(spark, d, "checkpoint_losses")
    per_run = t.groupBy("run_id").agg(F.max("step").alias("step"), F.count(F.lit(1)).alias("n_rows"))
    methods = runs.training_method(per_run.withColumn("dpo_beta", F.when(F.col("step") % 2 == 0, 0.1)), ["dpo_beta"])
    return runs.joined_history(methods, t.select("run_id", "row_id", "step")).select("run_id", "row_id", "step", "method", "n_rows")


@query("SELECT l_returnflag, l_linestatus, l_quantity, l_tax FROM lineitem")
def q_column_groups(spark, d):
    """Columns of groups, in order and once, then those whose names hold both texts; columns without values dropped."""
    rows = table(spark, d, "lineitem").withColumn("empty", F.lit(None).cast("double"))
    return runs.selected_columns(runs.without_null_columns(rows, ["empty", "gone"]), [["l_returnflag", "gone"], ["l_linestatus", "l_returnflag"], ["l_quantity"]], [("l_t", "ax")])


@query(f"WITH {EVALUATIONS_SQL} SELECT 'c4-' || params AS name, COUNT(*) AS n FROM (SELECT DISTINCT params, step FROM evals) GROUP BY params")
def q_same_name(spark, d):
    """Names compared without regard to case."""
    from quern.functions.scalar import same_ignoring_case

    points = views.evaluations(spark, d).select("params", "step").distinct().select("step", F.concat(F.lit("c4-"), "params").alias("name"))
    names = points.select(F.upper("name").alias("upper"), "name").distinct()
    return points.join(names.withColumnRenamed("name", "shown"), same_ignoring_case(F.col("name"), F.col("upper"))).groupBy(F.col("shown").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS whole, n_regionkey / 2.0 AS number, n_regionkey = 1 AS flag, n_name, '[' || n_nationkey || ',1]' AS list, CAST(n_regionkey AS BIGINT) AS whole_double FROM nation")
def q_inferred_types(spark, d):
    """Texts, doubles and lists in the narrowest types that hold all their values."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    texts = table(spark, d, "nation").select(
        F.concat(k.cast("string"), F.lit(".0")).alias("whole"), (r / 2).cast("string").alias("number"), F.when(r == 1, "True").otherwise("false").alias("flag"), "n_name",
        F.array(k, F.lit(1)).alias("list"), r.cast("double").alias("whole_double"),
    )
    return runs.inferred_types(texts)


@query("SELECT DISTINCT recipe, params, upper(recipe) AS data FROM tasks")
def q_model_columns(spark, d):
    """Recipe and size class of models from their paths and parameter counts (off by a hundredth)."""
    from quern.operators.schedule import EXACT_COUNTS

    counts = F.create_map(*[F.lit(x) for pair in EXACT_COUNTS.items() for x in pair])
    models = table(spark, d, "tasks").select("recipe", "params").distinct().select("recipe", F.concat(F.lit("hub/Ladder-"), "recipe", F.lit("-"), "params", F.lit("/snapshots/0a1b")).alias("model_name_or_path"), (counts[F.col("params")] * 1.01).alias("model_size"))
    official = {r.recipe: r.recipe.upper() for r in table(spark, d, "recipes").select("recipe").collect()}  # 25 recipes
    return runs.model_columns(models, prefix="Ladder-", names=official).select("recipe", "params", "data")


@query("SELECT CAST(n_regionkey AS BIGINT) AS claim_id, CAST(n_nationkey AS BIGINT) AS row_id, substring(r_name, 1, 4) AS quote, n_name AS evidence FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_claim_report(spark, d):
    """Claims with the words they quote from a text and the rows that bear them out."""
    path = scratch_folder(spark, "report")
    table(spark, d, "region").orderBy("r_regionkey").select("r_name").coalesce(1).write.text(path)
    claims = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("claim_id"), (F.col("r_regionkey") + 1).cast("int").alias("line"), F.lit(0).alias("start"), F.lit(4).alias("end"))
    evidence = readers.rows_relation(spark, [], "claim_id bigint, row_id bigint, evidence string").unionByName(table(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("claim_id"), F.col("n_nationkey").cast("bigint").alias("row_id"), F.col("n_name").alias("evidence")))
    return readers.text_slices(spark, path, claims).join(evidence, "claim_id").select("claim_id", "row_id", F.col("text").alias("quote"), "evidence")

"""Detail archives to tasks, instances and choices, with their consistency faults.

Input rows are those of ``sources.archives``: one per prediction line, with the task's
metrics text on each. Nested JSON is read with declared schemas; leaves stay text and
are cast where they are used, so a leaf of another type is NULL and not a failed read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import whole_number

CHECKPOINT = ("recipe", "params", "seed_value", "step")
TASK = (*CHECKPOINT, "task")
# Members of a task document and of a prediction line.
_TASK_SHAPE = "task_name string, task_hash string, model_hash string, model_config string, task_config string, compute_config string, processing_time string, current_date string, num_instances string, metrics map<string,string>, task_idx string"
_LINE_SHAPE = "doc_id string, native_id string, label string, task_hash string, model_hash string, metrics map<string,string>, model_output array<struct<sum_logits:string,num_tokens:string,num_tokens_all:string,is_greedy:string,sum_logits_uncond:string,logits_per_token:string,logits_per_char:string,logits_per_byte:string,num_chars:string>>"
_INT = ("num_tokens", "num_tokens_all", "num_chars")
_FLOAT = ("sum_logits", "sum_logits_uncond", "logits_per_token", "logits_per_char", "logits_per_byte")


def _finite(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def task_rows(lines: DataFrame, metrics: tuple[str, ...] = ("acc_raw", "acc_per_token", "acc_per_char", "acc_per_byte", "acc_uncond", "primary_score")) -> DataFrame:
    """One row per checkpoint and task; ``n_lines`` counts its predictions."""
    one = lines.groupBy(*TASK).agg(F.min("metrics").alias("text"), F.count("prediction").alias("n_lines"))
    t = one.withColumn("t", F.from_json("text", _TASK_SHAPE))
    return t.select(
        *TASK, "t.task_name", "t.task_hash", "t.model_hash", "t.model_config", "t.task_config", "t.compute_config", _finite(F.col("t.processing_time")).alias("processing_time"), F.col("t.current_date").alias("current_date"),
        whole_number(F.col("t.num_instances")).alias("num_instances"), F.get_json_object("t.task_config", "$.primary_metric").alias("primary_metric"), "n_lines",
        *[_finite(F.try_element_at("t.metrics", F.lit(m))).alias(m) for m in metrics],
    )


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.where("prediction IS NOT NULL").select(*TASK, "line_no", F.from_json("prediction", _LINE_SHAPE).alias("p"))


def instance_rows(lines: DataFrame, metrics: tuple[str, ...] = ("acc_raw", "acc_per_token", "acc_per_char", "acc_per_byte", "acc_uncond", "correct_choice", "predicted_index_raw")) -> DataFrame:
    """One row per prediction line."""
    return _parsed(lines).select(
        *TASK, "line_no", whole_number(F.col("p.doc_id")).alias("doc_id"), F.col("p.native_id").alias("native_id"), whole_number(F.col("p.label")).alias("label"), F.col("p.task_hash").alias("task_hash"), F.col("p.model_hash").alias("model_hash"),
        F.coalesce(F.array_size("p.model_output"), F.lit(0)).alias("n_choices"), *[_finite(F.try_element_at("p.metrics", F.lit(m))).alias(m) for m in metrics],
    )


def choice_rows(lines: DataFrame) -> DataFrame:
    """One row per choice, with its 0-based index; predictions without choices give none."""
    c = _parsed(lines).select(*TASK, whole_number(F.col("p.doc_id")).alias("doc_id"), F.posexplode("p.model_output").alias("choice_index", "c"))
    return c.select(*TASK, "doc_id", "choice_index", *[_finite(F.col(f"c.{f}")).alias(f) for f in _FLOAT], *[whole_number(F.col(f"c.{f}")).alias(f) for f in _INT], F.col("c.is_greedy").try_cast("boolean").alias("is_greedy"))


def detail_faults(lines: DataFrame) -> DataFrame:
    """(checkpoint, task, fault, n): what contradicts itself in an archive.

    ``metrics`` unreadable or under another task's name, ``hash`` of a line unlike its task's,
    ``doc_id`` missing or given twice, ``count`` of lines unlike the declared one.
    """
    tasks, instances = task_rows(lines), instance_rows(lines)
    named = tasks.where(F.col("task_name").isNull() | (F.col("task_name") != F.col("task"))).select(*TASK, F.lit("metrics").alias("fault"), F.lit(1).cast("bigint").alias("n"))
    counted = tasks.where(~F.col("num_instances").eqNullSafe(F.col("n_lines"))).select(*TASK, F.lit("count").alias("fault"), F.abs(F.coalesce("num_instances", F.lit(0)) - F.col("n_lines")).alias("n"))
    hashes = tasks.select(*TASK, F.col("task_hash").alias("_t"), F.col("model_hash").alias("_m"))
    unlike = ~F.col("task_hash").eqNullSafe(F.col("_t")) | ~F.col("model_hash").eqNullSafe(F.col("_m"))
    hashed = instances.join(hashes, list(TASK)).where(unlike).groupBy(*TASK).agg(F.count(F.lit(1)).alias("n")).select(*TASK, F.lit("hash").alias("fault"), "n")
    docs = instances.groupBy(*TASK, "doc_id").agg(F.count(F.lit(1)).alias("k")).where("doc_id IS NULL OR k > 1").groupBy(*TASK).agg(F.sum("k").alias("n")).select(*TASK, F.lit("doc_id").alias("fault"), "n")
    return named.unionByName(counted).unionByName(hashed).unionByName(docs)

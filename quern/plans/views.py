"""Analytic views over the test tables, and the same views as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECIPES, SEEDS, TOTAL_STEPS = 25, 3, 2000
TARGET_SIZE, TARGET_STEP = "1-URGENT", 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Order lines seen as experiments: priority is the size, year the step, nation the recipe.

    Quantities are whole, so sums and means are exact in any order of summation.
    """
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("params"), F.year("o_orderdate").cast("bigint").alias("step"))
    people = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("recipe"))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("task"), F.concat(F.lit("s"), (F.col("l_linenumber") % SEEDS).cast("string")).alias("seed"), "l_quantity")
    flat = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(people, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    cells = flat.groupBy("params", "step", "task", "recipe", "seed").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    spent = cells.groupBy("params", "step").agg(F.sum("q").alias("q"))
    compute = spent.select("params", "step", F.sum("q").over(Window.partitionBy("params").orderBy("step")).alias("compute"))
    both = F.array(F.struct(F.lit("qty").alias("metric"), (F.col("q") / F.col("n")).alias("score")), F.struct(F.lit("lines").alias("metric"), F.col("n").cast("double").alias("score")))
    return cells.join(compute, ["params", "step"]).select("params", "step", "compute", F.lit(TOTAL_STEPS).cast("bigint").alias("total_steps"), "task", "recipe", "seed", F.explode(both).alias("m")).select("params", "step", "compute", "total_steps", "task", "m.metric", "recipe", "seed", "m.score")


EVALUATIONS_SQL = f"""
flat AS (
  SELECT o_orderpriority AS params, CAST(year(o_orderdate) AS BIGINT) AS step, l_returnflag AS task, n_name AS recipe,
         's' || CAST(l_linenumber % {SEEDS} AS VARCHAR) AS seed, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
spent AS (
  SELECT params, step, SUM(q) OVER (PARTITION BY params ORDER BY step) AS compute
  FROM (SELECT params, step, SUM(l_quantity) AS q FROM flat GROUP BY params, step)),
cells AS (
  SELECT params, step, task, recipe, seed, SUM(l_quantity) / COUNT(*) AS qty, CAST(COUNT(*) AS DOUBLE) AS n
  FROM flat GROUP BY params, step, task, recipe, seed),
evals AS (
  SELECT params, step, compute, CAST({TOTAL_STEPS} AS BIGINT) AS total_steps, task, 'qty' AS metric, recipe, seed, qty AS score
  FROM cells JOIN spent USING (params, step)
  UNION ALL
  SELECT params, step, compute, CAST({TOTAL_STEPS} AS BIGINT), task, 'lines', recipe, seed, n FROM cells JOIN spent USING (params, step))"""

#: Complete cells with one row per recipe pair; seeds and seed means.
PAIRS_SQL = f"""{EVALUATIONS_SQL},
full_cells AS (
  SELECT params, step, task, metric, COUNT(*) = {RECIPES * SEEDS} AS available, COUNT(DISTINCT seed) AS n_seeds,
         COUNT(DISTINCT recipe) AS n_recipes, MIN(compute) AS compute
  FROM evals GROUP BY params, step, task, metric),
seed_full AS (
  SELECT params, step, task, metric, SUM(CASE WHEN n = {RECIPES} THEN 1 ELSE 0 END) AS n_full
  FROM (SELECT params, step, task, metric, seed, COUNT(*) AS n FROM evals GROUP BY params, step, task, metric, seed)
  GROUP BY params, step, task, metric),
means AS (
  SELECT params, step, task, metric, recipe,
         ((SUM(CASE WHEN seed = 's0' THEN score END) + SUM(CASE WHEN seed = 's1' THEN score END)) + SUM(CASE WHEN seed = 's2' THEN score END)) / {SEEDS} AS score
  FROM evals GROUP BY params, step, task, metric, recipe),
target_pairs AS (
  SELECT a.task, a.metric, a.recipe AS r1, b.recipe AS r2, sign(a.score - b.score) AS s
  FROM means a JOIN means b ON a.params = b.params AND a.step = b.step AND a.task = b.task AND a.metric = b.metric AND a.recipe < b.recipe
  WHERE a.params = '{TARGET_SIZE}' AND a.step = {TARGET_STEP}),
target_cells AS (
  SELECT task, metric, compute AS target_compute, available AS target_available FROM full_cells
  WHERE params = '{TARGET_SIZE}' AND step = {TARGET_STEP} AND compute > 0),
seed_accuracy AS (
  SELECT a.params, a.step, a.task, a.metric, a.seed, AVG(CASE WHEN sign(a.score - b.score) = t.s THEN 1.0 ELSE 0.0 END) AS acc
  FROM evals a JOIN evals b ON a.params = b.params AND a.step = b.step AND a.task = b.task AND a.metric = b.metric AND a.seed = b.seed AND a.recipe < b.recipe
  JOIN target_pairs t ON t.task = a.task AND t.metric = a.metric AND t.r1 = a.recipe AND t.r2 = b.recipe
  GROUP BY a.params, a.step, a.task, a.metric, a.seed),
mean_accuracy AS (
  SELECT a.params, a.step, a.task, a.metric, AVG(CASE WHEN sign(a.score - b.score) = t.s THEN 1.0 ELSE 0.0 END) AS acc
  FROM means a JOIN means b ON a.params = b.params AND a.step = b.step AND a.task = b.task AND a.metric = b.metric AND a.recipe < b.recipe
  JOIN target_pairs t ON t.task = a.task AND t.metric = a.metric AND t.r1 = a.recipe AND t.r2 = b.recipe
  GROUP BY a.params, a.step, a.task, a.metric),
accuracies AS (
  SELECT c.params, c.step, c.task, c.metric, c.compute, t.target_compute, c.compute / t.target_compute AS compute_ratio,
         c.available AND t.target_available AS available,
         CASE WHEN NOT c.available THEN CASE WHEN c.n_seeds <> {SEEDS} THEN 'missing seeds' ELSE 'missing recipes' END
              WHEN NOT t.target_available THEN 'target: missing' ELSE '' END AS reason,
         CASE WHEN c.available AND t.target_available THEN s.acc END AS decision_accuracy,
         CASE WHEN c.available AND t.target_available THEN s.std END AS accuracy_std,
         CASE WHEN c.available AND t.target_available THEN m.acc END AS aggregate_decision_accuracy
  FROM full_cells c JOIN target_cells t USING (task, metric)
  LEFT JOIN (SELECT params, step, task, metric, AVG(acc) AS acc, stddev_pop(acc) AS std FROM seed_accuracy GROUP BY params, step, task, metric) s USING (params, step, task, metric)
  LEFT JOIN mean_accuracy m USING (params, step, task, metric)
  WHERE c.compute > 0 AND c.compute <= t.target_compute)"""

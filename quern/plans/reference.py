"""Queries for the relational and domain operators, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.contracts import contract
from quern.functions.numbers import finite_double, whole_number
from quern.functions.scalar import answer_index, by_policy, canonical_json, continuations, directed_sign, first_largest, json_id, json_kind, json_leaf, mapped, query_text, round_to_multiple, short_number, size_number, size_rank, text_sizes, text_slice
from quern.operators import aggregates as agg
from quern.operators import diagnostics, ranking, relational, runs, schedule, validate, verify
from quern.operators.preprocess import PRIMARY_METRIC, json_metrics, parse_literal_metrics, schedule_ratios
from quern.operators.scoring import choice_differences, compare_joined, mismatches, published_items
from quern.plans import choice_sql, scaling_sql, views
from quern.sources.readers import TableCatalog, parquet_with_ordinal
from quern.plans.views import EVALUATIONS_SQL, PAIRS_SQL, RECIPES, SEEDS, TARGET_SIZE, TARGET_STEP, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


# -- scans, projections, filters ---------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_returnflag = 'R'")
def q_scan_project_filter(spark, d):
    """Projection and filter of a catalog table that reach the Parquet scan."""
    catalog = TableCatalog(spark, d, {"lineitem": "lineitem.parquet"})
    since = F.lit("1998-01-01").cast(dict(table(spark, d, "lineitem").dtypes)["l_shipdate"])  # a cast of the column would keep the filter out of the scan
    rows = catalog.read("lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], (F.col("l_shipdate") >= since) & (F.col("l_returnflag") == "R"))
    return rows.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("quantity"))


@query("SELECT l_orderkey, l_linenumber, CAST(copy_no AS BIGINT) AS copy_no FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS copy_no FROM lineitem) WHERE copy_no > 1")
def q_row_ordinal_duplicates(spark, d):
    found = validate.repeated_rows(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    return found.select("l_orderkey", "l_linenumber", F.col("copy_no").cast("bigint").alias("copy_no"))


@query("SELECT l_orderkey, l_linenumber, COUNT(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def q_duplicate_keys(spark, d):
    return validate.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT o_orderkey, kind, value FROM (SELECT o_orderkey,
  CASE WHEN o_orderstatus IS NULL OR o_orderstatus NOT IN ('O', 'F') THEN 'o_orderstatus' WHEN o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'o_orderpriority' WHEN o_totalprice < 1000 THEN 'price' END AS kind,
  CASE WHEN o_orderstatus IS NULL OR o_orderstatus NOT IN ('O', 'F') THEN o_orderstatus WHEN o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority END AS value FROM orders) WHERE kind IS NOT NULL""")
def q_domain_violations(spark, d):
    rules = [validate.outside_domain("o_orderstatus", ["O", "F"]), validate.outside_domain("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]), validate.Rule("price", F.col("o_totalprice") < 1000)]
    return validate.violations(table(spark, d, "orders"), rules, ["o_orderkey"]).drop("rule_no")


@query("SELECT o_orderkey, 'priority' AS kind FROM orders WHERE o_orderpriority IS NULL OR o_orderpriority <> '1-URGENT' ORDER BY o_orderkey LIMIT 1")
def q_first_violation(spark, d):
    """The first offending row by ordinal: a top-1, not a sort."""
    rule = validate.Rule("priority", F.col("o_orderpriority").isNull() | (F.col("o_orderpriority") != "1-URGENT"))
    return validate.first_violation(table(spark, d, "orders"), [rule], ["o_orderkey"]).select("o_orderkey", "kind")


@query("""SELECT eval_id, CASE WHEN d = trunc(d) AND d BETWEEN -9223372036854775808 AND 9223372036854775807 THEN CAST(d AS BIGINT) END AS step_value
  FROM (SELECT eval_id, TRY_CAST(TRY_CAST(trim(step) AS DOUBLE) AS DECIMAL(38,9)) AS d FROM evaluations)""")
def q_integral_text_cast(spark, d):
    return table(spark, d, "evaluations").select("eval_id", whole_number(F.col("step")).alias("step_value"))


@query("SELECT p_partkey, p_name, CAST(NULL AS DOUBLE) AS wikitext_ppl, CAST(p_size AS BIGINT) AS p_size FROM part")
def q_typed_nulls_missing_col(spark, d):
    shape = contract("part", {"p_partkey": "int64!", "p_name": "string", "wikitext_ppl": "float64", "p_size": "int64"}, ("p_partkey",))
    return shape.project(table(spark, d, "part"), {"wikitext_ppl": "eval/wikitext/Perplexity"})


@query("SELECT 'customer.parquet' AS source_file, 'customer' AS source_unit, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier.parquet', 'supplier', s_suppkey, s_nationkey FROM supplier")
def q_provenance_union(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return relational.provenance(a, "customer.parquet", "customer").unionByName(relational.provenance(b, "supplier.parquet", "supplier"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' END AS label FROM orders")
def q_case_mapping(spark, d):
    return table(spark, d, "orders").select("o_orderkey", mapped(F.col("o_orderpriority"), {"1-URGENT": "urgent", "2-HIGH": "high"}).alias("label"))


_POLICY_SQL = " ".join(f"WHEN task = '{t}' THEN {m}" for t, m in PRIMARY_METRIC.items())


@query(f"SELECT recipe, params, seed_value, step, task, loaded_at, CASE WHEN starts_with(task, 'mmlu_') THEN acc_raw {_POLICY_SQL} END AS policy_score FROM tasks")
def q_policy_case(spark, d):
    """The metric a task's policy names, a name prefix first."""
    t = table(spark, d, "tasks")
    score = by_policy(F.col("task"), {c: F.col(c) for c in ("acc_raw", "acc_per_char", "acc_uncond")}, "mmlu_", "acc_raw", PRIMARY_METRIC)
    return t.select("recipe", "params", "seed_value", "step", "task", "loaded_at", score.alias("policy_score"))


@query("SELECT doc_id, source, lang FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('de', 'fr') AND source NOT IN ('glossary')")
def q_exclusion_3vl(spark, d):
    """Exclusion with SQL's three-valued logic: a NULL source falls out."""
    return table(spark, d, "documents").where("lang IS NOT NULL AND lang NOT IN ('de', 'fr') AND source NOT IN ('glossary')").select("doc_id", "source", "lang")


@query("SELECT a.doc_id, a.lang, b.lang AS other_lang FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.lang IS DISTINCT FROM b.lang")
def q_null_safe_compare(spark, d):
    t = table(spark, d, "documents")
    b = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("other_lang"))
    return t.select("doc_id", "lang").join(b, "doc_id").where(~F.col("lang").eqNullSafe(F.col("other_lang")))


@query("SELECT source_group FROM evaluations WHERE source_group IS NULL OR trim(source_group) = '' OR source_group <> trim(source_group) OR regexp_matches(source_group, '^\\s|\\s$')")
def q_untidy_text(spark, d):
    from quern.functions.scalar import tidy

    return table(spark, d, "evaluations").where(~tidy(F.col("source_group"))).select("source_group")


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT MAX(first_ts) FROM (SELECT event_type, MIN(ts) AS first_ts FROM events GROUP BY event_type))")
def q_align_start(spark, d):
    return relational.aligned_start(table(spark, d, "events"), "event_type", "ts").select("event_id", "user_id")


@query("SELECT row_id, run_id FROM checkpoint_losses WHERE strftime(logged_at, '%Y-%m-%d') >= '2025-01-01' AND coalesce(recipe, '') NOT LIKE '%falcon%'")
def q_text_date_and_substring(spark, d):
    """ISO dates compared as text, and a null-safe exclusion of tagged runs (falcon runs are given the tag here)."""
    tags = F.when(F.col("recipe").contains("falcon"), F.concat(F.lit("old,"), F.lit(runs.CACHE_TAG))).otherwise(F.col("recipe"))
    t = table(spark, d, "checkpoint_losses").withColumn("day", F.date_format("logged_at", "yyyy-MM-dd")).withColumn("tags", tags)
    return runs.usable_runs(t, "day", "tags", earliest="2025-01-01").select("row_id", "run_id")


@query(f"WITH {EVALUATIONS_SQL} SELECT recipe, seed, score FROM evals WHERE params = '{TARGET_SIZE}' AND step = {TARGET_STEP} AND task = 'R' AND metric = 'qty'")
def q_checkpoint_lookup(spark, d):
    return views.evaluations(spark, d).where((F.col("params") == TARGET_SIZE) & (F.col("step") == TARGET_STEP) & (F.col("task") == "R") & (F.col("metric") == "qty")).select("recipe", "seed", "score")


# -- joins -----------------------------------------------------------------------------


@query("""SELECT t.recipe, t.params, t.seed_value, t.step, t.task, t.loaded_at, t.tokens AS stored_tokens, CAST(regexp_replace(t.params, '[MB]$', '') AS BIGINT) * CASE WHEN t.params LIKE '%B' THEN 1000 ELSE 1 END AS size_rank FROM tasks t""")
def q_enrichment_join(spark, d):
    """Schedule columns by broadcast join; sizes are ranked numerically."""
    t = table(spark, d, "tasks").select("recipe", "params", "seed_value", "step", "task", "loaded_at", F.col("tokens").alias("stored_tokens"))
    rich = schedule.enrich(t, details=False)
    return rich.select("recipe", "params", "seed_value", "step", "task", "loaded_at", "stored_tokens", size_rank(F.col("params")).cast("bigint").alias("size_rank"))


def _schedule_values() -> str:
    return ", ".join(f"('{r['params']}', {r['tokens_per_step']}, {r['exact_parameter_count']}, {r['warmup_steps']}, {r['lr_decay_steps']}, {r['lr_max']!r}, {r['lr_final']!r}, {r['total_steps']})" for r in schedule.schedule_rows())


SCHEDULE_SQL = f"sched(params, tokens_per_step, exact_count, warmup_steps, decay_steps, lr_max, lr_final, total_steps) AS (VALUES {_schedule_values()})"


@query(f"""WITH {SCHEDULE_SQL} SELECT t.row_id, t.params, t.step, CAST(t.step * s.tokens_per_step AS BIGINT) AS expected_tokens, t.tokens
  FROM checkpoint_losses t JOIN sched s USING (params) WHERE abs(CAST(t.tokens AS DOUBLE) - t.step * CAST(s.tokens_per_step AS DOUBLE)) > greatest(1e-6, 1e-12 * abs(t.step * CAST(s.tokens_per_step AS DOUBLE)))""")
def q_schedule_mismatch(spark, d):
    """Rows whose tokens contradict their step (equi-join with a residual)."""
    from quern.functions.scalar import off_schedule

    sched = F.broadcast(schedule.schedule_frame(spark).select("params", "tokens_per_step"))
    t = table(spark, d, "checkpoint_losses").join(sched, "params")
    expected = F.try_multiply("step", "tokens_per_step")
    return t.where(off_schedule(F.col("tokens").cast("double"), F.col("step") * F.col("tokens_per_step").cast("double"))).select("row_id", "params", "step", expected.alias("expected_tokens"), "tokens")


@query("""SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE c_custkey IS NULL) AS unmatched, COUNT(*) FILTER (WHERE o_totalprice < 5000) AS cheap FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def q_contradiction_counts(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    j = table(spark, d, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("c_custkey").isNull()).alias("unmatched"), F.count_if(F.col("o_totalprice") < 5000).alias("cheap"))


@query("SELECT o_orderkey, declared, actual FROM (SELECT o_orderkey, CAST(o_orderkey % 7 AS BIGINT) AS declared, COUNT(l_orderkey) AS actual FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey) WHERE declared <> actual")
def q_declared_vs_actual(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).cast("bigint").alias("n"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return verify.declared_counts(orders, lines, ["o_orderkey"], "n")


@query("SELECT vec_id, CAST(i - 1 AS BIGINT) AS place, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def q_unnest_ordinality(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "value")).select("vec_id", F.col("place").cast("bigint").alias("place"), F.col("value").cast("double").alias("value"))


@query("SELECT doc_id, lang, n_raters, n_raters IS NOT NULL AS matched FROM documents LEFT JOIN (SELECT doc_id, COUNT(*) AS n_raters FROM level_labels GROUP BY doc_id) USING (doc_id)")
def q_many_to_one_indicator(spark, d):
    labels = table(spark, d, "level_labels").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_raters"))
    return relational.many_to_one(table(spark, d, "documents").select("doc_id", "lang"), labels, ["doc_id"])


@query("""SELECT c_custkey, p_name AS nearest_size FROM (SELECT c_custkey, c_acctbal, p_name, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - p_size), ord) AS k
  FROM customer CROSS JOIN (VALUES ('small', 0.0, 1), ('middle', 2500.0, 2), ('large', 7500.0, 3)) v(p_name, p_size, ord)) WHERE k = 1""")
def q_nearest_match(spark, d):
    return relational.nearest_name(table(spark, d, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal"), {"small": 0.0, "middle": 2500.0, "large": 7500.0}, "nearest_size").drop("c_acctbal")


@query("SELECT n_name, task, CAST(ratio AS DOUBLE) AS ratio FROM nation CROSS JOIN (VALUES ('a'), ('b')) t(task) CROSS JOIN (VALUES (0.25), (0.5), (1.0)) r(ratio)")
def q_grid_cross(spark, d):
    return relational.grid(table(spark, d, "nation").select("n_name"), task=["a", "b"], ratio=[0.25, 0.5, 1.0])


@query("""SELECT coalesce(a.k, b.k) AS k, a.n_orders, b.n_lines, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right
  FROM (SELECT o_orderkey AS k, COUNT(*) AS n_orders FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1) a FULL JOIN (SELECT l_orderkey AS k, COUNT(*) AS n_lines FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON a.k = b.k""")
def q_full_outer_runs(spark, d):
    a = table(spark, d, "orders").where("o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n_orders"))
    b = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n_lines"))
    return relational.full_outer_runs(a, b, ["k"])


@query("SELECT recipe_name, coalesce(a.recipe, b.recipe) AS official FROM (SELECT DISTINCT recipe_name FROM olmes) o LEFT JOIN recipes a USING (recipe_name) LEFT JOIN recipes b ON o.recipe_name = b.recipe")
def q_alias_lookup(spark, d):
    aliases = table(spark, d, "recipes").select(F.col("recipe_name").alias("alias"), F.col("recipe").alias("official"))
    return relational.resolved(table(spark, d, "olmes").select("recipe_name").distinct(), "recipe_name", aliases, "official")


@query("""SELECT c_custkey, c_mktsegment, 'local' AS origin FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL
  SELECT c_custkey, c_mktsegment, 'remote' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""")
def q_anti_upsert(spark, d):
    """Remote rows only of groups that are absent locally."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    local = c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).withColumn("origin", F.lit("local"))
    return relational.add_missing_groups(local, c.withColumn("origin", F.lit("remote")), "c_mktsegment")


@query("""SELECT s_suppkey, s_nationkey, 'old' AS version FROM supplier WHERE s_nationkey IS DISTINCT FROM 3 UNION ALL SELECT s_suppkey + 100000, 3, 'new' FROM supplier WHERE s_nationkey = 3""")
def q_group_upsert(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    new = s.where("s_nationkey = 3").select((F.col("s_suppkey") + 100000).alias("s_suppkey"), "s_nationkey", F.lit("new").alias("version"))
    return relational.replace_group(s.withColumn("version", F.lit("old")), new, "s_nationkey", 3)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1)")
def q_semi_overlap(spark, d):
    first = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.shared_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey"), first, ["o_orderkey"])


@query("""SELECT c_custkey, c_nationkey, CASE WHEN m.at IS NOT NULL THEN m.at END AS match_at, m.v AS match_value FROM customer c LEFT JOIN LATERAL (
  SELECT s_acctbal AS at, s_suppkey AS v FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s_acctbal > 0 AND s_acctbal <= c_acctbal ORDER BY s_acctbal DESC, s_suppkey DESC LIMIT 1) m ON TRUE""")
def q_budget_asof(spark, d):
    """Largest positive value within a budget: a merge as-of join."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    found = relational.latest_at_or_before(c, s, ["nation"], F.col("c_acctbal"), F.col("s_acctbal"), F.col("s_suppkey"))
    return found.select("c_custkey", F.col("nation").alias("c_nationkey"), "match_at", "match_value")


# -- aggregates, windows, sorts ------------------------------------------------------------


@query("SELECT COUNT(DISTINCT (lang, source)) AS n_tuples, COUNT(DISTINCT lang) AS n_langs, COUNT(*) AS n_rows FROM documents")
def q_tuple_distinct(spark, d):
    """Distinct tuples count rows with NULL members."""
    return table(spark, d, "documents").agg(agg.distinct_tuples("lang", "source").alias("n_tuples"), F.count_distinct("lang").alias("n_langs"), F.count(F.lit(1)).alias("n_rows"))


@query("""SELECT l_returnflag, COUNT(*) FILTER (WHERE l_quantity > 25) AS large, bool_or(l_tax > 0.07) AS taxed, MIN(l_linenumber) AS low, COUNT(DISTINCT l_linestatus) AS statuses,
  CAST(coalesce(SUM(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS quantity FROM lineitem GROUP BY l_returnflag""")
def q_filter_aggs(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(F.col("l_quantity") > 25).alias("large"), F.bool_or(F.col("l_tax") > 0.07).alias("taxed"), F.min("l_linenumber").alias("low"), F.count_distinct("l_linestatus").alias("statuses"),
        F.coalesce(F.sum(F.col("l_quantity").cast("bigint")), F.lit(0)).alias("quantity"),
    )


@query("SELECT recipe, params, seed_value, step, concat_ws(',', CASE WHEN COUNT(DISTINCT num_instances) > 1 THEN 'num_instances' END, CASE WHEN COUNT(DISTINCT run_date) > 1 THEN 'run_date' END) AS fields FROM tasks GROUP BY 1, 2, 3, 4 HAVING COUNT(DISTINCT num_instances) > 1 OR COUNT(DISTINCT run_date) > 1")
def q_conflicting_fields(spark, d):
    found = validate.conflicts(table(spark, d, "tasks"), ["recipe", "params", "seed_value", "step"], ["num_instances", "run_date"])
    return found.withColumn("fields", F.array_join(F.sort_array("fields"), ","))


@query(f"""WITH {EVALUATIONS_SQL} SELECT params, step, metric, recipe, seed, COUNT(DISTINCT task) AS n_tasks, round(CASE WHEN COUNT(score) = 3 THEN AVG(score) END, 6) AS score FROM evals GROUP BY 1, 2, 3, 4, 5""")
def q_macro_mean_strict(spark, d):
    """Macro average over tasks, NULL unless all are present."""
    macro = ranking.macro_tasks(views.evaluations(spark, d), ["A", "N", "R"], "macro")
    return macro.select("params", "step", "metric", "recipe", "seed", "n_tasks", F.round("score", 6).alias("score"))


@query("SELECT task, CAST(SUM(CAST(round(acc_uncond * 1000000) AS BIGINT)) AS DOUBLE) / COUNT(acc_uncond) AS mean_uncond, COUNT(acc_uncond) AS n FROM tasks WHERE NOT isnan(coalesce(acc_uncond, 0)) GROUP BY task")
def q_mean_lenient(spark, d):
    """Mean of the present values only."""
    scaled = F.round(F.col("acc_uncond") * 1000000).cast("bigint").cast("double")
    t = table(spark, d, "tasks").where(~F.isnan(F.coalesce(F.col("acc_uncond"), F.lit(0.0))))
    return t.groupBy("task").agg(agg.lenient_mean(scaled).alias("mean_uncond"), F.count("acc_uncond").alias("n"))


@query(f"""WITH {EVALUATIONS_SQL}, per AS (SELECT params, step, task, metric, recipe, COUNT(score) AS k, AVG(score) AS m, stddev_pop(score) AS s FROM evals GROUP BY 1, 2, 3, 4, 5)
  SELECT params, step, task, metric, COUNT(*) AS recipe_count, round(AVG(CASE WHEN k > 0 THEN s END), 6) AS noise, round(stddev_pop(m), 6) AS spread FROM per GROUP BY 1, 2, 3, 4""")
def q_noise_spread(spark, d):
    rows = ranking.noise_and_spread(views.evaluations(spark, d))
    return rows.select("params", "step", "task", "metric", "recipe_count", F.round("noise", 6).alias("noise"), F.round("spread", 6).alias("spread"))


@query(f"WITH {EVALUATIONS_SQL} SELECT params, step, task, metric, recipe, COUNT(score) AS seed_count, round(AVG(score), 6) AS mean_score, round(CASE WHEN COUNT(score) > 1 THEN stddev_samp(score) END, 6) AS score_std FROM evals GROUP BY 1, 2, 3, 4, 5")
def q_recipe_summaries(spark, d):
    rows = ranking.recipe_summaries(views.evaluations(spark, d), ddof=1)
    return rows.select("params", "step", "task", "metric", "recipe", "seed_count", F.round("mean_score", 6).alias("mean_score"), F.round("score_std", 6).alias("score_std"))


@query(f"WITH {EVALUATIONS_SQL} SELECT params, step, MIN(compute) AS compute, MIN(total_steps) AS total_steps, step >= MIN(total_steps) AS schedule_complete, COUNT(DISTINCT (compute, total_steps)) = 1 AS consistent FROM evals GROUP BY params, step")
def q_observed_checkpoints(spark, d):
    return ranking.observed_checkpoints(views.evaluations(spark, d))


def _accuracies(spark: SparkSession, d: str) -> DataFrame:
    return ranking.decision_accuracies(views.evaluations(spark, d), TARGET_SIZE, TARGET_STEP, RECIPES, SEEDS)


def _six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query(f"WITH {PAIRS_SQL} SELECT params, step, task, metric, available, round(decision_accuracy, 6) AS decision_accuracy, round(accuracy_std, 6) AS accuracy_std, round(compute_ratio, 6) AS compute_ratio FROM accuracies")
def q_decision_accuracy(spark, d):
    """Share of recipe pairs each checkpoint orders like the target, per seed."""
    return _accuracies(spark, d).select("params", "step", "task", "metric", "available", *_six("decision_accuracy", "accuracy_std", "compute_ratio"))


@query(f"WITH {PAIRS_SQL} SELECT params, step, task, metric, round(aggregate_decision_accuracy, 6) AS aggregate_decision_accuracy FROM accuracies WHERE available")
def q_aggregate_accuracy(spark, d):
    return _accuracies(spark, d).where("available").select("params", "step", "task", "metric", *_six("aggregate_decision_accuracy"))


@query(f"WITH {PAIRS_SQL} SELECT params, step, task, metric, reason FROM accuracies WHERE reason LIKE 'missing%'")
def q_unavailable_reasons(spark, d):
    return _accuracies(spark, d).where("reason LIKE 'missing%'").select("params", "step", "task", "metric", "reason")


_LONG_SQL = f"""{PAIRS_SQL}, longer AS (SELECT 'per_seed' AS approach, params, step, task, metric, compute, compute_ratio, available, decision_accuracy AS acc FROM accuracies
  UNION ALL SELECT 'aggregate', params, step, task, metric, compute, compute_ratio, available, aggregate_decision_accuracy FROM accuracies)"""


@query(f"""WITH {_LONG_SQL}, o AS (SELECT *, log10(compute_ratio) AS x, lag(acc) OVER (PARTITION BY approach, task, metric, params ORDER BY compute, step) AS before FROM longer WHERE available)
  SELECT approach, task, metric, params, COUNT(*) AS checkpoints, round(CASE WHEN MAX(x) > MIN(x) THEN regr_slope(acc, x) END, 6) AS log10_compute_slope,
  round(CASE WHEN MAX(x) > MIN(x) AND MAX(acc) > MIN(acc) THEN regr_r2(acc, x) END, 6) AS r_squared, CAST(coalesce(SUM(CASE WHEN acc < before THEN 1 ELSE 0 END), 0) AS BIGINT) AS adjacent_decreases,
  round(arg_min(acc, (compute, step)), 6) AS first_accuracy, round(arg_max(acc, (compute, step)), 6) AS last_accuracy, round(MAX(acc), 6) AS max_accuracy FROM o GROUP BY 1, 2, 3, 4""")
def q_curve_summary(spark, d):
    rows = diagnostics.curve_summary(diagnostics.by_approach(_accuracies(spark, d)))
    return rows.select("approach", "task", "metric", "params", "checkpoints", *_six("log10_compute_slope", "r_squared"), "adjacent_decreases", *_six("first_accuracy", "last_accuracy", "max_accuracy"))


@query(f"""WITH {_LONG_SQL} SELECT a.approach, a.params, a.step, a.task, a.metric, round(a.acc, 6) AS decision_accuracy, round(b.acc, 6) AS primary_accuracy, round(a.acc - b.acc, 6) AS advantage_over_primary
  FROM longer a LEFT JOIN longer b ON a.approach = b.approach AND a.params = b.params AND a.step = b.step AND a.task = b.task AND b.metric = 'qty' AND b.available WHERE a.available""")
def q_baseline_selfjoin(spark, d):
    rows = diagnostics.proxy_comparisons(diagnostics.by_approach(_accuracies(spark, d)), "qty")
    return rows.select("approach", "params", "step", "task", "metric", *_six("decision_accuracy", "primary_accuracy", "advantage_over_primary"))


@query(f"""WITH {EVALUATIONS_SQL}, m AS (SELECT task, params, step, recipe, MIN(compute) AS compute, AVG(score) AS score FROM evals WHERE metric = 'lines' AND step = {TARGET_STEP} GROUP BY 1, 2, 3, 4),
  s AS (SELECT task, params, compute, COUNT(*) AS n, lag(params) OVER (PARTITION BY task ORDER BY compute, params) AS before, lag(compute) OVER (PARTITION BY task ORDER BY compute, params) AS compute_before, lag(COUNT(*)) OVER (PARTITION BY task ORDER BY compute, params) AS n_before FROM m GROUP BY 1, 2, 3),
  p AS (SELECT a.task, a.params, sign(a.score - b.score) AS g, a.recipe AS r1, b.recipe AS r2 FROM m a JOIN m b ON a.task = b.task AND a.params = b.params AND a.recipe < b.recipe)
  SELECT s.task, s.before AS smaller_size, s.params AS larger_size, s.compute_before AS smaller_compute, s.compute AS larger_compute, CASE WHEN ANY_VALUE(s.n) = {RECIPES} AND ANY_VALUE(s.n_before) = {RECIPES} THEN {RECIPES * (RECIPES - 1) // 2} END::INTEGER AS pair_count,
  CASE WHEN ANY_VALUE(s.n) = {RECIPES} AND ANY_VALUE(s.n_before) = {RECIPES} THEN SUM(CASE WHEN x.g * y.g < 0 THEN 1 ELSE 0 END) END::INTEGER AS strict_crossovers, ANY_VALUE(s.n) = {RECIPES} AND ANY_VALUE(s.n_before) = {RECIPES} AS complete
  FROM s LEFT JOIN p x ON x.task = s.task AND x.params = s.before LEFT JOIN p y ON y.task = s.task AND y.params = s.params AND y.r1 = x.r1 AND y.r2 = x.r2 WHERE s.before IS NOT NULL GROUP BY 1, 2, 3, 4, 5""")
def q_crossovers(spark, d):
    """Strict order reversals of seed means between adjacent completed sizes."""
    rows = views.evaluations(spark, d).where((F.col("metric") == "lines") & (F.col("step") == TARGET_STEP))
    return diagnostics.recipe_crossovers(rows, RECIPES)


_BUDGET_SQL = f"""{PAIRS_SQL}, sizes AS (SELECT DISTINCT params, task, metric, target_compute FROM accuracies), asked AS (SELECT *, ratio * target_compute AS budget FROM sizes CROSS JOIN (VALUES (CAST(0.1 AS DOUBLE)), (0.5), (1.0)) r(ratio)),
  points AS (SELECT DISTINCT params, step, compute FROM accuracies)"""


@query(f"""WITH {_BUDGET_SQL}, chosen AS (SELECT a.*, m.step, m.compute FROM asked a LEFT JOIN LATERAL (SELECT step, compute FROM points p WHERE p.params = a.params AND p.compute <= a.budget ORDER BY compute DESC, step DESC LIMIT 1) m ON TRUE)
  SELECT c.params, c.task, c.metric, c.ratio AS requested_ratio, coalesce(x.available, FALSE) AS available, CASE WHEN x.available THEN c.step END AS step, round(CASE WHEN x.available THEN c.compute / c.target_compute END, 6) AS actual_ratio,
  round(CASE WHEN x.available THEN 1 - c.compute / c.budget END, 6) AS undershoot, round(x.decision_accuracy, 6) AS decision_accuracy FROM chosen c LEFT JOIN accuracies x ON x.params = c.params AND x.step = c.step AND x.task = c.task AND x.metric = c.metric""")
def q_budget_accuracy(spark, d):
    acc = _accuracies(spark, d)
    sizes = acc.select("params", "task", "metric", "target_compute").distinct()
    rows = ranking.budget_accuracies(acc, sizes, [0.1, 0.5, 1.0], SEEDS)
    return rows.select("params", "task", "metric", "requested_ratio", "available", "step", *_six("actual_ratio", "undershoot", "decision_accuracy"))


@query(f"""WITH {_LONG_SQL}, points AS (SELECT DISTINCT params, step, compute FROM longer), ends AS (SELECT * FROM longer WHERE available AND metric = 'qty' AND step >= 2000), sizes AS (SELECT DISTINCT params FROM longer),
  chosen AS (SELECT e.approach, e.task, e.params AS final_size, e.step AS final_step, e.compute AS final_compute, e.acc AS final_acc, z.params, m.step, m.compute FROM ends e JOIN sizes z ON z.params <> e.params JOIN LATERAL (SELECT step, compute FROM points p WHERE p.params = z.params AND p.compute <= e.compute ORDER BY compute DESC, step DESC LIMIT 1) m ON TRUE WHERE (e.compute - m.compute) / e.compute <= 0.3)
  SELECT c.approach, c.task, c.final_size, c.final_step, c.params AS intermediate_size, c.step AS intermediate_step, round(1 - x.compute / c.final_compute, 6) AS relative_compute_gap, round(x.acc - c.final_acc, 6) AS accuracy_difference
  FROM chosen c JOIN longer x ON x.approach = c.approach AND x.task = c.task AND x.params = c.params AND x.step = c.step AND x.metric = 'qty' AND x.available AND x.step < 2000""")
def q_matched_compute(spark, d):
    rows = diagnostics.by_approach(_accuracies(spark, d)).withColumn("schedule_complete", F.col("step") >= 2000)
    found = diagnostics.matched_compute(rows, "qty", 0.3)
    return found.select("approach", "task", "final_size", "final_step", "intermediate_size", "intermediate_step", *_six("relative_compute_gap", "accuracy_difference"))


@query("""SELECT ps_part AS p_partkey, observed, predicted, abs(predicted - observed) AS absolute_error, CASE WHEN observed <> 0 THEN abs(predicted - observed) / abs(observed) END AS relative_error
  FROM (SELECT p_partkey AS ps_part, CAST(p_size AS DOUBLE) AS observed, CAST(p_partkey % 50 AS DOUBLE) AS predicted FROM part)""")
def q_prediction_errors(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("o"), (F.col("p_partkey") % 50).cast("double").alias("p"))
    return ranking.prediction_errors(rows, ["p_partkey"], "p", "o")


@query("""WITH r AS (SELECT p_brand, CAST(p_partkey % 97 AS VARCHAR) AS recipe, CAST(MIN(p_size) AS DOUBLE) AS observed, CAST(MIN(p_partkey) % 50 AS DOUBLE) AS predicted FROM part GROUP BY 1, 2),
  e AS (SELECT p_brand, COUNT(*) AS recipe_count, round(AVG(abs(predicted - observed)), 6) AS mean_absolute_error, round(AVG(CASE WHEN observed <> 0 THEN abs(predicted - observed) / abs(observed) END), 6) AS mean_relative_error, COUNT(CASE WHEN observed <> 0 THEN 1 END) AS relative_error_count FROM r GROUP BY 1),
  a AS (SELECT x.p_brand, round(AVG(CASE WHEN sign(x.predicted - y.predicted) = sign(x.observed - y.observed) THEN 1.0 ELSE 0.0 END), 6) AS decision_accuracy FROM r x JOIN r y ON x.p_brand = y.p_brand AND x.recipe < y.recipe GROUP BY 1)
  SELECT e.*, a.decision_accuracy FROM e LEFT JOIN a USING (p_brand)""")
def q_error_summaries(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand", (F.col("p_partkey") % 97).cast("string").alias("recipe")).agg(F.min("p_size").cast("double").alias("o"), (F.min("p_partkey") % 50).cast("double").alias("p"))
    found = ranking.error_summaries(rows, ["p_brand"], "recipe", "p", "o")
    return found.select("p_brand", "recipe_count", *_six("mean_absolute_error", "mean_relative_error"), "relative_error_count", *_six("decision_accuracy"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS largest_at FROM embeddings")
def q_argmax_first_tie(spark, d):
    return table(spark, d, "embeddings").select("vec_id", first_largest(F.col("embedding")).alias("largest_at"))


@query("""SELECT COUNT(*) AS n, AVG(CASE WHEN a.reading_level = b.reading_level THEN 1.0 ELSE 0.0 END) AS agreement, AVG(CAST(abs(a.reading_level - b.reading_level) AS DOUBLE)) AS mean_abs_diff, MAX(abs(a.reading_level - b.reading_level)) AS max_abs_diff
  FROM level_labels a JOIN level_labels b ON a.doc_id = b.doc_id AND a.rater < b.rater""")
def q_agreement(spark, d):
    labels = table(spark, d, "level_labels")
    other = labels.select("doc_id", F.col("rater").alias("r2"), F.col("reading_level").alias("l2"))
    return labels.join(other, "doc_id").where("rater < r2").agg(F.count(F.lit(1)).alias("n"), *agg.paired_agreement(F.col("reading_level"), F.col("l2")))


@query(f"""WITH {EVALUATIONS_SQL} SELECT params, step, task, metric, COUNT(*) AS n_rows, COUNT(DISTINCT recipe) AS n_recipe, COUNT(DISTINCT seed) AS n_seed, COUNT(*) = {RECIPES * SEEDS} AND COUNT(DISTINCT recipe) = {RECIPES} AND COUNT(DISTINCT seed) = {SEEDS} AS available FROM evals GROUP BY 1, 2, 3, 4""")
def q_pivot_cells(spark, d):
    """Coverage of the recipe by seed matrix in long form."""
    return agg.complete_cells(views.evaluations(spark, d), ["params", "step", "task", "metric"], {"recipe": RECIPES, "seed": SEEDS}, "score").drop("n_cells")


@query("""SELECT user_id, arg_min(value, (ts, event_id)) AS v_first, arg_max(value, (ts, event_id)) AS v_last, MIN(value) AS v_min, MAX(value) AS v_max, CASE WHEN COUNT(value) > 1 THEN arg_min(value, (ts, event_id)) - arg_max(value, (ts, event_id)) END AS v_improvement FROM events GROUP BY user_id""")
def q_group_first_last(spark, d):
    return agg.first_last(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", "v")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT({c}) AS present, COUNT(DISTINCT {c}) AS distinct_values, COUNT(*) AS n_rows, COUNT({c}) / CAST(COUNT(*) AS DOUBLE) AS coverage, CASE WHEN COUNT({c}) = 0 THEN 'all_null' WHEN COUNT(DISTINCT {c}) > 1 THEN 'other' WHEN COUNT({c}) < COUNT(*) THEN 'constant_or_null' ELSE 'constant' END AS kind FROM documents" for c in ("lang", "source", "n_chars", "model_key")))
def q_column_coverage(spark, d):
    return agg.column_coverage(table(spark, d, "documents"), ["lang", "source", "n_chars", "model_key"])


@query("""SELECT params, seed, step, task, eval_id FROM (SELECT params, trim(seed) AS seed, trim(step) AS step, lower(trim(task)) AS task, eval_id, row_number() OVER (PARTITION BY params, trim(seed), trim(step), lower(trim(task)) ORDER BY CASE WHEN train_cross_entropy IS NULL THEN 0 ELSE 1 END DESC, loaded_at DESC, eval_id DESC) AS k FROM evaluations) WHERE k = 1""")
def q_precedence_pick(spark, d):
    """Best row per cell: data first, then recency."""
    rows = table(spark, d, "evaluations").select("params", F.trim("seed").alias("seed"), F.trim("step").alias("step"), F.lower(F.trim("task")).alias("task"), "eval_id", "loaded_at", F.col("train_cross_entropy").isNotNull().cast("int").alias("has"))
    return relational.preferred(rows, ["params", "seed", "step", "task"], [F.desc("has"), F.desc("loaded_at"), F.desc("eval_id")]).select("params", "seed", "step", "task", "eval_id")


@query("SELECT COUNT(*) AS breaks FROM (SELECT o_totalprice, lag(o_totalprice) OVER () AS before FROM orders) WHERE before > o_totalprice")
def q_sortedness(spark, d):
    """Places where rows, as they lie in the files, fall back in price: stretches of a file are compared inside and end to start."""
    rows, place, file = parquet_with_ordinal(spark, f"{d}/orders.parquet")
    stretch = F.concat_ws("/", file, F.format_string("%012d", F.floor(F.col(place) / 100_000)))
    found = validate.order_breaks(rows.select(stretch.alias("part"), F.col(place).alias("at"), "o_totalprice"), "part", "at", ["o_totalprice"])
    return found.agg(F.count(F.lit(1)).alias("breaks"))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
def q_sorted_limit(spark, d):
    """Top 20 orders by price (the limit is the feature)."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(20)


# -- sets, verification ---------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) AS line, CAST(SUM(s) AS BIGINT) AS change FROM (SELECT l_returnflag, l_linestatus, l_linenumber, -1 AS s FROM lineitem UNION ALL SELECT l_returnflag, 'F', l_linenumber, 1 FROM lineitem) GROUP BY 1, 2, 3 HAVING SUM(s) <> 0")
def q_multiset_diff(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("bigint").alias("line"))
    return relational.multiset_changes(rows, rows.withColumn("l_linestatus", F.lit("F")))


@query("SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) b ON a.k = b.k")
def q_key_set_ops(spark, d):
    return relational.key_sets(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), ["k"])


@query("""SELECT t.field, COUNT(*) AS compared, COUNT(*) FILTER (WHERE NOT coalesce(abs(x - y) <= 1e-9, FALSE) AND NOT (x IS NULL AND y IS NULL)) AS disagreements FROM (
  SELECT a.*, f.field, CASE f.field WHEN 'acc_raw' THEN a.acc_raw ELSE a.primary_score END AS x, CASE f.field WHEN 'acc_raw' THEN a.acc_raw_2 ELSE a.acc_per_char END AS y FROM
   (SELECT task, step, seed_value, params, recipe, acc_raw, primary_score, acc_per_char, acc_raw AS acc_raw_2 FROM tasks QUALIFY row_number() OVER (PARTITION BY recipe, params, seed_value, step, task ORDER BY loaded_at DESC) = 1) a CROSS JOIN (VALUES ('acc_raw'), ('primary_score')) f(field)) t GROUP BY 1""")
def q_cross_source_parity(spark, d):
    key = ["recipe", "params", "seed_value", "step", "task"]
    rows = relational.preferred(table(spark, d, "tasks"), key, [F.desc("loaded_at")])
    left = rows.select(*key, "acc_raw", "primary_score")
    right = rows.select(*key, "acc_raw", F.col("acc_per_char").alias("primary_score"))
    return verify.cross_source_parity(left, right, key, ["acc_raw", "primary_score"])


@query("""SELECT l_returnflag, metric, stored, rebuilt, abs(stored - rebuilt) <= 1e-8 + 1e-5 * abs(rebuilt) AS agrees FROM (SELECT l_returnflag, 'l_quantity' AS metric, 25.0::DOUBLE AS stored, AVG(l_quantity) AS rebuilt FROM lineitem GROUP BY 1
  UNION ALL SELECT l_returnflag, 'primary_score', 25.0::DOUBLE, AVG(l_quantity) FROM lineitem GROUP BY 1)""")
def q_reconstruct_metric(spark, d):
    lines = table(spark, d, "lineitem")
    stored = lines.groupBy("l_returnflag").agg(F.lit(25.0).alias("l_quantity")).withColumn("primary_metric", F.lit("l_quantity")).withColumn("primary_score", F.lit(25.0))
    return verify.reconstructed_metrics(stored, lines, ["l_returnflag"], ["l_quantity"])


@query(f"""WITH {SCHEDULE_SQL} SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE s.params IS NULL) AS unknown_sizes, COUNT(*) FILTER (WHERE t.step < 0) AS negative_steps, COUNT(t.tokens) AS tokens_present, COUNT(t.compute) AS compute_present,
  COUNT(*) FILTER (WHERE t.tokens <> t.step * s.tokens_per_step) AS tokens_mismatches, COUNT(*) FILTER (WHERE abs(t.compute - t.step * CAST(s.tokens_per_step AS DOUBLE) * s.exact_count * 6) > greatest(1e-6, 1e-12 * abs(t.step * CAST(s.tokens_per_step AS DOUBLE) * s.exact_count * 6))) AS compute_mismatches,
  COUNT(*) FILTER (WHERE 24 <> s.warmup_steps OR (t.step + s.total_steps) % 2 = 1) AS detail_mismatches,
  COUNT(*) FILTER (WHERE abs(0.001 - CASE WHEN step <= warmup_steps THEN lr_max * step / warmup_steps WHEN step - warmup_steps >= decay_steps THEN lr_final ELSE lr_final + 0.5 * (lr_max - lr_final) * (1 + cos(pi() * (step - warmup_steps) / decay_steps)) END) > 1e-6) AS rate_mismatches
  FROM tasks t LEFT JOIN sched s USING (params)""")
def q_schedule_contradictions(spark, d):
    """Counters over stored columns, some of them wrong on purpose: warmup steps, total steps (of every second step) and rates."""
    totals = F.create_map(*[F.lit(x) for r in schedule.schedule_rows() for x in (r["params"], r["total_steps"])])[F.col("params")]
    t = table(spark, d, "tasks").select("params", "step", "tokens", "compute", F.lit(24).cast("bigint").alias("warmup_steps"), (totals + (F.col("step") + totals) % 2).alias("total_steps"), F.lit(0.001).alias("lr_at_step"))
    return schedule.schedule_contradictions(t)


@query("""SELECT 'unmatched' AS "check", COUNT(*) FILTER (WHERE o_custkey % 11 = 0) AS "count", CASE WHEN COUNT(*) FILTER (WHERE o_custkey % 11 = 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders
  UNION ALL SELECT 'cheap', COUNT(*) FILTER (WHERE o_totalprice < 5000), CASE WHEN COUNT(*) FILTER (WHERE o_totalprice < 5000) = 0 THEN 'PASS' ELSE 'DIAGNOSTIC' END FROM orders""")
def q_outcomes(spark, d):
    counters = table(spark, d, "orders").agg(F.count_if(F.col("o_custkey") % 11 == 0).alias("unmatched"), F.count_if(F.col("o_totalprice") < 5000).alias("cheap"))
    return verify.outcomes(counters, ["unmatched"], ["cheap"])


@query("SELECT source_unit, l_returnflag, l_linestatus, change FROM (SELECT 'F' AS source_unit, l_returnflag, l_linestatus, -COUNT(*) AS change FROM lineitem WHERE l_linestatus = 'F' GROUP BY 2, 3)")
def q_preserved(spark, d):
    """A consolidated output that lost one unit."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus")
    parts = {s: rows.where(F.col("l_linestatus") == s) for s in ("O", "F")}
    output = verify.consolidated(parts).where("source_unit = 'O'")
    return verify.preserved(parts, output)


# -- text, JSON, runs ----------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(props ->> '$.k' AS DOUBLE) / CASE WHEN event_id % 2 = 0 THEN 1 ELSE 8 END END AS acc_raw, CASE WHEN event_id % 5 <> 0 AND event_id % 3 = 0 THEN CAST('inf' AS DOUBLE) END AS no_answer,
  event_id % 5 <> 0 AS sound FROM events""")
def q_json_metrics(spark, d):
    """Metrics of JSON objects in both kinds of quotes, with NaN, infinities and damaged texts."""
    k = F.get_json_object("props", "$.k")
    even = F.col("event_id") % 2 == 0
    part = lambda c, text: F.when(c, text).otherwise(F.lit(""))
    third = part(F.col("event_id") % 3 == 0, F.lit(", 'no_answer': 'Infinity'"))
    text = F.concat(F.lit("{'acc_raw': "), F.when(even, k).otherwise((k.cast("double") / 8).cast("string")), F.lit(", 'margin': 'NaN'"), third, part(F.col("event_id") % 5 != 0, F.lit("}")))
    m = json_metrics(F.when(even, F.replace(text, F.lit("'"), F.lit('"'))).otherwise(text))
    rows = table(spark, d, "events").select("event_id", m.alias("m"))
    return rows.where("m.margin IS NULL").select("event_id", "m.acc_raw", "m.no_answer", F.col("m").isNotNull().alias("sound"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS whole, CAST(props ->> '$.k' AS DOUBLE) AS number, FALSE AS is_text, 'integer' AS id_kind, props ->> '$.k' AS id_value, '{\"a\":[1,null],\"k\":' || (props ->> '$.k') || '}' AS canonical FROM events")
def q_json_leaves(spark, d):
    """Typed leaves, ids and the canonical text of JSON objects."""
    doc = F.concat(F.lit('{ "k" : '), F.get_json_object("props", "$.k"), F.lit(', "a": [1, null] }'))
    t = table(spark, d, "events").select("event_id", json_leaf(F.col("props"), "$.k", "int64").alias("w"), json_leaf(F.col("props"), "$.k", "float64").alias("n"), json_leaf(F.col("props"), "$.k", "string").alias("s"), json_id(F.col("props"), "$.k").alias("i"), canonical_json(doc).alias("canonical"))
    return t.select("event_id", F.col("w.value").alias("whole"), F.col("n.value").alias("number"), F.col("s.valid").alias("is_text"), F.col("i.kind").alias("id_kind"), F.col("i.value").alias("id_value"), "canonical")


@query("""SELECT recipe, params, seed_value, step, task, loaded_at, CAST(replace(replace(params, 'M', '000000'), 'B', '000000000') AS DOUBLE) AS parameters,
  CASE WHEN tokens >= 1000000000 THEN printf('%.1fB', tokens / 1e9) WHEN tokens >= 1000000 THEN printf('%.1fM', tokens / 1e6) WHEN tokens >= 1000 THEN printf('%.1fk', tokens / 1e3) ELSE printf('%.2f', tokens / 1e0) END AS shown FROM tasks WHERE tokens % 1000000 <> 50000""")
def q_display_numbers(spark, d):
    """Sizes as numbers and token counts in short form (no halves, on which the rounding of formatters differs)."""
    t = table(spark, d, "tasks").where("tokens % 1000000 <> 50000")
    return t.select("recipe", "params", "seed_value", "step", "task", "loaded_at", size_number(F.col("params")).alias("parameters"), short_number(F.col("tokens").cast("double")).alias("shown"))


@query("SELECT user_id, COUNT(*) AS n, CAST(SUM(TRY_CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS oe_event_k FROM events GROUP BY user_id")
def q_json_flatten_pivot(spark, d):
    """Metric documents flattened to long rows and pivoted to columns."""
    flat = runs.metric_documents(table(spark, d, "events").select("user_id", "props"), "user_id", {"props": "event"})
    wide = flat.groupBy("user_id").pivot("name", ["oe_event_k"]).agg(F.sum(F.col("value").try_cast("bigint")))
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).join(wide, "user_id", "left")


@query(r"SELECT doc_id, nullif(regexp_extract(model_key, '-(\d+[MB])-', 1), '') AS size FROM documents")
def q_regex_extract(spark, d):
    key = F.regexp_extract("model_key", r"-(\d+[MB])-", 1)
    return table(spark, d, "documents").select("doc_id", F.when(key != "", key).alias("size"))


@query("""SELECT recipe, params, seed_value, step, task, loaded_at, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS run_datetime_rnp, 'try_' || task AS exp_name_rnp, replace(recipe, '-', '_') AS data_rnp, params AS params_rnp,
  CASE WHEN seed_value % 3 = 0 THEN CAST(step AS VARCHAR) WHEN params LIKE '%M' THEN 'main_branch' END AS checkpoint_rnp, seed_value AS epochs_rnp, step % 90 + 1 AS total_tok_rnp, CASE WHEN seed_value % 3 = 0 THEN 'finetune' ELSE 'dpo' END AS method_rnp,
  '1.0E-' || CAST(step % 3 + 5 AS VARCHAR) AS lr, CAST(step AS VARCHAR) AS steps, task[1:3] AS note FROM tasks""")
def q_run_names(spark, d):
    """Parts of run names written from every task row, in both forms of time and of the model part."""
    t = table(spark, d, "tasks")
    key = ["recipe", "params", "seed_value", "step", "task", "loaded_at"]
    stamp = F.when(F.col("seed_value") % 2 == 0, F.date_format("loaded_at", "yyMMdd-HHmmss")).otherwise(F.date_format("loaded_at", "yyyy_MM_dd-HH_mm_ss"))
    data, tokens = F.replace("recipe", F.lit("-"), F.lit("_")), F.concat((F.col("step") % 90 + 1).cast("string"), F.lit("Mtx"), F.col("seed_value").cast("string"))
    tuned = F.concat(F.lit("_DD-base_Ft_DD-"), data, F.lit("-"), F.col("params"), F.lit("-"), F.col("step").cast("string"), F.lit("-0_finetune_"), tokens)
    plain = F.concat(F.lit("_DD-"), data, F.lit("-"), F.col("params"), F.lit("_main_branch_"), tokens, F.lit("_DPO"))
    options = F.concat(F.lit("_--learning_rate=1e-0"), (F.col("step") % 3 + 5).cast("string"), F.lit("_--steps="), F.col("step").cast("string"), F.lit(".0_--note="), F.substring("task", 1, 3))
    name = F.concat(stamp, F.lit("_try_"), F.col("task"), F.when(F.col("seed_value") % 3 == 0, tuned).otherwise(plain), options)
    rows = runs.with_name_parts(t.select(*key, name.alias("run_name")))
    return rows.select(*key, *[c for c in rows.columns if c.endswith("_rnp") and c != "options_rnp"], *[F.col("options_rnp")[o].alias(o) for o in ("lr", "steps", "note")])


@query("SELECT p_partkey, list_contains(string_split(p_type, ' '), 'STEEL') AS STEEL_tag, list_contains(string_split(p_type, ' '), 'BRASS') AS BRASS_tag FROM part")
def q_tag_onehot(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.replace("p_type", F.lit(" "), F.lit(", ")).alias("tags"))
    return runs.tag_columns(p, "tags", ["STEEL", "BRASS"]).drop("tags")


@query("SELECT doc_id, length(text) AS chars, strlen(text) AS bytes FROM documents")
def q_char_byte_lengths(spark, d):
    s = text_sizes(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s["chars"].cast("bigint").alias("chars"), s["bytes"].cast("bigint").alias("bytes"))


@query("SELECT doc_id, substring(text, 6, 20) AS part FROM documents")
def q_text_slice(spark, d):
    """A stated slice of each text: characters 5 to 25."""
    return table(spark, d, "documents").select("doc_id", text_slice(F.col("text"), F.lit(5), F.lit(25)).alias("part"))


@query("SELECT item_id, 'Question: ' || question || chr(10) || 'Answer:' AS prompt, array_to_string(list_transform(choices, lambda c: ' ' || c), '|') AS continuations, CAST(CASE WHEN answer_index BETWEEN 0 AND 4 THEN answer_index END AS INTEGER) AS gold FROM eval_items")
def q_prompt_build(spark, d):
    t = table(spark, d, "eval_items")
    letter = F.substring(F.lit("ABCDE"), F.col("answer_index") + 1, F.lit(1))
    return t.select("item_id", query_text(F.col("question")).alias("prompt"), F.array_join(continuations(F.col("choices")), "|").alias("continuations"), answer_index(letter).alias("gold"))


@query(f"""WITH {SCHEDULE_SQL}, k AS (SELECT DISTINCT params, step FROM tasks)
  SELECT params, step, round(CASE WHEN step <= warmup_steps THEN lr_max * step / warmup_steps WHEN step - warmup_steps >= decay_steps THEN lr_final ELSE lr_final + 0.5 * (lr_max - lr_final) * (1 + cos(pi() * (step - warmup_steps) / decay_steps)) END, 9) AS lr_at_step,
  round(CASE WHEN step <= 0 THEN 0 WHEN step <= warmup_steps THEN lr_max * step * step / (2.0 * warmup_steps) ELSE lr_max * warmup_steps / 2.0 + (
    SELECT SUM((lr_final + 0.5 * (lr_max - lr_final) * (1 + cos(pi() * t / decay_steps))) * CASE WHEN t = 0 OR t = least(step - warmup_steps, decay_steps) THEN 0.5 ELSE 1 END) FROM (SELECT unnest(range(0, least(step - warmup_steps, decay_steps) + 1)) AS t)) END, 6) AS cumulative_lr
  FROM k JOIN sched USING (params)""")
def q_lr_schedule(spark, d):
    """Learning rate and its trapezoid sum at every observed checkpoint, in closed form."""
    rows = schedule.enrich(table(spark, d, "tasks").select("params", "step").distinct(), details=False)
    return rows.select("params", "step", F.round("lr_at_step", 9).alias("lr_at_step"), F.round("cumulative_lr", 6).alias("cumulative_lr"))


@query("SELECT params, MAX(tokens) // MAX(step) AS tokens_per_step, MAX(compute) / MAX(step) AS compute_per_step FROM tasks GROUP BY params")
def q_schedule_ratios(spark, d):
    return schedule_ratios(table(spark, d, "tasks"))


@query("SELECT p_partkey, CAST(round_even(p_retailprice / 32, 0) * 32 AS BIGINT) AS rounded, CAST(sign(p_size - 25) AS DOUBLE) AS above FROM part")
def q_rounding_signs(spark, d):
    t = table(spark, d, "part")
    return t.select("p_partkey", round_to_multiple(F.col("p_retailprice"), 32).alias("rounded"), directed_sign(F.col("p_size"), F.lit(25)).cast("double").alias("above"))


@query("""SELECT run_id, COUNT(*) AS step_count, MAX(step) AS max_step, MIN(step) AS min_step, MIN(train_loss) AS min_train_loss, MAX(train_loss) AS max_train_loss, MAX(total_tokens) AS max_tokens, MIN(total_tokens) AS min_tokens
  FROM (SELECT run_id, step, CASE WHEN isnan(train_cross_entropy) THEN NULL ELSE train_cross_entropy END AS train_loss, throughput_total_tokens AS total_tokens FROM checkpoint_losses) GROUP BY run_id""")
def q_run_dynamics(spark, d):
    h = table(spark, d, "checkpoint_losses").select("run_id", "step", F.col("train_cross_entropy").alias("train_loss"), F.col("throughput_total_tokens").alias("total_tokens"))
    return runs.run_dynamics(h).select("run_id", "step_count", "max_step", "min_step", "min_train_loss", "max_train_loss", "max_tokens", "min_tokens")


@query("""SELECT kind, COUNT(*) AS n FROM (SELECT CASE WHEN json_valid(x) THEN CASE json_type(x) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END END AS kind
  FROM (SELECT payload AS x FROM prediction_bundles UNION ALL SELECT raw_line FROM scaling_lines UNION ALL SELECT chr(34) || lang || chr(34) FROM documents UNION ALL SELECT CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN 'true' WHEN 2 THEN '[' || event_id || ']' ELSE event_id::VARCHAR || '.5' END FROM events)) GROUP BY kind""")
def q_strict_json(spark, d):
    """Kinds of texts under a strict JSON reader: payloads, raw lines, names and made-up values."""
    e = F.col("event_id")
    texts = [
        table(spark, d, "prediction_bundles").select(F.col("payload").alias("x")), table(spark, d, "scaling_lines").select("raw_line"), table(spark, d, "documents").select(F.concat(F.lit('"'), "lang", F.lit('"'))),
        table(spark, d, "events").select(F.when(e % 4 == 0, "null").when(e % 4 == 1, "true").when(e % 4 == 2, F.concat(F.lit("["), e.cast("string"), F.lit("]"))).otherwise(F.concat(e.cast("string"), F.lit(".5")))),
    ]
    return reduce(DataFrame.union, texts).groupBy(json_kind(F.col("x")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(scaling_sql.LITERALS_SQL)
def q_literal_dict_udf(spark, d):
    """Metric dictionaries of sound raw records: whether they have a fault, and three of their values."""
    from quern.operators.parse_lines import parse_records

    valid = parse_records(table(spark, d, "scaling_lines"), table(spark, d, "seeds")).valid
    parsed = valid.select("line_id", parse_literal_metrics(F.col("metrics")).alias("m"))
    return parsed.select("line_id", F.col("m.fault").isNotNull().alias("faulty"), "m.correct_choice", "m.acc_raw", "m.acc_per_char")


def _scaling(spark, d):
    """(rows in scope, rules, groups) of the raw scaling files."""
    from quern.operators.parse_lines import SCALING_COLUMNS, record_fields
    from quern.operators.preprocess import scaling_rows, scaling_rules

    lines, groups = table(spark, d, "scaling_lines"), table(spark, d, "source_groups")
    files = table(spark, d, "source_files")
    # exploded, so that filters on fields are not pushed into the splitting and repeat it
    rows = lines.join(files, "source_file").select(F.explode(F.array(record_fields(F.col("raw_line")))).alias("r"), F.col("precedence").alias("source_priority"), "source_file", F.col("line_no").alias("source_row")).where("r.sound AND size(r.fields) = 15")
    raw = rows.select("source_priority", "source_file", "source_row", *[F.get("r.fields", F.lit(k)).alias(c) for k, c in enumerate(SCALING_COLUMNS)])
    # both lookup tables are fixed
    known = [r[0] for r in groups.where("recipe IS NOT NULL").select("source_group").distinct().collect()]
    seeds = [r[0] for r in table(spark, d, "seeds").select("seed_value").distinct().collect()]
    return scaling_rows(raw, groups, 6198), scaling_rules(known, seeds), groups


@query(scaling_sql.RESOLUTION_SQL)
def q_scaling_resolution(spark, d):
    """Evaluations of the raw scaling files that pass the rules, after precedence, with schedule columns."""
    from quern.operators.preprocess import resolve_scaling

    rows, rules, groups = _scaling(spark, d)
    evaluations, _ = resolve_scaling(validate.sound_rows(rows, rules), groups)
    return evaluations.select("recipe", "params", "seed_value", "step", "task", "source_file", "tokens", "compute", F.col("metrics_fault").isNotNull().alias("metrics_faulty"), "acc_raw", "logits_per_byte_corr", "primary_metric")


@query(scaling_sql.CHECKPOINTS_SQL)
def q_scaling_checkpoints(spark, d):
    """Losses of each checkpoint in the raw scaling files, from its best file."""
    from quern.operators.preprocess import LOSS_COLUMNS, resolve_scaling

    rows, rules, groups = _scaling(spark, d)
    _, checkpoints = resolve_scaling(validate.sound_rows(rows, rules), groups)
    return checkpoints.select("recipe", "params", "seed_value", "step", "source_file", "tokens", "compute", "chinchilla", *LOSS_COLUMNS)


@query(scaling_sql.FAULTS_SQL)
def q_scaling_faults(spark, d):
    """Raw scaling rows in scope that break a rule (the first they break), cells repeated within a file, conflicting checkpoints."""
    from quern.operators.preprocess import scaling_conflicts

    rows, rules, groups = _scaling(spark, d)
    broken = validate.violations(rows, rules, ["source_file", "source_row"]).drop("rule_no").select("source_file", "source_row", "kind", "value")
    return broken.unionByName(scaling_conflicts(validate.sound_rows(rows, rules), groups))


def _published(spark, d):
    """Predictions with what was published for them; the published label is the gold answer."""
    from quern.operators.nested import choice_table, prediction_table

    bundles = table(spark, d, "prediction_bundles")
    place = ["bundle_id", "prediction_index"]
    names = {"raw": "predicted_index_raw", "per_token": "predicted_index_per_token", "per_char": "predicted_index_per_char", "pmi": "predicted_index_uncond"}
    published = prediction_table(bundles).select(*place, "label", F.col("label").alias("gold_index"), *[F.get_json_object("metrics", f"$.{n}").try_cast("int").alias(f"published_{r}") for r, n in names.items()])
    return published_items(choice_table(bundles), place).join(published, place).withColumn("item", F.concat_ws("/", *place))


@query(choice_sql.PREDICTIONS_SQL)
def q_choice_predictions(spark, d):
    """Predicted choice of each prediction under every decision rule."""
    from quern.operators.nested import choice_table

    choices = choice_table(table(spark, d, "prediction_bundles"))
    return published_items(choices, ["bundle_id", "prediction_index"]).drop("choices", "published_per_byte")


@query(choice_sql.AGREEMENT_SQL)
def q_rule_agreement(spark, d):
    """Agreement of computed and published predictions per decision rule; the published label is the gold answer.

    The published per-byte prediction is the smallest logits_per_byte. Ours divides by bytes that
    follow from the same figure, so it tests the whole bytes behind it, not an own count of them.
    """
    return compare_joined(_published(spark, d), "item").drop("first_mismatch")


@query(choice_sql.DIFFERENCES_SQL)
def q_choice_differences(spark, d):
    """Published choices against a copy that lacks some, with other likelihoods and token counts for others."""
    from quern.operators.nested import choice_table

    choices = choice_table(table(spark, d, "prediction_bundles"))
    key = ["bundle_id", "prediction_index", "choice_index"]
    theirs = choices.select(*key, F.col("sum_logits").alias("log_likelihood"), F.col("sum_logits_uncond").alias("unconditional"), F.col("num_tokens").alias("tokens"))
    shift = (F.col("bundle_id") % 3) * 0.25
    ours = theirs.where("bundle_id % 5 <> 0 OR choice_index <> 0").select(*key, (F.col("log_likelihood") + shift).alias("log_likelihood"), (F.col("unconditional") - shift).alias("unconditional"), (F.col("tokens") + (F.col("bundle_id") % 4 == 0).cast("int")).alias("tokens"))
    found = choice_differences(ours, theirs, key)
    return found.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in found.dtypes])


@query(choice_sql.MISMATCHES_SQL)
def q_rule_mismatches(spark, d):
    """The first five items per rule on which computed and published predictions differ (the limit is the feature)."""
    return mismatches(_published(spark, d), "item", 5)


@query("""SELECT p_partkey, p_name, p_size AS p_size_summary, p_retailprice AS p_retailprice_summary, p_retailprice AS learning_rate_hpm, p_brand, list_contains(string_split(p_type, ' '), 'BRASS') AS BRASS_tag, list_contains(string_split(p_type, ' '), 'STEEL') AS STEEL_tag, CAST(p_size AS VARCHAR) AS oe_t_k FROM part""")
def q_rebuilt_runs(spark, d):
    """Parts seen as runs: grouped columns with suffixes, tags and metrics of a JSON document."""
    p = table(spark, d, "part").select("*", F.replace("p_type", F.lit(" "), F.lit(", ")).alias("tags"), F.col("p_retailprice").alias("learning_rate"), F.to_json(F.struct(F.col("p_size").alias("k"))).alias("doc"))
    groups = {"id": ["p_partkey", "absent"], "status": ["p_name"], "x_axis": ["p_size"], "summary_metrics": ["p_retailprice"], "core_hpm": ["learning_rate", "p_brand"]}
    return runs.rebuilt_runs(p, groups, key="p_partkey", tags="tags", tag_names=["STEEL", "BRASS"], documents={"doc": "t"}, metrics=["oe_t_k"])


@query("SELECT recipe, params, seed_value, MAX(step) AS last_evaluated_step FROM tasks GROUP BY 1, 2, 3")
def q_last_evaluated(spark, d):
    return runs.last_evaluated(table(spark, d, "tasks"), ["recipe", "params", "seed_value"])


@query("""SELECT a.recipe, a.params, a.seed, a.step, task, score, loss, loss IS NOT NULL AND NOT isnan(loss) AND isfinite(loss) AND score IS NOT NULL AND isfinite(score) AS available FROM
  (SELECT DISTINCT recipe, params, seed_value AS seed, step, task, acc_raw AS score FROM tasks QUALIFY row_number() OVER (PARTITION BY recipe, params, seed_value, step, task ORDER BY loaded_at DESC) = 1) a LEFT JOIN
  (SELECT recipe, params, seed_value AS seed, step, MAX(train_cross_entropy) AS loss FROM checkpoint_losses WHERE NOT isnan(coalesce(train_cross_entropy, 0)) GROUP BY 1, 2, 3, 4) b USING (recipe, params, seed, step)""")
def q_loss_observations(spark, d):
    key = ["recipe", "params", "seed_value", "step", "task"]
    evals = relational.preferred(table(spark, d, "tasks"), key, [F.desc("loaded_at")]).select("recipe", "params", F.col("seed_value").alias("seed"), "step", "task", F.col("acc_raw").alias("score"), "compute")
    losses = table(spark, d, "checkpoint_losses").where(~F.isnan(F.coalesce("train_cross_entropy", F.lit(0.0)))).groupBy("recipe", "params", F.col("seed_value").alias("seed"), "step").agg(F.max("train_cross_entropy").alias("l"), F.max("compute").alias("compute"))
    return ranking.loss_observations(evals, losses, "l").select("recipe", "params", "seed", "step", "task", "score", "loss", "available")


@query(f"""WITH {_LONG_SQL}, w AS (SELECT *, params || '/' || CAST(step AS VARCHAR) AS row_id FROM longer WHERE available AND approach = 'per_seed'), c AS (SELECT 'small_scale' AS claim_id, * FROM w WHERE compute_ratio BETWEEN 0.0 AND 0.5 AND metric = 'qty' UNION ALL SELECT 'counts', * FROM w WHERE metric IN ('lines'))
  SELECT claim_id, task, array_to_string(list_sort(list(row_id)), ',') AS row_ids, arg_min(row_id, (-acc, row_id)) AS best_row FROM c GROUP BY 1, 2""")
def q_claim_evidence(spark, d):
    rows = diagnostics.by_approach(_accuracies(spark, d)).where("approach = 'per_seed'").withColumn("row_id", F.concat_ws("/", "params", F.col("step").cast("string")))
    found = diagnostics.claim_evidence(rows, "row_id", {"small_scale": {"compute_ratio": diagnostics.Between(0.0, 0.5), "metric": "qty"}, "counts": {"metric": ["lines"]}})
    return found.withColumn("row_ids", F.array_join("row_ids", ","))


@query("SELECT doc_id, CASE WHEN n_chars = length(text) THEN NULL ELSE n_chars END AS wrong_size FROM documents WHERE n_chars IS DISTINCT FROM length(text)")
def q_stored_size_check(spark, d):
    return table(spark, d, "documents").where(~F.col("n_chars").eqNullSafe(F.char_length("text").cast("bigint"))).select("doc_id", F.col("n_chars").alias("wrong_size"))


@query(scaling_sql.COMPUTE_SQL)
def q_double_text_cast(spark, d):
    """The compute of every record of sound shape, as it can be read: signs, exponents, blanks and other text included."""
    from quern.operators.parse_lines import record_fields

    rows = table(spark, d, "scaling_lines").select("line_id", F.explode(F.array(record_fields(F.col("raw_line")))).alias("r")).where("r.sound AND size(r.fields) = 15")
    return rows.select("line_id", finite_double(F.get("r.fields", F.lit(6))).alias("compute_value"))

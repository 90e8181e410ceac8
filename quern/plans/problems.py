"""Queries of the core training-data problems (p1, p2, p3 and p5) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.numbers import whole_number
from quern.operators.nested import bundle_table, choice_table, flatten_bundles, metric_table, prediction_table, span_table
from quern.operators.parse_lines import SCALING_COLUMNS, ParsedRecords, parse_records, plain_name
from quern.operators.spikes import find_spikes
from quern.operators.table_diff import diff_task_results, task_findings


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parsed(spark: SparkSession, d: str) -> ParsedRecords:
    return parse_records(_read(spark, d, "scaling_lines"), _read(spark, d, "seeds"))


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return diff_task_results(*(_read(spark, d, t) for t in ("tasks", "olmes", "recipes", "seeds")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).findings


def p1_valid(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).valid


def p1_invalid_values(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).invalid_values


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return task_findings(_diff(spark, d))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Differing fields with both values, one row per key and field."""
    rows = _diff(spark, d).where("side = 'both'")
    return rows.select("recipe", "params", "seed_value", "step", "task", F.explode("differences").alias("d")).select("recipe", "params", "seed_value", "step", "task", "d.field", "d.left_value", "d.right_value")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return find_spikes(_read(spark, d, "checkpoint_losses")).select("row_id", "field_name")


def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Findings per field and kind."""
    return find_spikes(_read(spark, d, "checkpoint_losses")).groupBy("field_name", "kind").agg(F.count(F.lit(1)).alias("n"))


def p3_separated(spark: SparkSession, d: str) -> DataFrame:
    """The findings that need no course: values outside the limits and stuck readings."""
    return find_spikes(_read(spark, d, "checkpoint_losses")).where("kind <> 'spike'")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten_bundles(_read(spark, d, "prediction_bundles")).select("bundle_id", "doc_id", "choice_index", "span_index")


def p5_bundles(spark: SparkSession, d: str) -> DataFrame:
    """One row per valid bundle, with the settings that its configurations name."""
    rows = bundle_table(_read(spark, d, "prediction_bundles"))
    setting = lambda c, name: F.get_json_object(c, f"$.{name}")
    return rows.select(
        "bundle_id", "task_name", "task_hash", "model_hash", "num_instances", setting("model_config", "revision").alias("revision"), setting("task_config", "primary_metric").alias("primary_metric"),
        whole_number(setting("task_config", "num_shots")).alias("num_shots"), setting("metrics", "acc_raw").try_cast("double").alias("acc_raw"),
    )


def p5_predictions(spark: SparkSession, d: str) -> DataFrame:
    return prediction_table(_read(spark, d, "prediction_bundles")).drop("metrics")


def p5_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every metric of every prediction as a row."""
    return metric_table(prediction_table(_read(spark, d, "prediction_bundles")))


def p5_choices(spark: SparkSession, d: str) -> DataFrame:
    return choice_table(_read(spark, d, "prediction_bundles"))


def p5_spans(spark: SparkSession, d: str) -> DataFrame:
    return span_table(_read(spark, d, "prediction_bundles"))


QUERIES = {f.__name__: f for f in (p1_found, p1_valid, p1_invalid_values, p2_found, p2_values, p3_found, p3_kinds, p3_separated, p5_found, p5_bundles, p5_predictions, p5_metrics, p5_choices, p5_spans)}


# -- the same answers in DuckDB's SQL --------------------------------------------------

_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def field_pattern(n: int) -> str:
    """``n`` comma-separated fields."""
    return f"{_FIELD}(,{_FIELD}){{{n - 1}}}"


def bare_field(k: int) -> str:
    """Field ``k`` of a sound record without its quotes."""
    raw = f"rtrim(regexp_extract(raw_line, '(?s)^(?:{_FIELD},){{{k}}}({_FIELD})', 1), chr(13) || chr(10))"
    return f"CASE WHEN starts_with({raw}, '\"') THEN replace(substring({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END"


def _cell(k: int) -> str:
    return f"trim({bare_field(k)}, ' ' || chr(9) || chr(10) || chr(13))"


def whole_sql(v: str) -> str:
    """The value as a whole DECIMAL, NULL if it is none."""
    number = f"TRY_CAST(ltrim({v}, '+') AS DECIMAL(38,12))"
    return f"CASE WHEN regexp_full_match({v}, '{NUMBER}') AND {number} = trunc({number}) AND abs({number}) <= 9223372036854775807 THEN {number} END"


_P1_BAD = {
    "step": f"coalesce({whole_sql('step')}, -1) < 0",
    "tokens": f"tokens <> '' AND coalesce({whole_sql('tokens')}, -1) < 0",
    "compute": f"compute <> '' AND NOT coalesce(regexp_full_match(compute, '{NUMBER}') AND isfinite(TRY_CAST(compute AS DOUBLE)) AND TRY_CAST(compute AS DOUBLE) >= 0, FALSE)",
    "seed": f"seed <> '' AND coalesce({whole_sql('seed')}, -1) NOT IN (SELECT seed_value FROM seeds UNION ALL SELECT 6198)",
}
_P1_NAMES = [plain_name(c) for c in SCALING_COLUMNS]
_P1_SHAPED = f"""shaped AS (
  SELECT line_id, raw_line, regexp_full_match(raw_line, '(?s){_FIELD}(,{_FIELD})*(\r\n|\r|\n)?') AS sound,
         1 + length(regexp_replace(regexp_replace(raw_line, '(?s)"(?:[^"]|"")*"', 'Q', 'g'), '[^,]', '', 'g')) AS n_fields
  FROM scaling_lines),
cells AS (
  SELECT line_id, {', '.join(f'{_cell(k)} AS "{n}"' for k, n in enumerate(_P1_NAMES))}
  FROM shaped WHERE sound AND n_fields = 15)"""
P1_SQL = f"""WITH {_P1_SHAPED}
SELECT line_id, 'quoting' AS reason FROM shaped WHERE NOT sound
UNION ALL SELECT line_id, 'column_count' FROM shaped WHERE sound AND n_fields <> 15
""" + "\n".join(f"UNION ALL SELECT line_id, '{c}' FROM cells WHERE {bad}" for c, bad in _P1_BAD.items())
P1_INVALID_SQL = f"WITH {_P1_SHAPED}\n" + "\nUNION ALL ".join(f"SELECT '{c}' AS name, {c} AS value, COUNT(*) AS records FROM cells WHERE {bad} GROUP BY 2" for c, bad in _P1_BAD.items())


def _p1_typed(n: str) -> str:
    if n in ("step", "tokens", "seed"):
        return f"CAST({whole_sql(n)} AS BIGINT) AS {n}"
    if n == "compute" or n.startswith(("eval_", "train_", "throughput_")):
        return f"CASE WHEN regexp_full_match({n}, '{NUMBER}') AND isfinite(TRY_CAST({n} AS DOUBLE)) THEN TRY_CAST({n} AS DOUBLE) END AS {n}"
    return f'"{n}"'


P1_VALID_SQL = f"WITH {_P1_SHAPED} SELECT line_id, {', '.join(_p1_typed(n) for n in _P1_NAMES)} FROM cells WHERE NOT ({' OR '.join(f'({bad})' for bad in _P1_BAD.values())})"

_P2_FIELDS = ("primary_score", "acc_raw", "acc_per_token", "acc_per_char", "acc_uncond", "no_answer")
_P2_SIDES = """
t AS (SELECT recipe, params, seed_value, step, task, primary_score, acc_raw, acc_per_token, acc_per_char, acc_uncond, no_answer FROM tasks
      QUALIFY row_number() OVER (PARTITION BY recipe, params, seed_value, step, task ORDER BY loaded_at DESC) = 1),
o AS (SELECT r.recipe, upper(trim(x.params)) AS params, s.seed_value, CAST(TRY_CAST(trim(x.step) AS DOUBLE) AS BIGINT) AS step, lower(trim(x.task)) AS task,
             x.primary_metric AS primary_score, acc_raw, acc_per_token, acc_per_char, acc_uncond, no_answer, x.loaded_at
      FROM olmes x LEFT JOIN recipes r ON lower(trim(x.recipe_name)) = lower(r.recipe_name) LEFT JOIN seeds s ON lower(trim(x.seed)) = s.seed
      QUALIFY row_number() OVER (PARTITION BY r.recipe, upper(trim(x.params)), s.seed_value, CAST(TRY_CAST(trim(x.step) AS DOUBLE) AS BIGINT), lower(trim(x.task)) ORDER BY x.loaded_at DESC) = 1)"""
_KEYS = "recipe, params, seed_value, step, task"
_SAME = " AND ".join(f"t.{k} = o.{k}" for k in _KEYS.split(", "))


def _value(side: str, f: str) -> str:
    return f"CASE WHEN isnan({side}.{f}) THEN NULL ELSE {side}.{f} END"


def _apart(f: str) -> str:
    a, b = _value("t", f), _value("o", f)
    return f"(({a}) IS NULL) <> (({b}) IS NULL) OR abs(({a}) - ({b})) > 1e-9"


P2_SQL = f"""WITH {_P2_SIDES}
SELECT {_KEYS}, 'missing_in_olmes' AS finding FROM t WHERE NOT EXISTS (SELECT 1 FROM o WHERE {_SAME})
UNION ALL SELECT {_KEYS}, 'missing_in_tasks' FROM o WHERE NOT EXISTS (SELECT 1 FROM t WHERE {_SAME})
""" + "\n".join(f"UNION ALL SELECT {', '.join('t.' + k for k in _KEYS.split(', '))}, '{f}' FROM t JOIN o ON {_SAME} WHERE {_apart(f)}" for f in _P2_FIELDS)
P2_VALUES_SQL = f"WITH {_P2_SIDES}\n" + "\nUNION ALL ".join(
    f"SELECT {', '.join('t.' + k for k in _KEYS.split(', '))}, '{f}' AS field, {_value('t', f)} AS left_value, {_value('o', f)} AS right_value FROM t JOIN o ON {_SAME} WHERE {_apart(f)}" for f in _P2_FIELDS
)

P3_SEPARATED_SQL = """
WITH once AS (SELECT * FROM checkpoint_losses QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY arrived_at DESC NULLS LAST) = 1),
cells AS (
  SELECT row_id, run_id, logged_at, 'step' AS field_name, CAST(step AS DOUBLE) AS x, 0.0 AS low FROM once WHERE step IS NOT NULL
  UNION ALL SELECT row_id, run_id, logged_at, 'train_cross_entropy', train_cross_entropy, NULL FROM once WHERE train_cross_entropy IS NOT NULL
  UNION ALL SELECT row_id, run_id, logged_at, 'c4_en_validation_cross_entropy', c4_en_validation_cross_entropy, NULL FROM once WHERE c4_en_validation_cross_entropy IS NOT NULL),
marked AS (SELECT *, NOT isfinite(x) OR x < low OR (low IS NULL AND x <= 0) AS bad, x = lag(x) OVER w AS same FROM cells WHERE run_id IS NOT NULL AND row_id IS NOT NULL WINDOW w AS (PARTITION BY run_id, field_name ORDER BY logged_at, row_id)),
runs AS (SELECT *, SUM(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, field_name ORDER BY logged_at, row_id) AS run FROM marked),
sized AS (SELECT *, COUNT(*) OVER (PARTITION BY run_id, field_name, run) AS n FROM runs)
SELECT row_id, field_name, CASE WHEN bad THEN 'limit' ELSE 'stuck' END AS kind FROM sized WHERE bad OR (same AND n >= 3 AND logged_at IS NOT NULL)"""


def _as_list(x: str) -> str:
    plain = "CASE json_type({0}) WHEN 'ARRAY' THEN {0} WHEN 'OBJECT' THEN json_array({0}) END"
    text = f"TRY_CAST({x} ->> '$' AS JSON)"
    return f"CASE WHEN json_type({x}) = 'VARCHAR' THEN {plain.format(text)} ELSE {plain.format(x)} END"


def _unnested(source: str, keep: str, x: str, place: str) -> str:
    return (
        f"SELECT {keep}, {place}, item FROM (SELECT {keep}, unnest(range(0, CAST(json_array_length(l) AS BIGINT))) AS {place}, unnest(json_extract(l, '$[*]')) AS item "
        f"FROM (SELECT {keep}, {_as_list(x)} AS l FROM {source}) WHERE l IS NOT NULL) WHERE json_type(item) = 'OBJECT'"
    )


P5_LINKS_SQL = f"""b AS (SELECT bundle_id, CAST(payload AS JSON) AS j FROM prediction_bundles WHERE json_valid(payload)),
p AS ({_unnested("(SELECT bundle_id, json_extract(j, '$.predictions') AS x FROM b WHERE json_type(j) = 'OBJECT')", "bundle_id", "x", "p_at")}),
q AS (SELECT bundle_id, p_at, CAST(TRY_CAST(item ->> '$.doc_id' AS DOUBLE) AS BIGINT) AS doc_id, json_extract(item, '$.model_output') AS x, item FROM p),
c AS ({_unnested("(SELECT bundle_id, p_at, doc_id, x FROM q)", "bundle_id, p_at, doc_id", "x", "choice_index")}),
z AS (SELECT bundle_id, p_at, doc_id, choice_index, json_extract(item, '$.spans') AS x FROM c),
s AS ({_unnested("z", "bundle_id, p_at, doc_id, choice_index", "x", "span_index")})"""
P5_SQL = f"""WITH {P5_LINKS_SQL}
SELECT bundle_id, doc_id, CAST(-1 AS BIGINT) AS choice_index, CAST(-1 AS BIGINT) AS span_index FROM q
UNION ALL SELECT bundle_id, doc_id, choice_index, -1 FROM c
UNION ALL SELECT bundle_id, doc_id, choice_index, span_index FROM s"""


def json_whole(x: str, name: str) -> str:
    d = f"TRY_CAST({x} ->> '$.{name}' AS DOUBLE)"
    return f"CASE WHEN {d} = trunc({d}) THEN CAST({d} AS BIGINT) END AS {name.split('.')[-1]}"


def json_real(x: str, name: str) -> str:
    return f"TRY_CAST({x} ->> '$.{name}' AS DOUBLE) AS {name.split('.')[-1]}"


P5_BUNDLES_SQL = f"""WITH {P5_LINKS_SQL} SELECT bundle_id, j ->> '$.task_name' AS task_name, j ->> '$.task_hash' AS task_hash, j ->> '$.model_hash' AS model_hash, {json_whole('j', 'num_instances')},
  j ->> '$.model_config.revision' AS revision, j ->> '$.task_config.primary_metric' AS primary_metric, {json_whole('j', 'task_config.num_shots')}, {json_real('j', 'metrics.acc_raw')} FROM b WHERE json_type(j) = 'OBJECT'"""
P5_PREDICTIONS_SQL = f"""WITH {P5_LINKS_SQL} SELECT bundle_id, p_at AS prediction_index, doc_id, item ->> '$.native_id' AS native_id, item ->> '$.task_hash' AS task_hash, item ->> '$.model_hash' AS model_hash, {json_whole('item', 'label')} FROM q"""
P5_METRICS_SQL = f"""WITH {P5_LINKS_SQL}, m AS (SELECT bundle_id, p_at, doc_id, json_extract(item, '$.metrics') AS o FROM q WHERE json_type(item, '$.metrics') = 'OBJECT'),
outermost AS (SELECT bundle_id, p_at, doc_id, k, json_extract(o, '$.' || k) AS v FROM (SELECT *, unnest(json_keys(o)) AS k FROM m)),
inner_keys AS (SELECT bundle_id, p_at, doc_id, v, unnest(json_keys(v)) AS k FROM outermost WHERE json_type(v) = 'OBJECT')
SELECT bundle_id, p_at AS prediction_index, doc_id, k AS metric, TRY_CAST(v ->> '$' AS DOUBLE) AS value FROM outermost WHERE json_type(v) <> 'OBJECT'
UNION ALL SELECT bundle_id, p_at, doc_id, k, TRY_CAST(v ->> ('$.' || k) AS DOUBLE) FROM inner_keys"""
P5_CHOICES_SQL = f"""WITH {P5_LINKS_SQL} SELECT bundle_id, p_at AS prediction_index, doc_id, choice_index, {', '.join(json_real('item', n) for n in ('sum_logits', 'sum_logits_uncond', 'logits_per_token', 'logits_per_char', 'logits_per_byte'))},
  {', '.join(json_whole('item', n) for n in ('num_tokens', 'num_tokens_all', 'num_chars'))}, TRY_CAST(item ->> '$.is_greedy' AS BOOLEAN) AS is_greedy FROM c"""
P5_SPANS_SQL = f"""WITH {P5_LINKS_SQL} SELECT bundle_id, p_at AS prediction_index, doc_id, choice_index, span_index, {json_whole('item', 'start').replace(' AS start', ' AS "start"')}, {json_whole('item', 'end').replace(' AS end', ' AS "end"')}, {json_real('item', 'logit')} FROM s"""

ORACLE = {"p1_found": P1_SQL, "p1_valid": P1_VALID_SQL, "p1_invalid_values": P1_INVALID_SQL, "p2_found": P2_SQL, "p2_values": P2_VALUES_SQL, "p3_separated": P3_SEPARATED_SQL, "p5_found": P5_SQL, "p5_bundles": P5_BUNDLES_SQL, "p5_predictions": P5_PREDICTIONS_SQL, "p5_metrics": P5_METRICS_SQL, "p5_choices": P5_CHOICES_SQL, "p5_spans": P5_SPANS_SQL}

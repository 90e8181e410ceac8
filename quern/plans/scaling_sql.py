"""DuckDB statements of the scaling-file queries."""

from __future__ import annotations

from quern.operators.preprocess import DROPPED_METRICS, LOSS_COLUMNS, METRICS, PRIMARY_METRIC, SIZES
from quern.operators.schedule import schedule_rows
from quern.plans.problems import NUMBER, P1_VALID_SQL, bare_field, field_pattern, whole_sql

_LOSSES = tuple(LOSS_COLUMNS)
_FIELDS = ("grp", "model", "task", "chinchilla", "step", "tokens", "compute", "metrics", *_LOSSES, "seed")
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"


def _trimmed(c: str) -> str:
    return f"trim({c}, {_BLANKS})"


def _finite(c: str) -> str:
    text = _trimmed(c)
    return f"CASE WHEN regexp_full_match({text}, '{NUMBER}') AND isfinite(TRY_CAST({text} AS DOUBLE)) THEN TRY_CAST({text} AS DOUBLE) END"


_WHOLE = {c: whole_sql(_trimmed(c)) for c in ("step", "tokens", "seed")}
_SCHEDULE = ", ".join(f"('{r['params']}', {r['tokens_per_step']}, {r['exact_parameter_count']})" for r in schedule_rows())
_RULES = [
    ("group", "grp NOT IN (SELECT source_group FROM source_groups WHERE recipe IS NOT NULL)", "grp"),
    ("model", f"model NOT IN ({', '.join(repr(s) for s in SIZES)})", "model"),
    ("task", rf"trim(task) = '' OR regexp_matches(task, '^\s|\s$')", "task"),
    ("step", "coalesce(w_step, -1) < 0", "step"),
    ("seed", "w_seed IS NULL OR w_seed NOT IN (SELECT seed_value FROM seeds)", "seed"),
    ("tokens", f"{_trimmed('tokens')} <> '' AND w_tokens IS NULL", "tokens"),
    ("compute", f"{_trimmed('compute')} <> '' AND ({_finite('compute')}) IS NULL", "compute"),
    *[(m, f"{_trimmed(m)} <> '' AND ({_finite(m)}) IS NULL", m) for m in _LOSSES],
    ("schedule", "w_step * per_step <> w_tokens", "tokens"),
]
_KIND = "CASE " + " ".join(f"WHEN {broken} THEN '{kind}'" for kind, broken, _ in _RULES) + " END"
_VALUE = "CASE " + " ".join(f"WHEN kind = '{kind}' THEN {value}" for kind, _, value in _RULES) + " END"
_SAME_CONTENT = ", ".join(["metrics", "c_chinchilla", *[f"c_{m}" for m in _LOSSES]])

#: ``judged`` rows in scope, ``good`` ones with typed values, ``files`` of cells, ``chosen`` files of checkpoints.
BASE = f"""sizes(s_model, per_step, exact) AS (VALUES {_SCHEDULE}),
texts AS (SELECT l.source_file, l.line_no, f.precedence, {', '.join(f"{bare_field(k)} AS {c}" for k, c in enumerate(_FIELDS))} FROM scaling_lines l JOIN source_files f USING (source_file)
  WHERE regexp_full_match(raw_line, '(?s){field_pattern(15)}(\r\n|\r|\n)?')),
read AS (SELECT *, {', '.join(f"{w} AS w_{c}" for c, w in _WHOLE.items())} FROM texts LEFT JOIN sizes ON model = s_model),
judged AS (SELECT *, {_KIND} AS kind FROM read WHERE {_trimmed('seed')} <> '' AND coalesce(w_seed, -1) <> 6198 AND grp NOT IN (SELECT source_group FROM source_groups WHERE recipe IS NULL)),
good AS (SELECT j.source_file, j.line_no, j.precedence, g.recipe, j.model AS params, CAST(w_seed AS BIGINT) AS seed_value, CAST(w_step AS BIGINT) AS step, j.task, j.metrics, j.per_step, j.exact, nullif({_trimmed('j.chinchilla')}, '') AS c_chinchilla,
  {', '.join(f"{_finite('j.' + m)} AS c_{m}" for m in _LOSSES)} FROM judged j JOIN source_groups g ON j.grp = g.source_group WHERE kind IS NULL),
files AS (SELECT recipe, params, seed_value, step, task, precedence, source_file, any_value(per_step) AS per_step, any_value(exact) AS exact, COUNT(*) AS n, max(line_no) AS line_no, arg_max(metrics, line_no) AS metrics, COUNT(DISTINCT ({_SAME_CONTENT})) = 1 AS alike FROM good GROUP BY 1, 2, 3, 4, 5, 6, 7),
per_file AS (SELECT recipe, params, seed_value, step, precedence, source_file, any_value(per_step) AS per_step, any_value(exact) AS exact, max(line_no) AS line_no, bool_or(coalesce({', '.join(f'c_{m}' for m in _LOSSES)}) IS NOT NULL) AS has,
  {', '.join(f'min(c_{m}) AS {m}' for m in ('chinchilla', *_LOSSES))}, concat_ws(', ', {', '.join(f"CASE WHEN COUNT(DISTINCT c_{m}) > 1 THEN '{m}' END" for m in ('chinchilla', *_LOSSES))}) AS conflicts FROM good GROUP BY 1, 2, 3, 4, 5, 6),
chosen AS (SELECT * FROM per_file QUALIFY row_number() OVER (PARTITION BY recipe, params, seed_value, step ORDER BY has DESC, precedence DESC) = 1)"""

_KNOWN = ", ".join(repr(m) for m in (*METRICS, *DROPPED_METRICS))
_POLICY = " ".join(f"WHEN task = '{t}' THEN {m}" for t, m in PRIMARY_METRIC.items())
_USED = ("acc_raw", "acc_per_char", "acc_uncond", "logits_per_byte_corr")

RESOLUTION_SQL = f"""WITH {BASE},
whole AS (SELECT *, max(n) OVER (PARTITION BY recipe, params, seed_value, step, task) AS most FROM files),
won AS (SELECT *, TRY_CAST(replace(replace(metrics, '''', '"'), 'None', 'null') AS JSON) AS j FROM whole WHERE most = 1 QUALIFY row_number() OVER (PARTITION BY recipe, params, seed_value, step, task ORDER BY precedence DESC) = 1),
parsed AS (SELECT *, j IS NULL OR len(list_filter(json_keys(j), lambda k: k NOT IN ({_KNOWN}))) > 0 AS metrics_faulty FROM won),
typed AS (SELECT *, {', '.join(f"CASE WHEN NOT metrics_faulty THEN TRY_CAST(j ->> '$.{m}' AS DOUBLE) END AS {m}" for m in _USED)} FROM parsed)
SELECT recipe, params, seed_value, step, task, source_file, step * per_step AS tokens, CAST(step * per_step AS DOUBLE) * exact * 6 AS compute, metrics_faulty, acc_raw, logits_per_byte_corr,
  CASE WHEN starts_with(task, 'mmlu_') THEN acc_raw {_POLICY} END AS primary_metric FROM typed"""

CHECKPOINTS_SQL = f"""WITH {BASE} SELECT recipe, params, seed_value, step, source_file, step * per_step AS tokens, CAST(step * per_step AS DOUBLE) * exact * 6 AS compute, chinchilla, {', '.join(_LOSSES)} FROM chosen WHERE conflicts = ''"""

FAULTS_SQL = f"""WITH {BASE} SELECT source_file, line_no AS source_row, kind, {_VALUE} AS value FROM judged WHERE kind IS NOT NULL
UNION ALL SELECT source_file, line_no, CASE WHEN alike THEN 'duplicate' ELSE 'unequal duplicate' END, concat_ws('/', recipe, params, seed_value, step, task) || ' x ' || n FROM files WHERE n > 1
UNION ALL SELECT source_file, line_no, 'conflict', concat_ws('/', recipe, params, seed_value, step) || ': ' || conflicts FROM chosen WHERE conflicts <> ''"""

COMPUTE_SQL = f"""SELECT line_id, {_finite("x")} AS compute_value FROM (SELECT line_id, {bare_field(6)} AS x FROM scaling_lines WHERE regexp_full_match(raw_line, '(?s){field_pattern(15)}(\r\n|\r|\n)?'))"""

LITERALS_SQL = f"""WITH v AS (SELECT line_id, TRY_CAST(replace(replace(metrics, '''', '"'), 'None', 'null') AS JSON) AS j FROM ({P1_VALID_SQL})),
f AS (SELECT *, j IS NULL OR len(list_filter(json_keys(j), lambda k: k NOT IN ({_KNOWN}))) > 0 AS faulty FROM v)
SELECT line_id, faulty, {', '.join(f"CASE WHEN NOT faulty THEN TRY_CAST(j ->> '$.{m}' AS DOUBLE) END AS {m}" for m in ('correct_choice', 'acc_raw', 'acc_per_char'))} FROM f"""

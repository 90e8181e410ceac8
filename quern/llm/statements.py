"""DuckDB statements of the queries of this subpackage."""

from __future__ import annotations

_P4_FIELDS = ("chinchilla", "tokens", "compute", "c4_en_validation_cross_entropy", "train_cross_entropy", "throughput_total_tokens", "acc_raw", "acc_per_char", "primary_metric")
_P4_ROWS = r"""
g AS (SELECT source_group, recipe, regexp_replace(lower(source_group), '[^a-z0-9]', '', 'g') AS s FROM source_groups),
letters AS (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM g),
spellings AS (
  SELECT s AS spelling, recipe FROM g
  UNION SELECT left(s, i - 1) || substring(s, i + 1), recipe FROM letters WHERE substring(s, i, 1) BETWEEN 'a' AND 'z'
  UNION SELECT left(s, i) || substring(s, i), recipe FROM letters WHERE substring(s, i, 1) BETWEEN 'a' AND 'z'),
rows AS (
  SELECT e.*, p.recipe, f.precedence, upper(trim(params)) AS k_params, CAST(CAST(trim(e.seed) AS DOUBLE) AS BIGINT) AS k_seed, CAST(CAST(trim(e.step) AS DOUBLE) AS BIGINT) AS k_step, lower(trim(e.task)) AS k_task
  FROM evaluations e JOIN spellings p ON regexp_replace(lower(e.source_group), '[^a-z0-9]', '', 'g') = p.spelling
  LEFT JOIN source_files f ON regexp_extract(lower(trim(e.source_file)), '([^/]*)$', 1) = f.source_file WHERE p.recipe IS NOT NULL),
cells AS (SELECT *, MIN(eval_id) OVER w AS group_id, COUNT(*) OVER w AS n FROM rows WINDOW w AS (PARTITION BY recipe, k_params, k_seed, k_step, k_task))"""


def _has(f: str) -> str:
    return "trim(chinchilla) <> ''" if f == "chinchilla" else f"{f} IS NOT NULL AND NOT isnan({f})"


P4_SQL = f"WITH {_P4_ROWS}\n" + "\nUNION ALL ".join(
    f"(SELECT group_id, '{f}' AS field_name, eval_id FROM cells WHERE n > 1 AND {_has(f)} QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY precedence DESC NULLS LAST, loaded_at DESC, eval_id) = 1)" for f in _P4_FIELDS
)

#: Candidates are the latest row per cell, filled fields and trust; undominated ones are counted by comparing all of them.
P4_MERGED_SQL = f"""WITH {_P4_ROWS},
known AS (SELECT *, {' + '.join(f"CASE WHEN {_has(f)} THEN {1 << k} ELSE 0 END" for k, f in enumerate(_P4_FIELDS))} AS mask, coalesce(precedence, -2147483648) AS trust, coalesce(loaded_at, TIMESTAMP '0001-01-01') AS came FROM cells),
candidates AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY group_id, mask, trust ORDER BY came DESC, eval_id) = 1),
skyline AS (SELECT * FROM candidates x WHERE NOT EXISTS (SELECT 1 FROM candidates a WHERE a.group_id = x.group_id AND (a.mask & x.mask) = x.mask AND a.trust >= x.trust AND a.came >= x.came AND (a.mask <> x.mask OR a.trust > x.trust OR a.came > x.came))),
best AS (SELECT group_id, COUNT(*) AS n_undominated, arg_min(eval_id, (-trust, -epoch_us(came), -bit_count(mask), eval_id)) AS best_eval_id FROM skyline GROUP BY 1)
SELECT k.recipe, k_params AS params, k_seed AS seed, k_step AS step, k_task AS task, group_id, any_value(n) AS n_rows, any_value(best_eval_id) AS best_eval_id, any_value(n_undominated) AS n_undominated,
  {', '.join(f"arg_min({f}, (-trust, -epoch_us(came), eval_id)) FILTER (WHERE {_has(f)}) AS {f}" for f in _P4_FIELDS)} FROM known k JOIN best USING (group_id) GROUP BY 1, 2, 3, 4, 5, 6"""

# Texts are undressed step by step; a line end after a hyphen is read joined in one copy and apart in the other.
# Character references other than &#39; do not stand in the tables.
_INLINE = "a|abbr|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strong|sub|sup|tt|u|var|wbr"
_QUOTED = r"[ \t]*\r?\n[ \t]*(?:>[ \t]*)*"
_INVISIBLE = " || ".join(f"chr({c})" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))


def _undressed(text: str) -> str:
    inline = rf"regexp_replace({text}, '(?is)</?({_INLINE})\b[^<>]*>', '', 'g')"
    bare = rf"regexp_replace({inline}, '(?s)</?[A-Za-z][A-Za-z0-9]*\b[^<>]*>', ' ', 'g')"
    soft = f"regexp_replace(replace({bare}, '&#39;', chr(39)), chr(173) || '{_QUOTED}', '', 'g')"
    return f"lower(nfc_normalize(regexp_replace({soft}, '[' || {_INVISIBLE} || ']', '', 'g')))"


def _stretches(source: str, key: str) -> str:
    words = rf"SELECT {key}, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') AS w FROM {source}"
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + 9], ' ') AS stretch FROM (SELECT {key}, w, unnest(range(1, len(w) - 8)) AS i FROM ({words}))"


_BREAK = rf"(?s)([\p{{L}}\p{{N}}])[-‐‑]{_QUOTED}([\p{{L}}\p{{N}}])"
_P6 = rf"""d AS (SELECT doc_id, {_undressed("text")} AS t FROM documents WHERE text IS NOT NULL),
d2 AS (SELECT doc_id, t FROM d UNION ALL SELECT doc_id, regexp_replace(t, '{_BREAK}', '\1\2', 'g') FROM d),
i AS (SELECT item_id, {_undressed("passage")} AS t FROM eval_items WHERE passage IS NOT NULL UNION ALL SELECT item_id, {_undressed("question")} FROM eval_items WHERE question IS NOT NULL),
found AS (SELECT DISTINCT doc_id, item_id FROM ({_stretches("d2", "doc_id")}) JOIN ({_stretches("i", "item_id")}) USING (stretch))"""
P6_SQL = f"WITH {_P6} SELECT doc_id, item_id FROM found"
P6_TASKS_SQL = f"WITH {_P6} SELECT task, COUNT(DISTINCT doc_id) AS documents, COUNT(DISTINCT item_id) AS items FROM found JOIN eval_items USING (item_id) GROUP BY task"

ORACLE = {"p4_found": P4_SQL, "p4_merged": P4_MERGED_SQL, "p6_found": P6_SQL, "p6_tasks": P6_TASKS_SQL}

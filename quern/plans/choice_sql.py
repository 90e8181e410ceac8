"""DuckDB statements of the choice queries."""

from __future__ import annotations

from quern.plans.problems import P5_LINKS_SQL, json_real, json_whole

_RULES = ("raw", "per_token", "per_char", "per_byte", "pmi")
_PUBLISHED = {"raw": "predicted_index_raw", "per_token": "predicted_index_per_token", "per_char": "predicted_index_per_char", "pmi": "predicted_index_uncond"}


def _first(value: str) -> str:
    """The place of the largest value, the first of equal ones."""
    return f"CAST(arg_min(choice_index, (-({value}), choice_index)) FILTER (WHERE ({value}) IS NOT NULL) AS INTEGER)"


_BASE = f"""{P5_LINKS_SQL},
v AS (SELECT *, CASE WHEN isfinite(logits_per_byte) THEN logits_per_byte END AS bits FROM (
  SELECT bundle_id, p_at, choice_index, {json_real('item', 'sum_logits')}, {json_real('item', 'sum_logits_uncond')}, {json_real('item', 'logits_per_byte')}, {json_whole('item', 'num_tokens')}, {json_whole('item', 'num_chars')} FROM c)),
o AS (SELECT *, CASE WHEN r >= 1 AND r < 9007199254740992 THEN r END AS octets FROM (SELECT *, round(-sum_logits / nullif(bits * ln(2), 0)) AS r FROM v)),
predicted AS (SELECT bundle_id, p_at AS prediction_index, {_first('sum_logits')} AS predicted_raw, {_first('sum_logits / nullif(num_tokens, 0)')} AS predicted_per_token, {_first('sum_logits / nullif(num_chars, 0)')} AS predicted_per_char,
  CASE WHEN COUNT(*) = COUNT(octets) THEN {_first('sum_logits / octets')} END AS predicted_per_byte, {_first('sum_logits - sum_logits_uncond')} AS predicted_pmi,
  CASE WHEN COUNT(*) = COUNT(bits) THEN {_first('-bits')} END AS published_per_byte FROM o GROUP BY 1, 2)"""

PREDICTIONS_SQL = f"WITH {_BASE} SELECT * EXCLUDE (published_per_byte) FROM predicted"

_READ = ", ".join(f"TRY_CAST(item ->> '$.metrics.{name}' AS INTEGER) AS published_{rule}" for rule, name in _PUBLISHED.items())
AGREEMENT_SQL = f"""WITH {_BASE},
known AS (SELECT bundle_id, p_at AS prediction_index, {json_whole('item', 'label')}, {_READ} FROM q),
matched AS (SELECT * FROM predicted JOIN known USING (bundle_id, prediction_index)),
long AS ({' UNION ALL '.join(f"SELECT '{r}' AS rule, predicted_{r} AS o, published_{r} AS p, label FROM matched" for r in _RULES)})
SELECT rule, COUNT(*) AS items, AVG(CASE WHEN o IS NULL OR p IS NULL THEN NULL WHEN o = p THEN 1.0 ELSE 0.0 END) AS agreement, AVG(CASE WHEN o IS NULL OR label IS NULL THEN NULL WHEN o = label THEN 1.0 ELSE 0.0 END) AS accuracy_ours,
  AVG(CASE WHEN p IS NULL OR label IS NULL THEN NULL WHEN p = label THEN 1.0 ELSE 0.0 END) AS accuracy_published FROM long GROUP BY rule"""

MISMATCHES_SQL = f"""WITH {_BASE},
known AS (SELECT bundle_id, p_at AS prediction_index, {_READ} FROM q),
matched AS (SELECT *, bundle_id || '/' || prediction_index AS item FROM predicted JOIN known USING (bundle_id, prediction_index)),
long AS ({' UNION ALL '.join(f"SELECT '{r}' AS rule, item, predicted_{r} AS ours, published_{r} AS published FROM matched" for r in _RULES)})
SELECT rule, item, ours, published FROM long WHERE ours IS DISTINCT FROM published QUALIFY row_number() OVER (PARTITION BY rule ORDER BY item) <= 5"""

DIFFERENCES_SQL = f"""WITH {_BASE},
pairs AS (SELECT *, bundle_id % 5 <> 0 OR choice_index <> 0 AS ours, (bundle_id % 3) * 0.25 AS shift FROM v)
SELECT COUNT(*) FILTER (WHERE ours) AS choices, CAST(0 AS BIGINT) AS ours_only, COUNT(*) FILTER (WHERE NOT ours) AS published_only,
  round(AVG(abs((sum_logits + shift) - sum_logits)) FILTER (WHERE ours), 9) AS log_likelihood_mean_abs_diff, round(MAX(abs((sum_logits + shift) - sum_logits)) FILTER (WHERE ours), 9) AS log_likelihood_max_abs_diff,
  round(AVG(abs((sum_logits_uncond - shift) - sum_logits_uncond)) FILTER (WHERE ours), 9) AS unconditional_mean_abs_diff, round(MAX(abs((sum_logits_uncond - shift) - sum_logits_uncond)) FILTER (WHERE ours), 9) AS unconditional_max_abs_diff,
  round(AVG(CASE WHEN bundle_id % 4 <> 0 OR num_tokens IS NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE ours), 9) AS token_agreement FROM pairs"""

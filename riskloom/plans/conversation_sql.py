"""SQL twins of the conversation queries."""

from riskloom import constants as K
from riskloom.plans import sql_text as X
from riskloom.sources.reports import PAGE

_TURNS = "turns AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, role AS sender, text AS t FROM conversations)"
_SCORED = f"{_TURNS}, {X.scored_cte('turns')}"
_RICH = f"""{_SCORED}, rich AS (SELECT *,
  CASE WHEN risk_score >= 30 THEN 'fraudulent' ELSE 'legitimate' END AS ml_label,
  greatest(risk_score, 100 - risk_score) / 100.0::DOUBLE AS ml_confidence FROM scored)"""
_SIZES = "sizes(w) AS (VALUES (2), (3), (5), (8))"
_WINDOWS = f"""{_SIZES}, lens AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
wins AS (SELECT a.conv_id, a.turn AS s, w FROM turns a JOIN lens USING (conv_id) CROSS JOIN sizes
  WHERE a.turn + w <= n)"""


def _sum_hits(vocabulary) -> str:
    return f"CAST({X.hits('lower(t)', vocabulary)} AS DOUBLE)"


_FEATURES = f"""{_RICH}, {_WINDOWS},
words AS (SELECT conv_id, turn, t, risk_score, ml_label, len(signals) AS sig,
  {_sum_hits(K.URGENCY_WORDS)} AS h_urg, {_sum_hits(K.CREDENTIAL_WORDS)} AS h_cred,
  {_sum_hits(K.IMPERSONATION_WORDS)} AS h_imp, {_sum_hits(K.PRIZE_WORDS)} AS h_prize,
  {_sum_hits(K.PRESSURE_WORDS)} AS h_press, {_sum_hits(K.TRANSFER_WORDS)} AS h_trans FROM rich),
cells AS (SELECT wins.conv_id, s, w, m.turn - s AS pos, greatest(1, w // 2) AS half, m.* EXCLUDE (conv_id, turn)
  FROM wins JOIN words m ON m.conv_id = wins.conv_id AND m.turn BETWEEN s AND s + w - 1),
agg AS (SELECT conv_id, s, w,
  regr_slope(risk_score, pos) AS risk_slope,
  arg_max(risk_score, pos) - arg_min(risk_score, pos) AS risk_delta,
  max(risk_score) AS risk_max, avg(risk_score) AS risk_mean, var_pop(risk_score) AS risk_variance,
  avg(risk_score) FILTER (pos >= half) - avg(risk_score) FILTER (pos < half) AS risk_acceleration,
  CASE WHEN w > 2 AND arg_max(risk_score, pos) > avg(risk_score) + 1.5 * stddev_pop(risk_score) + 1e-9
    THEN 1.0 ELSE 0.0 END AS late_risk_spike,
  avg(risk_score) FILTER (pos < half) AS early_risk_mean, avg(risk_score) FILTER (pos >= half) AS late_risk_mean,
  avg(CASE WHEN ml_label = 'fraudulent' THEN 1.0::DOUBLE ELSE 0 END) AS ml_fraud_ratio,
  avg(CASE WHEN ml_label = 'fraudulent' THEN 1.0::DOUBLE ELSE 0 END) FILTER (pos >= half) AS ml_fraud_late_ratio,
  avg(CASE WHEN ml_label = 'legitimate' THEN 1.0::DOUBLE ELSE 0 END) FILTER (pos < half) AS ml_legit_early_ratio,
  sum(sig) AS signal_total, regr_slope(sig, pos) AS signal_slope, arg_max(sig, pos) AS signal_last,
  sum(h_urg) AS urgency_count, sum(h_cred) AS credential_count, sum(h_imp) AS impersonation_count,
  sum(h_prize) AS prize_count, sum(h_press) AS pressure_count, sum(h_trans) AS transfer_count,
  lower(string_agg(t, ' ' ORDER BY pos) FILTER (pos < half)) AS early_text,
  lower(string_agg(t, ' ' ORDER BY pos) FILTER (pos >= half)) AS late_text
  FROM cells GROUP BY conv_id, s, w),
feats AS (SELECT *, w AS n_messages,
  {X.hits('late_text', K.URGENCY_WORDS)} / greatest(urgency_count, 1) AS urgency_late_ratio,
  {X.hits('late_text', K.CREDENTIAL_WORDS)} / greatest(credential_count, 1) AS credential_late_ratio,
  {X.hits('early_text', K.PRIZE_WORDS)} / greatest(prize_count, 1) AS prize_early_ratio FROM agg)"""

_KEYS = "conv_id, s AS start_idx, s + w - 1 AS end_idx"


def _bound(expr: str, limit: float) -> str:
    return f"least(greatest(({expr}) / {limit}::DOUBLE, 0), 1)"


_PATTERN_SQL = {
    "urgency_escalation": f"""0.40 * {_bound('risk_slope', 8.0)} + 0.40 * {_bound('risk_acceleration', 30.0)}
      + 0.20 * least(urgency_count / 3.0, 1) * (0.5 + 0.5 * urgency_late_ratio)""",
    "credential_harvesting": """0.40 * least(credential_count / 2.0, 1) * (0.5 + 0.5 * credential_late_ratio)
      + 0.25 * least(impersonation_count / 2.0, 1) + 0.20 * ml_fraud_ratio + 0.15 * least(urgency_count / 3.0, 1)""",
    "social_engineering": f"""CASE WHEN w < 4 THEN 0 ELSE 0.50 * ml_legit_early_ratio * ml_fraud_late_ratio
      + 0.30 * {_bound('risk_acceleration', 35.0)} + 0.20 * late_risk_spike END""",
    "impersonation": """0.45 * least(impersonation_count / 2.0, 1)
      + 0.30 * least((urgency_count + credential_count) / 3.0, 1) + 0.25 * ml_fraud_ratio""",
    "prize_scam_sequence": """CASE WHEN prize_count < 1 THEN 0 ELSE
      0.50 * least(prize_count / 2.0, 1) * prize_early_ratio + 0.50 * least(greatest(
        credential_late_ratio * least(credential_count, 1), least(transfer_count / 2.0, 1),
        ml_fraud_late_ratio * 0.6), 1) END""",
    "financial_coercion": """0.35 * least(pressure_count / 2.0, 1) + 0.35 * least(transfer_count / 2.0, 1)
      + 0.15 * least(urgency_count / 3.0, 1) + 0.15 * ml_fraud_ratio""",
    "trust_building_attack": f"""CASE WHEN w < 4 THEN 0 ELSE
      0.60 * ml_legit_early_ratio * (0.5 * late_risk_spike + 0.5 * {_bound('risk_delta', 60.0)})
      + 0.40 * {_bound('risk_delta', 60.0)} END""",
}
_PATTERNS = f"{_FEATURES}, pats AS (" + " UNION ALL ".join(
    f"SELECT conv_id, CAST(s AS INTEGER) AS start_idx, CAST(s + w - 1 AS INTEGER) AS end_idx, "
    f"'{name}' AS pattern_type, CAST(least({expr}, 0.92) AS DOUBLE) AS score FROM feats WHERE w >= {K.PATTERNS[name][0]}"
    for name, expr in _PATTERN_SQL.items()) + ")"


def _cands(threshold: float) -> str:
    return f"""WITH {_PATTERNS} SELECT conv_id, pattern_type, start_idx, end_idx, round(score, 6) AS score
      FROM pats WHERE score >= {threshold}"""


# The fold, one candidate per recursion step.
def _merged(threshold: float, score: str) -> str:
    """CTEs merged (rules only) and judged (after the stand-in reviewer)."""
    return f"""{_PATTERNS},
cands AS (SELECT conv_id, pattern_type, start_idx, end_idx, {score} AS score FROM pats WHERE score >= {threshold}),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pattern_type
  ORDER BY start_idx, score DESC, end_idx) AS rn FROM cands),
fold AS (
  SELECT conv_id, pattern_type, 1 AS rn,
    [{{'a': start_idx, 'b': end_idx, 'x': score}}] AS kept FROM ordered WHERE rn = 1
  UNION ALL
  SELECT conv_id, pattern_type, rn, CASE WHEN hit IS NULL THEN list_append(kept, item)
    WHEN item.x > kept[hit].x THEN list_transform(kept, lambda k, i: CASE WHEN i = hit THEN item ELSE k END)
    ELSE kept END AS kept
  FROM (SELECT f.conv_id, f.pattern_type, o.rn, f.kept,
      {{'a': o.start_idx, 'b': o.end_idx, 'x': o.score}} AS item,
      list_min(list_filter(list_transform(f.kept, lambda k, i: CASE WHEN
        greatest(0, least(o.end_idx, k.b) - greatest(o.start_idx, k.a) + 1)
        / least(o.end_idx - o.start_idx + 1, k.b - k.a + 1)::DOUBLE >= 0.60 THEN i END), lambda z: z IS NOT NULL)) AS hit
    FROM fold f JOIN ordered o ON o.conv_id = f.conv_id AND o.pattern_type = f.pattern_type AND o.rn = f.rn + 1)),
merged AS (SELECT conv_id, pattern_type, k.a AS start_idx, k.b AS end_idx, k.x AS rule_score FROM (
  SELECT conv_id, pattern_type, unnest(kept) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, pattern_type ORDER BY rn DESC) AS last FROM fold) WHERE last = 1)),
judged AS (SELECT *, CASE WHEN start_idx % 2 = 0 THEN round(
    wgt * vc + (1 - wgt) * rule_score, 3) ELSE rule_score END AS confidence FROM (
  SELECT *, CASE WHEN vc >= 0.70 THEN 0.60::DOUBLE ELSE 0.40::DOUBLE END AS wgt FROM (
    SELECT *, 0.5::DOUBLE + end_idx * 0.05::DOUBLE AS vc FROM merged)))"""


_MERGED = _merged(0.10, "round(score, 6)")
_LEVEL = """CASE WHEN {0} >= 0.80 THEN 'critical' WHEN {0} >= 0.60 THEN 'high'
  WHEN {0} >= 0.35 THEN 'medium' ELSE 'low' END"""

_FLAG = "CAST(sig_{} AS INTEGER)::DOUBLE"
_ENCODED = f"""{_RICH}, enc AS (SELECT conv_id, turn, risk_score / 100.0::DOUBLE AS risk,
  CASE risk_level WHEN 'low' THEN 0.0::DOUBLE WHEN 'medium' THEN 0.5 ELSE 1.0 END AS level,
  {_FLAG.format('credential')} AS credential, {_FLAG.format('urgency')} AS urgency,
  CAST(sig_pressure OR sig_block AS INTEGER)::DOUBLE AS pressure, {_FLAG.format('transfer')} AS transfer,
  {_FLAG.format('prize')} AS prize, CAST(sig_money OR sig_money_words AS INTEGER)::DOUBLE AS financial,
  round(least(length(t) / 300.0::DOUBLE, 1), 6) AS text_len,
  round(greatest((risk_score - coalesce(lag(risk_score) OVER (PARTITION BY conv_id ORDER BY turn), 0)) / 100.0::DOUBLE, 0), 6)
    AS risk_delta FROM rich)"""


def _path(risk: str, source: str) -> str:
    return f"""{source},
risks AS (SELECT conv_id, turn, t, {risk} AS r FROM scored),
means AS (SELECT conv_id, greatest(avg(r), 0.3) AS lim FROM risks GROUP BY conv_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY r DESC, turn) AS k FROM risks)
  JOIN means USING (conv_id) WHERE k <= 4)
SELECT conv_id, string_agg(turn, ',' ORDER BY turn) AS path, round(avg(r), 4) AS path_score,
  CAST(coalesce(min(turn) FILTER (r >= lim), min(turn)) AS INTEGER) AS escalation_start,
  CASE WHEN avg(r) >= 0.7 THEN 'ESCALADA SEVERA' WHEN avg(r) >= 0.4 THEN 'ESCALADA MODERADA' ELSE 'PATRÓN LEVE' END
  || ': ' || string_agg('msg[' || turn || '] (riesgo ' ||
    CASE WHEN r < 0.3 THEN 'baja' WHEN r < 0.6 THEN 'media' ELSE 'alta' END || ': ' ||
    CAST(round(r * 100) AS INTEGER) || '%) «' || replace(substring(t, 1, 50), chr(10), ' ') ||
    CASE WHEN length(t) > 50 THEN '…' ELSE '' END || '»', ' → ' ORDER BY turn) AS manipulation_arc
FROM top GROUP BY conv_id"""


_HEURISTIC = f"""round(least(0.15 * {X.hits('lower(t)', K.URGENCY_WORDS)} + 0.20 * {X.hits('lower(t)', K.CREDENTIAL_WORDS)}
  + 0.10 * {X.hits('lower(t)', K.MONEY_WORDS)}
  + CASE WHEN {X.match('lower(t)', r'https?://|www\.')} THEN 0.25 ELSE 0 END
  + CASE WHEN {X.match('lower(t)', r'\b\p{Nd}{7,}\b')} THEN 0.10 ELSE 0 END, 1)::DOUBLE, 6)"""


def _draw(a: str, b: int) -> str:
    return f"(((seq_id * 7919 + {a} * 104729 + 42) * 48271 + {b}) % 2147483647)"


_SEQUENCES = f"""{X.LABELLED}, {X.scored_cte('labelled')},
pools AS (
  SELECT 'fraud' AS pool, row_number() OVER (ORDER BY msg_id) - 1 AS number, msg_id, risk_score
    FROM scored WHERE label = 'fraudulent'
  UNION ALL SELECT 'legit', row_number() OVER (ORDER BY msg_id) - 1, msg_id, risk_score
    FROM scored WHERE label = 'legitimate'
  UNION ALL SELECT 'either', row_number() OVER (ORDER BY msg_id) - 1, msg_id, risk_score FROM scored),
sizes AS (SELECT pool, count(*) AS size FROM pools GROUP BY pool),
seqs AS (SELECT seq_id, CASE WHEN seq_id < 1250 THEN 'all_legit' WHEN seq_id < 2500 THEN 'all_fraud'
  WHEN seq_id < 4250 THEN 'trust_attack' ELSE 'escalation' END AS kind FROM range(5000) r(seq_id)),
slots AS (SELECT seq_id, kind, unnest(range(CASE WHEN kind = 'escalation' THEN 20 ELSE 5 END)) AS slot FROM seqs),
picks AS (SELECT *, CASE kind WHEN 'all_legit' THEN 'legit' WHEN 'all_fraud' THEN 'fraud'
  WHEN 'escalation' THEN 'either' ELSE CASE WHEN slot <
    greatest(5 * (40 + {_draw('1000', 17)} % 31) // 100, 1) THEN 'legit' ELSE 'fraud' END END AS pool FROM slots),
filled AS (SELECT p.seq_id, p.kind, p.slot, q.msg_id, q.risk_score FROM picks p JOIN sizes USING (pool)
  JOIN pools q ON q.pool = p.pool AND q.number = {_draw('slot', 0)} % sizes.size),
rising AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY risk_score, slot) - 1 AS r
  FROM filled WHERE kind = 'escalation')
SELECT *, CAST(kind <> 'all_legit' AS INTEGER) AS target FROM (
  SELECT seq_id, kind, CAST(slot AS INTEGER) AS pos, msg_id, risk_score FROM filled WHERE kind <> 'escalation'
  UNION ALL SELECT seq_id, kind, CAST(CASE WHEN r < 10 THEN r // 3 ELSE 3 + (r - 10) // 5 END AS INTEGER), msg_id, risk_score
  FROM rising WHERE r IN (0, 3, 6, 10, 15))"""

SQL = {
    "k1_enriched_turns": f"""WITH {_RICH} SELECT conv_id, turn, sender, risk_score, risk_level,
      array_to_string(signals, ' | ') AS signals, ml_label, ml_confidence FROM rich""",
    "k2_windows": f"""WITH {_TURNS}, {_WINDOWS} SELECT conv_id, s AS start_idx, CAST(s + w - 1 AS INTEGER) AS end_idx,
      (SELECT string_agg(sender, ',' ORDER BY turn) FROM turns m WHERE m.conv_id = wins.conv_id
        AND m.turn BETWEEN s AND s + w - 1) AS senders FROM wins""",
    "k3_k8_window_features": f"WITH {_FEATURES} SELECT conv_id, s AS start_idx, CAST(s + w - 1 AS INTEGER) AS end_idx, "
        + ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0::DOUBLE AS {c}" for c in K.WINDOW_FEATURES) + " FROM feats",
    "k9_k10_pattern_scores": f"""WITH {_PATTERNS} SELECT conv_id, start_idx, end_idx, pattern_type,
      round(score, 6) AS pattern_score FROM pats""",
    "k11_candidates": _cands(0.40),
    "k11_candidates_low_threshold": _cands(0.10),
    "k12_merged_spans": f"""WITH RECURSIVE {_MERGED}
      SELECT conv_id, pattern_type, start_idx, end_idx, rule_score FROM merged""",
    "k13_k14_confirmed_spans": f"""WITH RECURSIVE {_MERGED}
      SELECT conv_id, pattern_type, start_idx, end_idx, rule_score, confidence,
      {_LEVEL.format('confidence')} AS risk_level FROM judged""",
    "k15_conversation_summary": f"""WITH RECURSIVE {_MERGED},
      best AS (SELECT conv_id, count(*) AS pf, max(confidence) AS sc FROM judged GROUP BY conv_id)
      SELECT conv_id, n AS total_messages, coalesce(pf, 0) AS patterns_found,
      coalesce(sc, 0.0::DOUBLE) AS overall_score, {_LEVEL.format('coalesce(sc, 0)')} AS overall_risk
      FROM lens LEFT JOIN best USING (conv_id)""",
    "k15_conversation_report": f"""WITH RECURSIVE {_merged(0.40, "round(score, 6)")},
      best AS (SELECT conv_id, count(*) AS pf, max(rule_score) AS sc FROM merged GROUP BY conv_id)
      SELECT conv_id, n AS total_messages, coalesce(pf, 0) AS patterns_found,
      coalesce(sc, 0.0::DOUBLE) AS overall_score, {_LEVEL.format('coalesce(sc, 0)')} AS overall_risk
      FROM lens LEFT JOIN best USING (conv_id)""",
    "a13_conversation_report": f"""WITH RECURSIVE {_merged(0.10, "round(score, 6)")},
      best AS (SELECT conv_id, count(*) AS pf, max(rule_score) AS sc FROM merged GROUP BY conv_id),
      said AS (SELECT conv_id, CAST(floor(turn / {PAGE}) AS BIGINT) AS page, CAST(count(*) AS INTEGER) AS n_messages,
        string_agg(substring(text, 1, {K.REPORT_TEXT_CHARS}), '|' ORDER BY turn) AS texts FROM conversations GROUP BY ALL),
      found AS (SELECT conv_id, CAST(floor(start_idx / {PAGE}) AS BIGINT) AS page, CAST(count(*) AS INTEGER) AS n_matches
        FROM merged GROUP BY ALL)
      SELECT conv_id, page, n AS total_messages, {_LEVEL.format('coalesce(sc, 0)')} AS overall_risk,
      round(coalesce(sc, 0.0::DOUBLE), 3) AS overall_score, coalesce(pf, 0) AS patterns_found,
      coalesce(n_matches, 0) AS n_matches, n_messages, texts
      FROM said JOIN lens USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN found USING (conv_id, page)""",
    "k16_turn_encoding": f"WITH {_ENCODED} SELECT * FROM enc",
    "k17_padded_encoding": f"""WITH {_ENCODED} SELECT conv_id, 10 AS length,
      CAST(10 - count(*) AS INTEGER) AS n_padding,
      round(sum(risk + level + credential + urgency + pressure + transfer + prize + financial
        + least(tl, 1) + risk_delta), 6) AS total
      FROM (SELECT e.*, length(r.t) / 300.0::DOUBLE AS tl FROM enc e JOIN rich r USING (conv_id, turn))
      WHERE turn < 10 GROUP BY conv_id""",
    "k19_training_sequences": f"WITH {_SEQUENCES}",
    "k20_transition_table": """WITH steps AS (SELECT event_type AS a, ts,
        lead(event_type) OVER w AS b, lead(ts) OVER w AS nxt FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      agg AS (SELECT a, b, count(*) AS n, avg((epoch_us(nxt) - epoch_us(ts)) / 1e6::DOUBLE) AS d FROM steps
        WHERE b IS NOT NULL GROUP BY a, b)
      SELECT a AS from_state, b AS to_state, n,
        round(n / sum(n) OVER (PARTITION BY a)::DOUBLE, 6) AS probability,
        round(d, 3) AS mean_delay_seconds FROM agg""",
    "k21_k24_worst_path": f"WITH {_path('risk_score / 100.0::DOUBLE', _SCORED)}",
    "k23_heuristic_path": "WITH " + _path(_HEURISTIC, f"{_TURNS}, scored AS (SELECT * FROM turns)"),
    "o7_risk_series": f"WITH {_SCORED} SELECT conv_id, turn, sender, risk_score, risk_level FROM scored",
}

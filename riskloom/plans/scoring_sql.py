"""SQL twins of the scoring queries."""

from riskloom import constants as K
from riskloom.plans import sql_text as X
from riskloom.plans.message_sql import evidence_cte

_CLEAN_DOCS = f"{X.DOCS}, cdocs AS (SELECT msg_id, {X.clean('t')} AS t FROM docs)"
_CLEAN_LAB = f"{X.LABELLED}, clab AS (SELECT msg_id, label, {X.clean('t')} AS t FROM labelled)"


def _tfs(source: str, name: str, high: int = 3) -> str:
    three = ", list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
    return f"""{name}_tok AS (SELECT msg_id, regexp_extract_all(strip_accents(lower(t)), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {source}),
{name} AS (SELECT msg_id, term, count(*) AS tf FROM (SELECT msg_id, unnest(flatten([w,
  list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]){three if high == 3 else ''}])) AS term
  FROM {name}_tok) GROUP BY msg_id, term)"""


def _vocab(tfs: str, source: str, name: str = "vocab", limit: int = 10_000) -> str:
    return f"""{name} AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, df, tf,
  ln((1 + (SELECT count(*) FROM {source})) / (1 + df)::DOUBLE) + 1 AS idf FROM (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM {tfs} GROUP BY term
  HAVING count(*) >= 2 ORDER BY tf DESC, term LIMIT {limit}))"""


def _weights(tfs: str, name: str) -> str:
    return f"""{name} AS (SELECT msg_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY msg_id)) AS weight FROM (
  SELECT msg_id, term, (1 + ln(f.tf)) * idf AS x FROM {tfs} f JOIN vocab USING (term)))"""


_VOCAB_OUT = "SELECT term, term_id, df, tf, round(idf, 6) AS idf FROM vocab"

_BAYES_FIT = f"""{_CLEAN_LAB}, {evidence_cte('clab', 'lev')},
fit AS (SELECT count(*) AS n, count(*) FILTER (label = 'fraudulent') AS nf, count(*) FILTER (label <> 'fraudulent') AS nl,
  {', '.join(f"coalesce(sum({e}) FILTER (label = 'fraudulent'), 0) AS f_{e}, coalesce(sum({e}) FILTER (label <> 'fraudulent'), 0) AS l_{e}" for e in K.EVIDENCE)} FROM lev)"""


def _side(side: str, n: str) -> str:
    terms = [f"ln(({n} + 1) / (n + 2)::DOUBLE)"] + [
        f"ln(CASE WHEN s.{e} = 1 THEN ({side}_{e} + 1) / ({n} + 2)::DOUBLE ELSE 1 - ({side}_{e} + 1) / ({n} + 2)::DOUBLE END)"
        for e in K.EVIDENCE]
    return " + ".join(terms)


def _posterior(source: str, keys: str) -> str:
    """CTE bayes over raw texts (column t) of ``source``."""
    return f"""braw AS (SELECT {keys}, CASE WHEN {X.clean('t')} = '' THEN t ELSE {X.clean('t')} END AS t FROM {source}),
{evidence_cte('braw', 'bev')},
bayes AS (SELECT {keys}, round(exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 4) AS bayes_score
  FROM (SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, {_side('f', 'nf')} AS a, {_side('l', 'nl')} AS b FROM bev s CROSS JOIN fit))"""


_CASES = f"""{_CLEAN_LAB}, {_tfs('clab', 'ltf')}, {_vocab('ltf', 'clab')}, {_weights('ltf', 'lw')},
{_CLEAN_DOCS}, {_tfs('cdocs', 'dtf')}, {_weights('dtf', 'dw')},
sims AS (SELECT d.msg_id, c.msg_id AS case_id, round(sum(d.weight * c.weight), 6) AS sim, sum(d.weight * c.weight) AS raw
  FROM dw d JOIN lw c USING (term) GROUP BY d.msg_id, c.msg_id),
near AS (SELECT s.*, CASE WHEN label = 'fraudulent' THEN 1 ELSE 0 END AS lab FROM (
  SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY sim DESC, case_id) AS k FROM sims WHERE sim > 0) s
  JOIN clab ON clab.msg_id = s.case_id WHERE k <= 7),
cases AS (SELECT cdocs.msg_id, coalesce(round(sum(lab) / 7.0::DOUBLE, 4), 0) AS cbr_score,
  coalesce(string_agg(lab, ',' ORDER BY k), '') AS top_k_labels, coalesce(round(sum(round(raw, 4)), 4), 0) AS similarity_sum,
  coalesce(round(max(raw), 4), 0) AS most_similar FROM cdocs LEFT JOIN near ON near.msg_id = cdocs.msg_id GROUP BY cdocs.msg_id)"""

_SAMPLE = """ref AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM (SELECT *, row_number() OVER (
  PARTITION BY label ORDER BY (vec_id * 48271 + 42 * 69621) % 2147483647, vec_id) AS k FROM embeddings) WHERE k <= 500)"""
_SEARCH = f"""{_SAMPLE}, vsims AS (SELECT q.vec_id, r.vec_id AS ref_id, r.label, list_dot_product(q.e, r.e)
    / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(r.e, r.e))) AS raw, round(raw, 6) AS sim
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) q CROSS JOIN ref r),
best AS (SELECT vec_id, coalesce(round(max(raw) FILTER (label = 1), 4), 0) AS fraud_similarity,
  coalesce(round(max(raw) FILTER (label = 0), 4), 0) AS legit_similarity FROM vsims GROUP BY vec_id)"""

_INPUTS = f"""{_CASES}, {_BAYES_FIT.removeprefix(_CLEAN_LAB + ', ')}, {_posterior('docs', 'msg_id')},
{X.scored_cte('docs')}, {_SEARCH},
inputs AS (SELECT *, CASE WHEN clean = '' THEN 'low' ELSE
    CASE greatest(CASE WHEN predicted_class = 'fraudulent' THEN CASE WHEN conf < 0.6 THEN 1 ELSE 2 END
      ELSE CASE WHEN conf < 0.65 THEN 1 ELSE 0 END END,
      CASE risk_level WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END END AS model_level,
    CASE WHEN clean <> '' THEN conf END AS confidence
  FROM (SELECT s.msg_id, c.t AS clean, s.risk_score, s.risk_level, bayes_score, cbr_score, fraud_similarity, legit_similarity,
    (s.msg_id % 1000 * 617) % 1000 / 1000.0::DOUBLE AS anomaly_score,
    CASE WHEN s.msg_id % 4 <> 3 THEN (s.msg_id % 1000 * 389) % 1000 / 1000.0::DOUBLE END AS transformer_proba,
    CASE WHEN cbr_score >= 0.5 THEN 'fraudulent' ELSE 'legitimate' END AS predicted_class,
    greatest(cbr_score, 1 - cbr_score) AS conf FROM scored s JOIN cdocs c USING (msg_id) JOIN cases USING (msg_id)
    JOIN bayes USING (msg_id) LEFT JOIN best ON best.vec_id = s.msg_id)),
meta AS (SELECT *, round(0.5::DOUBLE * cbr_score + 0.3::DOUBLE * risk_score / 100.0::DOUBLE + 0.2::DOUBLE * bayes_score, 4) AS meta_proba FROM inputs),
verdicts AS (SELECT msg_id, CASE WHEN msg_id % 2 = 0 THEN 'fraudulent' WHEN msg_id % 5 = 0 THEN 'suspicious' ELSE 'legitimate' END AS verdict,
  (50 + msg_id % 50) / 100.0::DOUBLE AS vconf,
  {X.array([*K.FRAUD_TYPE_SUFFIX, 'none'])}[CAST(msg_id % 8 AS INTEGER) + 1] AS fraud_type FROM docs WHERE msg_id % 3 = 0)"""


def _gates(source: str, c: dict, name: str = "gated") -> str:
    return f"""{name} AS (SELECT *, NOT gate1 AND NOT gate2 AS is_open FROM (SELECT *,
  searched AND coalesce((predicted_class = 'fraudulent' AND fraud_similarity >= {c['emb_fraud_confirm']})
    OR (predicted_class = 'legitimate' AND legit_similarity >= {c['emb_legit_confirm']} AND fraud_similarity < {c['emb_fraud_threat']}), false) AS gate2
  FROM (SELECT *, NOT gate1 AND fraud_similarity IS NOT NULL AS searched FROM (SELECT *,
    coalesce((predicted_class = 'fraudulent' AND confidence >= {c['ml_conf_certain']} AND risk_score >= {c['rule_fraud_min']})
    OR (predicted_class = 'legitimate' AND confidence >= {c['ml_conf_certain']} AND risk_score < {c['rule_legit_max']}), false) AS gate1 FROM {source}))))"""


def _boosts(c: dict) -> str:
    return f"""greatest({_rank('model_level')},
  CASE WHEN searched AND fraud_similarity >= {c['emb_boost_high']} THEN 2 WHEN searched AND fraud_similarity >= {c['emb_boost_medium']} THEN 1 ELSE 0 END,
  CASE WHEN anomaly_score >= {c['anomaly_boost_thr']} AND predicted_class = 'legitimate' THEN 1 ELSE 0 END,
  CASE WHEN transformer_proba >= {c['transformer_high']} THEN 2 WHEN transformer_proba >= {c['transformer_med']} THEN 1 ELSE 0 END,
  CASE WHEN bayes_score >= {c['bayes_high_thr']} THEN 1 ELSE 0 END,
  CASE WHEN cbr_score >= {c['cbr_high_thr']} AND predicted_class <> 'legitimate' THEN 1 ELSE 0 END)"""


def _rank(level: str) -> str:
    return f"CASE {level} WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


def _decide(source: str, verdicts: bool, meta: bool, overrides: dict | None = None) -> str:
    c = {**K.CASCADE_DEFAULTS, **(overrides or {})}
    join = "LEFT JOIN verdicts USING (msg_id)" if verdicts else \
        "CROSS JOIN (SELECT CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS DOUBLE) AS vconf, CAST(NULL AS VARCHAR) AS fraud_type)"
    proba = "meta_proba" if meta else "CAST(NULL AS DOUBLE)"
    vlevel = """CASE verdict WHEN 'fraudulent' THEN CASE WHEN vconf >= 0.7 THEN 2 ELSE 1 END
      WHEN 'suspicious' THEN 1 ELSE 0 END"""
    advice = " ".join(f"WHEN '{k}' THEN {X.q(v)}" for k, v in K.RECOMMENDATION.items())
    suffix = " ".join(f"WHEN '{k}' THEN {X.q(v)}" for k, v in K.FRAUD_TYPE_SUFFIX.items())
    return f"""{_gates(source, c)},
ranked AS (SELECT *, CASE WHEN judged THEN greatest({_rank('model_level')}, {vlevel}) ELSE {_boosts(c)} END AS base,
  is_open AND mp IS NOT NULL AS meta_used FROM (SELECT *, {proba} AS mp, is_open AND verdict IS NOT NULL AS judged FROM gated {join})),
final AS (SELECT *, CASE CASE WHEN meta_used THEN greatest(base, CASE WHEN mp >= {c['meta_high_thr']} THEN 2
  WHEN mp >= {c['meta_med_thr']} THEN 1 ELSE 0 END) ELSE base END WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS lvl FROM ranked),
decided AS (SELECT msg_id, CASE WHEN judged THEN verdict ELSE predicted_class END AS predicted_class,
  round(CASE WHEN judged THEN vconf ELSE confidence END, 4) AS confidence, lvl AS risk_level, risk_score, is_open,
  CASE lvl {advice} END || CASE WHEN judged AND NOT meta_used THEN CASE fraud_type {suffix} ELSE '' END ELSE '' END AS recommendation,
  'rules,ml' || CASE WHEN transformer_proba IS NOT NULL THEN ',transformer' ELSE '' END || ',anomaly,bayes,cbr' || CASE WHEN searched THEN ',embeddings' ELSE '' END || CASE WHEN judged THEN ',llm' ELSE '' END
    || CASE WHEN meta_used THEN ',meta' ELSE '' END AS layers_used FROM final)"""


_OUT = "SELECT msg_id, predicted_class, confidence, risk_level, recommendation, layers_used FROM decided"
_RELAXED = {"ml_conf_certain": 0.80, "rule_fraud_min": 20, "rule_legit_max": 40,
            "emb_fraud_confirm": 0.30, "emb_legit_confirm": 0.30, "emb_boost_high": 0.45,
            "emb_boost_medium": 0.35, "cbr_high_thr": 0.50, "meta_med_thr": 0.20}

_FRAUD_TERMS = f"""{_CLEAN_LAB}, {_tfs('clab', 'ltf')}, {_vocab('ltf', 'clab')}, {_weights('ltf', 'lw')},
tw AS (SELECT term, sum(weight) / (SELECT count(*) FROM clab WHERE label = 'fraudulent') AS weight
  FROM lw JOIN clab USING (msg_id) WHERE label = 'fraudulent' GROUP BY term)"""
_PSEUDO = f"""{_INPUTS}, pseudo AS (SELECT i.msg_id, predicted_class AS label, 'pseudo_label' AS source,
  CAST(length(d.t) AS INTEGER) AS n_chars FROM inputs i JOIN docs d USING (msg_id)
  WHERE confidence >= 0.90 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = i.msg_id))"""

SQL = {
    "f1_term_counts": f"""WITH {X.DOCS}, {_tfs('docs', 'tfs')} SELECT msg_id, count(*) AS n_terms,
      CAST(sum(tf) AS BIGINT) AS n_grams, CAST(max(tf) AS INTEGER) AS max_tf, min(term) AS first_term, max(term) AS last_term
      FROM tfs GROUP BY msg_id""",
    "f2_vocabulary": f"WITH {_CLEAN_DOCS}, {_tfs('cdocs', 'tfs')}, {_vocab('tfs', 'cdocs')} {_VOCAB_OUT}",
    "f3_tfidf_weights": f"""WITH {_CLEAN_DOCS}, {_tfs('cdocs', 'tfs')}, {_vocab('tfs', 'cdocs')}, {_weights('tfs', 'ws')}
      SELECT msg_id, term, round(weight, 6) AS weight FROM ws""",
    "f5_legitimate_vocabulary": f"""WITH {_CLEAN_LAB}, legit AS (SELECT * FROM clab WHERE label = 'legitimate'),
      {_tfs('legit', 'tfs', 2)}, {_vocab('tfs', 'legit', limit=3000)} {_VOCAB_OUT}""",
    "i2_evidence_table": f"WITH {_BAYES_FIT} SELECT 'prior' AS feature, round((nf + 1) / (n + 2)::DOUBLE, 6) AS p_fraud, "
        "round((nl + 1) / (n + 2)::DOUBLE, 6) AS p_legit FROM fit" + "".join(
            f" UNION ALL SELECT '{e}', round((f_{e} + 1) / (nf + 2)::DOUBLE, 6), round((l_{e} + 1) / (nl + 2)::DOUBLE, 6) FROM fit"
            for e in K.EVIDENCE),
    "i3_i4_bayes_scores": f"WITH {_BAYES_FIT}, {X.DOCS}, {_posterior('docs', 'msg_id')} SELECT * FROM bayes",
    "i5_bayes_auc": f"""WITH {_BAYES_FIT}, {_posterior('labelled', 'msg_id, label')},
      r AS (SELECT label, rank() OVER (ORDER BY bayes_score) + (count(*) OVER (PARTITION BY bayes_score) - 1) / 2.0::DOUBLE AS rk FROM bayes),
      s AS (SELECT count(*) FILTER (label = 'fraudulent') AS p, count(*) FILTER (label <> 'fraudulent') AS n,
        sum(rk) FILTER (label = 'fraudulent') AS rp FROM r)
      SELECT p AS n_positive, n AS n_negative, round((rp - p * (p + 1) / 2.0::DOUBLE) / (p * n), 6) AS auc FROM s""",
    "i8_nearest_cases": f"WITH {_CASES} SELECT * FROM cases",
    "i9_case_base": """SELECT count(*) AS n_cases, count(*) FILTER (toxic = 1) AS n_fraud,
      count(*) FILTER (toxic <> 1) AS n_legit FROM labels JOIN documents USING (doc_id)""",
    "i10_reference_sample": f"WITH {_SAMPLE} SELECT vec_id, label FROM ref",
    "i11_vector_search": f"""WITH {_SEARCH} SELECT best.*, neighbors FROM best JOIN (
      SELECT vec_id, string_agg(ref_id || ':' || label, ',' ORDER BY k) AS neighbors FROM (
      SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, ref_id) AS k FROM vsims)
      WHERE k <= 5 GROUP BY vec_id) USING (vec_id)""",
    "j1_j2_gates": f"""WITH {_INPUTS}, {_gates('inputs', K.CASCADE_DEFAULTS)} SELECT msg_id, CAST(gate1 AS INTEGER) AS gate1,
      CAST(gate2 AS INTEGER) AS gate2, CAST(is_open AS INTEGER) AS is_open FROM gated""",
    "j3_boosts": f"WITH {_INPUTS}, {_decide('inputs', False, False)} {_OUT}",
    "j4_j6_verdicts": f"WITH {_INPUTS}, {_decide('inputs', True, False)} {_OUT}",
    "j7_meta_features": f"""WITH {_INPUTS} SELECT msg_id, round(CASE WHEN predicted_class = 'fraudulent'
      THEN coalesce(confidence, 0) ELSE 1 - coalesce(confidence, 0) END, 4) AS ml_proba_fraud,
      round(risk_score / 100.0::DOUBLE, 4) AS rule_score_norm, coalesce(fraud_similarity, 0) AS emb_fraud_sim,
      coalesce(legit_similarity, 0) AS emb_legit_sim, round(anomaly_score, 4) AS anomaly_score, coalesce(round(transformer_proba, 4), 0) AS transformer_proba,
      bayes_score, cbr_score FROM inputs""",
    "j9_meta_override": f"WITH {_INPUTS}, {_decide('meta', True, True)} {_OUT}",
    "j10_threshold_overrides": f"WITH {_INPUTS}, {_decide('meta', False, True, _RELAXED)} {_OUT}",
    "j11_cascade": f"""WITH {_INPUTS}, {_decide('meta', False, True)} SELECT predicted_class, risk_level, count(*) AS n,
      round(avg(risk_score), 4) AS mean_score, count(*) FILTER (is_open) AS n_open FROM decided GROUP BY ALL""",
    "l6_fraud_term_weights": f"WITH {_FRAUD_TERMS} SELECT term, round(weight, 6) AS weight FROM tw",
    "l7_top_fraud_terms": f"""WITH {_FRAUD_TERMS} SELECT term, round(weight, 6) AS weight FROM tw
      WHERE length(term) > 3 AND NOT list_contains({X.array(K.COMMON_WORDS)}, term) ORDER BY round(weight, 6) DESC, term LIMIT 200""",
    "l8_pseudo_labels": f"WITH {_PSEUDO} SELECT * FROM pseudo",
    "l9_augmented_table": f"""WITH {_PSEUDO} SELECT *, (msg_id * 48271 + 42 * 69621) % 2147483647 AS shuffle_key FROM (
      SELECT msg_id, label, 'original' AS source FROM labelled UNION ALL SELECT msg_id, label, source FROM pseudo)""",
    "l10_rebalanced_table": f"""WITH {X.LABELLED}, n AS (SELECT label, count(*) AS c FROM labelled GROUP BY label)
      SELECT msg_id, label, CAST(unnest(range(CAST(greatest(round((SELECT max(c) FROM n) / c::DOUBLE), 1) AS BIGINT))) AS INTEGER) AS copy
      FROM labelled JOIN n USING (label)""",
}

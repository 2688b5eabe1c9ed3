"""SQL twins of the learning, profile and stream queries."""

from riskloom import constants as K
from riskloom.operators import robustness
from riskloom.plans import sql_text as X
from riskloom.plans.message_sql import _features_sql
from riskloom.plans.scoring_sql import _INPUTS

_LABELS = "lab AS (SELECT doc_id AS msg_id, CASE WHEN toxic = 1 THEN 'fraudulent' ELSE 'legitimate' END AS label FROM labels)"
_PRED = f"""{X.LABELLED}, {X.scored_cte('labelled')}, pred AS (SELECT msg_id, label, risk_score / 100.0::DOUBLE AS score,
  CASE WHEN risk_score >= 30 THEN 'fraudulent' ELSE 'legitimate' END AS predicted FROM scored)"""
_RATES = """rates AS (SELECT class, support, CASE WHEN called > 0 THEN hit / called::DOUBLE ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END AS recall, hit FROM (
  SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (predicted = class) AS called,
  count(*) FILTER (label = class AND predicted = class) AS hit
  FROM pred CROSS JOIN (VALUES ('fraudulent'), ('legitimate')) c(class) GROUP BY class)),
full_rates AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1_score FROM rates)"""
_ADVICE = " ".join(f"WHEN '{k}' THEN {X.q(v)}" for k, v in K.RECOMMENDATION.items())

_VARIANT_FIX = "CASE WHEN NOT regexp_matches(out, '" + X.NS + "') THEN t ELSE out END"


def _first(text: str, word: str, by: str) -> str:
    return (f"CASE WHEN contains(lower({text}), {word}) THEN substring({text}, 1, instr(lower({text}), {word}) - 1) || {by} "
            f"|| substring({text}, instr(lower({text}), {word}) + length({word})) ELSE {text} END")


_SYNONYM = "CASE " + " ".join(
    f"WHEN contains(lower(t), {X.q(w)}) THEN " + _first("t", X.q(w), f"{X.array(o)}[CAST(r % {len(o)} AS INTEGER) + 1]")
    for w, o in K.URGENCY_SYNONYMS.items()) + " ELSE t END"
_JOIN = "array_to_string({}, ' ')"
_PERTURB = f"""{X.DOCS}, fan AS (SELECT msg_id, t, w, v AS variant, (msg_id * 31 + v * 17) % 5 AS kd,
  (msg_id * 7919 + v * 104729 + 42) % 2147483647 AS r,
  list_filter(list_transform(w, lambda x, i: CASE WHEN length(x) >= 3 THEN i END), lambda z: z IS NOT NULL) AS lo,
  list_filter(list_transform(w, lambda x, i: CASE WHEN length(x) <= 5 THEN i END), lambda z: z IS NOT NULL) AS sh
  FROM (SELECT msg_id, t, {X.words('t')} AS w FROM docs) CROSS JOIN range(200) g(v)),
spot AS (SELECT *, CASE WHEN kd = 0 AND len(lo) > 0 THEN lo[r % len(lo) + 1]
  WHEN kd = 1 THEN CASE WHEN len(sh) > 0 THEN sh[r % len(sh) + 1] WHEN len(w) > 0 THEN r % len(w) + 1 END
  WHEN kd = 3 AND len(w) > 0 THEN r % len(w) + 1 END AS pt FROM fan),
cutp AS (SELECT *, w[pt] AS x, (r // 7) % greatest(length(w[pt]) - 1, 1) AS c FROM spot),
changed AS (SELECT *, CASE
  WHEN kd = 0 AND pt IS NOT NULL THEN {_JOIN.format("list_transform(w, lambda y, i: CASE WHEN i = pt THEN substring(x, 1, c) || substring(x, c + 2, 1) || substring(x, c + 1, 1) || substring(x, c + 3) ELSE y END)")}
  WHEN kd = 1 AND len(w) > 2 THEN {_JOIN.format("list_concat(w[1:pt - 1], w[pt + 1:])")}
  WHEN kd = 2 THEN {_JOIN.format("list_concat(w[1:r % (len(w) + 1)], [" + X.array(K.FILLER_WORDS) + "[(r // 11) % 14 + 1]], w[r % (len(w) + 1) + 1:])")}
  WHEN kd = 3 AND pt IS NOT NULL THEN {_JOIN.format("list_transform(w, lambda y, i: CASE WHEN i = pt THEN CASE WHEN x = lower(x) AND x <> upper(x) THEN replace(replace(upper(x), 'ß', 'SS'), 'ẞ', 'SS') WHEN x = upper(x) AND x <> lower(x) THEN lower(x) ELSE array_to_string(list_transform(string_split(x, ''), lambda ch: CASE WHEN ch = lower(ch) THEN replace(replace(upper(ch), 'ß', 'SS'), 'ẞ', 'SS') ELSE lower(ch) END), '') END ELSE y END)")}
  WHEN kd = 4 THEN {_SYNONYM} ELSE t END AS out FROM cutp),
variants AS (SELECT msg_id, CAST(variant AS INTEGER) AS variant,
  ['swap_chars', 'delete_word', 'insert_filler', 'change_case', 'synonym_swap'][kd + 1] AS kind, {_VARIANT_FIX} AS message FROM changed)"""



def _disguises(source: str) -> str:
    """CTE disguised (msg_id, kind, message) over texts (column t) of ``source``."""
    signals = list(dict.fromkeys(K.URGENCY_WORDS + K.CREDENTIAL_WORDS))
    present = lambda least: (
        f"list_filter({X.array([w for w in signals if len(w) >= least])}, lambda x: contains(lower(t), x))")
    pick = lambda values, number: f"{X.array(values)}[CAST({number} % {len(values)} AS INTEGER) + 1]"
    steps, last = [], "marked"
    for k, (word, options) in enumerate(K.URGENCY_SYNONYMS.items()):
        steps.append(f"syn{k} AS (SELECT * EXCLUDE (s), {_first('s', X.q(word), pick(options, 'r'))} AS s FROM {last})")
        last = f"syn{k}"
    typo = "CASE look " + " ".join(
        f"WHEN {X.q(w)} THEN {pick(robustness._typos(w), '(r // 13)')}" for w in signals if len(w) >= 4) + " END"
    return f"""marked AS (SELECT msg_id, t, t AS s, r, six[CAST(r % greatest(len(six), 1) AS INTEGER) + 1] AS target,
  four[CAST(r % greatest(len(four), 1) AS INTEGER) + 1] AS look FROM (
  SELECT msg_id, t, (msg_id * 7919 + 42) % 2147483647 AS r, {present(6)} AS six, {present(4)} AS four FROM {source})),
{', '.join(steps)},
altered AS (SELECT *, substring(target, 1, CAST((r // 13) % (length(target) - 3) + 2 AS INTEGER)) || '-'
  || substring(target, CAST((r // 13) % (length(target) - 3) + 3 AS INTEGER)) AS broken, {typo} AS typo FROM {last}),
disguised AS (
  SELECT msg_id, 'dilution' AS kind, {pick(K.GREETINGS, 'r')} || t || {pick(K.CLOSINGS, '(r // 5)')} AS message FROM altered
  UNION ALL SELECT msg_id, 'synonyms', s FROM altered
  UNION ALL SELECT msg_id, 'negation', {pick(K.NEGATION_PREFIXES, 'r')} || t FROM altered
  UNION ALL SELECT msg_id, 'hyphen', CASE WHEN target IS NOT NULL THEN {_first('t', 'target', 'broken')} ELSE t END FROM altered
  UNION ALL SELECT msg_id, 'lookalike', CASE WHEN look IS NOT NULL THEN {_first('t', 'look', 'typo')} ELSE t END FROM altered)"""


_EVADING = f"""{X.LABELLED}, fraud AS (SELECT * FROM labelled WHERE label = 'fraudulent'), {_disguises('fraud')},
vs AS (SELECT msg_id, kind, message AS t FROM disguised), {X.scored_cte('vs', 'sv')}, {X.scored_cte('fraud', 'so')},
both_scores AS (SELECT sv.msg_id, sv.kind, 'fraudulent' AS label, so.risk_score AS original_score, sv.risk_score AS variant_score
  FROM sv JOIN so ON sv.msg_id = so.msg_id)"""

_WINDOWS = """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, strftime(w + INTERVAL '{width}', '%Y-%m-%d %H:%M:%S') AS "end",
  count(*) AS n_messages, CAST(sum(CAST(risk_level <> 'low' AS INTEGER)) AS BIGINT) AS n_alerts, max(risk_score) AS max_score
  FROM (SELECT time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01') AS w, risk_level, risk_score FROM scored) GROUP BY w"""

SQL = {
    "a1_a9_delimited_round_trip": f"""WITH {X.LABELLED} SELECT CASE WHEN coalesce(source, '') < 'src2' THEN 'comma' ELSE 'tab' END AS source,
      label, md5(t) AS message_md5, CAST(length(t) AS INTEGER) AS n_chars FROM labelled JOIN (SELECT doc_id, source FROM documents) d
      ON d.doc_id = labelled.msg_id WHERE {X.match('t', X.NS)}""",
    "a15_state_round_trip": "SELECT doc_id AS msg_id, true AS same_predicted_class, true AS same_confidence, true AS same_model_level FROM documents",
    "a5_label_map": """SELECT doc_id, CASE WHEN toxic = 1 THEN 'fraudulent' ELSE 'legitimate' END AS label
      FROM labels WHERE toxic = 1 OR quality = 1""",
    "a6_drop_blank": f"SELECT doc_id AS msg_id, source FROM documents WHERE {X.match('text', X.NS)}",
    "a10_json_conversations":
        "SELECT conv_id, CAST(turn AS INTEGER) AS turn, role AS sender, text FROM conversations",
    "a11_text_conversations": f"""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS INTEGER) AS turn,
      'unknown' AS sender, {X.sub('line', '^' + X.S + '+|' + X.S + '+$', '')} AS text FROM (
      SELECT doc_id AS conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
      FROM documents) WHERE {X.match('line', X.NS)}""",
    "g1_label_ids": f"""WITH {_LABELS} SELECT *, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM lab""",
    "g2_stratified_split": f"""WITH {_LABELS} SELECT msg_id, label, CAST(k <= floor(n * 0.2::DOUBLE + 0.5) AS INTEGER) AS is_test FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY (msg_id * 48271 + 42 * 69621) % 2147483647, msg_id) AS k,
      count(*) OVER (PARTITION BY label) AS n FROM lab)""",
    "g8_class_weights": f"""WITH {_LABELS} SELECT label, count(*) AS n_class,
      round((SELECT count(*) FROM lab) / ((SELECT count(DISTINCT label) FROM lab) * count(*))::DOUBLE, 6) AS weight FROM lab GROUP BY label""",
    "g10_confusion_matrix": f"""WITH {_PRED} SELECT label, count(*) FILTER (predicted = 'fraudulent') AS predicted_fraudulent,
      count(*) FILTER (predicted = 'legitimate') AS predicted_legitimate FROM pred GROUP BY label""",
    "g11_binary_metrics": f"""WITH {_PRED}, {_RATES} SELECT (SELECT count(*) FROM pred) AS n,
      round((SELECT sum(hit) / sum(support)::DOUBLE FROM rates), 6) AS accuracy, round(precision, 6) AS precision,
      round(recall, 6) AS recall, round(f1_score, 6) AS f1_score FROM full_rates WHERE class = 'fraudulent'""",
    "g12_class_metrics": f"""WITH {_PRED}, {_RATES} SELECT class, support, round(precision, 6) AS precision,
      round(recall, 6) AS recall, round(f1_score, 6) AS f1_score FROM full_rates""",
    "g13_classification_report": f"""WITH {_PRED}, {_RATES}, tot AS (SELECT CAST(sum(support) AS BIGINT) AS s, sum(hit) / sum(support)::DOUBLE AS a FROM rates)
      SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support FROM full_rates
      UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), s FROM tot
      UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6), (SELECT s FROM tot) FROM full_rates
      UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
      round(sum(f1_score * support) / sum(support), 6), (SELECT s FROM tot) FROM full_rates""",
    "g14_roc_auc": f"""WITH {_PRED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM pred),
      s AS (SELECT count(*) FILTER (label = 'fraudulent') AS p, count(*) FILTER (label <> 'fraudulent') AS n, sum(rk) FILTER (label = 'fraudulent') AS rp FROM r)
      SELECT p AS n_positive, n AS n_negative, round((rp - p * (p + 1) / 2.0::DOUBLE) / (p * n), 6) AS auc FROM s""",
    "g15_errors": f"""WITH {_PRED} SELECT *, CASE WHEN label = 'fraudulent' THEN 'false_negative' ELSE 'false_positive' END AS error
      FROM pred WHERE label <> predicted""",
    "h2_h5_combined_levels": f"""WITH {_INPUTS} SELECT msg_id, CASE WHEN predicted_class = 'fraudulent'
      THEN CASE WHEN confidence < 0.6 THEN 'medium' ELSE 'high' END ELSE CASE WHEN confidence < 0.65 THEN 'medium' ELSE 'low' END END AS class_level,
      model_level AS risk_level, CASE model_level {_ADVICE} END AS recommendation FROM inputs""",
    "l1_perturbations": f"WITH {_PERTURB} SELECT * FROM variants",
    "l2_l3_stability": f"""WITH {_PERTURB}, vs AS (SELECT msg_id, variant, message AS t FROM variants), {X.scored_cte('vs', 'sv')},
      {X.scored_cte('docs', 'so')}, st AS (SELECT msg_id, avg(risk_score) AS m, stddev_pop(risk_score) AS sd,
        quantile_cont(risk_score, 0.05) AS lo, quantile_cont(risk_score, 0.95) AS hi,
        round(avg(CASE WHEN risk_level = 'high' THEN 1.0::DOUBLE ELSE 0 END), 4) AS fr FROM sv GROUP BY msg_id),
      fin AS (SELECT *, round(least(greatest(1.0::DOUBLE - sd / greatest(m, 1.0), 0), 1), 4) AS stab FROM st)
      SELECT fin.msg_id, round(m, 2) AS mean_score, round(sd, 2) AS std_score, round(lo, 2) AS ci_low, round(hi, 2) AS ci_high,
      stab AS stability, fr AS fraud_rate, so.risk_score::DOUBLE AS original_score, 200 AS n_simulations,
      CASE WHEN stab >= 0.85 AND fr >= 0.80 THEN {X.q(K.STABILITY_TEXT['fraud'])} WHEN stab >= 0.85 AND fr < 0.30 THEN {X.q(K.STABILITY_TEXT['legit'])}
      WHEN stab >= 0.70 THEN {X.q(K.STABILITY_TEXT['stable'])} WHEN stab >= 0.50 THEN {X.q(K.STABILITY_TEXT['moderate'])}
      ELSE {X.q(K.STABILITY_TEXT['unstable'])} END AS verdict FROM fin JOIN so USING (msg_id)""",
    "l4_disguises": f"WITH {X.DOCS}, {_disguises('docs')} SELECT * FROM disguised",
    "l5_evading_variants": f"WITH {_EVADING} SELECT * FROM both_scores WHERE variant_score < original_score",
    "l5_disguised_scores": f"WITH {_EVADING} SELECT * FROM both_scores",
    "n1_contributions": None, "n2_global_summary": None,
    "o1_class_shares": f"""WITH {_LABELS} SELECT label, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lab), 2) AS percent
      FROM lab GROUP BY label""",
    "o2_length_summary": f"""WITH {X.LABELLED}, m AS (SELECT label, 'msg_length' AS measure, CAST(length(t) AS INTEGER) AS v FROM labelled
      UNION ALL SELECT label, 'word_count', CAST(len({X.words('t')}) AS INTEGER) FROM labelled)
      SELECT label, measure, count(*) AS n, round(avg(v), 1) AS mean, round(stddev_samp(v), 1) AS std, min(v) AS min,
      round(quantile_cont(v, 0.25), 1) AS q25, round(quantile_cont(v, 0.5), 1) AS q50, round(quantile_cont(v, 0.75), 1) AS q75,
      max(v) AS max FROM m GROUP BY label, measure""",
    "o3_length_histogram": f"""WITH {X.LABELLED}, e AS (SELECT label, length(t) AS l, min(length(t)) OVER (PARTITION BY label) AS lo,
      (max(length(t)) OVER (PARTITION BY label) - min(length(t)) OVER (PARTITION BY label)) / 40.0::DOUBLE AS w FROM labelled),
      b AS (SELECT *, CASE WHEN w > 0 THEN least(floor((l - lo) / w), 39) ELSE 0 END AS k FROM e)
      SELECT label, CAST(k AS INTEGER) AS bin, count(*) AS n, round(min(lo + k * w), 3) AS bin_start FROM b GROUP BY label, k""",
    "o4_signal_prevalence": f"""WITH {X.LABELLED}, f AS (SELECT label, lower(t) AS low, t FROM labelled) SELECT label, """ + ", ".join(
        f"round(avg(CASE WHEN {e} THEN 1.0::DOUBLE ELSE 0 END), 3) AS {n}" for n, e in {
            "has_urgency": X.any_of("low", K.URGENCY_WORDS), "has_credentials": X.any_of("low", K.CREDENTIAL_WORDS),
            "has_prize": X.any_of("low", K.PRIZE_WORDS), "has_money_words": X.any_of("low", K.MONEY_WORDS),
            "has_url": X.match("t", r"(?i)https?://|www\.")}.items()) + " FROM f GROUP BY label",
    "o5_top_words": f"""WITH {X.LABELLED}, c AS (SELECT label, word, count(*) AS n FROM (
      SELECT label, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word FROM labelled) GROUP BY label, word)
      SELECT label, word, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 15""",
    "o6_cleaning_effect": f"""WITH {X.DOCS}, c AS (SELECT t, {X.clean('t')} AS cl FROM docs) SELECT count(*) AS n_before,
      count(*) FILTER (cl <> '') AS n_after, count(*) FILTER (cl = '') AS n_removed, round(avg(length(t)), 4) AS mean_length_before,
      round(avg(length(cl)), 4) AS mean_length_after, round(avg(len({X.words('t')})), 4) AS mean_words_before,
      round(avg(len({X.words('cl')})), 4) AS mean_words_after FROM c""",
    "p1_scored_stream": f"WITH {X.DOCS}, {X.scored_cte('docs')} SELECT msg_id, risk_score, risk_level FROM scored",
    "p2_windowed_alerts": f"""WITH docs AS (SELECT row_number() OVER () AS msg_id, text AS t,
      make_timestamp(1000000 * (1704067200 + conv_id * 60 + turn * 20)) AS ts FROM conversations), {X.scored_cte('docs')}
      {_WINDOWS.format(width="10 minutes")}""",
    "p3_rolling_risk": f"""WITH docs AS (SELECT row_number() OVER () AS msg_id, conv_id, CAST(turn AS INTEGER) AS turn, text AS t FROM conversations),
      {X.scored_cte('docs')} SELECT conv_id, turn, CAST(count(*) OVER w AS INTEGER) AS n_turns, round(avg(risk_score) OVER w, 4) AS mean_risk,
      max(risk_score) OVER w AS max_risk, risk_score - first_value(risk_score) OVER w AS rise FROM scored
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
    "p2_event_alerts": f"""WITH docs AS (SELECT row_number() OVER () AS msg_id, concat_ws(' ', event_type, props) AS t, ts FROM events),
      {X.scored_cte('docs')} {_WINDOWS.format(width="1 hour")}""",
}
_FEAT = _features_sql("labelled").split("\nSELECT msg_id, ", 1)
_LINEAR = f"""{X.LABELLED}, {_FEAT[0]}, wide AS (SELECT msg_id, {_FEAT[1]}),
long AS (""" + " UNION ALL ".join(
    f"SELECT msg_id, '{n}' AS feature, {n} AS value FROM wide" for n in K.MANUAL_FEATURES) + """),
coef AS (SELECT feature, round(avg(value) FILTER (label = 'fraudulent') - avg(value) FILTER (label = 'legitimate'), 4) AS coefficient
  FROM long JOIN (SELECT msg_id, label FROM labelled) USING (msg_id) GROUP BY feature),
contrib AS (SELECT msg_id, feature, value * coefficient AS contribution FROM long JOIN coef USING (feature))"""
SQL["n1_contributions"] = f"""WITH {_LINEAR} SELECT *, CASE WHEN contribution > 0 THEN 'fraud' ELSE 'legit' END AS direction FROM (
  SELECT msg_id, feature, round(contribution, 5) + 0.0::DOUBLE AS contribution, CAST(row_number() OVER (PARTITION BY msg_id
  ORDER BY abs(round(contribution, 5)) DESC, feature) AS INTEGER) AS rank FROM contrib) WHERE rank <= 10"""
SQL["n2_global_summary"] = f"""WITH {_LINEAR} SELECT feature, round(sum(abs(contribution)) / (SELECT count(*) FROM labelled), 6) AS mean_abs
  FROM contrib GROUP BY feature ORDER BY mean_abs DESC, feature LIMIT 20"""

"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from riskloom.llm import license_scan, quality_rules, secret_scan

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"

#: Links (a, b) both ways and nodes (id) in; smallest reachable id of every node out.
_COMPONENTS = """
reached AS (
  SELECT id AS a, id AS b FROM nodes
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
components AS (SELECT a AS id, min(b) AS component_id FROM reached GROUP BY a)"""

OP1 = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.id AS a, y.id AS b FROM vectors x JOIN vectors y
    ON x.id <> y.id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95),
nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept
FROM components LEFT JOIN counts ON a = id"""

OP10 = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3
    THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, chr(32))] ELSE [] END) AS s FROM texts),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS met
  FROM items x JOIN items y ON x.v = y.v AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * met >= 85 * (na + nb - met)),
nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN components ON doc_id = id"""

OP5 = rf"""
WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines
  FROM documents),
triples AS (
  SELECT doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
repeated AS (SELECT doc_id, i FROM triples QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id),
single AS (
  SELECT doc_id, source, text, trim(regexp_replace(lower(l), '[\x20\x09-\x0D[:punct:]0-9]+', ' ', 'g')) AS h,
    len(regexp_extract_all(l, '{_WORD}')) AS words
  FROM (SELECT doc_id, source, text, unnest(lines) AS l FROM texts)),
often AS (SELECT source, h FROM single GROUP BY source, h HAVING count(DISTINCT text) > {quality_rules.LINE_LEAST}),
shares AS (SELECT doc_id, sum(words) AS n FROM single SEMI JOIN often USING (source, h) GROUP BY doc_id),
witnesses AS (
  SELECT doc_id FROM texts JOIN shares s USING (doc_id) WHERE len(w) - s.n >= {quality_rules.WORDS_LEFT} * len(w)),
boiler AS (
  SELECT source, h FROM single SEMI JOIN witnesses USING (doc_id) SEMI JOIN often USING (source, h)
  GROUP BY source, h HAVING count(DISTINCT text) > {quality_rules.LINE_LEAST}),
lost AS (SELECT doc_id, sum(words) AS n FROM single SEMI JOIN boiler USING (source, h) GROUP BY doc_id),
figures AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    (len(w) - coalesce(l.n, 0))::BIGINT AS words_left
  FROM texts LEFT JOIN covered c USING (doc_id) LEFT JOIN lost l USING (doc_id)),
judged AS (
  SELECT *, n_words < {quality_rules.LEAST_WORDS}
    OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND words_left >= {quality_rules.WORDS_LEFT} * n_words AS kept, words_left
FROM judged"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _op6() -> str:
    def matches(number: int, pattern: str, test: str) -> str:
        return rf"""
  SELECT doc_id, {number} AS kind, start, start + length(found) AS stop, found FROM (
    SELECT doc_id, split_part(piece, chr(2), 1) AS found,
      sum(length(piece) - (nr > 1)::INT) OVER (PARTITION BY doc_id ORDER BY nr) - length(piece) + (nr > 1)::INT AS start, nr
    FROM (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS nr FROM (
      SELECT doc_id, string_split(regexp_replace(text, '({_quoted(pattern)})', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS pieces
      FROM texts))) WHERE nr > 1 AND ({test})"""

    value = _quoted(secret_scan.ASSIGN_VALUE)
    allowed = " OR ".join(f"regexp_matches(found, '{_quoted(p)}')" for p in secret_scan.ALLOWED)
    kinds = "[" + ", ".join(f"'{k}'" for k in secret_scan.KINDS) + "]"
    written = f"string_agg({kinds}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return rf"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS text FROM documents),
base AS ({matches(0, secret_scan.ASSIGN, f"length(regexp_replace(found, '{value}', '')) >= {secret_scan.LEAST_VALUE}")}
  UNION ALL {matches(1, secret_scan.ACCESS, f"length(found) >= {secret_scan.LEAST_ACCESS}")}
  UNION ALL {matches(2, secret_scan.HEX, "true")}),
long AS ({matches(3, secret_scan.CANDIDATE, "true")}),
met AS (
  SELECT c.doc_id, c.start, c.stop, c.found, b.start AS cut, b.stop AS resume
  FROM long c JOIN base b ON b.doc_id = c.doc_id AND b.start < c.stop AND c.start < b.stop),
edges AS (
  SELECT doc_id, start, stop, found, start AS begin, 0 AS first FROM long
  UNION ALL SELECT doc_id, start, stop, found, resume, 1 FROM met),
gaps AS (
  SELECT doc_id, start, found, begin,
    coalesce((SELECT min(cut) FROM met m WHERE m.doc_id = e.doc_id AND m.start = e.start AND m.cut >= e.begin), stop) AS finish
  FROM (SELECT DISTINCT doc_id, start, stop, found, begin FROM edges) e
  WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.doc_id = e.doc_id AND m.start = e.start AND m.cut <= e.begin AND m.resume > e.begin)),
stretches AS (
  SELECT doc_id, substr(found, (begin - start + 1)::BIGINT, (finish - begin)::BIGINT) AS whole, finish AS stop
  FROM gaps WHERE finish - begin >= {secret_scan.WINDOW}),
rests AS (SELECT doc_id, stop, regexp_replace(whole, '{_quoted(secret_scan.DATES)}', '') AS found FROM stretches),
free AS (
  SELECT doc_id, stop - length(found) AS start, stop, found FROM rests
  WHERE length(found) >= {secret_scan.WINDOW} AND NOT ({allowed})),
shown AS (SELECT *, unnest(range(1, length(found) - {secret_scan.WINDOW - 2})) AS w FROM free),
letters AS (SELECT doc_id, start, stop, found, w, c, count(*) / {secret_scan.WINDOW}.0 AS p FROM (
  SELECT doc_id, start, stop, found, w, unnest(string_split(substr(found, w, {secret_scan.WINDOW}), '')) AS c FROM shown)
  GROUP BY ALL),
best AS (SELECT doc_id, start, stop, found, max(h) AS h FROM (
  SELECT doc_id, start, stop, found, w, -sum(p * log2(p)) AS h FROM letters GROUP BY ALL) GROUP BY ALL),
every AS (
  SELECT doc_id, kind, start, stop FROM base UNION ALL
  SELECT doc_id, 3, start, stop FROM best WHERE h >= CASE WHEN regexp_matches(found, '^[0-9a-fA-F]+$')
    THEN {secret_scan.HEX_BITS} ELSE {secret_scan.MIXED_BITS} END - 1e-9),
figures AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h,
    {written.replace(" ORDER", " ORDER", 1)} FILTER (kind < 3) AS b, {written} AS s FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM documents d LEFT JOIN figures f USING (doc_id)"""


def _op8() -> str:
    places = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS nr, '{label}' AS label FROM numbered WHERE "
        + " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase))
        for phrase, label in license_scan.PHRASES.items())
    templates = ", ".join(
        f"({k}, '{label}', [{', '.join(repr(w) for w in sorted(set(text.split())))}], {len(text.split())}, "
        f"{license_scan.needed(sorted(set(text.split())), license_scan.THRESHOLD)})"
        for k, (label, text) in enumerate(license_scan.TEMPLATES))
    cut = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH texts AS (
  SELECT doc_id, {_LOW} AS low, regexp_extract_all({_LOW}, '{cut}') AS w FROM documents),
numbered AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
places AS ({places}),
base AS (
  SELECT doc_id, count(*) AS n, min(nr) AS first_word, max(nr) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
templates(number, label, t, n, need) AS (VALUES {templates}),
blocks AS (
  SELECT doc_id, n, list_distinct(w[i + 1 : i + 2 * n]) AS b
  FROM (SELECT doc_id, w, n, unnest(range(0, greatest(len(w), 1), n)) AS i FROM texts, (SELECT DISTINCT n FROM templates))),
shares AS (
  SELECT doc_id, label, len(list_intersect(b, t)) / len(t) AS share FROM blocks JOIN templates USING (n)
  WHERE len(list_intersect(b, t)) >= need),
labelled AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM shares UNION ALL SELECT doc_id, label FROM places) GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce((SELECT max(share) FROM shares s WHERE s.doc_id = t.doc_id), 0) END::DOUBLE AS score
FROM texts t LEFT JOIN base b USING (doc_id) LEFT JOIN labelled l USING (doc_id)"""


OP12 = """
WITH usable AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(256 * x::DOUBLE))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    list_inner_product(a.e, b.e)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INT AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3"""


SQL = {"op1_cover_tree": OP1, "op5_quality_rules": OP5, "op6_secret_scan": _op6(),
       "op8_license_scan": _op8(), "op10_minhash": OP10, "op12_hard_negatives": OP12}

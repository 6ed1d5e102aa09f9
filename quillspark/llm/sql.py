"""DuckDB SQL that the tests hold the operators against."""

from . import license_scan

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_RULES_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 4] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
top AS (SELECT doc_id, max(c) AS most FROM (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, coalesce(top.most, 0) AS most,
    len(regexp_extract_all(text, '[A-Z]')) AS upper_, len(regexp_extract_all(text, '[A-Za-z]')) AS letters,
    len(list_filter(w, lambda x: regexp_matches(x, '^[\x00-@\[-`{{-\x7f]+$'))) AS bare
  FROM d JOIN l USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN top USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * upper_ > letters
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR (n_words >= 20 AND 10 * most > 3 * n_words)
       OR 2 * bare >= n_words) AS kept
FROM b
"""


def _level(name: str, parents: str, source: str) -> str:
    """One level of the budget tree; source: rows with parents, the name, room, given and w."""
    over = f"PARTITION BY {parents}" if parents else ""
    return f"""
SELECT *, CASE WHEN "full" THEN room ELSE least(room, (given - taken) * w / CASE WHEN "open" > 0 THEN "open" ELSE 1 END) END AS share FROM (
  SELECT *, sum(CASE WHEN "full" THEN room ELSE 0 END) OVER ({over}) AS taken, sum(CASE WHEN "full" THEN 0 ELSE w END) OVER ({over}) AS "open" FROM (
    SELECT *, rooms + level * rest <= given + 1e-6 AS "full" FROM (
      SELECT *, sum(room) OVER ({over} ORDER BY level, {name} ROWS UNBOUNDED PRECEDING) AS rooms,
        sum(w) OVER ({over}) - sum(w) OVER ({over} ORDER BY level, {name} ROWS UNBOUNDED PRECEDING) AS rest
      FROM (SELECT *, room / w AS level FROM ({source}) WHERE w > 0))))"""


_DOMAINS = "SELECT domain, sum(room) AS room, least(floor(any_value(total) * 0.8), sum(sum(room)) OVER ()) AS given, CASE domain WHEN 'web' THEN 4.0 WHEN 'books' THEN 3.0 WHEN 'forum' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM leaves GROUP BY domain"
_LANGS = "SELECT domain, lang, sum(room) AS room, any_value(share) AS given, CASE lang WHEN 'en' THEN 5.0 WHEN 'fr' THEN 2.0 WHEN 'de' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM leaves JOIN (SELECT domain, share FROM domains) USING (domain) GROUP BY domain, lang"
_SOURCES = "SELECT leaves.domain, leaves.lang, source, tokens, room, share AS given, 1.0::DOUBLE AS w FROM leaves JOIN (SELECT domain, lang, share FROM langs) l ON leaves.domain = l.domain AND leaves.lang = l.lang"

MIXING_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(source, '') AS source, len({WORDS})::BIGINT AS n_tokens, md5(coalesce(text, '')) AS digest,
    ['web', 'books', 'forum', 'code'][coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), 0) % 4 + 1] AS domain
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * 2)::DOUBLE AS room, sum(sum(n_tokens)) OVER ()::DOUBLE AS total FROM d GROUP BY domain, lang, source),
domains AS ({_level("domain", "", _DOMAINS)}),
langs AS ({_level("lang", "domain", _LANGS)}),
sources AS ({_level("source", "domain, lang", _SOURCES)}),
budget AS (SELECT domain, lang, source, tokens, floor(share + 1e-6)::BIGINT AS budget FROM sources),
plan AS (SELECT *, CASE WHEN whole < 2 THEN budget - whole * tokens ELSE 0 END AS rest FROM (
  SELECT *, CASE WHEN tokens > 0 THEN least(2, budget // greatest(tokens, 1)) ELSE 0 END AS whole FROM budget)),
keyed AS (SELECT d.*, whole, rest, md5(concat_ws(':', '7', (whole + 1)::VARCHAR, coalesce(doc_id::VARCHAR, digest))) AS key FROM d JOIN plan USING (domain, lang, source)),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id::VARCHAR, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS place FROM keyed)
SELECT doc_id, domain, lang, source, e::INTEGER AS epoch, n_tokens, n_tokens AS take_tokens FROM keyed, (SELECT unnest([1, 2]) AS e) WHERE e <= whole
UNION ALL
SELECT doc_id, domain, lang, source, (whole + 1)::INTEGER, n_tokens, least(n_tokens, rest - place)::BIGINT FROM placed WHERE place < rest
"""


def _templates() -> str:
    rows = ", ".join("({}, '{}', '{}', '{}', {}, {})".format(t, kind, label, text.replace("'", "''"), least, str(merge).lower()) for t, kind, label, text, least, merge in license_scan.TEMPLATES)
    return f"SELECT t, kind, label, least, merge, {_SCAN_WORDS} AS w FROM (VALUES {rows}) v(t, kind, label, text, least, merge)"


_SCAN_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LICENSE_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_SCAN_WORDS} AS w FROM documents),
tpl AS MATERIALIZED ({_templates()}),
tg AS (SELECT t, q, w[q + 1:q + 3] AS run FROM (SELECT t, w, unnest(range(0, len(w) - 2)) AS q FROM tpl)),
dg AS (SELECT doc_id, p, w[p + 1:p + 3] AS run FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS p FROM d)),
hits AS MATERIALIZED (SELECT DISTINCT doc_id, t, p - q AS diag, q FROM dg JOIN tg USING (run)),
diags AS (SELECT DISTINCT doc_id, t, diag FROM hits),
near AS (SELECT a.doc_id, a.t, a.diag, b.q FROM diags a JOIN tpl USING (t) JOIN hits b ON a.doc_id = b.doc_id AND a.t = b.t AND abs(a.diag - b.diag) <= CASE WHEN merge THEN {license_scan.SHIFT} ELSE 0 END),
places AS (SELECT doc_id, t, diag, count(DISTINCT q + i) AS n FROM near, (SELECT unnest(range(3)) AS i) GROUP BY ALL),
found AS (SELECT doc_id, diag, kind, label, n / len(w) AS share, n / len(w) >= least AS accepted FROM places JOIN tpl USING (t)),
each AS (
  SELECT doc_id, count(*) FILTER (WHERE accepted AND kind = 'phrase') AS n_base,
    min(diag) FILTER (WHERE accepted AND kind = 'phrase') AS first_word, max(diag) FILTER (WHERE accepted AND kind = 'phrase') AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE accepted AND kind = 'phrase')), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE accepted)), ',') AS labels, max(share) AS score
  FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN each USING (doc_id)
"""

HARD_NEGATIVES_SQL = """
WITH r AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 50 = 0),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT pos.anchor_id, positive_id, (row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s ON pos.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

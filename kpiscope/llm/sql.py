"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

from kpiscope.llm import blob_ledger

#: Longest rule first; a host fits a rule's host itself or as a subdomain.
_OP1 = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM u
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""

#: Windows as joined words; a document's windows of each size that some item has are compared.
_OP9 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT item_id, w, least(len(w), 10) AS size, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS pos FROM i WHERE len(w) > 0
), k AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS words FROM p
), s AS (
  SELECT DISTINCT size FROM k
), q AS (
  SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS pos FROM d, s WHERE len(w) >= size
), m AS (
  SELECT q.doc_id, q.size, q.pos, k.item_id FROM q JOIN k ON k.size = q.size AND k.words = array_to_string(list_slice(q.w, q.pos, q.pos + q.size - 1), ' ')
), h AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(pos, pos + size - 1)) AS place FROM m) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM m GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""



def _op10() -> str:
    """Each rule's matches and the pieces between them, whose lengths add up to the places."""
    parts = []
    for no, r in enumerate(blob_ledger.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {no} AS no, '{r.kind}' AS kind, string_split_regex(text, '{pattern}') AS gaps, "
            f"regexp_extract_all(text, '{pattern}', 0) AS found, regexp_extract_all(text, '{pattern}', {r.group}) AS tested, {r.at_least} AS least FROM docs"
        )
    base = len(blob_ledger.BASE_RULES)
    counts = ", ".join(f"count(CASE WHEN no = {k} THEN 1 END) AS n_{r.kind}" for k, r in enumerate(blob_ledger.BASE_RULES))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(generate_series(1, len(found))) AS n FROM m WHERE len(found) > 0),
p AS (
  SELECT doc_id, no, kind, length(found[n]) AS size, length(tested[n]) AS tested, least,
    list_sum(list_transform(list_slice(gaps, 1, n), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(found, 1, n - 1), lambda x: length(x))), 0) AS place
  FROM i
),
s AS (SELECT *, kind || ':' || CAST(CAST(place AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(place + size AS BIGINT) AS VARCHAR) AS span FROM p WHERE tested >= least),
g AS (
  SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY place, no) FILTER (no < {base}) AS base, string_agg(span, ',' ORDER BY place, no) AS spans FROM s GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in blob_ledger.BASE_RULES)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN g ON g.doc_id = d.doc_id
"""


#: All phrases of one to five words; the lowest cut by score, then by its place.
_OP11 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS pos FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size)
), f AS (
  SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL
), t AS (
  SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang
), c AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 100
), k AS (
  SELECT lang, size, phrase, a, w, unnest(generate_series(1, size - 1)) AS k FROM c
), s AS (
  SELECT k.lang, k.phrase, k.size, k.k, k.a, l.f AS l, r.f AS r, CAST(t.n AS BIGINT) AS n,
    CAST((1000 * CAST(k.a AS HUGEINT) * CAST(t.n AS HUGEINT)) // (CAST(l.f AS HUGEINT) * CAST(r.f AS HUGEINT)) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(list_slice(k.w, 1, k.k), ' ')
  JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(list_slice(k.w, k.k + 1, k.size), ' ') JOIN t ON t.lang = k.lang
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), d AS (
  SELECT * FROM b WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = b.lang AND c.size > b.size AND 100 * c.a >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM d
)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""


SQL: dict[str, str] = {"op10_blob_ledger": _op10(), "op11_phrase_mining": _OP11, "op1_url_cascade": _OP1, "op9_suffix_decontam": _OP9}

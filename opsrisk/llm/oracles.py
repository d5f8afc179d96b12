"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

#: ASCII white space, as regular expression class.
_BLANK = r"[\x20\x09-\x0D]"
#: A-Z to lower case and nothing else.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op9_line_dedup"] = rf"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM parts
), keyed AS (
  SELECT *, {_LOWER.format(f"regexp_replace(regexp_replace(line, '^{_BLANK}+', ''), '{_BLANK}+$', '')")} AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (WHERE s.key IS NOT NULL AND k.doc_id <> s.keeper)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place)
                       FILTER (WHERE s.key IS NULL OR k.doc_id = s.keeper), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s USING (key)
GROUP BY k.doc_id
"""

ORACLES["op4_near_dedup"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '{_BLANK}+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) END AS s
  FROM words
), flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION
  SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u
), roots AS (SELECT u, min(v) AS component_id FROM reached GROUP BY u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN roots ON doc_id = u
"""


def sharding_sql(limit: int) -> str:
    return f"""
WITH own AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT AS h
  FROM documents
), buckets AS (
  SELECT depth, h >> (48 - depth) AS prefix, sum(n_bytes)::BIGINT AS bytes, count(*) AS n
  FROM own, (SELECT unnest(range(0, 49))::INTEGER AS depth) GROUP BY ALL
), placed AS (
  SELECT doc_id, n_bytes, h, min(depth) AS depth
  FROM own JOIN buckets ON prefix = h >> (48 - depth) WHERE bytes <= {limit} OR depth = 48 GROUP BY ALL
)
SELECT doc_id, n_bytes, 'r' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard,
       bytes AS shard_bytes, n AS shard_docs
FROM placed JOIN buckets USING (depth) WHERE prefix = h >> (48 - depth)
"""


ORACLES["op6_sharding"] = sharding_sql(8 << 20)


ORACLES["op12_spelling"] = rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
         ORDER BY i) AS t FROM range(256) r(i)
), runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, {_LOWER.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents)
  GROUP BY ALL
), marked AS (
  SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM marked, crc
), counted AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM counted WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), places AS MATERIALIZED (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), gaps AS MATERIALIZED (
  SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS gap FROM places
), shorter AS (
  SELECT DISTINCT p.word AS a, w.word AS b FROM places p JOIN words w ON w.word = substr(p.word, 1, i - 1) || substr(p.word, i + 1)
), near AS MATERIALIZED (
  SELECT DISTINCT x.word AS a, y.word AS b FROM gaps x JOIN gaps y ON x.gap = y.gap AND x.word <> y.word
  UNION SELECT a, b FROM shorter UNION SELECT b, a FROM shorter
), best AS (
  SELECT a AS word, count(*) AS n_near, max(n) AS form_n, arg_max(b, (n, place)) AS form
  FROM near JOIN (SELECT word, n, -row_number() OVER (ORDER BY encode(word)) AS place FROM words) w ON w.word = b GROUP BY a
), forms AS MATERIALIZED (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form,
         CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), roots AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT r.word, r.next, f.form FROM roots r JOIN forms f ON f.word = r.next
)
SELECT f.word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM forms f JOIN roots r ON r.word = f.word AND r.next IS NULL
"""

ORACLES["op13_hard_negatives"] = """
WITH rows AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, list_inner_product(a.v, r.v)::BIGINT AS s
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, s AS p FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, p AS positive_score, s AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 80 * p <= 100 * s AND 100 * s <= 100 * p
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) <= 5
"""

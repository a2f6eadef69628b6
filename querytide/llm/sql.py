"""DuckDB texts equal to the registered queries, where SQL can say them."""

from querytide.llm.sharding import HASH_BITS, SHARD_BYTES

_TRIM = r"E' \t\n\x0b\x0c\r'"
_KEY = f"translate(trim(line, {_TRIM}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash FROM documents),
l AS (SELECT d.*, depth, hash >> ({HASH_BITS} - depth) AS prefix FROM d, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS depth)),
s AS (SELECT *, CAST(sum(n_bytes) OVER (PARTITION BY depth, prefix) AS BIGINT) AS shard_bytes FROM l),
f AS (SELECT * FROM s WHERE shard_bytes <= {SHARD_BYTES} OR depth = {HASH_BITS}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1)
SELECT doc_id, n_bytes, depth || ':' || prefix AS shard_id, depth, shard_bytes, shard_bytes > {SHARD_BYTES} AS oversized FROM f"""

OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM d),
keyed AS (SELECT *, {_KEY} AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, line, pos, keeper IS NULL OR keeper = doc_id AS kept FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

_FINITE = "embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"


def _whole(scale: int) -> str:
    return f"[CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]"


def _op11(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Brute force: every part against every entry, once per round."""
    near = """near{r} AS MATERIALIZED (SELECT vec_id, p, k, d FROM (
  SELECT vec_id, p, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM parts JOIN book{r} USING (p, j) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) = 1)"""
    book = """book{n} AS MATERIALIZED (SELECT b.k, b.p, b.j, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
  SELECT k, p, j, sum(x) // count(*) - CASE WHEN sum(x) % count(*) < 0 THEN 1 ELSE 0 END AS c
  FROM near{r} JOIN parts USING (vec_id, p) GROUP BY ALL) m USING (k, p, j))"""
    steps = [near.format(r=r) + ",\n" + book.format(r=r, n=r + 1) for r in range(rounds)] + [near.format(r=rounds)]
    return f"""
WITH kept AS (SELECT vec_id, label, {_whole(4096)} AS v FROM embeddings WHERE {_FINITE}),
parts AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (n // {parts}) AS p, (i - 1) % (n // {parts}) AS j, v[i] AS x
  FROM (SELECT vec_id, v, len(v) AS n, unnest(range(1, len(v) + 1)) AS i FROM kept)),
book0 AS MATERIALIZED (
  SELECT k, p, j, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept QUALIFY k < {entries}) USING (vec_id)),
{(", " + chr(10)).join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, k, j)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


OP12 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF x <> ''] AS w FROM pieces),
grams AS (
  SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS m)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, m)) AS k FROM c),
scored AS (
  SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, m, w, a, unnest(range(2, m)) AS s FROM c WHERE m > 2),
longer AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, unnest([array_to_string(w[b:b + s - 1], ' ') FOR b IN range(1, m - s + 2)]) AS phrase FROM spans) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored LEFT JOIN longer USING (lang, phrase) JOIN n USING (lang)
WHERE most IS NULL OR 100 * most < 80 * a
QUALIFY rank <= 2000"""

OP13 = f"""
WITH kept AS (SELECT vec_id, CAST({_whole(256)} AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {_FINITE}),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM kept q JOIN kept c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5"""

CHECK = {"op2_sharding": OP2, "op8_line_dedup": OP8, "op11_vector_codes": _op11(), "op12_collocations": OP12, "op13_topk_search": OP13}

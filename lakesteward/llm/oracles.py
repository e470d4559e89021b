"""DuckDB SQL for the rows of the registered queries."""

from __future__ import annotations

from lakesteward.llm.sharding import FACTORS, PRIME, round_shift

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: base32 of a SHA-1: eight characters for each of the four times 40 bits
_SHA1_BASE32 = " || ".join(
    f"substr('{_BASE32}', 1 + ((('0x' || substr(hex, {10 * q + 1}, 10))::BIGINT >> {35 - 5 * c}) & 31)::INT, 1)"
    for q in range(4)
    for c in range(8)
)

WARC = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (SELECT hex, max(page_id) AS leader FROM p GROUP BY hex)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_SHA1_BASE32} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM leader THEN NULL ELSE leader END AS refers_to
FROM p JOIN g USING (hex)
"""


def _network(x: str, total: str, seed: int) -> str:
    """One pass of the network as nested queries over a source with columns i, p, a, b."""
    sql = f"SELECT i, p, a, b, {x} % a AS x, {x} // a AS y FROM src"
    for n, factor in enumerate(FACTORS):
        side, other, most = ("x", "y", "a") if n % 2 == 0 else ("y", "x", "b")
        sql = f"SELECT *, ({other} * {factor} + {round_shift(seed, n)}) % {PRIME} AS t FROM ({sql})"
        sql = f"SELECT * EXCLUDE ({side}, t), ({side} + (t * t) % {PRIME}) % {most} AS {side} FROM ({sql})"
    return f"SELECT i, y * a + x AS p, a, b FROM ({sql})"


#: checksum table by its rule: eight shifts, each with the polynomial where the low bit was set
_SHIFT = "list_transform({}, lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_TABLE = "list_transform(range(256), lambda c: c::BIGINT)"
for _ in range(8):
    _TABLE = _SHIFT.format(_TABLE)

SHARDING = f"""
WITH RECURSIVE crc AS (SELECT {_TABLE} AS t),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
    xor(list_reduce(
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM documents, crc
), n AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS i FROM d
), s AS (
  SELECT total, a, (total + a - 1) // a AS b
  FROM (SELECT total, floor(sqrt(total - 1))::BIGINT + 1 AS a FROM (SELECT count(*) AS total FROM documents))
), walk(i, p, a, b) AS (
  SELECT i, p, a, b FROM (
    WITH src AS (SELECT i, i AS p, a, b FROM n, s) {_network("p", "total", 2024)}
  )
  UNION ALL
  SELECT * FROM (
    WITH src AS (SELECT w.* FROM walk w, s WHERE w.p >= s.total) {_network("p", "total", 2024)}
  )
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % 16)::INT AS shard, p // 16 AS slot, NULL::INT AS grown_shard
FROM n JOIN walk USING (i), s WHERE p < total
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) LEFT JOIN n USING (doc_id)
"""

#: windows are cut from pieces of 200 bytes and the next 199, so that no long text is searched for each one
REPEATS = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), c AS (
  SELECT doc_id, n, b, substr(h, (400 * b + 1)::BIGINT, 798) AS piece FROM (SELECT doc_id, h, n, unnest(range(0, n // 200 + 1)) AS b FROM d)
), w AS (
  SELECT doc_id, 200 * b + i AS p, md5_number(substr(piece, 2 * i + 1, 400)) AS k
  FROM (SELECT doc_id, n, b, piece, unnest(range(0, 200)) AS i FROM c) WHERE 200 * b + i + 200 <= n
), r AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh
  FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)
), s AS (
  SELECT doc_id, g, min(p) AS a, max(p) + 200 AS z
  FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM r) GROUP BY doc_id, g
), k AS (
  SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS z,
    string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS kept
  FROM (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s) JOIN d USING (doc_id)
  GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substr(h, (2 * z + 1)::BIGINT) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

TOP_PRODUCTS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, coalesce(list_inner_product(q.x, c.x), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.x) = len(c.x)
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5
"""

"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_BITS = "('0x' || substr(sha, 5 * (i // 4)::INT + 1, 5))::BIGINT"

OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
last AS (SELECT html, max(page_id) AS orig FROM p GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({_BITS}) >> (15 - 5 * (i % 4))::BIGINT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = orig THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id != orig THEN orig END AS refers_to
FROM p JOIN last USING (html)
"""

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = rf"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS t
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, t)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_HASHED = "(SELECT string_agg(coalesce(strlen(f.v) || ':' || f.v, '-'), '' ORDER BY f.k) FROM (VALUES (1, doc_id::VARCHAR), (2, source), (3, lang), (4, n_chars::VARCHAR), (5, {text})) AS f(k, v))"
_SIDES = """SELECT key, level, i, top, coalesce(string_agg(d, '') OVER (PARTITION BY key, level, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(d, '') OVER (PARTITION BY key, level, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
FROM {nodes} JOIN (SELECT key, max(level) AS top FROM {nodes} GROUP BY key) USING (key)"""
_UP = "SELECT key, level + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY key) AS c FROM {nodes}) WHERE c > 1 GROUP BY key, level, i // 8"

OP11 = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
hashed AS (SELECT doc_id, coalesce('=' || lang, '') AS key, sha256({_HASHED.format(text="text")}) AS leaf, sha256({_HASHED.format(text="translate(text, " + _ABC + ")")}) AS low,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 3 = 0 AS tampers
  FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
nodes(key, level, i, d) AS (SELECT key, 0, i, leaf FROM leaves UNION ALL {_UP.format(nodes="nodes")}),
tops AS (SELECT key, arg_max(d, level) AS subroot FROM nodes GROUP BY key),
places AS (SELECT key AS tree, subroot, row_number() OVER (ORDER BY key) - 1 AS place FROM tops),
over(key, level, i, d) AS (SELECT 0, 0, place, subroot FROM places UNION ALL {_UP.format(nodes="over")}),
sides AS ({_SIDES.format(nodes="nodes")}),
above AS ({_SIDES.format(nodes="over")}),
steps AS (
  SELECT l.key, l.i, s.level AS step, s.before, s.after FROM leaves l JOIN sides s ON s.key = l.key AND s.level < s.top AND s.i = l.i // (8 ** s.level)::BIGINT
  UNION ALL SELECT l.key, l.i, 1000 + a.level, a.before, a.after FROM leaves l JOIN places p ON p.tree = l.key JOIN above a ON a.level < a.top AND a.i = p.place // (8 ** a.level)::BIGINT),
paths AS (SELECT key, i, string_agg(before || after, '' ORDER BY step) AS proof, list(before || '|' || after ORDER BY step) AS path FROM steps GROUP BY key, i),
folded AS (SELECT doc_id, leaf, subroot, (SELECT arg_max(d, level) FROM over) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce(list_prepend(CASE WHEN tampers THEN low ELSE leaf END, coalesce(path, [])), lambda d, x: sha256(split_part(x, '|', 1) || d || split_part(x, '|', 2))) AS folded_root
  FROM leaves JOIN places ON tree = key LEFT JOIN paths USING (key, i))
SELECT *, folded_root = root AS verified FROM folded
"""

OP12 = """
WITH valid AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negatives AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_revisits": OP2, "op3_benchmark_decontamination": OP3, "op11_merkle_manifest": OP11, "op12_cover_tree_negatives": OP12}

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_MIX = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS skey, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 5) AS INTEGER) AS cell
  FROM documents),
s AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY min(source) NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY skey),
r AS (
  SELECT *, 3 * source_size / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
-- Sources in the order in which they reach their ceiling; the rate with the first j of them held.
h AS (
  SELECT *, (total - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS rate,
         row_number() OVER (ORDER BY ratio, skey) AS place
  FROM r WINDOW before AS (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(arg_min(rate, place) FILTER (WHERE rate * weight <= 3 * source_size), 0) AS rate FROM h),
t AS (
  SELECT skey, source_size, least(CAST(3 * source_size AS DOUBLE), weight * l.rate) AS target FROM s, l),
p AS (
  SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS passes FROM t),
b AS (
  SELECT skey, cell // 2048 AS block, sum(size) AS words FROM d GROUP BY 1, 2),
c AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY skey ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM b),
k AS (
  SELECT c.skey, c.block, target - passes * source_size - before AS room
  FROM c JOIN p USING (skey)
  WHERE before <= target - passes * source_size AND target - passes * source_size < before + words),
x AS (
  SELECT skey, block, cell, room, sum(size) AS words FROM d JOIN k USING (skey)
  WHERE cell // 2048 = block GROUP BY ALL),
y AS (
  SELECT *, sum(words) OVER (PARTITION BY skey ORDER BY cell) - words / 2 AS middle FROM x),
z AS (
  SELECT skey, coalesce(max(cell + 1) FILTER (WHERE middle <= room), max(block) * 2048) AS cut FROM y GROUP BY skey),
-- The blocks of each pass, halved at each node of the tree in the order of a hash, down to 8 shards.
u AS (
  SELECT p.skey, block, pass, passes, coalesce(cut, 0) AS cut, concat_ws(':', p.skey, pass, block) AS name
  FROM b JOIN p USING (skey) LEFT JOIN z USING (skey), unnest(range(1, passes + 2)) AS n(pass)
  WHERE pass <= passes OR block * 2048 < coalesce(cut, 0)),
v AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('7/0:' || name)) * 8 <= count(*) OVER () * 4 THEN 0 ELSE 4 END AS half FROM u),
f AS (
  SELECT *, half + CASE WHEN row_number() OVER (PARTITION BY half ORDER BY md5('7/1:' || name)) * 4
                          <= count(*) OVER (PARTITION BY half) * 2 THEN 0 ELSE 2 END AS quarter FROM v),
o AS (
  SELECT *, quarter + CASE WHEN row_number() OVER (PARTITION BY quarter ORDER BY md5('7/2:' || name)) * 2
                             <= count(*) OVER (PARTITION BY quarter) THEN 0 ELSE 1 END AS shard FROM f),
q AS (
  SELECT skey, block, list({'pass': pass, 'shard': shard} ORDER BY pass) AS places FROM o GROUP BY 1, 2)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (passes + CASE WHEN d.cell < coalesce(z.cut, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       coalesce(array_to_string(list_transform(
         list_filter(places, lambda x: x.pass <= passes OR d.cell < coalesce(z.cut, 0)), lambda x: x.shard), ','), '') AS shards
FROM d JOIN p USING (skey) LEFT JOIN z USING (skey) LEFT JOIN q ON q.skey = d.skey AND q.block = d.cell // 2048
"""

_TOP = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g AS a JOIN g AS b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op3_pivot_table": _TOP,
    "op5_minmax_dedup": _NEAR,
    "op8_splitting_tree": _MIX,
}

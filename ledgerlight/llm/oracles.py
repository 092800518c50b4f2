"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
i AS (
  SELECT *, least(len(w), 5) AS m FROM (
    SELECT item_id, md5(text) AS item_key, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
    FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
ds AS (
  SELECT DISTINCT doc_id, key, s FROM (
    SELECT doc_id, md5(array_to_string(w, ' ')) AS key,
      unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))) AS s
    FROM d, (SELECT DISTINCT m FROM i) WHERE len(w) >= m)),
ish AS (
  SELECT DISTINCT item_id, item_key, s FROM (
    SELECT item_id, item_key, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))) AS s
    FROM i)),
n AS (SELECT item_id, item_key, count(*) AS n FROM ish GROUP BY ALL),
hit AS (SELECT doc_id, key, item_id, item_key, count(*) AS shared FROM ds JOIN ish USING (s) GROUP BY ALL)
SELECT doc_id, item_id, max(shared / n) AS containment
FROM hit JOIN n USING (item_id, item_key) WHERE shared >= ceil(n * 0.8::DOUBLE - 1e-9::DOUBLE) GROUP BY doc_id, item_id
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('curriculum:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(place - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s),
c AS (
  SELECT *, cap / weight <= (total - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS capped
  FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT *, CASE WHEN capped THEN cap ELSE least(cap,
    (total - sum(CASE WHEN capped THEN cap ELSE 0.0::DOUBLE END) OVER ()) / sum(CASE WHEN NOT capped THEN weight END) OVER () * weight) END AS target
  FROM c),
p AS (
  SELECT doc_id, size, source_size, target, place, key,
    CAST(coalesce(sum(size) OVER (PARTITION BY place ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, greatest(0, least(size, CAST(floor(target + 0.5::DOUBLE) AS BIGINT) - start)) AS one,
    greatest(0, least(size, CAST(floor(target + 0.5::DOUBLE) AS BIGINT) - start - source_size)) AS two,
    CASE WHEN one > 0 THEN start / target ELSE (start + source_size) / target END AS q FROM p)
SELECT doc_id, size, source_size, target, one + two AS taken,
  CASE WHEN one + two > 0 THEN round(CASE (place - 1) % 3
    WHEN 0 THEN 2 * (q * 3.0::DOUBLE) / (4.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 4.5::DOUBLE * 4.5::DOUBLE + 2 * (-3.0::DOUBLE) * (q * 3.0::DOUBLE))))
    WHEN 1 THEN 2 * (q * 1.0::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(0.0::DOUBLE, 1.0::DOUBLE)))
    ELSE CASE WHEN q * 2.0::DOUBLE < 0.75::DOUBLE
      THEN 2 * (q * 2.0::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(0.0::DOUBLE, 1.0::DOUBLE + 2 * 2.0::DOUBLE * (q * 2.0::DOUBLE))))
      ELSE 0.5::DOUBLE + 2 * (q * 2.0::DOUBLE - 0.75::DOUBLE) / (2.0::DOUBLE + sqrt(greatest(0.0::DOUBLE, 4.0::DOUBLE + 2 * 2.0::DOUBLE * (q * 2.0::DOUBLE - 0.75::DOUBLE)))) END
    END, 6) END AS first_position
FROM k
"""

OP6 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages),
h AS (SELECT *, sha1(html) AS digest FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(digest, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - i % 4 * 5 AS INT)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM h
"""

OP8 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM d WHERE len(t) > 0),
i AS (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
f AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words)) AS earned FROM p, s),
r AS (
  SELECT item_id, doc_id, CAST(sum(w * earned * repeats) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN f USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10
"""

ORACLES = {"op12_lexical": OP12, "op2_decontamination": OP2, "op5_curriculum": OP5, "op6_warc": OP6, "op8_retrieval": OP8}

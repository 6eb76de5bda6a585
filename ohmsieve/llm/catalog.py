"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .additive import op13_additive_model
from .annulus import op11_annulus_search
from .jaccard import op2_heavy_light_join
from .nbest import op4_nbest_lattice
from .packing import op3_best_two_fit
from .quality import op9_ngram_logistic
from .reputation import op6_host_reputation
from .ring import op10_bounded_ring
from .suffix import op5_sparse_suffixes
from .topk import op7_impact_ordered
from .toxicity import op8_compression_distance
from .trie import op12_prefix_trie
from .wavelet import op1_wavelet_shards

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = (op1_wavelet_shards, op2_heavy_light_join, op3_best_two_fit, op4_nbest_lattice, op5_sparse_suffixes, op6_host_reputation, op7_impact_ordered, op8_compression_distance, op9_ngram_logistic, op10_bounded_ring, op11_annulus_search, op12_prefix_trie, op13_additive_model)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_impact_ordered": TOP_K_SQL, "op11_annulus_search": NEGATIVES_SQL, "op12_prefix_trie": TRIE_SQL}


TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(embedding) > 0
), s AS (
  SELECT q.r AS qr, c.r AS cr, q.vec_id AS query, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, cr) AS INTEGER) AS rank FROM s
)
SELECT query, rank, vec_id, score FROM r WHERE rank <= 20
"""

NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(embedding) > 0
), s AS (
  SELECT q.r AS qr, c.r AS cr, q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, cr) AS place FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.qr, p.cr ORDER BY s.score DESC, s.vec_id, s.cr) AS INTEGER) AS rank
  FROM p JOIN s ON p.qr = s.qr AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.place <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

TRIE_SQL = """
WITH c AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce("text", '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce("text", '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, turns, CAST(xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT)),
    lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), CAST(4294967295 AS BIGINT))) % 9 AS BIGINT) AS h FROM c
), r AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 5
), m AS (
  SELECT conv_id, d AS depth, len(turns) AS length, CASE WHEN d = 0 THEN 0 ELSE strlen(turns[d]['text']) END AS bytes,
         md5(array_to_string(list_transform(turns[1:d], lambda t: md5(t['role'] || chr(0) || t['text'])), ',') || d) AS node,
         CASE WHEN d > 0 THEN md5(array_to_string(list_transform(turns[1:d - 1], lambda t: md5(t['role'] || chr(0) || t['text'])), ',') || (d - 1)) END AS parent
  FROM (SELECT conv_id, turns, unnest(range(0, CAST(len(turns) AS BIGINT) + 1)) AS d FROM r)
), n AS (
  SELECT node, min(parent) AS parent, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(bytes) AS bytes, max(length) = min(depth) AS leaf,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM m GROUP BY node
), below AS (SELECT DISTINCT a.node AS top, b.node FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), s AS (
  SELECT top AS node, count(*) FILTER (n.leaf) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved FROM below JOIN n ON below.node = n.node GROUP BY top
), k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (node) LEFT JOIN n p ON n.parent = p.node LEFT JOIN k ON n.node = k.node
"""

"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, language, lines, merkle, mixing, packing, private, quality, sampling, scoring, setjoin, topk, wavelet
from .common import table


def word_vocabulary() -> str:
    """Place of the public word vocabulary the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), word_vocabulary())


def op2_private(spark: SparkSession, d: str) -> DataFrame:
    return private.spans(table(spark, d, "documents"))


def op3_topk(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_k(table(spark, d, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op4_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_repeats(table(spark, d, "documents"), weighted=True).select("doc_id", "n_lines", "n_dropped", "text")


def op5_wavelet(spark: SparkSession, d: str) -> DataFrame:
    return wavelet.write_and_read(table(spark, d, "documents"), word_vocabulary())


def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.scores(table(spark, d, "documents"), table(spark, d, "labels"))


def op7_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.taken(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_setjoin(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.classes(table(spark, d, "documents"))


def op9_scoring(spark: SparkSession, d: str) -> DataFrame:
    return scoring.scores(table(spark, d, "documents"), word_vocabulary())


def op10_sampling(spark: SparkSession, d: str) -> DataFrame:
    return sampling.fingerprints(table(spark, d, "documents"))


def op11_language(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "documents"))


def op12_alignment(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    byte_level, pieces = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(table(spark, d, "documents"), byte_level, pieces)


def op13_manifest(spark: SparkSession, d: str) -> DataFrame:
    return merkle.verified(merkle.manifest(table(spark, d, "documents"))).withColumnRenamed("key", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_packing, op2_private, op3_topk, op4_lines, op5_wavelet, op6_quality, op7_mixing, op8_setjoin, op9_scoring, op10_sampling,
        op11_language, op12_alignment, op13_manifest)}


TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM d GROUP BY source
), w AS (
  SELECT *, (CASE source_no % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight, 2.0::DOUBLE * source_size AS bound FROM s
), l AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM w)::DOUBLE AS budget,
    (1.5::DOUBLE * (SELECT sum(source_size) FROM w)::DOUBLE
      - coalesce(sum(bound) OVER (ORDER BY bound / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY bound / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_no, source_size, budget, CASE WHEN bound / weight <= level THEN bound ELSE weight * (
    SELECT arg_min(level, (bound / weight, source_no)) FROM l WHERE bound / weight > level) END AS target FROM l
), q AS (
  SELECT d.*, source_no, source_size, budget, target,
    sum(size) OVER (PARTITION BY source_no ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT q.*, turn, CASE WHEN target > 0 THEN (upto + turn * source_size)::DOUBLE / target END AS finish FROM q, (VALUES (0), (1)) x(turn)
), r AS (
  SELECT *, sum(size) OVER (ORDER BY finish NULLS FIRST, source_no, key, doc_id, size, turn ROWS UNBOUNDED PRECEDING) AS running FROM p
)
SELECT doc_id, size, source_size, target, sum(CASE WHEN running <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM r GROUP BY doc_id, source_no, key, size, source_size, target
"""


SET_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingles FROM w
), e AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY x, y, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r(x, y) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, (SELECT min(y) FROM r WHERE r.x = s.doc_id) AS component_id FROM s
"""


MERKLE = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, (SELECT list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END) END)) AS crc,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(head || body) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || lowered) ELSE sha256(head || body) END AS shown FROM f
), n0 AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos FROM leaves
), up(level, lang, pos, node, nodes) AS (
  SELECT 0, lang, pos, leaf, count(*) OVER (PARTITION BY lang) FROM n0
  UNION ALL
  SELECT DISTINCT level + 1, lang, pos // 8, sha256(string_agg(node, '' ORDER BY pos) OVER (PARTITION BY lang, pos // 8 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (nodes + 7) // 8
  FROM up WHERE nodes > 1
), subroots AS (
  SELECT lang, level AS height, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM up WHERE nodes = 1
), over(level, pos, node, nodes) AS (
  SELECT 0, tree, subroot, trees FROM subroots
  UNION ALL
  SELECT DISTINCT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos) OVER (PARTITION BY pos // 8 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (nodes + 7) // 8 FROM over WHERE nodes > 1
), sides AS (
  SELECT level, lang, pos, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
  FROM up WHERE nodes > 1 WINDOW w AS (PARTITION BY level, lang, pos // 8 ORDER BY pos)
), over_sides AS (
  SELECT level, pos, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
  FROM over WHERE nodes > 1 WINDOW w AS (PARTITION BY level, pos // 8 ORDER BY pos)
), steps AS (
  SELECT lang, level, pos, NULL::BIGINT AS tree, lefts, rights FROM sides
  UNION ALL
  SELECT lang, height + level, 0, tree, lefts, rights FROM subroots, over_sides WHERE over_sides.pos = tree // (8 ** level)::BIGINT
), walk(doc_id, lang, start, level, pos, proof, node) AS (
  SELECT doc_id, lang, pos, 0, pos, '', shown FROM n0
  UNION ALL
  SELECT w.doc_id, w.lang, w.start, w.level + 1, w.pos // 8, w.proof || lefts || rights, sha256(lefts || w.node || rights)
  FROM walk w JOIN steps s ON w.lang IS NOT DISTINCT FROM s.lang AND w.level = s.level AND w.pos = s.pos
), ends AS (
  SELECT lang, start, arg_max(proof, level) AS proof, arg_max(node, level) AS folded FROM walk GROUP BY lang, start
)
SELECT n0.doc_id, leaf, subroot, (SELECT node FROM over WHERE nodes = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = (SELECT node FROM over WHERE nodes = 1) AS verified
FROM n0 JOIN ends e ON n0.lang IS NOT DISTINCT FROM e.lang AND n0.pos = e.start JOIN subroots s ON n0.lang IS NOT DISTINCT FROM s.lang
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": TOP_K, "op7_mixing": MIX, "op8_setjoin": SET_JOIN, "op13_manifest": MERKLE}

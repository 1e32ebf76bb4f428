"""Exact top-k search by inner product with multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import materialise

VECTORS = "vec_id bigint, dim int, v binary, mark bigint"
FOUND = "query_id bigint, mark bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """floor(scale * x) of every component; vectors that are null or hold a null, NaN or infinity are left out.

    `mark` tells rows of one vec_id apart by content, and spreads them over blocks.
    """
    x = F.col("embedding")
    sound = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def pack(batches):
        for batch in batches:
            rows = [np.floor(scale * np.asarray(v, dtype=np.float64)).astype("<i8") for v in batch["embedding"]]
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "dim": [len(v) for v in rows], "v": [v.tobytes() for v in rows]}).assign(
                mark=0)

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.cast("array<double>").alias("embedding")).filter(sound)
    return rows.mapInPandas(pack, VECTORS).withColumn("mark", F.xxhash64("v"))


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Mean and deviation of each segment, scaled so that a product of two rows bounds the inner product.

    Within a segment of w components, <q, x> = w * mean * mean + <q - mean, x - mean>, and the
    second term is at most w times the deviations' product. Segment by segment this is the same
    as the lower bound of the distance |q|^2 + |x|^2 - 2 <q, x>.
    """
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        part = x[:, a:b]
        mean = part.mean(axis=1)
        out += [np.sqrt(b - a) * mean, np.sqrt(np.maximum(0, ((part - mean[:, None]) ** 2).sum(axis=1)))]
    return np.stack(out, axis=1)


def search_block(q_ids, q, x_ids, x, k: int) -> list[tuple[int, int, int]]:
    """(query row, candidate row, score) of each query's k best in one block, ties included by id.

    k scores found first give each query a threshold; candidates whose bound is below it go, level
    by level with twice as many segments; survivors are scored exactly.
    """
    out, dim = [], x.shape[1]
    levels = [s for s in (1, 2, 4, 8, 16, 32) if 4 * s <= dim] or [1]
    stats = [(_statistics(q, s), _statistics(x, s)) for s in levels] if dim else []
    for a in range(0, len(q), 128):
        part, own = q[a:a + 128], q_ids[a:a + 128, None] == x_ids[None, :]
        alive = ~own
        m = min(8 * k, x.shape[0])
        if dim:
            first = np.where(own, -np.inf, stats[-1][0][a:a + 128] @ stats[-1][1].T)
            best = np.argpartition(-first, m - 1, axis=1)[:, :m]
            scores = np.einsum("qd,qmd->qm", part, x[best])
            scores[np.take_along_axis(own, best, axis=1)] = -np.inf
            tau = np.partition(scores, m - k, axis=1)[:, m - k] if m >= k else np.full(len(part), -np.inf)
            for s_q, s_x in stats:
                cols = np.flatnonzero(alive.any(axis=0))
                bound = s_q[a:a + 128] @ s_x[cols].T
                alive[:, cols] &= bound >= (tau - 1e-6 * np.abs(tau) - 1e-3)[:, None]
        cols = np.flatnonzero(alive.any(axis=0))
        if alive.sum() > 0.02 * alive.size:
            exact = part @ x[cols].T
            rows, at = np.nonzero(alive[:, cols])
            scores, at = exact[rows, at], cols[at]
        else:
            rows, at = np.nonzero(alive)
            scores = np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", part[rows[i:i + 20_000]], x[at[i:i + 20_000]]) for i in range(0, len(rows), 20_000))])
        order = np.lexsort((x_ids[at], -scores, rows))
        rows, at, scores = rows[order], at[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < k
        out += zip((rows[keep] + a).tolist(), at[keep].tolist(), scores[keep].astype(np.int64).tolist())
    return out


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, block: int = 8192, query_block: int = 512) -> DataFrame:
    """The k highest integer inner products of each query row with all rows of other ids.

    Queries are the rows where `is_query` (a condition on vec_id) holds. All rows are cut by hash into blocks
    of about `block` rows and queries into blocks of `query_block`; each pair of blocks is one
    group of bounded size, searched exactly; the best k of every block are merged. Vectors of
    different length are not compared. Scores are exact below 2^53. Rows without an id are
    left out; equal rows of one id count once as query, and each as candidate. Extra columns
    are not read; no rows yield no rows.
    """
    rows = materialise(quantised(vectors, scale).filter("vec_id is not null"), "vectors")
    queries = rows.filter(is_query).distinct()
    blocks, query_blocks = max(1, -(-rows.count() // block)), max(1, -(-queries.count() // query_block))
    spread = lambda n, seed: F.pmod(F.xxhash64("vec_id", "mark", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("q_block", spread(query_blocks, 1)).withColumn("x_block", every(blocks))
    right = rows.withColumn("x_block", spread(blocks, 2)).withColumn("q_block", every(query_blocks))
    keys = ["dim", "q_block", "x_block"]

    def matrix(frame):
        return np.frombuffer(b"".join(frame["v"]), dtype="<i8").reshape(len(frame), -1).astype(np.float64)

    def search(q, x):
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "mark": [], "vec_id": [], "score": []}, dtype="int64")
        q_ids, x_ids = q["vec_id"].to_numpy(np.int64), x["vec_id"].to_numpy(np.int64)
        found = np.array(search_block(q_ids, matrix(q), x_ids, matrix(x), k), dtype=np.int64).reshape(-1, 3)
        return pd.DataFrame({"query_id": q_ids[found[:, 0]], "mark": q["mark"].to_numpy(np.int64)[found[:, 0]],
                             "vec_id": x_ids[found[:, 1]], "score": found[:, 2]})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, FOUND)
    order = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

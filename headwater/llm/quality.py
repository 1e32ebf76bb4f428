"""Quality classifier: a factorisation machine over hashed words, structure statistics and length."""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_of, remainder_column, text_of

#: Buckets of hashed words; statistics of a text have places of their own above these.
BUCKETS, STATISTICS, RANK = 1 << 14, 18, 4
WIDTH = BUCKETS + STATISTICS


@lru_cache(maxsize=50_000)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text: damped word counts of unit length, then statistics of about unit size."""
    words = text.lower().split()
    raw = text.encode("utf-8", "surrogatepass")
    byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) / max(1, len(raw))
    counts = Counter(words)
    lines = text.split("\n")
    n = max(1, len(words))
    marks = byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()
    prose = byte[39] + byte[44] + byte[45] + byte[46]
    letters = byte[65:91].sum() + byte[97:123].sum() + byte[128:].sum()
    most = max(counts.values(), default=0)
    stats = [
        1.0, float(not words), np.log1p(len(text)) / 10, np.log1p(len(words)) / 8, min(2.0, len(text) / n / 8),
        5 * byte[65:91].sum(), 5 * byte[48:58].sum(), 5 * (marks - prose), 5 * prose, 10 * byte[124], 10 * byte[33],
        1 - letters, byte[128:].sum(), len(counts) / n, min(1.0, most / n), 1 - len(set(lines)) / len(lines),
        min(2.0, len(lines) / n * 10), 10 * (byte[35] + byte[36] + byte[37] + byte[38] + byte[42]),
    ]
    places = np.array([_bucket(w) for w in counts], dtype=np.int64)
    values = np.log1p(np.array(list(counts.values()), dtype=np.float64))
    values /= max(1e-9, float(np.sqrt((values ** 2).sum())))
    return np.concatenate([places, BUCKETS + np.arange(STATISTICS)]), np.concatenate([values, stats])


def raw_scores(model, rows: list) -> np.ndarray:
    """w0 + <w, x> + half of the sum over factors of (sum v x)^2 - sum (v x)^2: linear in the features."""
    bias, w, v = model
    if not rows:
        return np.zeros(0)
    starts = np.cumsum([0, *(len(p) for p, _ in rows[:-1])])
    places, values = np.concatenate([p for p, _ in rows]), np.concatenate([x for _, x in rows])
    vx = v[places] * values[:, None]
    sums = np.add.reduceat(vx, starts)
    squares = np.add.reduceat((vx ** 2).sum(axis=1), starts)
    return bias + np.add.reduceat(w[places] * values, starts) + ((sums ** 2).sum(axis=1) - squares) / 2


def fit(rows: list, labels: np.ndarray, epochs: int = 12, rate: float = 0.1, penalty: float = 1e-5):
    """Adagrad on the logistic loss in small batches, in a fixed order; without labels every score is a half."""
    rng = np.random.default_rng(0)
    bias, w, v = 0.0, np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, RANK))
    gw, gv, gb = np.full(WIDTH, 1e-3), np.full((WIDTH, RANK), 1e-3), 1e-3
    if not rows:
        return bias, w, np.zeros_like(v)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = order[at:at + 64]
            some = [rows[i] for i in part]
            places, values = np.concatenate([p for p, _ in some]), np.concatenate([x for _, x in some])
            sizes = np.array([len(p) for p, _ in some])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = v[places] * values[:, None]
            sums = np.add.reduceat(vx, starts)
            raw = bias + np.add.reduceat(w[places] * values, starts) + (
                (sums ** 2).sum(axis=1) - np.add.reduceat((vx ** 2).sum(axis=1), starts)) / 2
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]) / len(part)
            each = np.repeat(error, sizes)
            dw = each * values
            dv = dw[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            touched, inverse = np.unique(places, return_inverse=True)
            tw = np.bincount(inverse, weights=dw) + penalty * w[touched]
            tv = np.stack([np.bincount(inverse, weights=dv[:, f]) for f in range(RANK)], axis=1) + penalty * v[touched]
            gw[touched] += tw ** 2
            gv[touched] += tv ** 2
            gb += error.sum() ** 2
            w[touched] -= rate * tw / np.sqrt(gw[touched])
            v[touched] -= rate * tv / np.sqrt(gv[touched])
            bias -= rate * error.sum() / np.sqrt(gb)
    return bias, w, v


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, folds: int = 4, held_out: int = 2):
    """A model fitted on at most `sample` labelled documents outside the held-out fold.

    The bound is a parameter; the sample is the labelled ids of smallest hash, whatever the order of rows. A label given
    twice counts as its maximum.
    """
    chosen = labels.filter("doc_id is not null and quality is not null").filter(remainder_column(F.col("doc_id"), folds) != held_out).groupBy(
        "doc_id").agg(F.max("quality").cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def extract(batches):
        for batch in batches:
            found = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "places": [p.astype("<i4").tobytes() for p, _ in found],
                                "values": [x.astype("<f4").tobytes() for _, x in found]})

    rows = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id").mapInPandas(
        extract, "doc_id bigint, label double, places binary, values binary").toPandas().sort_values(["doc_id", "places"])
    data = [(np.frombuffer(p, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(np.float64)) for p, x in zip(rows["places"], rows["values"])]
    return fit(data, rows["label"].to_numpy(np.float64))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, held_out: int = 2, sample: int = 6000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; the score sees the text alone.

    Texts are read whole, missing text is empty and scored too; a missing doc_id is in the fold of the empty text; repeated
    rows give a row each; no labels give a half for every text, no rows no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, folds, held_out))

    def score(batches):
        for batch in batches:
            found = []
            for at in range(0, len(batch), 256):
                found.append(raw_scores(model.value, [features(t) for t in batch["text"].iloc[at:at + 256]]))
            p = 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *found]), -30, 30)))
            yield pd.DataFrame({"doc_id": pd.array(ids_of(batch["doc_id"]), dtype="Int64"), "score": p, "predicted": (p >= threshold).astype("int32")})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text")).mapInPandas(
        score, "doc_id bigint, score double, predicted int")
    return rows.select("doc_id", (remainder_column(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The documents scored at or above the threshold, all columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def keep(batches):
        for batch in batches:
            texts, found = batch.column("text"), [np.zeros(0)]
            for at in range(0, len(texts), 256):
                found.append(raw_scores(model.value, [features(t or "") for t in texts.slice(at, 256).to_pylist()]))
            raw = np.concatenate(found)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)

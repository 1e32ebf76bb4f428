"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_of, remainder_column, text_of

#: Buckets of hashed subwords and width of their embeddings.
BITS, WIDTH = 15, 16
BUCKETS = 1 << BITS
UNKNOWN = "und"


# One odd multiplier for each place in a run of characters, by the run's length.
_PLACES = np.random.default_rng(11).integers(1, 1 << 62, (5, 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLAB = 1 << 20


def buckets(text: str) -> np.ndarray:
    """How many subwords of a whole text fall into each bucket.

    Subwords are a word's runs of two to four characters, blanks at its ends included, so short words are
    subwords themselves. Long texts go by slabs of characters; a run that leaves a slab counts in the slab it starts in.
    """
    words = text.lower().split()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    if not words:
        return counts
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(codes), _SLAB):
        part = codes[at:at + _SLAB + 3].astype(np.uint64)
        blank = part == 32
        for n in (2, 3, 4):
            size = min(_SLAB, len(part) - n + 1)
            if size <= 0:
                continue
            key, inner = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=bool)
            for k in range(n):
                key += part[k:size + k] * _PLACES[n, k]
                if 0 < k < n - 1:
                    inner |= blank[k:size + k]
            key = (key ^ (key >> np.uint64(29))) * _PLACES[0, 0] >> np.uint64(64 - BITS)
            counts += np.bincount(key[~inner].astype(np.int64), minlength=BUCKETS)
    return counts


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and the share of each among all its subwords."""
    counts = buckets(text)
    places = np.flatnonzero(counts)
    return places, counts[places] / max(1, int(counts.sum()))


class Model:
    """The fitted softmax, folded: a text's class scores are the mean over its subwords of `table`'s rows, plus `bias`."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, heat: float, least: float):
        self.langs, self.table, self.bias, self.heat, self.least = langs, table, bias, heat, least


    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether that is below the least."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        places, shares = bag(text)
        p = softmax(((shares @ self.table[places] + self.bias) / self.heat)[None])[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.least)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(bags: list, labels: np.ndarray, n_langs: int, epochs: int = 6, rate: float = 0.3, batch: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and softmax by stochastic gradient descent in a fixed order, each weight's steps scaled by its
    gradients so far; folded into a row of class scores a bucket."""
    rng = np.random.default_rng(0)
    embed = rng.uniform(-0.5, 0.5, (BUCKETS, WIDTH))
    out, bias = rng.uniform(-0.5, 0.5, (WIDTH, n_langs)), np.zeros(n_langs)
    g_embed, g_out, g_bias = np.full(BUCKETS, 1e-8), np.full((WIDTH, n_langs), 1e-8), np.full(n_langs, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            places = np.concatenate([bags[i][0] for i in part])
            values = np.concatenate([bags[i][1] for i in part])
            starts = np.cumsum([0, *(len(bags[i][0]) for i in part[:-1])])
            mean = np.add.reduceat(embed[places] * values[:, None], starts)
            error = softmax(mean @ out + bias)
            error[np.arange(len(part)), labels[part]] -= 1
            error /= len(part)
            d_out, d_bias = mean.T @ error, error.sum(axis=0)
            d_embed = np.repeat(error @ out.T, np.diff([*starts, len(places)]), axis=0) * values[:, None]
            g_out += d_out ** 2
            g_bias += d_bias ** 2
            np.add.at(g_embed, places, (d_embed ** 2).mean(axis=1))
            out -= rate * d_out / np.sqrt(g_out)
            bias -= rate * d_bias / np.sqrt(g_bias)
            np.add.at(embed, places, -rate * d_embed / np.sqrt(g_embed[places])[:, None])
    return embed @ out, bias


def calibrate(raw: np.ndarray, labels: np.ndarray, right: float) -> tuple[float, float]:
    """Temperature of least log loss on texts the softmax was not fitted on, and the least probability above
    which at least `right` of these are right; 1, 0 without texts."""
    if not len(raw):
        return 1.0, 0.0
    # As if one more text of each kind had been right and wrong, so that no temperature makes scores certain.
    sure = (len(raw) + 1) / (len(raw) + 2)
    wanted = np.full(raw.shape, (1 - sure) / max(1, raw.shape[1] - 1))
    wanted[np.arange(len(labels)), labels] = sure
    heats = np.geomspace(0.05, 20, 60)
    loss = [-(wanted * np.log(np.maximum(softmax(raw / h), 1e-12))).sum() for h in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = softmax(raw / heat)
    order = np.argsort(-p.max(axis=1), kind="stable")
    good = np.cumsum(p.argmax(axis=1)[order] == labels[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(good >= right)
    if len(enough) and enough[-1] == len(order) - 1:
        return heat, 0.0
    return heat, float(p.max(axis=1)[order[enough[-1]]]) if len(enough) else 1.0


def train(docs: DataFrame, folds: int = 3, held_out: int = 1, sample: int = 4000, chars: int = 40_000_000, right: float = 0.99) -> Model:
    """A model of the languages of the documents outside the held-out fold.

    Every language found there takes an equal part of at most `sample` documents and `chars` characters, whole texts in order of a hash
    of id and text, the last of which may go over; each language has one at least. A fifth of them sets the temperature and the
    least probability only. Texts without letters teach nothing.
    """
    spark = docs.sparkSession
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder_column(F.col("doc_id"), folds) != held_out))
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = known.filter(F.col("text").rlike(r"\p{L}"))  # a bag of a text with letters is never empty
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    most = max(1, sample // len(langs))
    # Few more than the wanted share of each language's hashes are looked at, whatever the number of documents.
    mark = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    limits = spark.createDataFrame([(x, min((1 << 63) - 1, (2 * most + 100) * (1 << 63) // n)) for x, n in counts.items()], "lang string, limit bigint")
    by = Window.partitionBy("lang").orderBy("mark", "doc_id", "size")
    chosen = known.select("lang", "doc_id", mark.alias("mark"), F.length("text").alias("size")).join(F.broadcast(limits), "lang").filter(
        F.col("mark") <= F.col("limit")).withColumn("turn", F.row_number().over(by)).filter(F.col("turn") <= most)
    before = F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = chosen.withColumn("before", before).filter(F.col("before") < chars / len(langs))
    chosen = chosen.select("lang", "doc_id", "mark").distinct()

    def extract(batches):
        for batch in batches:
            found = [bag(t) for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "mark": batch["mark"], "places": [p.astype("<i4").tobytes() for p, _ in found],
                                "shares": [x.astype("<f4").tobytes() for _, x in found]})

    wanted = F.broadcast(chosen.withColumnRenamed("doc_id", "_doc_id"))  # at most `sample` rows
    rows = known.withColumn("mark", mark).join(wanted, ["lang", "mark"], "left_semi").dropDuplicates(["lang", "mark"]).mapInPandas(
        extract, "lang string, mark bigint, places binary, shares binary").toPandas().sort_values(["mark", "lang"], ignore_index=True)
    bags = [(np.frombuffer(p, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(np.float64)) for p, x in zip(rows["places"], rows["shares"])]
    labels = np.array([langs.index(x) for x in rows["lang"]], dtype=np.int64)
    aside = np.arange(len(bags)) % 5 == 4
    table, bias = fit([b for b, a in zip(bags, aside) if not a], labels[~aside], len(langs))
    raw = np.array([(table[p] * x[:, None]).sum(axis=0) + bias for (p, x), a in zip(bags, aside) if a]).reshape(-1, len(langs))
    return Model(langs, table.astype(np.float32), bias, *calibrate(raw, labels[aside], right))


def languages(docs: DataFrame, folds: int = 3, held_out: int = 1, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document; only the text is looked at.

    `rejected` marks predictions whose calibrated probability is below the least at which the given share of predictions on
    texts kept aside was right. Texts that are missing or have no letter are `und` with score 0 and rejected, and so is every text
    where no language could be learned. A missing id is in the fold of the empty text; repeated rows give a row each; no rows no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, folds, held_out, **options))

    def predict(batches):
        for batch in batches:
            lang, score, rejected = zip(*map(model.value.predict, batch["text"])) if len(batch) else ((), (), ())
            yield pd.DataFrame({"doc_id": pd.array(ids_of(batch["doc_id"]), dtype="Int64"), "lang_pred": lang, "score": score, "rejected": rejected})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text")).mapInPandas(
        predict, "doc_id bigint, lang_pred string, score double, rejected boolean")
    return rows.select("doc_id", (remainder_column(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score", "rejected")

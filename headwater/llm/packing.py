"""Best-fit packing of tokenised documents by minimum bin slack."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import materialise
from .common import ids_of, text_of
from .encode import encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The combination of available lengths that leaves the least of `room` empty.

    `lengths` is ascending. Bit t of the bitset says that some combination sums to t; each stage
    adds up to a power of two of copies of one length, longest first, until the room is filled.
    """
    reach, stages = 1, []
    full = (1 << (room + 1)) - 1
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[i]
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            stages.append((length, copies, reach))
            reach |= reach << length * copies & full
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, copies, before in reversed(stages):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + copies
            at -= length * copies
    return list(used.items())


def plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Bins for a histogram of lengths: rows (length, first rank, copies per bin, first bin, offset).

    Each bin takes the longest piece left and the fullest combination for the rest; the same
    combination is taken as often as the counts allow. Every round more than halves the count of
    some length, so rounds are at most `size` times the logarithm of the largest count.
    """
    counts = {k: v for k, v in counts.items() if v}
    lengths, used, out, bins = sorted(counts), dict.fromkeys(counts, 0), [], 0
    while lengths:
        longest = lengths[-1]
        counts[longest] -= 1
        if not counts[longest]:
            lengths.pop()
        chosen = dict(fullest(counts, lengths, size - longest))
        if not counts[longest]:
            insort(lengths, longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[n] // m for n, m in chosen.items())
        at = 0
        for n, m in sorted(chosen.items(), reverse=True):
            out.append((n, used[n], m, bins, at))
            at += n * m
            used[n] += m * times
            counts[n] -= m * times
            if not counts[n]:
                lengths.remove(n)
        bins += times
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """Pieces of at most `size` ids; `rank` numbers the pieces of one length within one task."""

    def encode(batches):
        enc, end, task = encoder(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(ids_of(batch["doc_id"]), batch["text"].tolist()):
                ids = enc.ids(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at:at + 4 * size]
                    n = len(part) // 4
                    rows.append((doc, piece, at // 4, n, zlib.crc32(part), task, int(seen[n])))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]).astype(
                {"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text")).mapInPandas(encode, PIECES)


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack documents into sequences of at most `size` ids; one row per piece.

    Texts are encoded whole; a document ends with `end_id`; only documents over `size` ids are cut.
    Which pieces share a sequence depends on their lengths alone, so the driver plans on the
    histogram of lengths (at most `size` rows, whatever the input) and tasks place each piece by
    its length and its rank among the pieces of that length. No text is shuffled. The plan has
    at most a few rows per length, so it may be broadcast.

    Missing text is empty and yields one piece holding the end id; repeated rows and ids are
    documents of their own; a missing doc_id stays missing; no rows yield no rows. Only doc_id
    and text are read, so further columns never clash.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, tokenizer, size, end_id), "pieces")
    tasks = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    bins = spark.sparkContext.broadcast(plan(counts, size))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def place(batches):
        length, first, copies, bin_no, offset = bins.value.T
        keys = length << 42 | first
        for batch in batches:
            own = batch["length"].to_numpy(np.int64)
            rank = (batch["rank"] + batch["first"]).to_numpy(np.int64)
            at = np.searchsorted(keys, own << 42 | rank, side="right") - 1
            rank = rank - first[at]
            yield batch[["doc_id", "piece", "start", "length", "ids_crc32"]].astype({"doc_id": "Int64"}).assign(
                sequence_id=bin_no[at] + rank // copies[at], offset=offset[at] + rank % copies[at] * own)

    return pieces.join(tasks, ["task", "length"]).mapInPandas(place, PLACED)

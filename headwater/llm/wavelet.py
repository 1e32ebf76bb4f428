"""Token ids of a corpus as wavelet-matrix files, one per shard.

A file holds, for every bit of the ids from high to low, one bit-plane in blocks that are
compressed one by one, with the number of ones before each block. Each level's ids are the last
level's, those with a 0 bit first. That gives the id at a place, the number of an id's
occurrences and their places from the file alone, reading only the blocks on the way.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import materialise, new_path
from .common import ids_of, text_of
from .encode import encoder

MAGIC = b"HWWM0001"
BLOCK = 1 << 16  # bits per block
MANIFEST = "shard int, file string, n_docs bigint, n_tokens bigint"
DIGEST = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def build(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> bytes:
    """One file: header, document table and bit-planes of the ids."""
    ids = np.asarray(ids, dtype=np.uint32)
    bits = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    body, at, planes = [], 0, []

    def add(raw: bytes) -> tuple[int, int]:
        nonlocal at
        body.append(packed := zlib.compress(raw, 1))
        at += len(packed)
        return at - len(packed), len(packed)

    for b in range(bits - 1, -1, -1):
        ones = (ids & ids.dtype.type(1 << b)) != 0
        packed = np.packbits(ones)
        blocks = [add(packed[i:i + BLOCK // 8].tobytes()) for i in range(0, len(packed), BLOCK // 8)]
        sums = np.array([np.count_nonzero(ones[i:i + BLOCK]) for i in range(0, len(ones), BLOCK)], dtype=np.int64)
        planes.append({"bit": b, "zeros": int(len(ones) - sums.sum()), "blocks": blocks,
                       "ones_before": (np.cumsum(sums) - sums).tolist()})
        ids = np.concatenate([ids.take(np.flatnonzero(~ones)), ids.take(np.flatnonzero(ones))])
    docs = {"ids": add(json.dumps(doc_ids).encode()), "lengths": add(np.asarray(lengths, dtype="<i8").tobytes())}
    head = zlib.compress(json.dumps({"n": len(ids), "bits": bits, "planes": planes, "docs": docs}).encode(), 1)
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *body])


class WaveletFile:
    """Random access into one file; `read(offset, size)` fetches bytes of it."""

    def __init__(self, read):
        if read(0, 8) != MAGIC:
            raise ValueError("not a wavelet file")
        n = int.from_bytes(read(8, 8), "little")
        head = json.loads(zlib.decompress(read(16, n)))
        self._read, self._base, self._planes, self._kept = read, 16 + n, head["planes"], {}
        self.n, self.bits = head["n"], head["bits"]
        self.doc_ids = json.loads(self._part(head["docs"]["ids"]))
        self.lengths = np.frombuffer(self._part(head["docs"]["lengths"]), dtype="<i8")

    def _part(self, place) -> bytes:
        return zlib.decompress(self._read(self._base + place[0], place[1]))

    def _block(self, level: int, block: int) -> np.ndarray:
        """Bits of one block; the last few dozen blocks stay in memory."""
        if (level, block) not in self._kept:
            if len(self._kept) >= 64:
                self._kept.pop(next(iter(self._kept)))
            self._kept[level, block] = np.unpackbits(np.frombuffer(self._part(self._planes[level]["blocks"][block]), dtype=np.uint8))
        return self._kept[level, block]

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before place i."""
        plane, block = self._planes[level], i // BLOCK
        if block >= len(plane["blocks"]):
            return self.n - plane["zeros"]
        return plane["ones_before"][block] + int(self._block(level, block)[: i % BLOCK].sum())

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, plane in enumerate(self._planes):
            bit, ones = int(self._block(level, i // BLOCK)[i % BLOCK]), self._ones(level, i)
            value = value << 1 | bit
            i = plane["zeros"] + ones if bit else i - ones
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for level, plane in enumerate(self._planes):
            a, b = self._ones(level, start), self._ones(level, stop)
            start, stop = (plane["zeros"] + a, plane["zeros"] + b) if token >> plane["bit"] & 1 else (start - a, stop - b)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of an id between two places."""
        if not 0 <= token < 1 << self.bits:
            return 0
        a, b = self._range(token, start, self.n if stop is None else stop)
        return max(0, b - a)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) given bit of a plane."""
        plane = self._planes[level]
        ones = np.array(plane["ones_before"])
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._block(level, block) == bit)[k - before[block]])

    def places(self, token: int) -> list[int]:
        """Places of all occurrences of an id, ascending."""
        if not 0 <= token < 1 << self.bits:
            return []
        out = []
        for i in range(*self._range(token, 0, self.n)):
            for level in range(len(self._planes) - 1, -1, -1):
                plane = self._planes[level]
                bit = token >> plane["bit"] & 1
                i = self._select(level, bit, i - plane["zeros"] if bit else i)
            out.append(i)
        return out

    def tokens(self) -> np.ndarray:
        """All ids: the levels undone from the last to the first."""
        ids = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(len(self._planes) - 1, -1, -1):
            plane = self._planes[level]
            packed = b"".join(self._part(x) for x in plane["blocks"])
            ones = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=self.n).view(bool)
            before = np.empty_like(ids)
            before[np.flatnonzero(~ones)] = ids[: plane["zeros"]]
            before[np.flatnonzero(ones)] = ids[plane["zeros"]:] | ids.dtype.type(1 << plane["bit"])
            ids = before
        return ids.astype(np.uint32, copy=False)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_file(path: str) -> WaveletFile:
    """A file of any store that pyarrow knows (local, HDFS, S3, GCS)."""
    system, place = _filesystem(path)
    source = system.open_input_file(place)

    def read(offset: int, size: int) -> bytes:
        source.seek(offset)
        return source.read(size)

    return WaveletFile(read)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, chars_per_shard: int = 16_000_000) -> DataFrame:
    """Encode all texts and write shards in ascending doc_id order; returns the manifest.

    Documents are range-partitioned by doc_id, one partition per shard; a shard holds about
    `chars_per_shard` characters, so tasks stay small at any input size. Each task writes under a
    name of its own and only files named in the manifest count, so a retried or doubled task does no harm.
    A missing text is empty, a missing doc_id sorts first, rows of equal id are ordered by text.
    No rows yield an empty manifest.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    chars = docs.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    shards = max(1, -(-chars // chars_per_shard))

    def write(batches):
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        doc_ids, lengths, parts = [], [], []
        for batch in batches:
            for doc, text in zip(ids_of(batch["doc_id"]), batch["text"].tolist()):
                parts.append(enc.ids(text) + end)
                doc_ids.append(doc)
                lengths.append(len(parts[-1]) // 4)
        if not doc_ids:
            return
        ids = np.frombuffer(b"".join(parts), dtype="<u4")
        del parts
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.wm"
        system, place = _filesystem(path)
        system.create_dir(place, recursive=True)
        with system.open_output_stream(f"{place}/{name}") as out:
            out.write(build(ids, doc_ids, np.array(lengths)))
        yield pd.DataFrame({"shard": [shard], "file": [f"{path}/{name}"], "n_docs": [len(doc_ids)], "n_tokens": [len(ids)]})

    ordered = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return materialise(ordered.mapInPandas(write, MANIFEST), "wavelet-manifest")


def read_digest(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ids before it, number of ids and their crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches):
        for batch in batches:
            for name, base in zip(batch["file"], batch["base"]):
                file = open_file(name)
                ids, at = file.tokens().astype("<u4"), np.concatenate([[0], np.cumsum(file.lengths)])
                yield pd.DataFrame({
                    "doc_id": pd.array(file.doc_ids, dtype="Int64"), "start": base + at[:-1], "n_tokens": file.lengths,
                    "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]})

    return files.repartition(max(1, manifest.count()), "shard").mapInPandas(read, DIGEST)


def write_and_read(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Round trip of a corpus through its files under `path` (a new shared folder if none is given)."""
    path = path or new_path(docs.sparkSession, "wavelet")
    return read_digest(write_shards(docs, path, tokenizer, **options))

"""Alignment of two tokenizers' ids over byte offsets.

Texts are tokenised whole. Where a space-marked token of both starts at the same byte, all tokens before
it end there in both: such anchors cut texts into windows of ids. A window's groups and links follow from
its ids alone, so of equal windows of many texts one is aligned.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import materialise
from .common import ids_of
from .encode import _byte_letters

# Fixed value: where byte-level vocabularies split a text before they merge.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters up to U+017F are of the same class in every Unicode version; the faster library needs stack for long blank runs.
_USUAL = re.compile("[\0-\u017F]*")
_LONG = re.compile(r"\s{1000}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Pair:
    """Both vocabularies: whole texts to ids, windows of ids to groups and links."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        value = {letter: byte for byte, letter in enumerate(_byte_letters())}
        size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        a_bytes = [self._plain(self.a.id_to_token(i), value) for i in range(size_a)]
        b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.size_b)]
        special = self.a.get_added_tokens_decoder()
        self.fast = tiktoken.Encoding("a", pat_str=_SPLIT, special_tokens={},
                                      mergeable_ranks={x: i for i, x in enumerate(a_bytes) if i not in special})
        self.sides = []
        for side in (a_bytes, b_bytes):
            sizes = np.array([len(x) for x in side], dtype=np.int64)
            self.sides.append((sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(side), np.uint8), np.array([x[:1] == b" " for x in side])))
        self.shown = [f"{i}{mark}" for i in range(max(size_a, self.size_b)) for mark in ",|;"]
        self.pairs = size_a * self.size_b

    @staticmethod
    def _plain(token: str, value: dict) -> bytes:
        return bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("\u2581", " ").encode()

    def a_ids(self, text: str) -> list[int]:
        """Ids of a whole text; the faster of two libraries with the same merges takes texts of usual characters."""
        if _USUAL.fullmatch(text) and not _LONG.search(text):
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def b_ids(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)

    def _sound(self, side: int, ids: list[np.ndarray], raw: list[bytes]) -> np.ndarray:
        """Of each text, whether its tokens' bytes are its bytes."""
        sizes, starts, flat, _ = self.sides[side]
        found = np.array([int(sizes[x].sum()) == len(r) for x, r in zip(ids, raw)], dtype=bool)
        for k in np.flatnonzero(found):
            n = sizes[ids[k]]
            found[k] = np.array_equal(flat[np.repeat(starts[ids[k]] - np.cumsum(n) + n, n) + np.arange(len(raw[k]))], np.frombuffer(raw[k], np.uint8))
        return found

    def align(self, texts: list[str | None]) -> list[tuple]:
        """For each text: n_a, n_b, n_groups, n_links, groups, distinct linked pairs, how often each is linked."""
        none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        given = [t for t in texts if t]
        raw = [b" " + t.encode() for t in given]
        a = [np.array(self.a_ids(" " + t), dtype=np.int64) for t in given]
        b = [np.array(x, dtype=np.int64) for x in (self.b_ids(given) if given else [])]
        sound = self._sound(0, a, raw) & self._sound(1, b, raw) if given else []
        rows = iter(self._rows([x for x, ok in zip(a, sound) if ok], [x for x, ok in zip(b, sound) if ok]))
        found = iter([next(rows) if ok else none for ok in sound])
        return [next(found) if t else none for t in texts]

    def anchors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in both where windows start: space-marked tokens that start at one byte, so all before end there too."""
        (a_sizes, _, _, a_marked), (b_sizes, _, _, b_marked) = self.sides
        a_at, b_at = np.flatnonzero(a_marked[a]), np.flatnonzero(b_marked[b])
        a_starts, b_starts = (np.cumsum(a_sizes[a]) - a_sizes[a])[a_at], (np.cumsum(b_sizes[b]) - b_sizes[b])[b_at]
        where = np.minimum(np.searchsorted(b_starts, a_starts), len(b_starts) - 1)
        same = b_starts[where] == a_starts
        return a_at[same], b_at[where[same]]

    @staticmethod
    def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return ids[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]

    def distinct(self, sides: list) -> tuple[np.ndarray, np.ndarray]:
        """The first of all windows that are equal in the ids of both, and of each window which of these it is.

        `sides`: ids, window starts and window sizes of both. Windows are sorted by a hash of their id tuples; where windows of
        one hash differ, which their ids then show, a window counts as new.
        """
        keys = np.zeros(len(sides[0][1]), dtype=np.uint64)
        for side, (ids, starts, sizes) in enumerate(sides):
            place = (np.arange(len(ids)) - np.repeat(starts, sizes)).astype(np.uint64)
            keys += _mixed(np.add.reduceat(_mixed(ids.astype(np.uint64) + _mixed(place * np.uint64(2) + np.uint64(side + 1))), starts) + np.uint64(side))
        order = np.argsort(keys, kind="stable")
        same = np.concatenate([[False], keys[order][1:] == keys[order][:-1]])
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        like = np.empty(len(order), dtype=np.int64)
        like[order] = first
        equal = np.ones(len(order), dtype=bool)
        for ids, starts, sizes in sides:
            equal &= sizes == sizes[like]
        check = np.flatnonzero(equal)
        for ids, starts, sizes in sides:
            n = sizes[check]
            differ = self._gather(ids, starts[check], n) != self._gather(ids, starts[like[check]], n)
            equal[check[np.add.reduceat(differ, np.cumsum(n) - n) > 0]] = False
        like = np.where(equal, like, np.arange(len(order)))
        return np.unique(like, return_inverse=True)

    def windows(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Windows in a row: text of each one's groups, its groups and links counted, and all links as a * size_b + b."""
        (a_sizes, *_), (b_sizes, *_) = self.sides
        a_ends, b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
        ends = a_ends[np.cumsum(n_a) - 1]
        at = np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)
        shared = a_ends[b_ends[at] == a_ends]
        bounds = np.sort(np.concatenate([a_ends[b_ends[at] != a_ends], b_ends]))
        # Between two neighbouring ends lies one token of each: one link.
        links = a[np.searchsorted(a_ends, bounds)] * self.size_b + b[np.searchsorted(b_ends, bounds)]
        n_links = np.diff(np.searchsorted(bounds, ends, side="right"), prepend=0)
        n_groups = np.diff(np.searchsorted(shared, ends, side="right"), prepend=0)
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        shown = np.empty(len(a) + len(b), dtype=np.int64)
        shown[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = a * 3 + (shared[a_group] == a_ends)
        shown[np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")] = b * 3 + 2 * (shared[b_group] == b_ends)
        parts = list(map(self.shown.__getitem__, shown.tolist()))
        cuts = [0, *np.cumsum(n_a + n_b).tolist()]
        return ["".join(parts[i:j]) for i, j in zip(cuts, cuts[1:])], n_groups, n_links, links

    def _rows(self, a_of: list[np.ndarray], b_of: list[np.ndarray]) -> list[tuple]:
        """`align` of sound texts. Each starts with a blank in both, so the texts in a row are one, with an anchor at each start."""
        if not a_of:
            return []
        a, b = np.concatenate(a_of), np.concatenate(b_of)
        at_a, at_b = self.anchors(a, b)
        size_a, size_b = np.diff(at_a, append=len(a)), np.diff(at_b, append=len(b))
        firsts, number = self.distinct([(a, at_a, size_a), (b, at_b, size_b)])
        n_a, n_b = size_a[firsts], size_b[firsts]
        groups, n_groups, n_links, links = self.windows(self._gather(a, at_a[firsts], n_a), n_a, self._gather(b, at_b[firsts], n_b), n_b)
        n = n_links[number]
        linked = self._gather(links, (np.cumsum(n_links) - n_links)[number], n)
        lengths = np.array([len(x) for x in a_of])
        cuts = [*np.searchsorted(at_a, np.cumsum(lengths) - lengths).tolist(), len(number)]
        of_text = np.repeat(np.arange(len(a_of)), np.diff(cuts))
        pairs, times = np.unique(linked + self.pairs * np.repeat(of_text, n), return_counts=True)
        pair_cuts = np.searchsorted(pairs, self.pairs * np.arange(len(a_of) + 1))
        all_groups, all_links = (np.bincount(of_text, weights=x[number], minlength=len(a_of)).astype(np.int64) for x in (n_groups, n_links))
        number = number.tolist()
        out = []
        for k in range(len(a_of)):
            text = "".join(map(groups.__getitem__, number[cuts[k]:cuts[k + 1]]))[:-1]
            own = slice(pair_cuts[k], pair_cuts[k + 1])
            out.append((len(a_of[k]), len(b_of[k]), int(all_groups[k]), int(all_links[k]), text, pairs[own] - self.pairs * k, times[own]))
        return out


_PAIRS: dict = {}


def pair_of(byte_path: str, piece_path: str) -> Pair:
    """This worker's pair of vocabularies."""
    key = byte_path, piece_path
    if key not in _PAIRS:
        _PAIRS[key] = Pair(*key)
    return _PAIRS[key]


_TEXTS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def texts(docs: DataFrame, byte_path: str, piece_path: str, groups: bool = False) -> DataFrame:
    """A row per document: counts, hash of its groups (their text too if asked), distinct linked pairs and how often each.

    A pair is a * (size of B's vocabulary) + b. Texts that are missing, empty or not given back by both
    vocabularies have no tokens.
    """
    def work(batches):
        both = pair_of(byte_path, piece_path)
        for batch in batches:
            ids = ids_of(batch["doc_id"])
            for at in range(0, len(batch), 500):
                rows = both.align(batch["text"].iloc[at:at + 500].tolist())
                n_a, n_b, n_groups, n_links, shown, pairs, times = zip(*rows)
                out = pd.DataFrame({"doc_id": pd.array(ids[at:at + 500], dtype="Int64"), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
                                    "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in shown], "pairs": pairs, "times": times})
                yield out.assign(groups=shown) if groups else out

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        work, _TEXTS + (", groups string" if groups else ""))


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """Rows (pair, docs, best): documents that hold a pair linked, and whether no pair of its A id has more.

    Counts are combined before the shuffle; the highest count is one row per A id, so bounded by the vocabulary.
    """
    counts = materialise(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "align-counts")
    a_id = F.floor(F.col("pair") / size_b).alias("a")
    most = counts.groupBy(a_id).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", a_id).join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str, frequent: int = 100_000) -> DataFrame:
    """Rows doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one per document.

    n_best: links whose pair has its A id's highest document count, ties included; count_sum: document counts summed over
    links. Pairs of more than 1/`frequent` of all (document, pair) rows, at most `frequent` of them, are broadcast; the
    others, each of few rows, meet their counts in a shuffle. Missing and empty texts and such as either vocabulary does not give
    back have zeros and an empty hash; repeated rows are documents of their own; missing ids stay missing; no rows give no rows.
    """
    rows = materialise(texts(docs, byte_path, piece_path).withColumn("row", F.monotonically_increasing_id()), "align-texts")
    counts = materialise(pair_counts(rows, pair_of(byte_path, piece_path).size_b), "align-best")
    total = counts.agg(F.sum("docs")).first()[0] or 0
    often = F.col("docs") * frequent > total
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("docs") * F.col("times")).alias("count_sum")]
    joined = each.join(F.broadcast(counts.filter(often)), "pair", "left")
    known = joined.filter("docs is not null").groupBy("row").agg(*sums)
    rare = joined.filter("docs is null").select("row", "pair", "times").join(counts.filter(~often), "pair").groupBy("row").agg(*sums)
    found = known.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(found, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")

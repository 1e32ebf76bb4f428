"""Jaccard join of word n-gram sets by token-combination prefixes.

All sets are read in one global order: shingles of one document, then rare ones, then frequent
ones, each by hash. Two sets that link share at least two shingles of their prefixes extended by
one. So a shared rare shingle finds the pair, or else a shared combination of two frequent ones;
candidates are then verified on the whole sets. The sets of one key are first held against one of them, the
centre; what is left is compared by the differences from the centre, see `links`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import materialise
from .common import numbered, text_of
from .graph import components, if_small

#: Bits of the two maps that tell repeated and frequent shingles: 16 MB and 4 MB at any input size.
REPEATED_BITS, FREQUENT_BITS, MEMBER_BITS = 27, 25, 24
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORDS: dict[str, bytes] = {}
_WORDS_KEPT = 300_000


def words_of(text: str) -> list[str]:
    """Runs of anything but ASCII white space."""
    for blank in "\n\t\r\v\f":
        if blank in text:
            text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def lower_ascii(word: str) -> bytes:
    """UTF-8 of a word with A-Z in lower case."""
    return word.encode("utf-8", "surrogatepass").translate(_UPPER)


def _hash(word: str) -> bytes:
    if len(_WORDS) >= _WORDS_KEPT:
        _WORDS.clear()
    _WORDS[word] = found = xxhash.xxh64_digest(lower_ascii(word))
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_set(text: str, n: int = 4) -> np.ndarray:
    """Distinct n-word shingles of a text as ascending 64-bit hashes; a shorter text is one shingle."""
    known = _WORDS
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.frombuffer(b"".join([known.get(w) or _hash(w) for w in words]), dtype="<u8")
    m = min(n, len(hashes))
    total = np.zeros(len(hashes) - m + 1, dtype=np.uint64)
    for i in range(m):
        total += _mixed(hashes[i:len(hashes) - m + 1 + i] + _ODD[i % 4]) * (_ODD[i % 4] + np.uint64(2 * (i // 4)))
    return np.unique(_mixed(total + np.uint64(m)))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))


def _node(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def _objects(values) -> pd.Series:
    """A column of bytes or arrays, of object type even where it has no rows."""
    return pd.Series(list(values), dtype=object)


def _bits(values: np.ndarray, size: int) -> bytes:
    flags = np.zeros(1 << size, dtype=bool)
    flags[values] = True
    return zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1)


def joined_maps(parts: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The two maps of `frequency_maps`, put together from their parts."""
    repeated, often = (np.zeros(1 << bits - 3, dtype=np.uint8) for bits in (REPEATED_BITS, FREQUENT_BITS))
    for part, *own in parts:
        for whole, packed in zip((repeated, often), own):
            chunk = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
            whole[part * len(chunk):(part + 1) * len(chunk)] = chunk
    return repeated, often


def frequency_maps(docs: DataFrame, n: int, frequent: int) -> list[tuple[int, bytes, bytes]]:
    """Bit maps over hash space: shingles of two documents or more, and of more than `frequent`; in parts for `joined_maps`.

    Every shingle of every document is counted: tasks send sorted, pre-counted blocks, one group
    per range of hashes, with more ranges for more text. The maps have a fixed size, so they may be
    sent to tasks; the driver passes compressed parts on and only tasks put them together. Where many
    hashes share a bit a rare shingle counts as repeated or frequent, which costs time and changes no result.
    """
    chars = docs.agg(F.sum(F.length(text_of(docs)))).first()[0] or 0
    parts = min(20, max(6, (chars // 16_000_000).bit_length()))

    def count(batches):
        kept, size = [], 0

        def blocks():
            tokens, times = np.unique(np.concatenate(kept), return_counts=True)
            part = (tokens >> np.uint64(64 - parts)).astype(np.int64)
            low = (tokens << np.uint64(parts) >> np.uint64(32)).astype("<u4")
            cuts = np.searchsorted(part, np.arange((1 << parts) + 1))
            rows = []
            for p in np.unique(part):
                own, many = low[cuts[p]:cuts[p + 1]], times[cuts[p]:cuts[p + 1]]
                rows.append((int(p), own[many == 1].tobytes(), own[many > 1].tobytes(), many[many > 1].astype("<u4").tobytes()))
            return pd.DataFrame(rows, columns=["part", "once", "more", "times"])

        for batch in batches:
            for text in batch["text"]:
                kept.append(shingle_set(text, n))
                size += len(kept[-1])
                if size > 3_000_000:
                    yield blocks()
                    kept, size = [], 0
        if size:
            yield blocks()

    def reduce(key, group):
        tokens = np.concatenate([np.frombuffer(x, dtype="<u4") for x in [*group["once"], *group["more"]]])
        times = np.concatenate([np.ones(sum(map(len, group["once"])) // 4, dtype=np.int64), *(np.frombuffer(x, dtype="<u4") for x in group["times"])])
        order = np.argsort(tokens, kind="stable")
        tokens, times = tokens[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])[:len(tokens)])
        total = np.add.reduceat(times, first)
        out = [_bits(tokens[first][total > most] >> np.uint32(32 - bits + parts), bits - parts)
               for most, bits in ((1, REPEATED_BITS), (frequent, FREQUENT_BITS))]
        return pd.DataFrame({"part": [key[0]], "repeated": out[:1], "often": out[1:]})

    rows = _documents(docs).select("text").mapInPandas(count, "part int, once binary, more binary, times binary").groupBy(
        "part").applyInPandas(reduce, "part int, repeated binary, often binary").collect()
    return [(r["part"], bytes(r["repeated"]), bytes(r["often"])) for r in rows]


def _has(bits: np.ndarray, s: np.ndarray, size: int) -> np.ndarray:
    at = s >> np.uint64(64 - size)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def prefix_keys(s: np.ndarray, repeated: np.ndarray, often: np.ndarray, percent: int, singles_from: int) -> np.ndarray:
    """Index keys of one set: rare shingles of the extended prefix, and pairs of its frequent ones.

    A partner holds at least `percent` % of the set, so all but that share plus two shingles, first in the
    order, must hold two common ones. Sets above `singles_from` shingles, whose pairs would be
    many, are indexed by single frequent shingles; sets that may link to those have both.
    Shingles of one document come first and give no keys: they match nothing.
    """
    n = len(s)
    if n < 2 or n * (100 - percent) < percent:  # so small a set links with no other set
        return np.zeros(0, dtype=np.uint64)
    least = (percent * n + 99) // 100
    common = _has(often, s, FREQUENT_BITS)
    more = _has(repeated, s, REPEATED_BITS) & ~common
    prefix = min(n, n - least + 2)
    alone = int(n - common.sum() - more.sum())
    rare = s[more][:max(0, prefix - alone)]
    held = s[common][:max(0, prefix - alone - len(rare))]
    keys = [rare]
    if n <= singles_from:
        i, j = np.triu_indices(len(held), 1)
        keys.append(_mixed(held[i] * _ODD[0] + held[j] * _ODD[1]))
    if 100 * n >= percent * singles_from:
        keys.append(held)
    return np.concatenate(keys)


def index(docs: DataFrame, n: int, percent: int, maps, singles_from: int) -> DataFrame:
    """(doc_id, node, n_shingles, keys) of every document; its node is a 128-bit digest of its set. `maps` are broadcast parts."""
    def keys(batches):
        repeated, often = joined_maps(maps.value)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingle_set(text, n)
                rows.append((_node(s), len(s), prefix_keys(s, repeated, often, percent, singles_from).view(np.int64)))
            node, size, keys = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "node": _objects(node), "n_shingles": np.array(size, np.int64), "keys": _objects(keys)})

    return _documents(docs).mapInPandas(keys, "doc_id bigint, node binary, n_shingles bigint, keys array<bigint>")


def sets_of(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(node, s) for the wanted nodes, given by one doc_id each.

    A bit map of the wanted ids, of fixed size, lets tasks pass over most texts; nodes are then joined exactly.
    """
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MEMBER_BITS))
    rows = wanted.select(F.floor(at / 32).cast("bigint").alias("at"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 32).cast("int")).alias("bit")).groupBy(
        "at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << MEMBER_BITS - 5, dtype=np.int64)
    bits[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    bits = docs.sparkSession.sparkContext.broadcast(bits)

    def gather(batches):
        for batch in batches:
            at = batch["at"].to_numpy(np.int64)
            found = batch["text"][(bits.value[at >> 5] >> (at & 31) & 1).astype(bool)]
            sets = [shingle_set(t, n) for t in found]
            yield pd.DataFrame({"node": _objects([_node(s) for s in sets]), "s": _objects([s.view(np.int64) for s in sets])})

    rows = _documents(docs).select("text", at.alias("at")).mapInPandas(gather, "node binary, s array<bigint>")
    return rows.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("s").alias("s"))


def compared(pairs: DataFrame, sets: DataFrame, salts: int = 64) -> DataFrame:
    """(a, b, n_a, n_b, apart, diff) of pairs (a, b): set sizes and the shingles that only one of the two has.

    `apart` counts those shingles; `diff` lists them where they are at most a third of both sets
    together. Pairs of one `a` are spread over `salts` tasks.
    """
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(salts)).alias("salt"))
    left = pairs.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("s").alias("s_a")), "a")
    full = pairs.join(left, ["a", "salt"]).join(sets.select(F.col("node").alias("b"), F.col("s").alias("s_b")), "b")
    full = full.select("a", "b", F.size("s_a").alias("n_a"), F.size("s_b").alias("n_b"),
                       F.array_except("s_a", "s_b").alias("only_a"), F.array_except("s_b", "s_a").alias("only_b"))
    apart = F.size("only_a") + F.size("only_b")
    return full.select("a", "b", "n_a", "n_b", apart.alias("apart"), F.when(
        3 * apart <= F.col("n_a") + F.col("n_b"), F.concat("only_a", "only_b")).alias("diff"))


def _link(apart: Column, both: Column, percent: int) -> Column:
    """Whether sets of `both` shingles together, `apart` of them not shared, link."""
    return (100 + percent) * apart <= (100 - percent) * both


def meetings(near: DataFrame, percent: int) -> DataFrame:
    """Pairs (centre, a, b) of the nodes `near` (centre, node, n, component, apart, centre_n, diff) that may link.

    What two sets must share of their differences from the centre follows from `excess`, (100 + percent) * apart - (100 - percent) * n:
    their excesses together, over 2 * (100 + percent). Of two nodes in different components the one of higher excess does not link with the
    centre, which bounds its excess from below; its own bound comes from the least excess and largest set there are. So a node shows
    only its rarest differences, all but one less than it must share; the lower of two shows fewer than the higher.
    """
    p, q = 100 + percent, 100 - percent
    near = near.withColumn("excess", (p * F.col("apart") - q * F.col("n")).cast("bigint")).withColumn("linked", (q * F.col("centre_n")).cast("bigint"))
    ends = near.groupBy("centre").agg(F.min("excess").alias("least"), F.max("n").alias("most"))
    largest = F.least(F.col("most"), F.floor(F.col("n") * 100 / percent))
    low = F.greatest(F.lit(1), F.ceil((F.col("excess") + F.greatest("excess", F.col("linked") + 1)) / (2 * p)))
    high = F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col("least")) / (2 * p)), F.ceil((F.col("excess") - q * largest) / p))
    near = near.join(if_small(materialise(ends, "set-ends")), "centre").withColumn("as_low", F.col("apart") - low + 1).withColumn(
        "as_high", F.when(F.col("excess") > F.col("linked"), F.col("apart") - high + 1).otherwise(0))
    marks = near.select("centre", "node", "component", "excess", "as_low", "as_high", F.explode("diff").alias("shingle"))
    often = marks.groupBy("centre", "shingle").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    rarest = Window.partitionBy("centre", "node").orderBy(F.coalesce("many", F.lit(1)), "shingle")
    marks = marks.join(often, ["centre", "shingle"], "left").withColumn("place", F.row_number().over(rarest))
    marks = materialise(marks.filter("many is not null and place <= greatest(as_low, as_high)"), "set-marks")
    lower = marks.filter("place <= as_low").select("centre", "shingle", "node", "component", "excess")
    higher = marks.filter("place <= as_high").select("centre", "shingle", *[F.col(c).alias(f"{c}_2") for c in ("node", "component", "excess")])
    found = lower.join(higher, ["centre", "shingle"]).filter("component <> component_2 and excess <= excess_2")
    return found.select("centre", F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct()


def links(keyed: DataFrame, members: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links (a, b) of the nodes of `keyed` (node, n, keys) that connect all that share a key and link.

    `members` gives the sets (node, s) of a table of nodes.
    The centre of a key is its node with most keys: in a group of copies the one with the fewest
    shingles of its own. Every node is compared with the centres of its keys, and what links becomes a component.
    Two nodes of a key in different components do not both link with the centre, and then they link
    only if some shingle tells both from the centre: without one they are as far apart
    as both are from the centre together, which is too far. So nodes close to a centre meet by the rarest of such shingles (`meetings`),
    and the number of those they share tells how far apart they are; copies that differ in other places never meet.
    Nodes far from the centre meet by the key, where sizes and distances from the centre leave it open.
    """
    rows = keyed.select("node", "n", F.size("keys").alias("n_keys"), F.explode("keys").alias("key"))
    ends = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.max(F.struct("n_keys", "node", "n")).alias("c")).filter("many > 1")
    ends = materialise(ends.select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n")), "set-keys")
    posts = materialise(rows.drop("n_keys").join(if_small(ends), "key").filter("node <> centre"), "set-posts")
    sets = members(posts.select("node").unionByName(ends.select(F.col("centre").alias("node"))).distinct())
    sized = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)

    tried = posts.filter(sized(F.col("n"), F.col("centre_n"))).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    star = materialise(compared(materialise(tried, "set-star"), sets), "set-compared")
    first = star.filter(_link(F.col("apart"), F.col("n_a") + F.col("n_b"), percent)).select("a", "b")
    found = components(first)
    own = posts.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = own.join(star.select(F.col("a").alias("centre"), F.col("b").alias("node"), "apart", F.col("diff").isNotNull().alias("close")), ["centre", "node"], "left")
    own = materialise(own.withColumn("close", F.coalesce("close", F.lit(False))), "set-own")
    mixed = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    own = own.join(mixed, "key", "left_semi")
    other = lambda df, *also: df.select(*also, *[F.col(c).alias(f"{c}_2") for c in ("node", "n", "component", "apart", "close")])

    near = own.filter("close and apart > 0").select("centre", "node", "n", "component", "apart").distinct().join(
        star.select(F.col("a").alias("centre"), F.col("b").alias("node"), F.col("n_a").alias("centre_n"), "diff"), ["centre", "node"])
    near = materialise(near, "set-near")
    of = lambda end: near.select("centre", *[F.col(c).alias(end if c == "node" else f"{c}_{end}") for c in ("node", "n", "apart", "diff")])
    met = materialise(meetings(near, percent), "set-met").join(of("a"), ["centre", "a"]).join(of("b"), ["centre", "b"])
    apart = F.col("apart_a") + F.col("apart_b") - 2 * F.size(F.array_intersect("diff_a", "diff_b"))
    met = met.filter(_link(apart, F.col("n_a") + F.col("n_b"), percent)).select("a", "b")

    far = own.filter("not close").join(other(own, "key"), "key").filter(
        (F.col("component") != F.col("component_2")) & (F.col("close_2") | (F.col("node") < F.col("node_2"))) & sized(F.col("n"), F.col("n_2"))
        & F.coalesce(_link(F.abs(F.col("apart") - F.col("apart_2")), F.col("n") + F.col("n_2"), percent), F.lit(True)))
    far = far.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct()
    far = compared(materialise(far, "set-far"), sets).filter(_link(F.col("apart"), F.col("n_a") + F.col("n_b"), percent)).select("a", "b")
    return first.unionByName(met).unionByName(far)


def classes(docs: DataFrame, n: int = 4, percent: int = 85, frequent: int = 64, singles_from: int = 512) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest doc_id it reaches by links.

    Links are sets of distinct n-word shingles with 100 * intersection >= percent * union. Equal sets are one node; nodes that share
    an index key are compared by `links`. Frequent means in more than `frequent` documents.

    Texts are read whole. A text of fewer than n words is one shingle; missing text and text without words are empty,
    link with nothing and keep their own doc_id. A missing doc_id never names a component; a document
    that reaches no id has none. Repeated rows and ids each give a row. Only doc_id and text are
    read. No rows yield no rows. Shingles are compared by 64-bit hash.
    """
    maps = docs.sparkSession.sparkContext.broadcast(frequency_maps(docs, n, frequent))
    rows = materialise(index(docs, n, percent, maps, singles_from), "sets")
    maps.unpersist()
    nodes = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    keyed = materialise(rows.filter(F.size("keys") > 0).groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "set-keyed")
    members = lambda wanted: materialise(sets_of(docs, n, nodes.join(wanted, "node")), "set-members")
    found = components(links(keyed, members, percent))

    nodes = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = nodes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    nodes = nodes.join(names, "component").select("node", "component_id")
    empty = F.col("n_shingles") == 0
    return rows.join(nodes, "node", "left").select(
        "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each component: that of the smallest doc_id, then of the smallest text hash; a missing id comes last.

    Rows are told apart by a number of their own, written with them, so rows that repeat an id or have none are
    kept and dropped one by one. Missing text and text without words are like nothing and stay.
    """
    rows = materialise(numbered(docs), "set-rows")
    plain = rows.select("row_no", F.col("whole").getField("doc_id").alias("doc_id"), F.col("whole").getField("text").alias("text"))
    found = classes(plain.select(F.col("row_no").alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("row_no"), "component_id")
    found = materialise(found, "set-found")
    many = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("component_id")
    marked = found.join(many, "component_id").join(plain.select("row_no", "doc_id", F.xxhash64(text_of(plain)).alias("mark")), "row_no")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "row_no")
    best = marked.groupBy("component_id").agg(F.min(order).alias("best")).select("best.row_no")
    gone = marked.select("row_no").join(best, "row_no", "left_anti")
    return rows.join(gone, "row_no", "left_anti").select("whole.*")

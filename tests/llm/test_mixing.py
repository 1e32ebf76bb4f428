"""Mixing against a plain version; the shared SQL checks are in test_registered.py."""

import hashlib
import re
from collections import defaultdict

from headwater.llm import mixing

from .conftest import AWKWARD


def plain(rows):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, s, n in sized:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        left = budget - sum(2 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / sum(weight[r] for r in rest) for s in order}
        over = {s for s in rest if target[s] >= 2 * sizes[s]}
        if not over:
            break
        full |= over
    queue = []
    for s in order:
        upto = 0
        own = sorted((hashlib.md5(str("" if i is None else i).encode()).hexdigest(), -1 if i is None else i, n) for i, x, n in sized if x == s)
        for turn in (0, 1):
            for key, i, n in own:
                upto += n
                if target[s]:
                    queue.append((upto / target[s], order.index(s), key, i, n, turn))
    taken, running = defaultdict(int), 0
    for _, s, _, i, n, _ in sorted(queue):
        running += n
        if running <= budget:
            taken[order[s], i] += n
    return target, taken


def test_plain_version(awkward):
    target, taken = plain(AWKWARD)
    got = defaultdict(int)
    rows = mixing.taken(awkward, rows_per_bucket=1).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        got[r.doc_id, r.size] += r.taken
    want = defaultdict(int)
    for i, t, s in {(i, t, s) for i, t, s in AWKWARD}:
        want[i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))] += taken[s, -1 if i is None else i]
    assert got == want
    for r in rows:
        assert min(abs(r.target - t) for t in target.values()) < 1e-6


def test_buckets_change_nothing_and_rows_repeat(spark, sf, awkward, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    many = sorted(tuple(r) for r in mixing.taken(docs, rows_per_bucket=1).select("doc_id", "taken").collect())
    assert many == sorted(tuple(r) for r in mixing.taken(docs).select("doc_id", "taken").collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = dict(mixed.groupBy("doc_id").count().collect())
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert {i: t // size[i] for i, t in many if t} == times
    assert mixing.mix(awkward).columns == awkward.columns
    assert mixing.taken(nothing).collect() == [] and mixing.mix(nothing).collect() == []

"""Merkle manifest against a plain tree built level by level."""

import zlib

import pytest

from headwater.llm import merkle
from headwater.llm.merkle import Appender, digest, fold


def plain_levels(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[at:at + fanout])) for at in range(0, len(last), fanout)])
    return levels


def plain_steps(levels, at, fanout):
    steps = []
    for level in levels[:-1]:
        run = level[at // fanout * fanout:][:fanout]
        steps.append((at % fanout, "".join(n for i, n in enumerate(run) if i != at % fanout)))
        at //= fanout
    return steps


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 513])
def test_appender_is_the_plain_tree(n):
    leaves = [digest(str(i)) for i in range(n)]
    appender = Appender(8)
    for node in leaves:
        appender.append(node)
    root, levels = appender.finish(None), plain_levels(leaves, 8)
    assert root == levels[-1][0]
    assert [list(w) for w in appender.witnesses] == [plain_steps(levels, i, 8) for i in range(n)]
    assert all(fold(node, w) == root for node, w in zip(leaves, appender.witnesses))


def test_witness_grows_when_a_sibling_completes():
    appender = Appender(2)
    seen = []
    for i in range(4):
        appender.append(digest(str(i)))
        seen.append([len(w) for w in appender.witnesses])
    assert seen == [[0], [1, 1], [1, 1, 0], [2, 2, 2, 2]]


def plain(rows, fanout=8):
    """Digest rows of the contract, from rows (doc_id, text, source, lang, n_chars)."""
    def leaf_of(r, lower=False):
        text = r["text"]
        if lower and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        out = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)
        return merkle.hashlib.sha256(out.encode()).hexdigest()

    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        built[name] = plain_levels([x[2] for x in trees[name]], fanout)
    top = plain_levels([built[n][-1][0] for n in names], fanout)
    out = []
    for i, name in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(trees[name]):
            steps = plain_steps(built[name], at, fanout) + plain_steps(top, i, fanout)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            folded = fold(leaf_of(r, lower=hit), steps)
            out.append((r["doc_id"], leaf, built[name][-1][0], top[-1][0], digest("".join(s for _, s in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def found(docs, **options):
    return sorted((tuple(r) for r in merkle.verified(merkle.manifest(docs, **options)).collect()), key=repr)


def test_manifest_of_awkward_rows(spark, awkward, nothing):
    rows = [r.asDict() for r in awkward.collect()]
    for r, lang in zip(rows, [None, "fr", "", "é", "en", None, "en", "en", "z", "fr"], strict=True):
        r["lang"] = lang
    rows += [{**rows[0], "doc_id": i, "lang": "en", "n_chars": None} for i in range(100, 180)]
    docs = spark.createDataFrame(rows, awkward.schema)
    for clash in ("tree", "pos", "node", "key", "steps", "range", "line", "turn", "block", "total"):
        docs = docs.withColumn(clash, merkle.F.lit("x"))
    wanted = plain(rows)
    assert found(docs) == wanted
    assert found(docs, height=1) == wanted  # blocks of eight: several rounds
    assert found(docs, fanout=2, height=2) == plain(rows, fanout=2)
    assert found(nothing) == []


def test_one_document(documents):
    docs = documents([(5, "Only one.", "a")])
    assert found(docs) == plain([r.asDict() for r in docs.collect()])


def test_changed_leaf_does_not_verify(documents):
    docs = documents([(i, f"Text {i}", "a") for i in range(30)])
    rows = merkle.verified(merkle.manifest(docs)).collect()
    for r in rows:
        assert r.verified == (zlib.crc32(str(r.key).encode()) % 3 != 0)
    assert {r.verified for r in rows} == {True, False}

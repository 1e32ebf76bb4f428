"""Alignment against a plain pass over bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from headwater.llm import alignment, common

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
BOTH = alignment.Pair(*PATHS)
LETTERS = {c: b for b, c in enumerate(alignment._byte_letters())}


def a_token(i):
    return bytes(LETTERS[c] for c in A.id_to_token(i))


def b_token(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()


def plain(text):
    """Groups and linked occurrences of a text, byte by byte; None if it has no tokens."""
    if not text:
        return None
    raw = b" " + text.encode()
    sides = []
    for ids, token in ((A.encode(" " + text, add_special_tokens=False).ids, a_token), (B.encode(text), b_token)):
        if b"".join(map(token, ids)) != raw:
            return None
        spans, at = [], 0
        for i in ids:
            spans.append((i, at, at + len(token(i))))
            at = spans[-1][2]
        sides.append(spans)
    owner = [[k for k, (_, s, e) in enumerate(side) for _ in range(s, e)] for side in sides]
    links = Counter((sides[0][i][0], sides[1][j][0]) for i, j in sorted(set(zip(*owner))))
    cuts = sorted({e for _, _, e in sides[0]} & {e for _, _, e in sides[1]})
    groups, low = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in sides))
        low = cut
    return sides, groups, links


def plain_rows(rows):
    """Rows of the contract, as a multiset."""
    found = [(doc_id, plain(text)) for doc_id, text in rows]
    docs = Counter(pair for _, f in found if f for pair in f[2])
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    out = Counter()
    for doc_id, f in found:
        if f is None:
            out[doc_id, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        sides, groups, links = f
        n_best = sum(n for pair, n in links.items() if docs[pair] == best[pair[0]])
        total = sum(n * docs[pair] for pair, n in links.items())
        out[doc_id, len(sides[0]), len(sides[1]), len(groups), sum(links.values()), n_best, total,
            hashlib.sha256(";".join(groups).encode()).hexdigest()] += 1
    return out


ODD = ["\n  foo  \n\n  bar ", "  ", " ", "a  b  c", "▁ piece mark", "\x1c a \x85 b", "don't 'll <|endoftext|> </s> <0x0A>",
       "é́ ﬁ ½ \U0001f600\U0001f600 日本語 text", "x" * 3000, " " * 1500 + "x", "\xa0\xa0 \xad \xb2\xaa", "İ ß Ÿ"]


def test_windows_of_random_texts():
    rng = random.Random(3)
    words = ["the", "Alignment", "don't", "naïve", "12,345.6", "\n", " ", "日本", "<s>", "unbelievably", "😀", "a", "\t"]
    texts = ODD + [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(150)]
    for text, row in zip(texts, BOTH.align(texts), strict=True):
        wanted = plain(text)
        if wanted is None:
            assert row[:5] == (0, 0, 0, 0, "")
            continue
        sides, groups, links = wanted
        assert row[:5] == (len(sides[0]), len(sides[1]), len(groups), sum(links.values()), ";".join(groups))
        assert {divmod(int(p), BOTH.size_b): int(n) for p, n in zip(row[5], row[6])} == dict(links)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(alignment, "_mixed", lambda x: x * np.uint64(0))
    texts = ["one two three one two", "two one", "three and one"]
    for text, row in zip(texts, BOTH.align(texts), strict=True):
        assert row[4] == ";".join(plain(text)[1])


def test_equal_windows_are_aligned_once():
    texts = ["same words here"] * 20
    seen = []
    own = alignment.Pair.windows

    class Watched(alignment.Pair):
        def windows(self, a, n_a, b, n_b):
            seen.append(len(n_a))
            return own(self, a, n_a, b, n_b)

    Watched(*PATHS).align(texts)
    assert seen == [3]


@pytest.mark.parametrize("frequent", [100_000, 3])
def test_align(spark, awkward, frequent):
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(100 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for clash in ("pair", "pairs", "times", "row", "docs", "best", "a", "x", "n_a"):
        docs = docs.withColumn(clash, alignment.F.lit("y"))
    found = alignment.align(docs, *PATHS, frequent=frequent)
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[c] for c in cols) for r in found.collect()) == plain_rows(rows)


def test_query_and_empty(spark, sf, nothing):
    docs = common.table(spark, sf, "documents").filter("doc_id < 40")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[c] for c in cols) for r in alignment.align(docs, *PATHS).collect()) == plain_rows(rows)
    assert alignment.align(nothing, *PATHS).collect() == []
    shown = alignment.texts(docs, *PATHS, groups=True).first()
    assert hashlib.sha256(shown.groups.encode()).hexdigest() == shown.groups_sha256

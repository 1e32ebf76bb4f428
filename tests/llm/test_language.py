"""Language identification: held-out accuracy, calibration and odd input."""

import numpy as np
import pytest

from headwater.llm import common, language, queries


def test_score_is_the_softmax_of_averaged_embeddings():
    rng = np.random.default_rng(0)
    embed, out = rng.normal(size=(language.BUCKETS, 8)), rng.normal(size=(8, 3))
    model = language.Model(["a", "b", "c"], embed @ out, np.zeros(3), 1.0, 0.5)
    for text in ["one two  Three one", "x", "é ß 中文 " * 50]:
        counts = language.buckets(text)
        p = language.softmax(((counts[:, None] * embed).sum(axis=0) / counts.sum() @ out)[None])[0]
        lang, score, rejected = model.predict(text)
        assert lang == "abc"[p.argmax()] and score == pytest.approx(p.max()) and rejected == (p.max() < 0.5)


def test_subwords_stay_within_words_and_slabs(monkeypatch):
    text = "Of the \n naïve words, and words"
    whole = language.buckets(text)
    runs = [f" {w} "[i:i + n] for w in text.lower().split() for n in (2, 3, 4) for i in range(len(w) + 3 - n)]
    assert whole.sum() == len(runs) and np.count_nonzero(whole) == len(set(runs))
    assert (language.buckets("words and, of naïve the words".replace("and,", "and").replace("words", "words,", 1)) == whole).all()
    monkeypatch.setattr(language, "_SLAB", 7)
    assert (language.buckets(text) == whole).all()
    assert language.buckets(" \n").sum() == 0


def test_training_descends():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcd" if k else "wxyz"), 6)) + " word" for k in (0, 1) for _ in range(40)]
    labels = np.repeat([0, 1], 40)
    bags = [language.bag(t) for t in texts]
    table, bias = language.fit(bags, labels, 2)
    raw = np.array([(table[p] * x[:, None]).sum(axis=0) + bias for p, x in bags])
    assert (raw.argmax(axis=1) == labels).all()


def test_calibration():
    rng = np.random.default_rng(2)
    truth = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=p) for p in language.softmax(truth)])
    heat, least = language.calibrate(truth * 5, labels, 0.9)  # scores five times too sure
    p = language.softmax(truth * 5 / heat)
    kept = p.max(axis=1) >= least
    assert 4 < heat < 6 and 0.3 < kept.mean() < 0.9
    assert (p.argmax(axis=1) == labels)[kept].mean() == pytest.approx(0.9, abs=0.01)
    assert language.calibrate(np.zeros((0, 3)), labels[:0], 0.9) == (1.0, 0.0)


def test_query(spark, sf):
    rows = {r.doc_id: r for r in queries.op11_language(spark, sf).collect()}
    docs = common.table(spark, sf, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert rows[d.doc_id].held_out == (common.remainder(d.doc_id, 3) == 1) and 0 <= rows[d.doc_id].score <= 1
    held = [d for d in docs if rows[d.doc_id].held_out]
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in held]) > 0.95
    assert np.mean([rows[d.doc_id].rejected for d in docs]) < 0.2


def test_awkward(spark, awkward, nothing):
    docs = awkward
    for clash in ("mark", "turn", "size", "before", "lang_pred", "score", "held_out"):
        docs = docs.withColumn(clash, language.F.lit(1))
    rows = language.languages(docs).collect()
    assert len(rows) == docs.count()
    assert [r.lang_pred for r in rows if r.doc_id in (1, 2, 5)] == ["und"] * 3
    assert {r.lang_pred for r in rows if r.doc_id in (3, 7, 9)} == {"en"}
    assert language.languages(nothing).collect() == []
    unlearned = language.languages(docs.withColumn("lang", language.F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlearned} == {("und", 0.0)}

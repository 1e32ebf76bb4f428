"""Set join, line dedup, fingerprints, quality, personal data and scoring against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from headwater.llm import common, graph, lines, private, quality, queries, sampling, scoring, setjoin

from .conftest import AWKWARD

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components_of(nodes, links):
    name = {n: n for n in nodes}

    def root(n):
        while name[n] != n:
            n = name[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        name[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 130)] + [(1, i) for i in range(2, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    linked = {n for link in links for n in link if link[0] != link[1]}
    assert got == components_of(linked, links)
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def plain_sets(rows, n=4):
    out = {}
    for k, (_, text, _) in enumerate(rows):
        words = re.findall(WORD, (text or "").translate(LOWER))
        out[k] = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}
    return out


def edited_rows(seed, docs, words):
    """Families of near copies with shared passages, so that shingles of every frequency occur."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for family in range(docs // 12):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, words]))]
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(60)}"
            rows.append((len(rows), " ".join(copy + (passage if rng.random() < 0.5 else [])), "a"))
    return rows


def test_set_join(spark, documents, awkward, nothing):
    for rows, options in ((edited_rows(1, 240, 60), {"frequent": 3, "singles_from": 40}), (edited_rows(2, 120, 30), {"frequent": 1}), (AWKWARD, {})):
        sets = plain_sets(rows)
        links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
        root = components_of(sets, links)
        want = Counter()
        for k, (i, _, _) in enumerate(rows):
            ids = [rows[j][0] for j in sets if root[j] == root[k] and rows[j][0] is not None]
            want[i, len(sets[k]), (min(ids) if ids else None) if sets[k] else i] += 1
        assert Counter(map(tuple, setjoin.classes(documents(rows), **options).collect())) == want
    assert setjoin.classes(nothing).collect() == []
    kept = setjoin.one_of_each(documents(edited_rows(2, 120, 30)))
    assert kept.columns == awkward.columns and 0 < kept.count() < 120


def test_one_row_of_each_group_stays(documents):
    text, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(None, text, "a")] * 3 + [(4, text, "a"), (4, text, "a"), (7, text, "a"), (7, "a clean text of its own", "a")] + [(None, other, "a")] * 5 + [(8, None, "a"), (8, "", "a")]
    got = Counter((r.doc_id, r.text) for r in setjoin.one_of_each(documents(rows), n=5, percent=80).collect())
    assert got == Counter([(4, text), (7, rows[6][1]), (8, ""), (8, None), (None, other)])


def test_set_join_of_copies_with_many_edits(documents):
    """Copies of one text with edits in other places: linked with the text, with one another, or with none."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(160):
        words = list(base) if i % 4 else [f"u{i}_{k}" for k in range(10)] + base[:60]
        for _ in range(i % 6):
            words[rng.randrange(len(words))] = f"e{rng.randrange(6)}"
        rows.append((i, " ".join(words[:rng.choice((90, 88, 80))]), "a"))
    shingles = {i: {tuple(t.split()[j:j + 4]) for j in range(len(t.split()) - 3)} for i, t, _ in rows}
    near = [(a, b) for a in shingles for b in shingles if a < b and 100 * len(shingles[a] & shingles[b]) >= 85 * len(shingles[a] | shingles[b])]
    want = {i: (len(shingles[i]), c) for i, c in components_of(shingles, near).items()}
    assert 3 < len({c for _, c in want.values()}) < 140
    for frequent in (1, 4, 64):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.classes(documents(rows), frequent=frequent).collect()}
        assert got == want


def plain_norm(line):
    plain = re.sub(r"[^\w]+|_+", " ", line.lower()).strip()
    return plain or line.strip()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_lines(spark, documents, awkward, nothing):
    long = " ".join(f"term{i}" for i in range(300))
    rows = [(1, "One two three four five.\nshort line\nOne, two THREE four five", "a"), (2, "ONE two three four five\nother words are in here now", "a"),
            (3, f"{long} tail\nx", "a"), (4, f"y\n{long} tails", "a"), (5, None, "a"), (6, "", "a"), (7, "!!! ??? ... --- !!!\n!!! ??? ... --- !!!", "a"),
            (None, "one two three four five", "a")]
    got = {r.doc_id: r for r in lines.without_repeats(documents(rows)).collect()}
    assert got[None].text == "one two three four five" and got[None].n_dropped == 0
    assert got[1].text == "short line" and got[1].n_dropped == 2 and got[1].n_lines == 3 and got[1].n_chars == 10
    assert got[2].text == "other words are in here now"
    assert got[5].text is None and got[5].n_lines == 0 and got[6].text == "" and got[7].n_dropped == 1
    assert len({got[3].n_dropped + got[4].n_dropped}) == 1
    assert lines.without_repeats(nothing).collect() == []
    assert lines.without_repeats(awkward).count() == len(AWKWARD)


def test_short_and_unspaced_lines(spark, documents):
    rows = [(1, "Share this article\n\n\t\n一行没有空格的文字但是很长\nfirst", "a"), (2, "SHARE this article!\n\n\t\nsecond\n一行没有空格的文字但是很长", "a"), (3, "x\r\n\r\nX\n\u2003", "a")]
    got = {r.doc_id: r.text for r in lines.without_repeats(documents(rows)).collect()}
    assert got == {1: rows[0][1], 2: "\n\t\nsecond", 3: "x\r\n\r\n\u2003"}


def test_lines_of_repeated_rows_stay_once(documents):
    rows = [(None, "a line of its own\nand one more", "a")] * 3 + [(2, "second text of two rows", "a")] * 2
    got = Counter((r.doc_id, r.text, r.n_dropped) for r in lines.without_repeats(documents(rows), anchors=lines.ANCHORS).collect())
    assert got == Counter({(*rows[0][:2], 0): 1, (None, "", 2): 2, (2, rows[3][1], 0): 1, (2, "", 1): 1})


def test_lines_links_against_all_pairs(spark, documents):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.choice([6, 40, 200]))] for _ in range(25)]
    rows = []
    for text in base:
        for _ in range(6):
            copy = list(text)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = f"y{rng.randrange(9)}"
            rows.append((len(rows), " ".join(copy), "a"))
    docs = documents(rows)
    keys = {r.doc_id: r for r in lines.line_keys(docs).collect()}
    norm = {i: plain_norm(t) for i, t, _ in rows}
    links = [(a, b) for a in norm for b in norm if a < b and bin((keys[a].sim ^ keys[b].sim) & (1 << 64) - 1).count("1") <= 2
             and distance(norm[a], norm[b]) <= 0.2 * max(len(norm[a]), len(norm[b]))]
    root = components_of(norm, links)
    got = {r.doc_id for r in lines.without_repeats(docs).filter("n_dropped = 0").collect()}
    assert got == {i for i in norm if root[i] == i} and len(got) < len({*norm.values()})


def test_fingerprints(spark, documents, awkward, nothing):
    rows = [(5, "a b c d e f", "x"), (9, "a b c d e f", "x"), (12, None, "x"), (20, "long words " * 50, "x"), (21, "", "x")]
    got = {r.doc_id: r for r in sampling.fingerprints(documents(rows)).collect()}
    text = [(i, t or "") for i, t, _ in rows]
    for k, (i, t) in enumerate(text):
        half, following = len(t) // 2, text[(k + 1) % len(text)][1]
        edited = t[:len(t) - half] + following[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
    assert got[5].fingerprint == got[9].fingerprint and got[5].near_next == 1.0 and got[12].near_edited == 1.0 and got[12].near_next == 0.0
    assert sampling.fingerprints(nothing).collect() == [] and sampling.fingerprints(awkward).count() == len(AWKWARD)


def test_collision_rate_is_weighted_jaccard(spark, documents):
    a, b = "x " * 6 + "y " * 3 + "z q r s", "x " * 3 + "y " * 6 + "z q t u"
    docs = documents([(1, a, "s"), (2, b, "s")])
    rows = {r.id0: r.signature for r in sampling.signatures(sampling._texts(docs), ["id0"], 400).collect()}
    ca, cb = Counter(a.split()), Counter(b.split())
    true = sum((ca & cb).values()) / sum((ca | cb).values())
    rate = np.mean([x == y for x, y in zip(rows[1], rows[2])])
    assert abs(rate - true) < 4 * math.sqrt(true * (1 - true) / 400)


def test_fingerprints_as_registered_come_close_to_exact_likeness(documents):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{min(rng.randrange(1, 120), rng.randrange(1, 120))}" for _ in range(rng.choice((60, 150)))) + (" same tail" * i), "a") for i in range(120)]
    rows = [(i, rows[i - 1][1][:len(rows[i - 1][1]) * 7 // 8] + " x y" if i % 3 == 1 else t, s) for i, t, s in rows]
    got = {r.doc_id: r for r in sampling.fingerprints(documents(rows)).collect()}

    def exact(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        return sum((a & b).values()) / sum((a | b).values())

    off = []
    for k, (i, t, _) in enumerate(rows):
        following, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        for found, true in ((got[i].near_edited, exact(t, t[:len(t) - half] + following[:half])), (got[i].near_next, exact(t, following))):
            off.append((found - true) / math.sqrt(max(true * (1 - true), 0.01)))
    assert np.std(off) < 0.16 and abs(np.mean(off)) < 0.03


def test_quality(spark, sf, awkward, nothing):
    d = sf.replace("sf0.001", "sf0.01")
    rows = queries.op6_quality(spark, d).collect()
    label = {r.doc_id: r.quality for r in common.table(spark, d, "labels").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert len(rows) == 1000 and np.mean([a == b for a, b in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    labels = common.table(spark, d, "labels")
    assert quality.scores(awkward, labels).count() == len(AWKWARD) and quality.scores(nothing, labels).collect() == []
    assert {r.score for r in quality.scores(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.accepted(awkward, labels).columns == awkward.columns


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    model = (0.3, rng.normal(0, 1, quality.WIDTH), rng.normal(0, 1, (quality.WIDTH, quality.RANK)))
    places, values = quality.features("some words, some WORDS | and 12 more!!")
    pairs = sum(model[2][i] @ model[2][j] * x * y for k, (i, x) in enumerate(zip(places, values)) for j, y in list(zip(places, values))[k + 1:])
    assert abs(quality.raw_scores(model, [(places, values)])[0] - (0.3 + model[1][places] @ values + pairs)) < 1e-9


def plain_spans(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", "b.c", ".", "_", "%", "é", " ", "-", "+", "1", "22", "255", "256", "4111111111111111", "(", ")", "\n", "0", "٣"]), max_size=30))
def test_base_spans(parts):
    text = "".join(parts)
    assert sorted(private.base_spans(text)) == plain_spans(text)


def test_long_texts_are_linear():
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "a.b@" * 50_000):
        private.base_spans(text)
        if "@" not in text:
            private.regions(text)


def test_private(spark, sf, awkward, nothing):
    texts = {r.doc_id: r.text or "" for r in common.table(spark, sf, "documents").collect()}
    for r in queries.op2_private(spark, sf).collect():
        base = plain_spans(texts[r.doc_id])
        listed = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert {(private.KINDS[k], str(a), str(b)) for k, a, b in base} <= set(listed)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in base) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{private.KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert private.spans(awkward).count() == len(AWKWARD) and private.spans(nothing).collect() == []


def test_every_kind_keeps_training_regions(documents):
    kinds = ["zoe{}@mail.example.org", "10.0.{}.9", "4111111111111111", "+1 (269) 555-32{}"]
    texts = [f"{n} pieces, " + " and ".join(f"{n}{k} of" for k in range(90)) + " or " + " or ".join(k.format(10 + n % 80) for k in kinds) for n in range(60)]
    found = private.training_regions(documents([(i, t, "a") for i, t in enumerate(texts)]), sample=48)
    assert len(found) == 48 and set("0123") <= {k for t in found for k in private._kinds(t)}


def test_field_finds_the_best_segmentation():
    rng = np.random.default_rng(1)
    weights = rng.normal(0, 1, (4, private.FEATURES))
    text = "call +1 (269) 555-3296 4524132264652876 10.0.0.1"
    words = private.regions(text)[0]
    segments = private.lattice(text, words)

    def best(j):
        if j == 0:
            return 0.0
        return max(best(j - 1), *(best(i) + (weights @ segments[i, j - 1]).max() for i in range(max(0, j - private.LONGEST), j)))

    found = private.decode(weights, segments, len(words))
    assert abs(sum(weights[k] @ segments[i, j] for k, i, j in found) - best(len(words))) < 1e-9


def test_scoring(spark, sf, awkward, nothing):
    for docs, source in ((awkward, [(i, t) for i, t, _ in AWKWARD]), (common.table(spark, sf, "documents"), None)):
        source = source or [(r.doc_id, r.text) for r in docs.collect()]
        tokens = [re.findall(WORD, (t or "").translate(LOWER)) + [""] for _, t in source]
        held = [common.remainder(i, 7) == 2 for i, _ in source]
        counts = Counter(w for t, h in zip(tokens, held) if not h for w in t)
        n, v = sum(counts.values()), len(counts)
        want = Counter((i, h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 3))
                       for (i, _), t, h in zip(source, tokens, held))
        rows = scoring.scores(docs, queries.word_vocabulary(), hot=50).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in rows) == want
        assert all(r.score < 0 for r in rows)
    assert scoring.scores(nothing, queries.word_vocabulary()).collect() == []


def test_windows_score_each_place_once_and_look_back_only():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 8, 9, 0, 30])
    places = rng.integers(1, scoring.PLACES, lengths.sum())
    inputs, target, there = scoring.windows(places, lengths)
    assert sorted(target[target >= 0].tolist()) == list(range(lengths.sum()))
    model = scoring.start_model()
    before = scoring.attend(model, inputs, there)[0].copy()
    changed = inputs.copy()
    changed[:, -1] = 7
    after = scoring.attend(model, changed, there)[0]
    assert np.allclose(before[:, :-1], after[:, :-1])


def test_gradient():
    rng = np.random.default_rng(3)
    model = {k: x.astype(np.float64) for k, x in scoring.start_model().items()}
    inputs, target, there = scoring.windows(rng.integers(1, 50, 20), np.array([20]))
    classes = np.where(target >= 0, rng.integers(0, scoring.CLASSES, target.shape), -1)

    def loss(m):
        logs = scoring.log_classes(m, scoring.attend(m, inputs, there)[0])
        known = classes.ravel() >= 0
        return -logs[known, classes.ravel()[known]].mean()

    past = {k: np.zeros_like(x) for k, x in model.items()}
    stepped = {k: x.copy() for k, x in model.items()}
    scoring.train_step(stepped, past, inputs, there, classes, rate=0.0)
    for name, at in (("q", (inputs[0, 8], 2)), ("k", (inputs[1, 5], 1)), ("v", (inputs[0, 9], 3)), ("own", (inputs[0, 9], 0)), ("out", (1, 4)), ("distance", (2,))):
        up, down = ({k: x.copy() for k, x in model.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        assert abs(abs(slope) - math.sqrt(past[name][at])) < 1e-4


def test_anchors_find_near_lines_of_all_lengths(spark, documents):
    """Against edit similarity alone, on lines of 6 to 40 words with one to many words replaced."""
    rng = random.Random(11)
    words = [f"{rng.choice('bcdfgh')}{rng.randrange(10 ** rng.choice([1, 2, 4]))}{'a' * rng.randrange(6)}" for _ in range(700)]
    rows = []
    for n in (6, 8, 12, 20, 30, 40) * 12:
        line = [words[int(700 * rng.random() ** 2)] for _ in range(n)]
        rows.append((len(rows), " ".join(line), "a"))
        for share in (0, 0.1, 0.15):
            copy = list(line)
            for at in rng.sample(range(n), max(1, int(share * n))):
                copy[at] = rng.choice(words)
            rows.append((len(rows), " ".join(copy), "a"))
    norm = {i: t for i, t, _ in rows}
    near = [(a, b) for a in norm for b in norm if a < b and 5 * abs(len(norm[a]) - len(norm[b])) <= max(len(norm[a]), len(norm[b]))
            and (a // 4 == b // 4 or len({*norm[a].split()} & {*norm[b].split()}) > 2) and 5 * distance(norm[a], norm[b]) <= max(len(norm[a]), len(norm[b]))]
    keys = {}
    for r in lines.anchored_lines(documents(rows), lines.ANCHORS).select("doc_id", lines._anchor_keys(F.col("rare"), lines.ANCHORS).alias("key")).collect():
        keys.setdefault(r.doc_id, set()).add(r.key)
    met = sum(norm[a] == norm[b] or bool(keys[a] & keys[b]) for a, b in near)
    assert len(near) > 100 and met >= 0.95 * len(near), (met, len(near))
    got = {r.doc_id for r in lines.without_repeats(documents(rows), anchors=lines.ANCHORS).filter("n_dropped = 0").collect()}
    first = components_of(norm, near)
    wanted = {i for i in norm if first[i] == i}
    assert wanted <= got and len(got) <= len(wanted) + 0.05 * len(norm)


def test_scorer_learns_words_in_order_from_far_context_and_sums_to_one():
    rng = np.random.default_rng(4)
    assert scoring.CONTEXT >= 64
    tables = scoring.class_table(np.full(600, 50.0))
    cls = tables["cls"]
    model = scoring.first_model(tables)
    past = {k: np.full_like(x, 1e-2) for k, x in model.items()}
    for _ in range(150):  # 40 follows 10 and 41 follows 11: alike in count and class
        first = rng.integers(0, 2, 200)
        flat = np.stack([10 + first, 40 + first], axis=1).ravel()
        inputs, target, there = scoring.windows(tables["place"][flat], np.full(200, 2))
        scoring.train_step(model, past, inputs, there, np.where(target >= 0, cls[flat[target]], -1), words=flat[target], tables=tables)
    right, swapped = scoring.log10_of([np.array([10, 40]), np.array([10, 41])], model, tables)
    assert right > swapped + 0.5
    every = scoring.log10_of([np.array([w]) for w in range(600)], model, tables)
    assert abs((10 ** every).sum() - 1) < 1e-3
    text = rng.integers(0, 600, 100)
    far = text.copy()
    far[20] = 599 - far[20]
    inputs, _, there = scoring.windows(tables["place"][np.concatenate([text, far])], np.array([100, 100]))
    a, b = np.split(scoring.attend(model, inputs, there)[0].reshape(-1, scoring.WIDTH), 2)
    assert not np.allclose(a[84], b[84], atol=1e-7) and np.allclose(a[20], b[20])


def test_bands_decide_as_the_whole_distance(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(120):
        a = "".join(rng.choice("abcé ") for _ in range(rng.choice([0, 1, 30, 300])))
        b = list(a)
        for _ in range(rng.choice([0, 1, 9, 40, 150])):
            b.insert(rng.randrange(len(b) + 1), rng.choice("xyz"))
        rows.append((a, "".join(b), rng.choice([0, 1, 8, 20, 33, 140, 200])))
    pairs = spark.createDataFrame(rows, "norm_a string, norm_b string, most int")
    got = pairs.select("norm_a", "norm_b", "most", lines._within(F.col("most")).alias("near")).collect()
    assert {r.near for r in got} == {True, False}
    assert all(r.near == (distance(r.norm_a, r.norm_b) <= r.most) for r in got)


def test_columns_of_any_name_come_back(spark):
    names = ("_row", "_kept", "_lines", "_gone", "row_no", "whole", "kept", "mark", "a.b")
    schema = "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names)
    body = "this passage of many plain words stands in two documents of the table"
    mine = tuple(range(100, 100 + len(names)))
    docs = spark.createDataFrame([(1, f"{body}\nfirst", *mine), (2, body, *mine), (None, None, *mine)], schema)
    got = {r[0]: r for r in lines.without_repeats(docs, anchors=lines.ANCHORS).collect()}
    assert {i: (r[1], r[2:-2]) for i, r in got.items()} == {1: (f"{body}\nfirst", mine), 2: ("", mine), None: (None, mine)}
    kept = sorted(setjoin.one_of_each(docs, n=5, percent=80).collect(), key=lambda r: (r[0] is None, r[0]))
    assert [tuple(r) for r in kept] == [(1, f"{body}\nfirst", *mine), (None, None, *mine)]


def near_lines():
    """Lines of 6 to 40 words, each with three copies of which none, a tenth or a fifth of the words are replaced."""
    rng = random.Random(23)
    words = [f"{rng.choice('bcdfgh')}{rng.randrange(10 ** rng.choice([1, 2, 4]))}{'a' * rng.randrange(6)}" for _ in range(700)]
    rows = []
    for n in (6, 8, 12, 20, 30, 40) * 15:
        line = [words[int(700 * rng.random() ** 2)] for _ in range(n)]
        for share in (None, 0, 0.1, 0.2):
            copy = list(line)
            for at in rng.sample(range(n), 0 if share is None else max(1, int(share * n))):
                copy[at] = rng.choice(words)
            rows.append((len(rows), " ".join(copy), "a"))
    return rows


def test_weighted_simhash_finds_near_lines(documents):
    """Against edit similarity alone; rows come through the blocks: lines that share no set of them stay."""
    rows = near_lines()
    norm = {i: t for i, t, _ in rows}
    near = [(a, b) for a in norm for b in norm if a < b and (a // 4 == b // 4 or len({*norm[a].split()} & {*norm[b].split()}) > 2)
            and 5 * abs(len(norm[a]) - len(norm[b])) <= max(len(norm[a]), len(norm[b])) and 5 * distance(norm[a], norm[b]) <= max(len(norm[a]), len(norm[b]))]
    blocks = {r.norm: r.blocks for r in lines.blocked_lines(documents(rows)).collect()}
    assert all(len(b) == lines.WEIGHTED and all(0 <= x < 1 << lines.BLOCK_BITS for x in b) for b in blocks.values())
    share = lambda a, b: any(all(blocks[norm[a]][i] == blocks[norm[b]][i] for i in at) for at in lines.TABLES)
    met = [(a, b) for a, b in near if share(a, b)]
    assert len(near) > 150 and len(met) >= 0.9 * len(near), (len(met), len(near))
    root = components_of(norm, met)
    got = {r.doc_id for r in lines.without_repeats(documents(rows), weighted=True).filter("n_dropped = 0").collect()}
    assert got == {i for i in norm if root[i] == i}


def test_line_queries_go_through_simhash(spark, monkeypatch):
    import corpus_pipeline
    from headwater.llm import queries

    used = []
    monkeypatch.setattr(lines, "repeated_lines", lambda docs, similarity, anchors, weighted: used.append((anchors, weighted)) or docs.select(
        "doc_id", F.xxhash64("text").alias("mark"), F.array(F.lit(0)).alias("kept")))
    queries.op4_lines(spark, "/root/testdata/sf0.001")
    corpus_pipeline.fresh_lines(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "")
    assert used == [(0, True)] * 2


def test_words_in_place_bound_the_distance(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        a = [rng.choice(("a", "bc", "def", "ghij")) for _ in range(rng.choice((1, 5, 12)))]
        b = list(a)
        for _ in range(rng.choice((0, 1, 2))):
            at = rng.randrange(len(b))
            b[at:at + rng.randrange(2)] = [rng.choice(("k", "lm", "def"))] * rng.randrange(1, 3)
        rows.append((" ".join(a), " ".join(b), rng.choice((0, 2, 4, 8))))
    got = spark.createDataFrame(rows, "norm_a string, norm_b string, most int").select(
        "*", lines._aligned(F.col("most")).alias("near"), *[lines._within(F.col("most"), F.lit(alike)).alias(f"within_{alike}") for alike in (True, False)]).collect()
    assert sum(r.near for r in got) > 50 and all(distance(r.norm_a, r.norm_b) <= r.most for r in got if r.near)
    assert all(r.within_True == r.within_False == (distance(r.norm_a, r.norm_b) <= r.most) for r in got)


def test_plans_of_components_stay_small(spark, monkeypatch):
    written, materialise = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: written.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange")) or materialise(df, name))
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    assert {r.component for r in graph.components(chain).collect()} == {0}
    assert len(written) > 3 and max(written) <= 8


def test_copies_meet_by_their_rarest_differences(documents, monkeypatch):
    """Copies with one word of their own each share shingles they have lost, yet are not compared pair by pair."""
    base = [f"b{i}" for i in range(40)]
    rows = [(0, " ".join(base), "a")] + [(i, " ".join(base[:5 + i % 8] + [f"x{i // 3}"] + base[6 + i % 8:]), "a") for i in range(1, 241)]
    sets = plain_sets(rows)
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = components_of(sets, links)
    met, materialise = {}, setjoin.materialise

    def counted(df, name):
        met[name] = materialise(df, name)
        return met[name]

    monkeypatch.setattr(setjoin, "materialise", counted)
    got = {r.doc_id: r.component_id for r in setjoin.classes(documents(rows)).collect()}
    assert got == root
    assert met["set-met"].count() < 2 * len(rows)


def test_frequency_maps_reach_the_driver_packed(documents):
    """Of few texts only a few bytes pass through the driver, not the whole maps; tasks put the same maps together."""
    rows = [(i, f"a{i % 3} b c d e{i % 7} f g h", "a") for i in range(30)]
    parts = setjoin.frequency_maps(documents(rows), 4, 9)
    assert parts and sum(len(x) for _, *own in parts for x in own) < 1_000_000
    times = Counter(int(h) for _, text, _ in rows for h in setjoin.shingle_set(text))
    maps = setjoin.joined_maps(parts)
    for held, bits, most in zip(maps, (setjoin.REPEATED_BITS, setjoin.FREQUENT_BITS), (1, 9)):
        want = {h >> 64 - bits for h, n in times.items() if n > most}
        assert want and set(np.flatnonzero(np.unpackbits(held, bitorder="little")).tolist()) == want


def test_lines_that_share_a_few_words_seldom_meet(spark):
    """Pairs to compare grow with the square of a group, so lines of 23 words of which three are shared are to be kept apart."""
    rows = [(20 * group + i, " ".join([f"common{group}x{k}" for k in range(3)] + [f"own{group}x{i}x{k}" for k in range(20)])) for group in range(60) for i in range(20)]
    blocks = lines.weighted_blocks(spark.createDataFrame(rows, "node bigint, norm string"), spark.createDataFrame([], "light bigint"))
    blocks = {r.node: r.blocks for r in blocks.collect()}
    met = [(a, b) for a in blocks for b in blocks if a < b and any(all(blocks[a][i] == blocks[b][i] for i in at) for at in lines.TABLES)]
    assert len(blocks) == 1200 and len(met) <= 30, len(met)

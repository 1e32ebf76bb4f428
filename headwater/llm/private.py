"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The field reads regions: runs of words that hold a digit or an at sign. A segment of up to five
words may be an entity; features look at the whole candidate span. All segmentations of a region
compete, so boundaries and types are chosen together, for instance where a phone and a card
number follow each other and the patterns see one long number.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_of, text_of

KINDS = ["email", "ip", "card", "phone"]
LONGEST = 5  # words of a segment

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHORED = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_OPENING, _CLOSING = "([{<\"'", ".,;:!?)]}>\"'"


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _byte_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the patterns: leftmost, not overlapping per kind, each scan linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        local = text[last:at]
        start = last + len(local.rstrip(_LOCAL))
        last = at + 1
        if domain and start < at:
            out.append((0, start, domain.end()))
            last = domain.end()
        at = text.find("@", last)
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _byte_parts(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Words (start, end) with a digit or at sign, runs of neighbours together."""
    out, last = [], -1
    for m in _ANCHORED.finditer(text):
        if last >= 0 and text[last:m.start()].isspace() and "\n" not in text[last:m.start()]:
            out[-1].append(m.span())
        else:
            out.append([m.span()])
        last = m.end()
    return out


def _span(text: str, words: list, i: int, j: int) -> tuple[int, int]:
    """Span of words i to j without brackets and marks around it."""
    start, end = words[i][0], words[j][1]
    part = text[start:end]
    inner = part.rstrip(_CLOSING)
    if inner.count("(") > inner.count(")"):
        inner = part[:len(inner) + 1] if part[len(inner):len(inner) + 1] == ")" else inner
    bare = inner.lstrip(_OPENING) if inner.count("(") <= inner.count(")") and not (inner[:1] == "(" and ")" in inner) else inner
    return end - len(part) + len(inner) - len(bare), start + len(inner)


def segment_features(text: str, words: list, i: int, j: int) -> np.ndarray:
    """Features of a whole candidate segment."""
    start, end = _span(text, words, i, j)
    part = text[start:end][:400]
    d = _digits(part)
    n, letters = len(d), sum(c.isalpha() for c in part)
    at, dots, other = part.count("@"), part.count("."), sum(not (c.isalnum() or c in "@.+-() _%") for c in part)
    groups = re.findall("[0-9]+", part)
    tail = part.rpartition(".")[2]
    number = not letters and not at and not other
    return np.array([
        1, j > i, j - i, at == 1, at > 1, at == 1 and "." in part.partition("@")[2] and tail.isalpha() and len(tail) >= 2, at == 1 and part[0] != "@",
        letters == 0, min(letters, 12) / 12, other > 0, number and dots == 3 and len(groups) == 4,
        number and dots == 3 and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups), dots == 1, part[:1] == "+",
        part.find("+", 1) > 0, number and n < 7, number and 7 <= n <= 8, number and 9 <= n <= 12, number and 13 <= n <= 19, n > 19,
        number and 13 <= n <= 19 and luhn(d), "(" in part and ")" in part, number and n >= 9 and "-" in part, not n,
        number and len(groups) >= 3 and all(2 <= len(g) <= 4 for g in groups[-2:]), number and all(len(g) == 4 for g in groups) and n == 16,
        number and n >= 9 and dots == 0, number and j == i and n >= 9 and part[:1] != "+",
    ], dtype=np.float64)


FEATURES = 28


def lattice(text: str, words: list) -> dict[tuple[int, int], np.ndarray]:
    """Features of all segments of at most LONGEST words."""
    return {(i, j): segment_features(text, words, i, j) for i in range(len(words)) for j in range(i, min(len(words), i + LONGEST))}


def decode(weights: np.ndarray, segments: dict, n: int) -> list[tuple[int, int, int]]:
    """Best segmentation (kind, first word, last word): entities of up to LONGEST words, other words alone."""
    best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
    for j in range(n):
        best[j + 1], back[j + 1] = best[j], (j, None)
        for i in range(max(0, j - LONGEST + 1), j + 1):
            score = weights @ segments[i, j]
            kind = int(score.argmax())
            if best[i] + score[kind] > best[j + 1]:
                best[j + 1], back[j + 1] = best[i] + score[kind], (i, kind)
    out, j = [], n
    while j:
        i, kind = back[j]
        if kind is not None:
            out.append((kind, i, j - 1))
        j = i
    return out[::-1]


def fit(examples: list, epochs: int = 12, rate: float = 0.4, penalty: float = 0.002) -> np.ndarray:
    """Weights (kind, feature) by gradient ascent on the conditional likelihood of whole segmentations.

    Examples are (segments, number of words, true entities). Expected features come from the forward and
    backward sums over all segmentations.
    """
    weights, past = np.zeros((len(KINDS), FEATURES)), np.full((len(KINDS), FEATURES), 1e-2)
    for _ in range(epochs):
        for segments, n, true in examples:
            keys = list(segments)
            x = np.stack([segments[k] for k in keys])
            score = x @ weights.T
            top = score.max(axis=1)
            whole = dict(zip(keys, top + np.log(np.exp(score - top[:, None]).sum(axis=1))))
            ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            ahead[0] = behind[n] = 0.0
            for j in range(n):
                ahead[j + 1] = np.logaddexp.reduce([ahead[j], *(ahead[i] + whole[i, j] for i in range(max(0, j - LONGEST + 1), j + 1))])
            for i in range(n - 1, -1, -1):
                behind[i] = np.logaddexp.reduce([behind[i + 1], *(whole[i, j] + behind[j + 1] for j in range(i, min(n, i + LONGEST)))])
            chance = np.exp(np.array([ahead[i] + behind[j + 1] for i, j in keys])[:, None] + score - ahead[n])
            for kind, i, j in true:
                chance[keys.index((i, j)), kind] -= 1
            step = -(chance.T @ x) - penalty * weights
            past += step ** 2
            weights += rate * step / np.sqrt(past)
    return weights


def examples_of(text: str) -> list:
    """Regions with the base spans as truth, where these are whole segments; at most 40 words a region."""
    base = base_spans(text)
    out = []
    for words in regions(text):
        if len(words) > 40:
            continue
        low, high = words[0][0], words[-1][1]
        inside = [s for s in base if s[1] < high and s[2] > low]
        spans = {_span(text, words, i, j): (i, j) for i in range(len(words)) for j in range(i, min(len(words), i + LONGEST))}
        places = sorted((*spans[s[1], s[2]], s[0]) for s in inside if (s[1], s[2]) in spans)
        apart = all(a[1] < b[0] for a, b in zip(places, places[1:]))
        # A long run of digits that the patterns reject is no proof that nothing is there.
        unsure = any(len(_digits(text[a:b])) >= 9 for k, (a, b) in enumerate(words) if not any(i <= k <= j for i, j, _ in places))
        if len(places) == len(inside) and apart and not (unsure and len(words) > 1):
            out.append((lattice(text, words), len(words), [(kind, i, j) for i, j, kind in places]))
    return out


def _kinds(region: str) -> str:
    return "".join(sorted({str(k) for k, _, _ in base_spans(region)}))


def _bounded(found: list[str], most: int) -> list[str]:
    """At most `most` regions: of each set of kinds a sixteenth for certain, the rest whatever their kinds; by hash, not by text."""
    order = sorted((sha256(t.encode("utf-8", "surrogatepass")).digest(), t) for t in set(found))
    if len(order) <= most:
        return [t for _, t in order]
    seen, first, rest = Counter(), [], []
    for _, t in order:
        kinds = _kinds(t)
        seen[kinds] += 1
        (first if seen[kinds] <= max(1, most // 16) else rest).append(t)
    return (first + rest)[:most]


def training_regions(docs: DataFrame, sample: int = 3000, per_text: int = 50, chars: int = 2000) -> list[str]:
    """Texts of at most `sample` regions, from the `sample` documents of smallest hash that have digits or at signs.

    A document gives at most `per_text` regions, a region its first `chars` characters. Every kind keeps regions where a bound cuts.
    """
    rows = docs.select(text_of(docs).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    chosen = rows.select(F.xxhash64("text").alias("mark")).distinct().orderBy("mark").limit(sample)

    def gather(batches):
        for batch in batches:
            kept = []
            for text in batch["text"]:
                kept += _bounded([text[words[0][0]:words[-1][1]][:chars] for words in regions(text)], per_text)
            yield pd.DataFrame({"text": kept}, dtype="object")

    found = rows.join(F.broadcast(chosen), F.xxhash64("text") == F.col("mark")).select("text").mapInPandas(gather, "text string").distinct()
    return _bounded(found.toPandas()["text"].tolist(), sample)


def train(docs: DataFrame, sample: int = 3000, per_text: int = 50, chars: int = 2000) -> np.ndarray:
    """Weights learnt from `training_regions`, in the order of their hashes; regions above 40 words give no example."""
    order = sorted(training_regions(docs, sample, per_text, chars), key=lambda t: sha256(t.encode("utf-8", "surrogatepass")).digest())
    return fit([e for t in order for e in examples_of(t)])


def find(text: str, weights: np.ndarray) -> tuple[list, list]:
    """Base spans, and base spans with those added by the field where they overlap none."""
    base = base_spans(text)
    added = []
    for words in regions(text):
        low, high = words[0][0], words[-1][1]
        near = [(a, b) for _, a, b in base if a < high and b > low]
        if len(words) == 1 and near:
            continue
        for kind, i, j in decode(weights, lattice(text, words), len(words)):
            a, b = _span(text, words, i, j)
            if a < b and not any(a < y and b > x for x, y in near):
                added.append((kind, a, b))
    return base, sorted(base + added)


def spans(docs: DataFrame, sample: int = 3000) -> DataFrame:
    """Personal data of every whole text: counts and a digest of the base spans, and all spans.

    Spans are kind:start:end in code points. Missing text is empty and has none; repeated rows and missing ids give a row
    each; only doc_id and text are read; no rows yield no rows. The field is trained on a bounded sample whose base spans serve
    as labels.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    def written(found: list) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(found))

    def search(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(ids_of(batch["doc_id"]), batch["text"]):
                base, every = find(text, weights.value)
                kinds = [k for k, _, _ in base]
                rows.append((doc, *(kinds.count(k) for k in range(4)), sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text")).mapInPandas(
        search, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")

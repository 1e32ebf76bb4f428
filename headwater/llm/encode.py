"""Whole texts to token ids with the tokenizers library, word by word with a bounded cache.

The vocabulary lower-cases, drops white space and never merges across it, so a text's ids are the
ids of its blank-separated chunks in order. Chunks repeat, so each worker keeps what it has
encoded, up to a fixed number of chunks.
"""

from __future__ import annotations

import re
from array import array

#: Letters that are one code point in composed form and whose lower case is one code point too.
_MARKS = "!.,;:|%$#&*"
_PLAIN = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{_MARKS}]*)")
_ENCODERS: dict = {}


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Encoder:
    """`ids(text)`: the ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, chunks: int = 600_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.chunks = chunks
        self.known: dict[str, bytes] = {"": b""}

    def _piece(self, plain: str) -> bytes:
        """Ids of one run of plain letters or marks, which the model sees as a single word."""
        word = plain.lower()
        found = self.known.get(word)
        if found is None:
            if not word.isascii():
                word = "".join(map(self.letters.__getitem__, word.encode()))
            found = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        return found

    def chunk(self, chunk: str) -> bytes:
        letters = chunk.rstrip(_MARKS)
        if letters.isalpha() and (chunk.isascii() or _PLAIN.fullmatch(chunk)):
            found = self._piece(letters)
            if len(letters) < len(chunk):
                found += self._piece(chunk[len(letters):])
        else:
            found = array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(self.known) >= self.chunks:
            self.known = {"": b""}
        self.known[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        get, chunk = self.known.get, self.chunk
        if "\n" in text:
            text = text.replace("\n", " ")
        out = []
        for c in text.split(" "):
            found = get(c)
            if found is None:
                found = chunk(c)
                get = self.known.get
            out.append(found)
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

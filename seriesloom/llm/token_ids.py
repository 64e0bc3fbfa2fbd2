"""Token ids of many texts by a byte-level BPE tokenizer, with the ids of words remembered.

The tokenizer first cuts a text into pre-tokens, and none of them reaches over a single white space character between other
characters: a blank goes to the piece after it and a line feed is a piece of its own. So such texts are cut at blanks and line
feeds, each distinct word is encoded once, and the ids are put together as bytes. Texts with white space in a row or at
their ends, or with what may be a special token, are encoded whole. The result is the tokenizer's for every text.
"""

from __future__ import annotations

from array import array
from functools import cache

#: Byte-level tokenizers write a byte that prints as its Latin-1 character and number the others from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
BLANK = chr(LETTERS[32])
#: Words remembered per task before starting anew.
MEMORY = 800_000
#: Characters of texts that are looked up together.
BLOCK = 1 << 19


@cache
def encoder(path: str) -> TokenIds:
    """One per worker process, so that tasks after each other share what was learned."""
    return TokenIds(path)


class TokenIds:
    """Ids as unsigned 32-bit integers in bytes, of the machine's order (little-endian on all that Spark supports well)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.inner: dict[str, bytes] = {}  # word after a blank
        self.first: dict[str, bytes] = {}  # word at the start of a line
        self.model = self.tokenizer.model
        self.feed = self._whole(["\n"])[0]
        self.stops = {c: self._whole([c])[0] for c in ",."}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, known: dict[str, bytes], words: set[str], blank: str) -> None:
        if len(known) > MEMORY:
            known.clear()
        new = {w for w in words if w not in known}
        # a stop after a letter is a pre-token of its own, and letters alone are one
        ended = {w for w in new if w[-1] in ",." and w[-2:-1].isalpha()}
        for w in (new - ended) | {w[:-1] for w in ended if w[:-1] not in known}:
            known[w] = self._letters(blank + w) if w.isalpha() else self._whole([blank + w])[0]
        for w in ended:
            known[w] = known[w[:-1]] + self.stops[w[-1]]

    def _letters(self, piece: str) -> bytes:
        """One pre-token, given to the tokenizer's model in the letters that it has for bytes."""
        if piece.isascii():
            piece = piece.replace(" ", BLANK)
        else:
            piece = piece.encode().decode("latin-1").translate(LETTERS)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        block: list[tuple[int, list[list[str]]]] = []
        size = 0
        for i, text in enumerate(texts):
            if "<|" in text or " ".join(text.split()) != text.replace("\n", " "):
                out[i] = self._whole([text])[0]
            elif text:
                block.append((i, [line.split(" ") for line in text.split("\n")]))
                size += len(text)
            if size >= BLOCK:
                self._fill(block, out)
                block, size = [], 0
        self._fill(block, out)
        return out

    def _fill(self, block: list[tuple[int, list[list[str]]]], out: list[bytes]) -> None:
        first: set[str] = set()
        inner: set[str] = set()
        for _, lines in block:
            for words in lines:
                first.add(words[0])
                inner.update(words[1:])
        # both before any lookup: learning may forget what came before
        self._learn(self.first, first, "")
        self._learn(self.inner, inner, " ")
        get_first, get = self.first.__getitem__, self.inner.__getitem__
        for i, lines in block:
            out[i] = self.feed.join([get_first(w[0]) + b"".join(map(get, w[1:])) for w in lines])

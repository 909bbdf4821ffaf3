"""Tokens of white-space delimited chunks, for tokenizers that never let a token cross such a border.

A chunk is looked up in a table of the worker; one that is not there goes through the tokenizer and into
the table. The table is emptied when it is full, so a worker's memory is bounded and its answers are the
tokenizer's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from struct import pack

# Letters that case folding, composition and every version of the letter class leave no doubt about.
PLAIN_WORD = re.compile(r"[a-zß-öø-ÿ]+", re.ASCII)
MARKS = frozenset(".,")
# Characters that composition leaves alone and that lower-case one by one. Special tokens hold a "<".
CALM_TEXT = re.compile("[\0-;=-įı-ſ–—‘-”…]*")
# A comma or full stop between a letter and white space is a word of its own.
CLOSING_MARK = re.compile(r"(?<=[a-zß-öø-ÿ])([.,])(?=[ \n]|\Z)")
CACHE_ENTRIES = 400_000
# Longer chunks are not kept, so a worker's table is bounded in bytes as well.
LONGEST_ENTRY = 64


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> dict[int, str]:
    """How the tokenizer's byte alphabet writes each Latin-1 letter and the space."""
    from tokenizers.pre_tokenizers import ByteLevel

    step = ByteLevel(add_prefix_space=False, use_regex=False)
    points = [ord(" "), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0xC0, 0x100)]
    return {point: step.pre_tokenize_str(chr(point))[0][0] for point in points}


class ChunkIds(dict):
    """Chunk (UTF-8, no white space inside) to its ids as packed little-endian 32-bit numbers.

    For tokenizers that drop white space and lower-case. A chunk of plain letters is one word for
    them, so the model is asked directly; anything else takes the whole tokenizer.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.tokenizer, self.entries = load_tokenizer(path), entries
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.words: dict[str, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.entries:
            self.clear()
        low = chunk.decode("utf-8", "replace").lower()
        if PLAIN_WORD.fullmatch(low):
            packed = self._word(low)
        elif low[-1] in ".," and PLAIN_WORD.fullmatch(low, 0, len(low) - 1):
            packed = self._word(low[:-1]) + self._whole(low[-1])
        else:
            packed = self._whole(chunk.decode("utf-8", "replace"))
        if len(chunk) <= LONGEST_ENTRY:
            self[chunk] = packed
        return packed

    def _word(self, word: str) -> bytes:
        if (packed := self.words.get(word)) is None:
            if len(self.words) >= self.entries:
                self.words.clear()
            tokens = self.model.tokenize(word if word.isascii() else word.translate(self.letters))
            packed = pack("<%dI" % len(tokens), *[token.id for token in tokens])
            if len(word) <= LONGEST_ENTRY:
                self.words[word] = packed
        return packed

    def _whole(self, text: str) -> bytes:
        if (packed := self.words.get(text)) is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            packed = pack("<%dI" % len(ids), *ids)
            if text in MARKS:
                self.words[text] = packed
        return packed

    def of_text(self, text: str) -> bytes:
        if CALM_TEXT.fullmatch(text):
            # Lower-casing early and setting closing marks apart leave fewer different chunks.
            text = CLOSING_MARK.sub(r" \1", text.lower())
        # bytes.split knows the six ASCII white-space characters only; others stay inside a chunk.
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


class ChunkLengths(dict):
    """Chunk, with the space before it if it has one, to its number of tokens, in two tiers.

    The first tier is a given table of frequent chunks, which stays; the second is what this worker
    met besides, up to ``entries``.
    """

    PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+", re.ASCII)
    # A space between two characters that are no white space in any reading.
    BORDER = re.compile(r"(?<=\S) (?=\S)")
    DOUBLE_SPACE = re.compile(r"\s\s|\A\s|\s\Z|[^\S \n]")

    def __init__(self, path: str, frequent: dict[str, int], entries: int = CACHE_ENTRIES):
        super().__init__(frequent)
        self.tokenizer, self.frequent, self.entries = load_tokenizer(path), frequent, entries
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.entries + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        n = self._count(chunk)
        if len(chunk) <= LONGEST_ENTRY:
            self[chunk] = n
        return n

    def _count(self, chunk: str) -> int:
        if self.PLAIN.fullmatch(chunk):
            return len(self.model.tokenize(chunk.translate(self.letters)))
        if chunk[-1] in ".," and self.PLAIN.fullmatch(chunk[:-1]):
            return self[chunk[:-1]] + 1
        return len(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def of_text(self, text: str) -> int:
        if not text:
            return 0
        if self.DOUBLE_SPACE.search(text):
            return self.of_chunks(self._cut(text))
        lines = text.split("\n")  # single line breaks between visible characters are tokens of their own
        total = (len(lines) - 1) * self["\n"]
        for line in lines:
            first, *others = line.split(" ")
            total += self[first] + sum(map(self.__getitem__, [" " + chunk for chunk in others]))
        return total

    def of_chunks(self, chunks: Iterable[str]) -> int:
        return sum(map(self.__getitem__, chunks))

    def _cut(self, text: str) -> Iterable[str]:
        start = 0
        for border in self.BORDER.finditer(text):
            yield text[start : border.start()]
            start = border.start()
        yield text[start:]

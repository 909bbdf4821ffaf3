"""Byte-pair encoding by forced boundaries, and decoding.

A merge joins two neighbours into a token that holds both. Where two bytes stand side by side in a word and
no token of the vocabulary has that pair inside, no merge can ever cross: the place is a certain cut. White
space is in no token, so the first cuts fall there; inside a word they come from a table of byte pairs, with
a word's last byte as a symbol of its own. The fragments between the cuts are merged independently of each
other, each one once per worker while its table holds it, and their ids are concatenated.

The tokenizer's own normalizer and pre-tokenizer say what the words are; the merging is done here.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Entries of each of a worker's tables, and the longest string one holds: together they bound its memory.
TABLE_ENTRIES = 400_000
LONGEST_ENTRY = 64
# Fragments from this length on are merged with a heap, which long ones need and short ones do not repay.
HEAP_FROM = 24
# Output rows handed back at once: so many bytes of ids or text at most, a single text aside.
SLICE_BYTES = 8 << 20

ENCODED = "doc_id bigint, n_tokens bigint, ids binary"
DECODED = f"{ENCODED}, decoded string"

# Letters that composition leaves alone and that lower-case one by one, and the signs common beside them.
CALM_TEXT = re.compile("[\0-įı-ſ–—‘-”…]*")
PLAIN_WORD = re.compile("[a-zß-öø-ÿ]+")
# A comma or full stop between a letter and white space is a word of its own.
CLOSING_MARK = re.compile(r"(?<=[a-zß-öø-ÿ])([.,])(?=[ \n]|\Z)")


class ForcedBoundaryBpe:
    """Encoder of one tokenizer file: a byte-level vocabulary with a suffix at word ends."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer, self.entries = Tokenizer.from_file(path), entries
        spec = json.loads(self.tokenizer.to_str())
        model = spec["model"]
        if model["type"] != "BPE" or spec["post_processor"] or spec["decoder"] or model["continuing_subword_prefix"]:
            raise ValueError("a BPE vocabulary without post-processor, decoder and subword prefix is expected")
        self.end = model["end_of_word_suffix"] or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.inside = self._pairs_inside()
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        if any(token[flag] for token in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that strip, normalize or match whole words are not supported")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self.special else None
        # The byte alphabet's letters for Latin-1, as the pre-tokenizer writes them.
        self.letters = {
            point: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(point))[0][0]
            for point in (*range(ord("a"), ord("z") + 1), *range(0xDF, 0xF7), *range(0xF8, 0x100))
        }
        self.chunks: dict[str, bytes] = {}
        self.fragments: dict[str, bytes] = {}

    def _pairs_inside(self) -> set[tuple[str, str]]:
        """Neighbouring symbols of all tokens; a word's last byte carries the suffix."""
        pairs = set()
        for token in self.vocabulary:
            symbols = self._symbols(token[: -len(self.end)], True) if self.end and token.endswith(self.end) else list(token)
            pairs.update(zip(symbols, symbols[1:], strict=False))
        return pairs

    def _symbols(self, letters: str, ends_word: bool) -> list[str]:
        symbols = list(letters)
        if ends_word and symbols:
            symbols[-1] += self.end
        return symbols

    def fragments_of(self, word: str) -> list[list[str]]:
        """The symbols of a word (in the byte alphabet) cut at its forced boundaries."""
        symbols = self._symbols(word, True)
        cuts = [k for k, pair in enumerate(zip(symbols, symbols[1:], strict=False), 1) if pair not in self.inside]
        return [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True)] if cuts else [symbols]

    def _word(self, word: str) -> bytes:
        return b"".join(map(self._fragment, self.fragments_of(word)))

    def _fragment(self, symbols: list[str]) -> bytes:
        key = "".join(symbols)
        if (packed := self.fragments.get(key)) is None:
            merge = self._merged_long if len(symbols) >= HEAP_FROM else self._merged
            ids = [self.vocabulary[token] for token in merge(symbols)]
            packed = pack(f"<{len(ids)}I", *ids)
            self._keep(self.fragments, key, packed)
        return packed

    def _keep(self, table: dict[str, bytes], key: str, packed: bytes) -> None:
        if len(key) <= LONGEST_ENTRY:
            if len(table) >= self.entries:
                table.clear()
            table[key] = packed

    def _merged(self, symbols: list[str]) -> list[str]:
        """Merge the pair of lowest rank, the leftmost of equals, until no pair has a rank."""
        rank_of, none = self.ranks.get, len(self.ranks)
        ranks = [rank_of(pair, none) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            merged = symbols[k] + symbols[k + 1]
            symbols[k : k + 2] = [merged]
            del ranks[k]
            if k:
                ranks[k - 1] = rank_of((symbols[k - 1], merged), none)
            if k < len(ranks):
                ranks[k] = rank_of((merged, symbols[k + 1]), none)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        """The same merges from a heap of ranked pairs over a linked list."""
        n, ranks = len(symbols), self.ranks
        tokens: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[pair], k, *pair) for k, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in ranks]
        heapq.heapify(heap)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            other = after[k]
            if tokens[k] != left or other == n or tokens[other] != right:
                continue  # one of the two has been merged since
            tokens[k], tokens[other] = left + right, None
            after[k] = after[other]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (rank := ranks.get((tokens[a], tokens[b]))) is not None:
                    heapq.heappush(heap, (rank, a, tokens[a], tokens[b]))
        return [token for token in tokens if token is not None]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a string without white space that has no special token inside."""
        if (packed := self.chunks.get(chunk)) is None:
            if PLAIN_WORD.fullmatch(chunk):
                packed = self._word(chunk if chunk.isascii() else chunk.translate(self.letters))
            else:
                normal = self.tokenizer.normalizer.normalize_str(chunk)
                words = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
                packed = b"".join(self._word(word) for word, _ in words if word)
            self._keep(self.chunks, chunk, packed)
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self._encode_plain(text)
        parts = self.special_pattern.split(text)
        return b"".join(
            pack("<I", self.special[part]) if k % 2 else self._encode_plain(part) for k, part in enumerate(parts)
        )

    def _encode_plain(self, text: str) -> bytes:
        if CALM_TEXT.fullmatch(text):
            # Lower-casing early and setting closing marks apart leave fewer different chunks.
            chunks = CLOSING_MARK.sub(r" \1", text.lower()).encode().split()
        else:
            chunks = text.encode("utf-8", "replace").split()
        # bytes.split cuts at the six ASCII white-space characters; others stay inside a chunk.
        known = self.chunks
        return b"".join([known.get(c) or self._chunk(c) for c in map(bytes.decode, chunks)])


class TokenStrings:
    """Decoder of one tokenizer file: a string per id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.strings = {i: token.encode() for token, i in Tokenizer.from_file(path).get_vocab(True).items()}

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with spaces between them, special ones included; unknown ids are left out."""
        strings = self.strings
        return b" ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist() if i in strings]).decode("utf-8", "replace")


def _sliced(columns: list[str], rows: Iterator[tuple], size) -> Iterator[pd.DataFrame]:
    waiting, held = [], 0
    for row in rows:
        waiting.append(row)
        held += size(row)
        if held >= SLICE_BYTES:
            yield pd.DataFrame(waiting, columns=columns).astype({"doc_id": "Int64"})
            waiting, held = [], 0
    if waiting:
        yield pd.DataFrame(waiting, columns=columns).astype({"doc_id": "Int64"})


def encode_documents(
    docs: DataFrame, tokenizer: str, text: str = "text", entries: int = TABLE_ENTRIES, decoded: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, ids) per row of ``docs``: the ids as packed little-endian unsigned 32-bit integers.

    Special strings inside a text become their tokens; none is added. A null text is an empty one, with
    no ids; repeated rows stay; an empty table gives none. Nothing is shuffled. With ``decoded`` the ids
    are decoded again in the same worker, as ``decode_documents`` does it in a pass of its own.
    """
    columns = ["doc_id", "n_tokens", "ids", *(["decoded"] if decoded else [])]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ForcedBoundaryBpe(tokenizer, entries)
        tokens = TokenStrings(tokenizer) if decoded else None

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                    ids = bpe.encode(text or "")
                    yield (doc_id, len(ids) // 4, ids, *([tokens.decode(ids)] if tokens else []))

        yield from _sliced(columns, rows(), lambda row: len(row[-1]))

    schema = DECODED if decoded else ENCODED
    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInPandas(encode, schema)


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) per row of packed ``ids``, special tokens kept; null ids give the empty text."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = TokenStrings(tokenizer)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, n_tokens, ids in zip(batch["doc_id"].astype("Int64"), batch["n_tokens"], batch["ids"], strict=True):
                    yield doc_id, n_tokens, ids, tokens.decode(ids or b"")

        yield from _sliced(["doc_id", "n_tokens", "ids", "decoded"], rows(), lambda row: len(row[3]))

    counted = encoded.select(
        F.col("doc_id").cast("long"), F.coalesce(F.octet_length("ids") / 4, F.lit(0)).cast("long").alias("n_tokens"), "ids"
    )
    return counted.mapInPandas(decode, DECODED)

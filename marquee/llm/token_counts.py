"""Token counts by the whole-token shortcut.

Offline, on the driver and once per vocabulary, every vocabulary string is tried: if it is one
pre-token as a text of its own and the merges turn it into one token, it is proven whole. A
matching pre-token then counts as one without any merge; only the others are merged, each
distinct one once while a worker remembers it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import leaves
from .common import Memo, share
from .merges import merge, rule

#: Merged pre-tokens in one of the two generations of a worker's memo, and the longest of them.
MEMO, MEMO_CHARS = 250_000, 64
#: The byte-level split (fixed value): contractions, letters, numbers, other signs, white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def printable_bytes() -> list[str]:
    """The sign by which a byte-level vocabulary writes each byte.

    Bytes that print in Latin-1 stand for themselves, the others take the code points from 256 on
    in their order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class TokenCounter:
    """Counts tokens as the tokenizers library does for a byte-level BPE file.

    ``spec`` is the parsed JSON file. Added tokens that the library finds inside texts count one
    each and end the pre-tokens at both sides. Files with another normalizer or pre-tokenizer, or
    whose added tokens ask for stripping or word bounds, raise ValueError.
    """

    def __init__(self, spec: dict):
        before = spec["pre_tokenizer"] or {}
        odd = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"]]
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or odd:
            raise ValueError("not a plain byte-level BPE file")
        vocabulary = spec["model"]["vocab"]
        pairs = {}
        for rank, both in enumerate(spec["model"]["merges"]):
            a, b = both.split(" ") if isinstance(both, str) else both
            pairs[vocabulary[a], vocabulary[b]] = rule(rank, vocabulary[a + b])
        signs = printable_bytes()
        self.pairs = pairs
        self.of_byte = [vocabulary[s] for s in signs]
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.whole = frozenset(self._proven(vocabulary, {s: b for b, s in enumerate(signs)}))
        self._compile()

    def _compile(self) -> None:
        self.split = regex.compile(SPLIT).findall
        longest_first = sorted(self.added, key=len, reverse=True)
        self.around = regex.compile("|".join(map(regex.escape, longest_first))) if self.added else None
        self.counts = Memo(self.merged, MEMO, MEMO_CHARS)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("split", "around", "counts")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self._compile()

    def _proven(self, vocabulary: dict[str, int], byte_of: dict[str, int]) -> Iterator[str]:
        split = regex.compile(SPLIT).findall
        for string in vocabulary:
            try:
                text = bytes(byte_of[s] for s in string).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # never a pre-token
            if split(text) == [text] and self.merged(text) == 1:
                yield text

    def merged(self, piece: str) -> int:
        """Tokens of a pre-token by its merges."""
        return len(merge([self.of_byte[b] for b in piece.encode()], self.pairs))

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if self.around is None:
            return self._plain(text)
        total, start = 0, 0
        for found in self.around.finditer(text):
            total += self._plain(text[start : found.start()]) + 1
            start = found.end()
        return total + self._plain(text[start:])

    def _plain(self, text: str) -> int:
        return sum(sum(map(self._tokens, self.split(leaf))) for leaf in leaves(text))

    def _tokens(self, piece: str) -> int:
        """Tokens of a pre-token: one if proven whole, else merged when first asked for."""
        if piece in self.whole:
            return 1
        return self.counts[piece]


def count_tokens(
    df: DataFrame, tokenizer_path: str, text: str = "text", out: str = "n_tokens"
) -> DataFrame:
    """Add the number of tokens of ``text`` as a long column; all other columns stay.

    A null or empty text has none. Texts are counted whole. A column that already has the name
    ``out`` is replaced; an empty table stays empty.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        counter = TokenCounter(json.load(file))
    df = df.drop(out)
    proven = share(df.sparkSession, counter)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = proven()
        for batch in batches:
            counts = [known.count(t) if t else 0 for t in batch.column(text).to_pylist()]
            columns = [*batch.columns, pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField(out, T.LongType())]))

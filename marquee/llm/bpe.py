"""Byte-level BPE encoding and decoding by a monoid tree reduction.

The value of a byte string is its token sequence. A string is cut in halves, the halves are
encoded recursively (both are memoised: halves of words recur far more often than words), and
two neighbours are joined by encoding a window around their boundary again. The window starts
with one token on each side and doubles until its outermost tokens come out unchanged or it
reaches the ends. Then everything outside is final: a token sequence is the encoding of its
bytes exactly if every two neighbours are the encoding of their joined bytes, and all
neighbours outside the window, and those across its edges, are neighbours as before.

Texts form the same tree one level up: they are cut where no match of the split pattern can
reach across (before white space that follows something else), so that a long text is a row of
bounded pieces whose sequences are concatenated. Decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, share
from .merges import merge, rule

#: Characters of a text that are split into pre-tokens at a time.
LEAF_CHARS = 1 << 18
#: Bytes of a leaf of the encoding tree, merged without further halving: below, joining two halves
#: costs more than merging both at once.
LEAF_BYTES = 16
#: Words, and halves and windows of words, in one of the two generations of a worker's memos.
MEMO, PART_MEMO = 200_000, 100_000
#: Longest words, halves (bytes) and windows (tokens) that are remembered.
MEMO_CHARS, MEMO_BYTES, MEMO_TOKENS = 64, 32, 8
#: Ids decoded in one leaf of the decoding tree.
LEAF_IDS = 1 << 15
_CUT = regex.compile(r"(?<=\S)\s")


def read_ranks(path: str) -> bytes:
    """The raw rank file, read on the driver; its size is that of a vocabulary."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


def by_id(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id."""
    vocabulary = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        vocabulary[rank] = token
    return vocabulary


def decode_ids(vocabulary: list[bytes], ids: np.ndarray) -> bytes:
    """Bytes of a token sequence, concatenated up a tree."""
    if len(ids) > LEAF_IDS:
        middle = len(ids) // 2
        return decode_ids(vocabulary, ids[:middle]) + decode_ids(vocabulary, ids[middle:])
    return b"".join(map(vocabulary.__getitem__, ids.tolist()))


class TreeCodec:
    """Encodes and decodes by the vocabulary ``ranks`` and the split pattern ``pattern``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.vocabulary = by_id(ranks)
        self.pairs = {
            (ranks[token[:i]], ranks[token[i:]]): rule(rank, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        self.halves = Memo(self._tree, PART_MEMO, MEMO_BYTES)
        self.windows = Memo(self._merged, PART_MEMO, MEMO_TOKENS)
        self.fitting = Memo(lambda edge: self.windows[edge] == edge, PART_MEMO)
        self.words = Memo(self._word, MEMO, MEMO_CHARS)

    # -- bytes ------------------------------------------------------------------------------

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one pre-token."""
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else self._tree(piece)

    def _tree(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) <= LEAF_BYTES:
            return tuple(merge([self.of_byte[b] for b in piece], self.pairs))
        middle = len(piece) // 2
        return self._join(self.halves[piece[:middle]], self.halves[piece[middle:]])

    def _join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if self.fitting[left[-1], right[0]]:
            return left + right
        size = 2
        while True:
            head, tail = left[-size:], right[:size]
            window = self.windows[head + tail]
            left_final = size >= len(left) or window[0] == head[0]
            right_final = size >= len(right) or window[-1] == tail[-1]
            if left_final and right_final:
                return left[: max(0, len(left) - size)] + window + right[size:]
            size *= 2

    def _merged(self, tokens: tuple[int, ...]) -> tuple[int, ...]:
        data = b"".join(map(self.vocabulary.__getitem__, tokens))
        return tuple(merge([self.of_byte[b] for b in data], self.pairs))

    # -- texts ------------------------------------------------------------------------------

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text."""
        bytes_of = self.words.__getitem__
        found = b"".join(b"".join(map(bytes_of, self.split(leaf))) for leaf in leaves(text))
        return np.frombuffer(found, np.int32)

    def _word(self, word: str) -> bytes:
        """Ids of a pre-token as the bytes of 32-bit numbers."""
        return array("i", self.encode_piece(word.encode())).tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a token sequence."""
        return decode_ids(self.vocabulary, ids)


def leaves(text: str, size: int = LEAF_CHARS) -> Iterator[str]:
    """The text in pieces that the split pattern treats as it treats the whole.

    A piece ends before white space that follows something else: no match holds white space
    after another character, and what follows such a character does not change its match.
    """
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def _encoded(codec: TreeCodec, texts: list[str | None]) -> tuple[list[np.ndarray], pa.Array]:
    encoded = [codec.encode(t or "") for t in texts]
    ends = np.cumsum([0, *map(len, encoded)], dtype=np.int32)
    flat = np.concatenate(encoded) if encoded else np.zeros(0, np.int32)
    return encoded, pa.ListArray.from_arrays(ends, flat)


def encode(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """Add the token ids of ``text`` as an array column ``ids``; all other columns stay.

    With ``decoded`` the ids are decoded in the same pass, and their bytes added under that name.

    Special tokens are not known: their strings are ordinary text. A null or empty text has an
    empty array and no bytes. Texts are encoded whole, however long; repeated rows get equal
    arrays, an empty table stays empty. Columns that already have the new names are replaced.
    ``pattern`` must cut texts as ``leaves`` expects: no match may hold white space after
    something else.
    """
    codec_of = share(
        df.sparkSession, (read_ranks(ranks_path), pattern), lambda x: TreeCodec(parse_ranks(x[0]), x[1])
    )
    df = df.drop(ids, *([decoded] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        for batch in batches:
            encoded, column = _encoded(codec, batch.column(text).to_pylist())
            if decoded is None:
                yield _with(batch, **{ids: column})
            else:
                whole = pa.array([codec.decode(x) for x in encoded], pa.binary())
                yield _with(batch, **{ids: column, decoded: whole})

    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if decoded is not None:
        added.append(T.StructField(decoded, T.BinaryType()))
    return df.mapInArrow(run, T.StructType([*df.schema, *added]))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids of each row stand for; a null array gives no bytes.

    An id outside the vocabulary raises IndexError. A column that has the name ``out`` already
    is replaced, all others stay.
    """
    vocabulary_of = share(df.sparkSession, read_ranks(ranks_path), lambda raw: by_id(parse_ranks(raw)))
    df = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of()
        for batch in batches:
            column = batch.column(ids)
            rows = (x.values.to_numpy(zero_copy_only=False) if x.is_valid else _NO_IDS for x in column)
            yield _with(batch, **{out: pa.array([decode_ids(vocabulary, x) for x in rows], pa.binary())})

    schema = T.StructType([*df.schema, T.StructField(out, T.BinaryType())])
    return df.mapInArrow(run, schema)


_NO_IDS = np.zeros(0, np.int32)

"""Language identification of mixed-language text.

The script of a word's letters narrows the languages that can have it, scores of its letter
trigrams rank those, and a Viterbi pass over the words with a penalty for each change of
language labels spans. A document gets the language that labels most of its letters.

The pass is exact but rarely runs word by word: if no stretch of words gains more than one
penalty by leaving the best single language, no path with a change can be better, and the
largest gain of any stretch is found with running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import looked_up, lowest_hashes, share

#: Labelled texts that a language's model is fitted on at most, the first by a hash of the text.
SAMPLE_DOCS = 600
#: Trigrams are hashed to so many cells: bounds the model, whatever the corpus.
CELLS = 1 << 16
#: Cost of a change of language, in nats.
SWITCH = 15.0
#: A script belongs to a language if this share of its sample's letters is in it.
SCRIPT_SHARE = 0.02
#: Words a worker remembers at most.
MEMO = 150_000
#: Score of a letter under a language that does not use its script.
OUTSIDE = -30.0
#: Undetermined.
UND = "und"
#: Ranges of letters by script (fixed values: Unicode blocks); letters elsewhere are "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_EDGE_LEFT, _EDGE_RIGHT = ord("<"), ord(">")
_MIX = np.random.default_rng(5).integers(1 << 20, 1 << 31, 4, dtype=np.int64) | 1


Alphabet = tuple[np.ndarray, np.ndarray, np.ndarray]


def alphabet() -> Alphabet:
    """For every code point: whether it belongs to words, whether it is a letter, its script."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    of_word, letter = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for kind, found in ((of_word, _LETTERS), (letter, regex.compile(r"\p{L}+"))):
        for run in found.finditer(everything):
            kind[ord(run[0][0]) : ord(run[0][-1]) + 1] = True
        kind[0xD800:0xE000] = False
    scripts = np.zeros(0x110000, np.uint8)  # 0: other
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            scripts[first : last + 1] = number
    return of_word, letter, scripts


class Letters(NamedTuple):
    """The letters of some tokens in order: token, cell of the trigram around each, script."""

    token: np.ndarray
    cell: np.ndarray
    script: np.ndarray
    counted: np.ndarray  # whether it is a letter, not a mark


def letters_of(tokens: list[str], signs: Alphabet | None = None) -> Letters:
    """Letters of tokens (without line feeds) in lower case, all at once.

    A trigram is a letter with its two neighbours; where a run of letters begins or ends, an edge
    takes the neighbour's place.
    """
    of_word, letter, scripts = signs or alphabet()
    code = np.frombuffer("\n".join(tokens).lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    inside = of_word[code]
    left = np.where(np.r_[False, inside[:-1]], np.r_[0, code[:-1]], _EDGE_LEFT)
    right = np.where(np.r_[inside[1:], False], np.r_[code[1:], 0], _EDGE_RIGHT)
    at = np.flatnonzero(inside)
    mixed = left[at] * _MIX[0] + code[at] * _MIX[1] + right[at] * _MIX[2]
    cell = ((mixed ^ (mixed >> 17)) * _MIX[3] >> 13) % CELLS
    return Letters(np.cumsum(code == 10)[at], cell, scripts[code[at]], letter[code[at]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells and scripts of each language in a batch, summed up."""
    signs = alphabet()
    for batch in batches:
        rows: list[tuple[str, str, int, int]] = []
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            texts.setdefault(lang, []).extend((text or "").split())
        for lang, tokens in texts.items():
            found = letters_of(tokens, signs)
            for kind, values in (("cell", found.cell), ("script", found.script)):
                counts = np.bincount(values)
                rows += [(lang, kind, int(i), int(counts[i])) for i in np.flatnonzero(counts)]
        columns = list(zip(*rows)) if rows else [()] * 4
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "kind", "place", "n"]
        )


class Model:
    """Languages, their scripts, and log probabilities of trigram cells."""

    def __init__(self, counts: list[tuple[str, str, int, int]]):
        self.signs: Alphabet | None = None  # made where the model is used
        self.languages = sorted({lang for lang, *_ in counts})
        place = {lang: i for i, lang in enumerate(self.languages)}
        cells = np.zeros((CELLS, len(place)))
        scripts = np.zeros((len(SCRIPTS) + 1, len(place)))
        for lang, kind, at, n in counts:
            (cells if kind == "cell" else scripts)[at, place[lang]] = n
        self.scores = np.log((cells + 0.5) / (cells.sum(axis=0) + 0.5 * CELLS))
        self.candidates = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)

    def words(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language, and letters, of each token."""
        return self.weighed(tokens)[:2]

    def weighed(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by language, letters, and letters in a script that some language has.

        Letters whose script is not a language's count against it; letters in a script that no
        language has say nothing.
        """
        if self.signs is None:
            self.signs = alphabet()
        found = letters_of(tokens, self.signs)
        number = len(tokens)
        candidates = self.candidates[found.script]
        own = np.where(candidates, self.scores[found.cell], OUTSIDE)
        known = candidates.any(axis=1)
        own[~known] = 0.0
        scores = [np.bincount(found.token, column, number) for column in own.T]
        letters = np.bincount(found.token, found.counted, number).astype(np.int64)
        told = np.bincount(found.token, found.counted & known, number).astype(np.int64)
        return np.stack(scores, axis=1), letters, told


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on up to SAMPLE_DOCS texts of each language; null languages are left out.

    The sample of a language are its texts of the lowest hashes; equal texts count once. Counts of
    hashes decide how far it reaches; only then are texts read and moved, those of the sample.
    What reaches the driver is bounded by the number of languages times that of cells.
    """
    hashed = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")
    )
    reach = lowest_hashes(hashed.select("lang", "hash"), "lang", SAMPLE_DOCS)
    sample = (
        hashed.where(F.col("hash") <= looked_up(reach, F.col("lang")))
        .dropDuplicates(["lang", "hash"])
        .select("lang", "text")
    )
    counts = (
        sample.mapInArrow(_count, "lang string, kind string, place long, n long")
        .groupBy("lang", "kind", "place")
        .agg(F.sum("n").alias("n"))
    )
    return Model([tuple(row) for row in counts.collect()])


class _Places(dict):
    """Token to its row in a table; new tokens get the next rows."""

    def __missing__(self, token: str) -> int:
        place = self[token] = len(self)
        return place


class Labeller:
    """Labels texts by a model, remembering the scores of words."""

    def __init__(self, model: Model):
        self.model = model
        self.number = len(model.languages)
        self._forget()

    def _forget(self) -> None:
        self.place = _Places()
        self.table = np.zeros((1 << 16, self.number))
        self.letters = np.zeros(1 << 16, np.int64)
        self.told = np.zeros(1 << 16, np.int64)

    def _places(self, tokens: list[str]) -> np.ndarray:
        if len(self.place) > MEMO:
            self._forget()
        known = len(self.place)
        places = np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))
        if len(self.place) > known:
            first = np.full(len(self.place) - known, len(tokens))
            np.minimum.at(first, places[places >= known] - known, np.flatnonzero(places >= known))
            while len(self.table) < len(self.place):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
                self.told = np.concatenate([self.told, np.zeros_like(self.told)])
            fresh = slice(known, len(self.place))
            weighed = self.model.weighed([tokens[i] for i in first])
            self.table[fresh], self.letters[fresh], self.told[fresh] = weighed
        return places

    def label(self, text: str) -> tuple[str, float, list[tuple[int, int, str]]]:
        """Language, share of letters it labels, and spans (first word, words, language).

        Letters in a script that no language has are labelled, but do not count for the share.
        """
        tokens = text.split()
        if not self.number or not tokens:
            return UND, 0.0, []
        places = self._places(tokens)
        letters = self.letters[places]
        total = int(letters.sum())
        if not total:
            return UND, 0.0, []
        path = viterbi(self.table[places])
        by_language = np.bincount(path, weights=letters, minlength=self.number)
        best = int(by_language.argmax())
        edges = np.flatnonzero(np.diff(path, prepend=-1, append=-1))
        spans = [
            (int(a), int(b - a), self.model.languages[path[a]]) for a, b in zip(edges[:-1], edges[1:])
        ]
        told = int(self.told[places][path == best].sum())
        return self.model.languages[best], told / total, spans


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word: scores along the path less ``switch`` for each change."""
    n, number = scores.shape
    single = int(scores.sum(axis=0).argmax())
    others = scores - scores[:, [single]]
    others[:, single] = -np.inf
    gain = others.max(axis=1)
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    if number == 1 or (sums - np.minimum.accumulate(sums)).max() <= switch:
        return np.full(n, single)
    best, came = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(best)
        change, leader = top - switch, best.index(top)
        came.append([i if b >= change else leader for i, b in enumerate(best)])
        best = [(b if b >= change else change) + x for b, x in zip(best, row)]
    path = np.empty(n, np.int64)
    path[-1] = at = best.index(max(best))
    for t in range(n - 2, -1, -1):
        path[t] = at = came[t][at]
    return path


_SPAN = T.ArrayType(
    T.StructType(
        [
            T.StructField("first", T.IntegerType()),
            T.StructField("words", T.IntegerType()),
            T.StructField("lang", T.StringType()),
        ]
    )
)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``lang_score`` (0 to 1) and ``lang_spans``; other columns stay.

    Only the text decides. Spans count white-space separated words from 0. A text that is null,
    empty or without a letter gets ``und``, score 0 and no spans, as does every text if the model
    knows no language. Texts are read whole. Columns of these names are replaced.
    """
    df = df.drop("lang_pred", "lang_score", "lang_spans")
    labeller_of = share(df.sparkSession, model, Labeller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = labeller_of()
        for batch in batches:
            found = [labeller.label(t or "") for t in batch.column(text).to_pylist()]
            spans = [[dict(zip(("first", "words", "lang"), s)) for s in x[2]] for x in found]
            columns = [
                pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] for x in found], pa.float64()),
                pa.array(spans, _SPAN_ARROW),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns],
                [*batch.schema.names, "lang_pred", "lang_score", "lang_spans"],
            )

    added = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("lang_score", T.DoubleType()),
        T.StructField("lang_spans", _SPAN),
    ]
    return df.mapInArrow(run, T.StructType([*df.schema, *added]))


_SPAN_ARROW = pa.list_(
    pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])
)

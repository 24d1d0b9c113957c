"""BagMinHash signatures of multisets, and exact overlaps of multisets, of one text at a time.

The weights of a multiset are its counts, whole numbers already, so a level is one occurrence.
The levels from 0 on are cut into dyadic intervals [0, 1), [1, 2), [2, 4), [4, 8) and so on. For
each element and interval a Poisson process, whose rate is the interval's width, yields points
in order of time; each point has a register and a level inside the interval, all drawn from a
hash of element, interval and number of the point. An element of weight w owns the points whose
level is below w. Whole intervals are thus served by one process however wide they are, and in
the one that w cuts, points above w are passed over. A register holds the earliest time of the
points that fall to it. Two multisets agree in a register if the earliest point of both
belongs to both, and the chance of that is their weighted Jaccard similarity.

Points come in order of time, so a process ends as soon as it has passed the latest register.
"""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5
#: Bands of rows: a pair of similarity 0.8 shares no band with probability 5e-8.
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Points drawn at once for small multisets: about enough to reach every register.
FIRST_POINTS = 8 * REGISTERS
#: The same once some have ended.
NEXT = 4 * REGISTERS
#: Bytes of a text hashed at a time.
CHUNK = 1 << 20

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)
_LEVEL = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            line = lambda base: np.concatenate(
                [np.ones(1, _U), np.cumprod(np.full(size - 1, base, _U))]
            )
            self.up, self.down = line(_BASE), line(_BASE_INVERSE)
        return self.up[:n], self.down


_POWERS = _Powers()


def normal(text: str) -> bytes:
    """The words of a text, all but ASCII white space, joined by one space."""
    return b" ".join(text.encode().split())


def fingerprint(normal_text: bytes) -> bytes:
    """16 bytes that tell word sequences apart."""
    return hashlib.blake2b(normal_text, digest_size=16).digest()


def word_hashes(normal_text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, from running sums of weighted bytes."""
    out, start = [], 0
    while start < len(normal_text):
        end = len(normal_text)
        if end - start > CHUNK:
            end = normal_text.find(b" ", start + CHUNK)
            end = len(normal_text) if end < 0 else end
        data = np.frombuffer(normal_text, np.uint8, end - start, start)
        up, down = _POWERS.upto(len(data))
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[data] * up)])
        spaces = np.flatnonzero(data == 32)
        begins = np.concatenate([[0], spaces + 1])
        ends = np.concatenate([spaces, [len(data)]])
        out.append(mix((sums[ends] - sums[begins]) * down[begins]))
        start = end + 1
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingles(normal_text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of five words, ascending, and their counts.

    A text of one to four words is one shingle; a text without words has none.
    """
    words = word_hashes(normal_text)
    n = len(words)
    if not n:
        return words, np.zeros(0, np.int64)
    size = min(n, SHINGLE)
    total = np.zeros(n - size + 1, _U)
    for j in range(size):
        total += words[j : n - size + 1 + j] * _PLACE[j]
    return np.unique(mix(total), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 0.0


def signature(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Earliest times by register, of a multiset that is not empty."""
    seeds, low, width, weight = [], [], [], []
    lower, step, level = 0, 1, 0
    top = int(counts.max())
    while lower < top:
        own = counts > lower
        number = int(own.sum())
        seeds.append(mix(elements[own] + _LEVEL[level]))
        low.append(np.full(number, lower))
        width.append(np.full(number, float(step)))
        weight.append(counts[own])
        level += 1
        lower, step = (1, 1) if level == 1 else (lower * 2, step * 2)
    seed, low = np.concatenate(seeds), np.concatenate(low)
    width, weight = np.concatenate(width), np.concatenate(weight)
    registers = np.full(REGISTERS, np.inf)
    time = np.zeros(len(seed))
    done = 0
    while len(seed):
        points = max(1, (NEXT if done else FIRST_POINTS) // len(seed))
        number = np.arange(done + 1, done + points + 1, dtype=_U)
        draw = mix(seed[:, None] + number[None, :] * _GOLDEN)
        uniform = ((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        times = time[:, None] + np.cumsum(-np.log(uniform) / width[:, None], axis=1)
        place = mix(draw ^ _GOLDEN)
        register = (place % _U(REGISTERS)).astype(np.int64)
        inside = (place >> _U(11)).astype(np.float64) * 2.0**-53 * width[:, None]
        owned = low[:, None] + np.floor(inside) < weight[:, None]
        np.minimum.at(registers, register[owned], times[owned])
        done += points
        time = times[:, -1]
        going = time < registers.max()
        if not going.all():
            seed, low, width = seed[going], low[going], width[going]
            weight, time = weight[going], time[going]
    return registers


def band_hashes(registers: np.ndarray) -> np.ndarray:
    """One 64-bit number for each band; equal registers give equal numbers."""
    bits = mix(registers.view(_U)).reshape(BANDS, ROWS)
    return mix((bits * _BAND).sum(axis=1, dtype=_U)).view(np.int64)

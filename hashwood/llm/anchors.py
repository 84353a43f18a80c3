"""Anchors of byte strings: positions that any two equal strings of a given length agree on.

A gram is GRAM bytes. Of the grams inside each string of LENGTH bytes, those with the least hash are anchors; equal
strings so have equal anchors at equal places. About two bytes in LENGTH - GRAM + 2 begin one.
"""

from __future__ import annotations

import numpy as np

LENGTH, GRAM = 200, 100
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = [_mixed(np.arange(1, 257, dtype=_U) * _U(k)) for k in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)]
_BASES = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n at least; the longest so far is kept."""
    for (b, size), held in _POWERS.items():
        if b == base and size >= n:
            return held
    out = np.ones(max(n, 1 << 16), _U)
    out[1:] = _U(base)
    out = np.multiply.accumulate(out)
    for key in [k for k in _POWERS if k[0] == base]:
        del _POWERS[key]
    _POWERS[base, len(out)] = out
    return out


class Hashes:
    """Hashes of any stretch of an array of bytes in constant time each; which is 0 or 1, for two independent ones."""

    def __init__(self, raw: np.ndarray, which: int):
        base = _BASES[which]
        self.back = _powers(pow(base, -1, 1 << 64), len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, _U)
        np.cumsum(_BYTES[which][raw] * _powers(base, len(raw) + 1)[: len(raw)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.back[start]
        return _mixed(value + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))


def _sliding(values: np.ndarray, width: int, most: bool) -> np.ndarray:
    """Least (or largest) of each `width` values on end."""
    pick, n = (np.maximum, len(values)) if most else (np.minimum, len(values))
    rows = -(-n // width)
    padded = np.full(rows * width, _U(0) if most else ~_U(0), _U)
    padded[:n] = values
    blocks = padded.reshape(rows, width)
    ahead = pick.accumulate(blocks, axis=1).reshape(-1)
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in texts that lie end to end in raw, the first at starts[0] and so on; starts has the end too.

    Gives their positions, gram hashes, hashes of their surroundings, and the bounds of these. Surroundings hold every
    string of `length` bytes whose anchor this is, as far as the text goes; their hash tells where the anchor is in them.
    """
    n, wide = len(raw), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.astype(_U), none.astype(_U), none, none
    first = Hashes(raw, 0)
    at = np.arange(n - gram + 1)
    grams = first(at, at + gram)
    ends = np.repeat(starts[1:], np.diff(starts))
    whole = at[: n - length + 1] + length <= ends[: n - length + 1]
    least = _sliding(grams, wide, False)
    least[~whole] = 0
    # Windows that hold a position begin up to wide - 1 before it.
    reach = _sliding(np.concatenate([np.zeros(wide - 1, _U), least, np.zeros(wide - 1, _U)]), wide, True)
    place = np.flatnonzero((reach[: len(grams)] == grams) & (reach[: len(grams)] > 0))
    begins = np.repeat(starts[:-1], np.diff(starts))[place]
    low, high = np.maximum(place - (wide - 1), begins), np.minimum(place + length, ends[place])
    around = _mixed(Hashes(raw, 1)(low, high) ^ _mixed((place - low).astype(_U)))
    return place, grams[place], around, low, high

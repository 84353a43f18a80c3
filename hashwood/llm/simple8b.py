"""Simple-8b word-aligned coding of unsigned integers, vectorised over mini-blocks.

A 64-bit word holds a selector in its top four bits and values of one width below, the first lowest. Coding starts anew
every MINI values, and offsets tell each mini-block's first word, so that all of them are coded and decoded side by side.
Selector 1 stands for one value of 2**60 or more; the word's low bits then number an entry of the escapes.
"""

from __future__ import annotations

import numpy as np

MINI = 4096
# Selector -> values a word holds, and their width in bits.
COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE, PAD = 1, 240
_BITS16 = np.array([int(i).bit_length() for i in range(1 << 16)], np.uint8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, 0 for 0."""
    out = np.zeros(values.shape, np.uint8)
    for shift in (48, 32, 16, 0):
        part = _BITS16[(values >> np.uint64(shift)) & np.uint64(0xFFFF)]
        out = np.where((out == 0) & (part > 0), part + np.uint8(shift), out) if shift else np.where(out == 0, part, out)
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each mini-block (and the end), escapes."""
    n = len(values)
    rows = -(-n // MINI)
    padded = np.zeros((rows, MINI + PAD), np.uint64)
    flat = np.zeros(rows * MINI, np.uint64)
    flat[:n] = values
    padded[:, :MINI] = flat.reshape(rows, MINI)
    if n and int(flat.max()) < 1 << 16:
        bits = _BITS16.take(padded.astype(np.uint16))
    else:
        bits = bit_lengths(padded)
    selector = np.where(bits[:, :MINI] > 60, ESCAPE, 15).astype(np.uint8)
    most, held = bits, 1  # the largest width among the next `held` values
    for s in (14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 0):
        count = int(COUNTS[s])
        while held < count:
            reach = min(held, count - held)
            shifted = np.zeros_like(most)
            shifted[:, : most.shape[1] - reach] = most[:, reach:]
            most, held = np.maximum(most, shifted), held + reach
        fits = most[:, :MINI] <= np.uint8(WIDTHS[s])  # of one type with the widths, else all are cast
        if not fits.any():
            break  # wider words would need all of these to fit
        np.copyto(selector, np.uint8(s), where=fits)
    # Where the word after the one that starts at a place starts; past a mini-block's values is one more place, which stays.
    after = np.full((rows, MINI + 1), MINI)
    np.minimum(COUNTS.take(selector) + np.arange(MINI), MINI, out=after[:, :MINI])
    after[-1:][after[-1:] >= n - (rows - 1) * MINI] = MINI
    after += np.arange(rows)[:, None] * (MINI + 1)
    after, chosen = after.reshape(-1), np.zeros(after.size, bool)
    at, last = np.arange(rows) * (MINI + 1), np.arange(1, rows + 1) * (MINI + 1) - 1
    while (at < last).any():
        for _ in range(16):
            chosen[at] = True
            at = after.take(at)
    chosen[last] = False
    row, at = np.divmod(np.flatnonzero(chosen), MINI + 1)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int64)
    picked = selector[row, at]
    words = picked.astype(np.uint64) << np.uint64(60)
    escapes = np.zeros(0, np.uint64)
    held, at = padded.reshape(-1), row * (MINI + PAD) + at
    for s in np.unique(picked):
        which = np.flatnonzero(picked == s)
        if s == ESCAPE:
            escapes = held[at[which]]
            words[which] |= np.arange(len(which), dtype=np.uint64)
        elif WIDTHS[s]:
            start, low = at[which], np.zeros(len(which), np.uint64)
            for j in range(COUNTS[s]):
                low |= held.take(start + j) << np.uint64(j * int(WIDTHS[s]))
            words[which] |= low
    return words, offsets, escapes


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n values."""
    rows = len(offsets) - 1
    out = np.zeros((rows, MINI + PAD), np.uint64)
    picked = (words >> np.uint64(60)).astype(np.int64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    counts = COUNTS[picked]
    before = np.cumsum(counts) - counts
    at = before - before[offsets[:-1]][row] if rows else before
    for s in np.unique(picked):
        which = np.flatnonzero(picked == s)
        low = words[which] & np.uint64((1 << 60) - 1)
        if s == ESCAPE:
            out[row[which], at[which]] = escapes[low]
        elif WIDTHS[s]:
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for j in range(COUNTS[s]):
                out[row[which], at[which] + j] = (low >> np.uint64(j * int(WIDTHS[s]))) & mask
    return out[:, :MINI].reshape(-1)[:n]

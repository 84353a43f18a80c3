"""Suffix arrays of byte strings by induced sorting, vectorised bucket by bucket.

Texts lie end to end, each closed by a byte 0 that no text holds; a suffix ends at the next 0, and equal suffixes come in
any order. Suffixes are of type S or L (smaller or larger than the next), and leftmost S ones are sorted first: inducing
from them in any order sorts the substrings between them, equal substrings get one name, and the string of names is
ranked. Inducing once more from that order gives the array. A string of names has far more letters than buckets pay for
when each costs a step in Python, so its suffixes are ranked by doubling instead of another round of buckets.
"""

from __future__ import annotations

import numpy as np


def types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are of type S, and the leftmost ones of each run of them."""
    n = len(text)
    step = np.ones(n, np.int8)  # the last is S
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    place = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(place[::-1])[::-1]  # where the next different letter decides
    small = step[nearest] > 0
    first = np.zeros(n, bool)
    first[1:] = small[1:] & ~small[:-1]
    return small, np.flatnonzero(first)


def induce(text: np.ndarray, small: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost S suffixes in order."""
    n = len(text)
    letters = np.arange(257)
    begin_l = np.concatenate([[0], np.cumsum(np.bincount(text[~small], minlength=256))])
    begin_s = np.concatenate([[0], np.cumsum(np.bincount(text[small], minlength=256))])
    large, less = np.zeros(begin_l[-1], np.int32), np.zeros(begin_s[-1], np.int32)
    head, tail = begin_l[:-1].copy(), begin_s[1:].copy()
    by_letter = leftmost[np.argsort(text[leftmost], kind="stable")]
    bounds = np.searchsorted(text[by_letter], letters)

    def spread(suffixes: np.ndarray, to: np.ndarray, pointer: np.ndarray, up: bool) -> None:
        t = text[suffixes]
        order = np.argsort(t, kind="stable")
        t = t[order]
        counts = np.bincount(t, minlength=256)
        rank = np.arange(len(t)) - (np.cumsum(counts) - counts)[t]
        if up:
            to[pointer[t] + rank] = suffixes[order]
            pointer += counts
        else:
            to[pointer[t] - 1 - rank] = suffixes[order]
            pointer -= counts

    def before(suffixes: np.ndarray, kind: bool) -> np.ndarray:
        j = suffixes[suffixes > 0] - 1
        return j[small[j] == kind]

    present = np.flatnonzero(np.bincount(text, minlength=256))
    for c in present:
        done = begin_l[c]
        while done < head[c]:
            done, wave = head[c], large[done : head[c]]
            if len(found := before(wave, False)):
                spread(found, large, head, True)
        if len(found := before(by_letter[bounds[c] : bounds[c + 1]], False)):
            spread(found, large, head, True)
    for c in present[::-1]:
        done = begin_s[c + 1]
        while done > tail[c]:
            done, wave = tail[c], less[tail[c] : done][::-1]
            if len(found := before(wave, True)):
                spread(found, less, tail, False)
        if len(found := before(large[begin_l[c] : begin_l[c + 1]][::-1], True)):
            spread(found, less, tail, False)
    less[0] = n - 1  # the end follows from no suffix and is the least
    out = np.empty(n, np.int32)
    begin = begin_l + begin_s
    out[np.repeat(begin[:-1] - begin_l[:-1], np.diff(begin_l)) + np.arange(len(large))] = large
    out[np.repeat(begin_l[1:], np.diff(begin_s)) + np.arange(len(less))] = less
    return out


def _names(text: np.ndarray, ordered: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Numbers of substrings in order, equal ones alike. following: per position, where its substring ends."""
    a, b = ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64)
    size = following[a] - a
    same = size == following[b] - b
    on = np.flatnonzero(same)
    k = 0
    while len(on):
        differs = text[a[on] + k] != text[b[on] + k]
        same[on[differs]] = False
        k += 1
        on = on[~differs & (size[on] >= k)]
    return np.concatenate([[0], np.cumsum(~same)])


def _ranked(names: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of a string of names; left: names up to the end of each one's text, its own 0 not counted."""
    n = len(names)
    rank = names.astype(np.int64)
    held, most = 1, int(left.max(initial=0))
    order = np.argsort(rank, kind="stable")
    firsts = np.concatenate([[True], np.diff(rank[order]) != 0])
    rank[order] = np.maximum.accumulate(np.where(firsts, np.arange(n), 0))
    alone = firsts & np.concatenate([firsts[1:], [True]])
    active = order[~alone]  # members of groups of several, in order of their groups
    while len(active) and held <= most:
        after = np.where(left[active] > held, rank[np.minimum(active + held, n - 1)] + 1, 0)
        key = rank[active] * (n + 2) + after
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        group, step = rank[active], np.concatenate([[True], key[1:] != key[:-1]])
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        at = np.arange(len(active))
        within = at - np.maximum.accumulate(np.where(new_group, at, 0))
        rank[active] = group + np.maximum.accumulate(np.where(step, at, 0)) - (at - within)
        alone = step & np.concatenate([step[1:], [True]])
        active = active[~alone]
        held *= 2
    return rank


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order; text ends with 0."""
    small, leftmost = types(text)
    if not len(leftmost):
        return induce(text, small, leftmost)
    among = np.zeros(len(text), bool)
    among[leftmost] = True
    ordered = induce(text, small, leftmost)
    ordered = ordered[among[ordered]]
    following = np.zeros(len(text), np.int64)
    following[leftmost] = np.append(leftmost[1:], len(text) - 1)
    names = np.zeros(len(text), np.int64)
    names[ordered] = _names(text, ordered, following) + 1
    in_text = names[leftmost]
    ends = text[leftmost] == 0
    in_text[ends] = 0
    at = np.arange(len(leftmost))
    left = np.minimum.accumulate(np.where(ends, at, len(at))[::-1])[::-1] - at
    rank = _ranked(in_text, left)
    return induce(text, small, leftmost[np.argsort(rank, kind="stable")])


def common_words(text: np.ndarray, array: np.ndarray, words: int) -> np.ndarray:
    """For each position, in order of positions, how many times eight bytes it shares with the suffix before it in the array, up to `words`."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8 * words + 8, np.uint8)])
    eight = np.zeros(n + 8 * words, np.uint64)
    for k in range(8):
        eight |= padded[k : k + len(eight)].astype(np.uint64) << np.uint64(8 * k)
    previous = np.full(n, -1, np.int64)
    previous[array[1:]] = array[:-1]
    out = np.zeros(n, np.int16)
    on = np.flatnonzero(previous >= 0)
    for k in range(words):
        on = on[eight[on + 8 * k] == eight[previous[on] + 8 * k]]
        out[on] = k + 1
        if not len(on):
            break
    return out

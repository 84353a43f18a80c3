"""Similarity digests of improbable features.

A feature is WINDOW bytes. Its entropy gives its rank: the further from the entropy that plain text usually has, the
rarer, and near-constant windows count for nothing. In every run of POPULAR windows the rarest (the first of several) gets
a point; those with LEAST_POINTS are selected and inserted, in the order of the text, into Bloom filters of FILTER_BITS
bits, a new one for every FILTER_FEATURES features. Two filters are compared by their common bits, between what chance
gives and what is possible; a digest by the best partners of the smaller one's filters.

Ranks of a text are computed once: an edited text takes over its parts' and adds those of the windows over the seam.

Defined results: a null text counts as empty, has no features and the fingerprint "f1:0:"; a text with no selected window
has all its windows as features, one shorter than a window itself; two texts without features are alike (1), one without
is like no other (0); rows of one doc_id follow each other by text, a null doc_id comes last; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .anchors import Hashes
from .ordered import map_with_next

WINDOW, POPULAR, LEAST_POINTS = 64, 64, 16
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Entropy of a window in thousandths of the most possible: what text usually has, and the bounds of what counts.
USUAL, LOW, HIGH = 690, 100, 990
#: Share of the way from chance to the most possible that still counts as chance.
CUTOFF = 0.3
_U = np.uint64
# n log2 n as integers, so that sums don't depend on what came before.
_COUNTS = np.arange(WINDOW + 1)
_TERMS = np.round(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) * (1 << 20)).astype(np.int64)
_RISE = np.diff(_TERMS)
_MOST = WINDOW * np.log2(WINDOW)
_UNRANKED = 1 << 15


def ranks(raw: np.ndarray) -> np.ndarray:
    """Rank of the window at each place of an array of bytes; the smaller, the rarer. Windows overlap any joins in it."""
    n = len(raw)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    order = np.argsort(raw, kind="stable")
    keys = (raw[order].astype(np.int64) << 40) + order
    at = np.arange(n)
    behind, ahead = np.empty(n, np.int64), np.empty(n, np.int64)
    # The same byte among the WINDOW - 1 before and after each place.
    behind[order] = at - np.searchsorted(keys, keys - (WINDOW - 1), "left")
    ahead[order] = np.searchsorted(keys, keys + (WINDOW - 1), "right") - 1 - at
    come, go = _RISE[behind], _RISE[np.minimum(ahead, WINDOW - 1)]
    first = int(_TERMS[np.bincount(raw[:WINDOW], minlength=256)].sum())
    sums = first + np.concatenate([[0], np.cumsum(come[WINDOW:] - go[: n - WINDOW])])
    entropy = 1000 - (sums * 1000 / (_MOST * (1 << 20))).astype(np.int64)
    return np.where((entropy < LOW) | (entropy > HIGH), _UNRANKED, 1000 - np.abs(entropy - USUAL))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.int64).max)
    padded[:n] = values
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def selected(rank: np.ndarray) -> np.ndarray:
    """Places of the windows of a text that become features."""
    if not len(rank):
        return np.zeros(0, np.int64)
    keys = (rank << 40) + np.arange(len(rank))
    winners = _least(keys, min(POPULAR, len(rank)))
    winners = winners[winners >> 40 < _UNRANKED] & ((1 << 40) - 1)
    points = np.bincount(winners, minlength=len(rank))
    found = np.flatnonzero(points >= LEAST_POINTS)
    return found if len(found) else np.arange(len(rank))


class Digest:
    """Filters as rows of bits, and the features in each."""

    def __init__(self, raw: bytes, rank: np.ndarray):
        if not raw:
            hashes = np.zeros(0, _U)
        elif len(raw) < WINDOW:
            hashes = np.frombuffer(hashlib.sha1(raw).digest()[:8], "<u8")
        else:
            place = selected(rank)
            hashes = Hashes(np.frombuffer(raw, np.uint8), 0)(place, place + WINDOW)
            hashes = hashes[np.sort(np.unique(hashes, return_index=True)[1])]
        self.counts = np.diff(np.append(np.arange(0, len(hashes), FILTER_FEATURES), len(hashes)))
        self.bits = np.zeros((len(self.counts), FILTER_BITS), np.uint8)
        for k in range(HASHES):
            self.bits[np.arange(len(hashes)) // FILTER_FEATURES, (hashes >> _U(11 * k)) & _U(FILTER_BITS - 1)] = 1

    def __str__(self) -> str:
        return f"f1:{self.counts.sum()}:" + base64.b64encode(np.packbits(self.bits, axis=1).tobytes()).decode()

    @classmethod
    def parse(cls, fingerprint: str) -> Digest:
        _, features, packed = fingerprint.split(":")
        out = cls(b"", np.zeros(0, np.int64))
        out.bits = np.unpackbits(np.frombuffer(base64.b64decode(packed), np.uint8).reshape(-1, FILTER_BITS // 8), axis=1)
        out.counts = np.diff(np.append(np.arange(0, int(features), FILTER_FEATURES), int(features)))
        return out

    def likeness(self, other: Digest) -> float:
        few, many = (self, other) if len(self.counts) <= len(other.counts) else (other, self)
        if not len(few.counts):
            return float(not len(many.counts))
        many_bits, sizes = many.bits.astype(np.float32), many.bits.sum(axis=1, dtype=np.int64)
        total = 0.0
        for bits, features in zip(few.bits, few.counts, strict=True):
            common, size = many_bits @ bits.astype(np.float32), int(bits.sum())
            most, chance = np.minimum(sizes, size), sizes * size / FILTER_BITS
            floor = chance + CUTOFF * (most - chance)
            total += features * float(np.where(common >= most, 1.0, np.clip((common - floor) / np.maximum(most - floor, 1e-9), 0, 1)).max())
        return total / int(few.counts.sum())


def _all_ranks(raws: list[bytes]) -> list[np.ndarray]:
    joined = ranks(np.frombuffer(b"".join(raws), np.uint8))
    starts = np.cumsum([0, *map(len, raws)])
    return [joined[a : max(a, b - WINDOW + 1)] for a, b in zip(starts, starts[1:], strict=False)]


def edited(text: str, after: str) -> tuple[bytes, bytes]:
    """The parts of the edited text: the first half of text, and as much of the one after."""
    cut = len(text) // 2
    return text[: len(text) - cut].encode("utf-8", "surrogatepass"), after[:cut].encode("utf-8", "surrogatepass")


def compare(ids: list, batch: list[str], after: str) -> dict:
    """The query's columns for texts that follow each other, after being the one behind the last."""
    following = [*batch[1:], after]
    raws = [t.encode("utf-8", "surrogatepass") for t in [*batch, after]]
    rank = _all_ranks(raws)
    parts = [edited(t, f) for t, f in zip(batch, following, strict=True)]
    spliced = [len(a) >= WINDOW and len(b) >= WINDOW for a, b in parts]
    seams = _all_ranks([a[1 - WINDOW :] + b[: WINDOW - 1] if whole else a + b for (a, b), whole in zip(parts, spliced, strict=True)])
    out = {k: [] for k in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
    digest = Digest(raws[0], rank[0])
    for i, (a, b) in enumerate(parts):
        edit = Digest(a + b, np.concatenate([rank[i][: len(a) - WINDOW + 1], seams[i], rank[i + 1][: len(b) - WINDOW + 1]]) if spliced[i] else seams[i])
        behind = Digest(raws[i + 1], rank[i + 1])
        out["n_chars"].append(len(batch[i]))
        out["edited_sha256"].append(hashlib.sha256(a + b).hexdigest())
        out["fingerprint"].append(str(digest))
        out["edited_fingerprint"].append(str(edit))
        out["near_edited"].append(digest.likeness(edit))
        out["near_next"].append(digest.likeness(behind))
        digest = behind
    return out | {"doc_id": ids}


def fingerprint(text: str | None) -> str:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return str(Digest(raw, ranks(np.frombuffer(raw, np.uint8))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return map_with_next(docs, compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

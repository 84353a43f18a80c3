"""Pages from rows in key order, in one pass that holds a page per level.

A row ends all open pages of lower levels, so a page's bounds, pointers and hash are known as soon as the row comes that
ends it. Rows whose page reaches beyond the first or last row of a task's tree are given out as they are, with what hangs
on them already; a page per level and end, so they are some hundred for a task of any size. A second pass over these rows
of all tasks, where the ends are those of the trees, makes the other pages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

ABSENT = b"~"


@dataclass
class Page:
    """An open page: places of its rows in the batch at hand, their texts, and the pointers found so far."""

    level: int
    low: str | None = None
    rows: list[int] = field(default_factory=list)
    texts: list[bytes] = field(default_factory=list)
    nexts: list[str | None] = field(default_factory=list)

    def hash(self, algorithm: str) -> str:
        if self.level:
            body = b"".join(t + (ABSENT if n is None else b"%d:%s" % (len(n), n.encode())) for t, n in zip(self.texts, self.nexts, strict=True))
        else:
            body = ABSENT.join(self.texts) + ABSENT
        return hashlib.new(algorithm, b"%d|%s|%s" % (self.level, self.low.encode() if self.low else ABSENT, body)).hexdigest()


@dataclass
class Made:
    """What a batch gives out: finished pages, and single rows, which have no hash."""

    rows: list[int] = field(default_factory=list)
    nexts: list[str | None] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    heads: list[tuple] = field(default_factory=list)  # level, hash, low, before, until, is_low, said

    def page(self, page: Page, hash: str, before: int | None, until: int | None, is_low: bool) -> None:
        self.rows += page.rows
        self.nexts += page.nexts if page.level else [None] * len(page.rows)
        self.sizes.append(len(page.rows))
        self.heads.append((page.level, hash, page.low, before, until, is_low, None))

    def single(self, page: Page) -> None:
        nexts = page.nexts if page.level else [None] * len(page.rows)
        self.rows += page.rows
        self.nexts += nexts
        self.sizes += [1] * len(page.rows)
        self.heads += [(page.level, None, page.low if i == 0 else None, None, None, False, row) for i, row in enumerate(page.rows)]

    def batch(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        level, hash, low, before, until, is_low, said = zip(*self.heads, strict=True)
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        at = pa.array(self.rows, pa.int64())
        key = rows["key"].take(at)
        ord_ = rows["ord"].take(at) if "ord" in rows.schema.names else key
        entries = pa.StructArray.from_arrays([ord_, key, rows["value"].take(at), pa.array(self.nexts, pa.string())], names=["ord", "key", "value", "next"])
        place = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                rows["tree"].take(at.take(pa.array(ends[:-1], pa.int64()))),
                pa.array(hash, pa.string()),
                pa.array(level, pa.int32()),
                pa.array(low, pa.string()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries),
                rows["key"].take(place(before)),
                rows["key"].take(place(until)),
                pa.array(is_low, pa.bool_()),
                rows["said"].take(place(said)),
            ],
            names=["tree", "hash", "level", "low", "entries", "before_key", "until_key", "is_low", "said"],
        )


class Fold:
    """The pass over one task's rows; whole where these are whole trees, else their ends are open."""

    def __init__(self, algorithm: str, whole: bool, keep: bool):
        self.algorithm, self.whole, self.keep = algorithm, whole, keep
        self.open: list[Page] = []  # by falling level
        self.made = Made()

    def _give(self, page: Page, hash: str, before: int | None, until: int | None, is_low: bool) -> None:
        if self.keep or (before is None and until is None):
            self.made.page(page, hash, before, until, is_low)

    def end(self) -> None:
        """A tree's last row is through."""
        while self.open:
            page = self.open.pop()
            if not self.whole:
                self.made.single(page)
                continue
            hash, above = page.hash(self.algorithm), self.open[-1] if self.open else None
            if above:
                above.nexts[-1] = hash
            self._give(page, hash, above and above.rows[-1], None, False)

    def row(self, i: int, level: int, said: bytes, low: str | None, onward: str | None) -> None:
        """A row above the lowest level."""
        while self.open and self.open[-1].level < level:
            page = self.open.pop()
            above = self.open[-1] if self.open else None
            if above is None and not self.whole:
                self.made.single(page)
                continue
            hash = page.hash(self.algorithm)
            # Of the two bounds, the lower one's page has the pointer.
            is_low = above is None or above.level > level
            if is_low:
                low = hash
            else:
                above.nexts[-1] = hash
            self._give(page, hash, above and above.rows[-1], i, is_low)
        if not self.open or self.open[-1].level > level:
            self.open.append(Page(level, low))
        page = self.open[-1]
        page.rows.append(i)
        page.texts.append(said)
        page.nexts.append(onward)

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            start = held.num_rows if held else 0
            rows = pa.concat_batches([held, batch]) if start else batch
            self._go(rows, start)
            if self.made.heads:
                yield self.made.batch(rows)
                self.made = Made()
            held = self._hold(rows)
        self.end()
        if self.made.heads:
            yield self.made.batch(held)

    def _go(self, rows: pa.RecordBatch, start: int) -> None:
        n, said, level = rows.num_rows, rows["said"].to_pylist(), rows["level"].to_numpy()
        lows, nexts = (rows[c].to_pylist() if c in rows.schema.names else None for c in ("low", "next"))
        trees = rows["tree_text"].dictionary_encode().indices.fill_null(-1).to_numpy()
        new = np.zeros(n, bool)
        new[1:] = trees[1:] != trees[:-1]  # held rows are of the tree of the last row
        stops = [*np.flatnonzero((level > 0) | new).tolist(), n]
        i, s = start, 0
        while i < n:
            if new[i]:
                self.end()
            if level[i]:
                self.row(i, int(level[i]), said[i], lows[i] if lows else None, nexts[i] if nexts else None)
                i += 1
                continue
            while stops[s] <= i:
                s += 1
            # A run of the lowest level, where nothing hangs.
            if not self.open or self.open[-1].level:
                self.open.append(Page(0))
            self.open[-1].rows += range(i, stops[s])
            self.open[-1].texts += said[i : stops[s]]
            i = stops[s]

    def _hold(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of open pages, which get new places."""
        at, n = [r for page in self.open for r in page.rows], 0
        for page in self.open:
            page.rows = list(range(n, n + len(page.rows)))
            n += len(page.rows)
        return rows.take(pa.array(at, pa.int64()))


def folded(algorithm: str, whole: bool, keep: bool):
    """A function for mapInArrow over rows (tree, tree_text, ord unless it is the key, key, value, said, level, low, next)."""
    return lambda batches: Fold(algorithm, whole, keep).batches(batches)

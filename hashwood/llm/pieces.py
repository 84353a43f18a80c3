"""Splitting texts into the pieces that byte-level BPE treats one by one, and a bounded memo of their ids."""

from __future__ import annotations

from collections.abc import Callable

import regex

#: Pieces that a memo holds at most, some 100 MB; a full memo starts anew.
MEMO_PIECES = 400_000


class Memo:
    """Ids of pieces as little-endian unsigned 32-bit integers; resolve gets each unknown piece of a batch once."""

    def __init__(self, pattern: str, resolve: Callable[[list[str]], list[bytes]]):
        self.split = regex.compile(pattern).findall
        self.resolve, self.known = resolve, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MEMO_PIECES:
            self.known.clear()
        split = [self.split(t) for t in texts]
        unknown = list(set().union(*split).difference(self.known))
        self.known.update(zip(unknown, self.resolve(unknown) if unknown else (), strict=True))
        found = self.known.__getitem__
        return [b"".join(map(found, pieces)) for pieces in split]


def slices(texts: list[str] | list[bytes], chars: int = 1 << 21) -> list[tuple[int, int]]:
    """Ranges of texts that hold about so many characters, so that a batch of long texts isn't split up at once."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            out.append((start, i + 1))
            start, held = i + 1, 0
    return out + [(start, len(texts))] * (start < len(texts))

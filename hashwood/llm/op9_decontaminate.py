"""Benchmark decontamination by suffix arrays over shards of the training text.

A shard is some megabytes of whole documents as numbers of benchmark words; a word that no benchmark item has ends a
suffix, since no match can run over it. The shard's suffix array is sorted by doubling ranks. Every benchmark suffix,
cut to its window, is binary-searched in it, which gives all places of its verbatim matches. The longest match of a
document is the longest run of words that it shares with one text of an item it hits, by ranks that double.

The benchmark goes to the workers in blocks of BLOCK_BYTES text at most. With more than one block, documents pass once
per block, and what the passes found is carried in a written table.

Defined results: null and empty texts have no words and are never hit; items without words have no windows; items with
equal item_id count as one, and a null item_id counts as the id "null"; rows are treated one by one, so repeats and ties
stay; other columns are ignored (decontaminate() keeps them all); empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BATCH_ROWS, LOWERED, arrow_schema, as_batch, drop_written, texts, written
from .pieces import slices

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_CHARS = 4 << 20
#: Bytes to word characters in lower case; those outside of words to spaces.
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split()


class Items:
    """Distinct windows of a block of items, ready for binary search."""

    def __init__(self, rows: list[tuple[str, str]], window: int = WINDOW):
        self.window, self.numbers, self.ids = window, {}, sorted({key for key, _ in rows})
        place, found = {key: i for i, key in enumerate(self.ids)}, {}
        #: Texts of at least a window by item.
        self.long: dict[int, list[np.ndarray]] = {}
        for key, text in rows:
            item = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            for i in range(max(1, len(item) - window + 1) if item else 0):
                found.setdefault(tuple(item[i : i + window]), set()).add(place[key])
            if len(item) >= window:
                self.long.setdefault(place[key], []).append(np.array(item, np.uint32))
        self.lengths = np.array([len(w) for w in found], np.int64)
        low, high = np.zeros((len(found), window), ">u4"), np.full((len(found), window), 0xFFFFFFFF, ">u4")
        for i, w in enumerate(found):
            low[i, : len(w)] = high[i, : len(w)] = w
        self.low, self.high = as_keys(low), as_keys(high)
        self.least = int(self.lengths.min()) if len(found) else 0
        self.item_ends = np.cumsum([0, *map(len, found.values())])
        self.items = np.array([i for s in found.values() for i in sorted(s)], np.int64)


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings that sort likewise."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1] * 4}").reshape(len(rows))


def words_left(ids: np.ndarray) -> np.ndarray:
    """Words from each position up to the next 0."""
    at = np.arange(len(ids))
    return np.minimum.accumulate(np.where(ids == 0, at, len(ids))[::-1])[::-1] - at


def longest_shared(doc: np.ndarray, rows: list[np.ndarray]) -> int:
    """Words of the longest run that doc and some row have in common; a 0 is no word."""
    ids = np.concatenate([x for part in (doc, *rows) for x in (part.astype(np.int64), np.zeros(1, np.int64))])
    left, ours, ranks = words_left(ids), np.arange(len(ids)) < len(doc), ids

    def keys(size: int, half: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions that begin so many words, and what tells these apart: the ranks of their first and last half words."""
        place = np.flatnonzero(left >= size)
        return place, ranks[place] << 32 | ranks[place + size - half]

    def shared(size: int, half: int) -> bool:
        place, key = keys(size, half)
        return bool(np.isin(key[ours[place]], key[~ours[place]]).any())

    if not shared(1, 1):
        return 0
    low = 1
    while shared(2 * low, low):
        place, key = keys(2 * low, low)
        ranks = np.zeros(len(ids), np.int64)
        ranks[place] = np.unique(key, return_inverse=True)[1]
        low *= 2
    half, high = low, 2 * low
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if shared(middle, half) else (low, middle)
    return low


def suffix_array(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes of at least so many words, sorted, and the words left at each position up to the next 0."""
    n = len(ids)
    left = words_left(ids)
    begins = np.flatnonzero((ids != 0) & (np.concatenate([[0], ids[:-1]]) == 0))
    in_long = np.zeros(n + 1, np.int64)
    long = begins[left[begins] >= least]
    in_long[long] += 1
    in_long[long + left[long]] -= 1
    place = np.flatnonzero(np.cumsum(in_long[:n]))
    if not len(place):
        return place, left
    rank = np.zeros(n, np.int64)
    rank[place] = ids[place]
    held, most = 1, int(left[place].max())
    while held < most:
        on = left[place] > held
        after = np.zeros(len(place), np.int64)
        after[on] = rank[place[on] + held]
        distinct, inverse = np.unique(rank[place] << 32 | after, return_inverse=True)
        rank[place] = inverse + 1
        held *= 2
        if len(distinct) == len(place):
            break
    place = place[left[place] >= least]
    return place[np.argsort(rank[place], kind="stable")], left


def search(items: Items, docs: list[list[bytes]], measure: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Per document: which words are hit, the items found (places in items.ids), words in the longest match if measured."""
    number = items.numbers.get
    ids = np.fromiter((number(w, 0) for doc in docs for w in (*doc, b"")), np.int64)
    starts = np.cumsum([0, *(len(d) + 1 for d in docs)])
    suffixes, left = suffix_array(ids, items.least) if items.least else (np.zeros(0, np.int64), ids)
    if not len(suffixes):
        yield from ((np.zeros(len(d), bool), np.zeros(0, np.int64), 0) for d in docs)
        return
    offset = np.arange(items.window)
    rows = ids[np.minimum(suffixes[:, None] + offset, len(ids) - 1)]
    rows[offset >= left[suffixes][:, None]] = 0
    keys = as_keys(rows.astype(">u4"))
    low, high = np.searchsorted(keys, items.low, "left"), np.searchsorted(keys, items.high, "right")
    window = np.repeat(np.arange(len(low)), high - low)
    place = suffixes[np.arange(len(window)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[window]]
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + items.lengths[window], -1)
    hit = np.cumsum(cover[:-1]) > 0
    doc = np.searchsorted(starts, place, "right") - 1
    pairs = np.unique(np.stack([doc, window], 1), axis=0)
    sizes = np.diff(items.item_ends)[pairs[:, 1]]
    which = items.items[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(items.item_ends[pairs[:, 1]], sizes)]
    found = np.unique(np.stack([np.repeat(pairs[:, 0], sizes), which], 1), axis=0)
    bounds, windows = (np.searchsorted(x[:, 0], np.arange(len(docs) + 1)) for x in (found, pairs))
    for i, d in enumerate(docs):
        mask = hit[starts[i] : starts[i] + len(d)]
        longest = 0
        if measure and bounds[i] < bounds[i + 1]:
            longest = int(items.lengths[pairs[windows[i] : windows[i + 1], 1]].max())
            runs = np.array(runs_of(mask))
            # Only items of at least a window go on behind it, and no match is longer than the words hit around it.
            if longest == items.window < (runs[1::2] - runs[::2]).max():
                rows = [x for j in found[bounds[i] : bounds[i + 1], 1] for x in items.long.get(int(j), ())]
                longest = longest_shared(np.where(mask, ids[starts[i] : starts[i] + len(d)], 0), rows)
        yield mask, found[bounds[i] : bounds[i + 1], 1], longest


def item_blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Items with text in blocks of bounded size; the driver holds one partition and one block at a time."""
    block, size = [], 0
    for key, text in benchmark.select("item_id", "text").toLocalIterator():
        if text:
            block.append(("null" if key is None else str(key), text))
            size += len(text.encode("utf-8", "surrogatepass")) + 64
            if size >= limit:
                yield block
                block, size = [], 0
    if block:
        yield block


def shards(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in batches:
        strings = texts(batch.column(text_at))
        for a, b in slices(strings, SHARD_CHARS):
            yield batch.slice(a, b - a), [words(t) for t in strings[a:b]]


def _compiled(cache: dict, broadcast) -> Items:
    if "items" not in cache:
        cache["items"] = Items(broadcast.value)
    return cache["items"]


def runs_of(mask: np.ndarray) -> list[int]:
    """Starts and ends, in turn, of the runs of true values."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()


def mask_of(runs: list[int] | None, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for a, b in zip((runs or [])[::2], (runs or [])[1::2], strict=True):
        out[a:b] = True
    return out


def _pass(docs: DataFrame, block: list, last: bool) -> DataFrame:
    """docs: doc_id, text, runs, items, longest as found so far."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    broadcast, cache = spark.sparkContext.broadcast(block), {}
    ddl = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, hit_runs array<int>" if last else "doc_id long, text string, runs array<int>, items array<string>, longest int"
    schema = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, docs in shards(batches, 1):
            items, out = _compiled(cache, broadcast), {f.name: [] for f in schema}
            before = [batch.column(i).to_pylist() for i in (2, 3, 4)]
            for doc, found, runs, had, longest in zip(docs, search(items, docs), *before, strict=True):
                mask, keys = found[0] | mask_of(runs, len(doc)), sorted({*(had or ()), *(items.ids[i] for i in found[1])})
                longest = max(longest or 0, found[2])
                if last:
                    row = {"n_words": len(doc), "n_hit": int(mask.sum()), "n_items": len(keys), "items_sha256": hashlib.sha256(",".join(keys).encode()).hexdigest(), "contaminated": bool(mask.any()), "longest_match": longest, "hit_runs": runs_of(mask)}
                else:
                    row = {"runs": runs_of(mask), "items": keys, "longest": longest}
                for k, v in row.items():
                    out[k].append(v)
            yield as_batch(out | {"doc_id": batch.column(0)} | ({} if last else {"text": batch.column(1)}), schema)

    return docs.mapInArrow(run, ddl)


def scan(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, words hit, items found, whether any; the runs of hit words and the longest too."""
    state = docs.selectExpr("doc_id", "text", "cast(null as array<int>) runs", "cast(null as array<string>) items", "0 longest")
    block: list = []
    for more in item_blocks(benchmark, block_bytes):
        if block:
            before, state = state, written(_pass(state, block, False), "decontaminate")
            if before is not docs and before.inputFiles() and "decontaminate-" in before.inputFiles()[0]:
                drop_written(before)
        block = more
    return _pass(state, block, True)


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of a benchmark item occurs, with all their columns."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    at = docs.columns.index("text")
    for block in item_blocks(benchmark, block_bytes):
        broadcast = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], broadcast=broadcast, cache={}) -> Iterator[pa.RecordBatch]:  # noqa: B006
            for batch, words_of in shards(batches, at):
                clean = [not mask.any() for mask, _, _ in search(_compiled(cache, broadcast), words_of, measure=False)]
                if any(clean):
                    yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


SQL = rf"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS MATERIALIZED (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(1, len(w) - 9)::BIGINT + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS words
    FROM items WHERE len(w) > 0
), sizes AS (
    SELECT DISTINCT size FROM windows
), places AS (
    SELECT row_no, size, unnest(range(1, len(w) - size + 2)) AS place, w FROM docs JOIN sizes ON len(w) >= size
), hits AS MATERIALIZED (
    SELECT p.row_no, p.place, p.size, x.item_id FROM (SELECT row_no, size, place, array_to_string(w[place:place + size - 1], ' ') AS words FROM places) p JOIN windows x ON x.words = p.words AND x.size = p.size
), covered AS (
    SELECT row_no, count(DISTINCT pos) AS n_hit FROM (SELECT row_no, unnest(range(place, place + size)) AS pos FROM hits) GROUP BY row_no
), found AS (
    SELECT row_no, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row_no, item_id FROM hits) GROUP BY row_no
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (row_no) LEFT JOIN found USING (row_no)
"""

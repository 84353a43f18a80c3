"""Removal of long repeated byte strings by suffix arrays over shards.

A whole corpus has no one suffix array here. Anchors (anchors.py) deal it out instead: equal strings of LENGTH bytes have
equal anchors at equal places, so whatever repeats meets in one shard, and an anchor that occurs once needs no more. An
occurrence whose whole surroundings occur again is settled by their hashes. What is left, anchors with different
surroundings at most FEW of them, goes to shards of about SHARD_BYTES: a shard keeps the stretches whose inner part
occurs twice, sorts their suffixes by induction (suffix.py), computes common prefixes in the order of the text, and finds
the strings of LENGTH bytes that begin in two places. An anchor with more surroundings than FEW is no shard of its own:
there each string of LENGTH bytes goes by a 128-bit hash into one aggregate, which combines before it shuffles.

Defined results: a null or empty text has no bytes; a text of fewer bytes than LENGTH loses none; equal texts of LENGTH
bytes or more lose all; a very long one is one text, and its anchors' surroundings meet those of others; rows that repeat
a doc_id are texts of their own; a null doc_id is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, LENGTH, Hashes, anchors
from .common import BATCH_ROWS, arrow_schema, as_batch, drop_written, mapped, mapped_texts, written
from .pieces import slices
from .suffix import common_words, suffix_array

#: Surroundings of one anchor that a shard takes: 4 MB of them, for which it needs some 300 MB.
FEW = (4 << 20) // (2 * LENGTH - GRAM)
SHARD_BYTES = 1 << 20
#: Bytes of text whose anchors are looked for at once; some 150 times as much memory.
PASS_BYTES = 1 << 20
#: Places of strings around an anchor that a shard looks at together.
STEP = 20
_U = np.uint64


def _raw(column: pa.Array) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_hash; a row is found by the first and last, whatever texts share a doc_id."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def _by_row(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """rows with what was found for their (doc_id, text_hash), one row each."""
    other = found.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    return rows.join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), how).drop("_id", "_hash")


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans in order that cover the same places."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[first, 0], reach[np.concatenate([first[1:], [True]])]], 1)


def occurrences(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, spans that its own anchors settle, and one occurrence of each (gram, surroundings) with whether there are more in the text."""

    def rows(batch: pa.RecordBatch) -> dict:
        raw = _raw(batch.column(1))
        out = {k: [] for k in ("own", "places", "grams", "arounds", "more")}
        for a, b in slices(raw, PASS_BYTES):
            for k, v in part(raw[a:b]).items():
                out[k] += v
        return out | {"doc_id": batch.column(0), "text_hash": batch.column(2), "n": [len(x) for x in raw]}

    def part(raw: list[bytes]) -> dict:
        starts = np.cumsum([0, *map(len, raw)])
        place, gram, around, low, high = anchors(np.frombuffer(b"".join(raw), np.uint8), starts)
        doc = np.searchsorted(starts, place, "right") - 1
        bounds = np.searchsorted(doc, np.arange(len(raw) + 1))
        out = {k: [] for k in ("own", "places", "grams", "arounds", "more")}
        for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            order = a + np.lexsort((place[a:b], around[a:b], gram[a:b]))
            first = np.ones(len(order), bool)
            first[1:] = (gram[order[1:]] != gram[order[:-1]]) | (around[order[1:]] != around[order[:-1]])
            several = ~first | ~np.concatenate([first[1:], [True]])
            own = order[several]
            once = order[first]
            out["own"].append(merged(np.stack([low[own], high[own]], 1) - starts[i]).reshape(-1))
            out["places"].append(place[once] - starts[i])
            out["grams"].append(gram[once].astype(np.int64))
            out["arounds"].append(around[once].astype(np.int64))
            out["more"].append(several[first])
        return out

    return mapped_texts(_keyed(docs), rows, "doc_id long, text_hash long, n int, own array<int>, places array<int>, grams array<long>, arounds array<long>, more array<boolean>")


def _classes(gram: np.ndarray, first: Hashes, second: Hashes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers for stretches, alike for those of equal gram and bytes."""
    a, b = first(start, end) ^ gram.astype(_U), second(start, end) + gram.astype(_U)
    order = np.lexsort((b, a))
    new = np.concatenate([[False], (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])])[: len(order)]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _shard(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of repeated strings. rows: gram, occurrence key, place, start of the surroundings, bytes, whether settled."""
    sizes = np.array([len(r[4]) for r in rows])
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    gram = np.array([r[0] for r in rows])
    anchor = np.array([r[2] - r[3] for r in rows])  # within the surroundings
    settled = np.array([r[5] for r in rows])
    begin = np.array([r[3] for r in rows])
    first, second = Hashes(raw, 0), Hashes(raw, 1)
    stretches = []
    for a in range(GRAM - LENGTH, 1, STEP):
        b = min(a + STEP - 1, 0)
        low, high = np.maximum(anchor + a, 0), np.minimum(anchor + b, sizes - LENGTH)
        on = np.flatnonzero(low <= high)
        # All strings that begin from low to high share the inner part; if that occurs nowhere else, none of them does.
        inner = _classes(gram[on], first, second, starts[on] + anchor[on] + b, starts[on] + anchor[on] + a + LENGTH)
        # If the whole occurs elsewhere, all of them do. The place of the anchor in it tells where they begin.
        whole = _classes(gram[on] * 1000 + (anchor[on] - low[on]), first, second, starts[on] + low[on], starts[on] + high[on] + LENGTH)
        again = np.bincount(whole)[whole] > 1
        for i in on[again & ~settled[on]]:
            yield int(i), int(begin[i] + low[i]), int(begin[i] + high[i]) + LENGTH
        # One of each kind goes on, where an inner part has several kinds.
        one = np.unique(whole, return_index=True)[1]
        one = on[one[np.bincount(inner[one])[inner[one]] > 1]]
        stretches.append(np.stack([one, low[one], high[one]], 1))
    spans = np.concatenate(stretches)
    if not len(spans):
        return
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    opens = np.concatenate([[True], (spans[1:, 0] != spans[:-1, 0]) | (spans[1:, 1] > spans[:-1, 2] + 1)])
    spans = np.stack([spans[opens, 0], spans[opens, 1], spans[np.concatenate([opens[1:], [True]]), 2] + LENGTH], 1)
    row, low, high = spans.T
    length = high - low
    at = np.cumsum(length + 1) - (length + 1)
    # 0 closes each stretch; a text's own 0 bytes become 255, which UTF-8 never has.
    text = np.zeros(int((length + 1).sum()), np.uint8)
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    text[np.repeat(at, length) + inside] = raw[np.repeat(starts[row] + low, length) + inside]
    text[np.repeat(at, length) + inside] += (text[np.repeat(at, length) + inside] == 0) * np.uint8(255)
    array = suffix_array(text)
    same = common_words(text, array, LENGTH // 8) >= LENGTH // 8
    # Where each suffix is in the corpus: stretches of one text may overlap.
    keys = np.unique(np.array([r[1] for r in rows]), return_inverse=True)[1]
    stretch = np.repeat(np.arange(len(row)), length + 1)
    offset = np.arange(len(text)) - at[stretch]
    where = (keys[row[stretch]].astype(np.int64) << 40) + begin[row[stretch]] + low[stretch] + offset
    on = np.flatnonzero(offset + LENGTH <= length[stretch])
    among = np.zeros(len(text), bool)
    among[on] = True
    ordered = array[among[array]]
    group = np.cumsum(~same[ordered]) - 1 if len(ordered) and not same[ordered[0]] else np.cumsum(~same[ordered])
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    spread = np.minimum.reduceat(where[ordered], heads) != np.maximum.reduceat(where[ordered], heads)
    repeated = ordered[np.repeat(spread, np.diff(np.append(heads, len(ordered))))]
    repeated = np.sort(repeated[~settled[row[stretch[repeated]]]])
    found_row = row[stretch[repeated]]
    found = begin[found_row] + low[stretch[repeated]] + offset[repeated]
    if len(found):
        new = np.concatenate([[True], (found_row[1:] != found_row[:-1]) | (found[1:] > found[:-1] + 1)])
        ends = np.append(np.flatnonzero(new)[1:] - 1, len(found) - 1)
        for r, a, b in zip(found_row[new], found[new], found[ends], strict=True):
            yield int(r), int(a), int(b) + LENGTH


def _shards(contexts: DataFrame) -> DataFrame:
    """uid, start, end of strings that occur again, from (gram, uid, place, low, bytes, settled) of anchors with few surroundings."""
    ddl = "uid long, start int, end int"
    spark = contexts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    schema = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            found = [(held[r][1], a, b) for r, a, b in _shard(held)]
            return as_batch(dict(zip(schema.names, map(list, zip(*found, strict=True)), strict=True)) if found else {k: [] for k in schema.names}, schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield done()

    return contexts.select("gram", "uid", "place", "low", "bytes", "settled").repartition("gram").sortWithinPartitions("gram").mapInArrow(run, ddl)


def _strings(contexts: DataFrame) -> DataFrame:
    """Two hashes of every string around each anchor, for anchors with many surroundings."""

    def rows(batch: pa.RecordBatch) -> dict:
        sizes = np.array([len(x) for x in batch.column(2).to_pylist()])
        starts = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8)
        counts = sizes - LENGTH + 1
        of = np.repeat(np.arange(len(sizes)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = starts[of] + offset
        take = lambda i: np.array(batch.column(i))[of]
        hashes = [Hashes(raw, k)(at, at + LENGTH).astype(np.int64) for k in (0, 1)]
        return {"uid": take(0), "start": take(1) + offset, "a": hashes[0], "b": hashes[1], "settled": take(3)}

    return mapped(contexts.select("uid", "low", "bytes", "settled"), rows, "uid long, start int, a long, b long, settled boolean")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the spans (starts and ends in turn, disjoint) of strings that begin elsewhere too; texts without any are left out."""
    docs = docs.select("doc_id", "text")
    seen = written(occurrences(docs).withColumn("uid", F.monotonically_increasing_id()), "occurrences")
    each = seen.select("uid", F.explode(F.arrays_zip("places", "grams", "arounds", "more")).alias("x")).select("uid", "x.places", "x.grams", "x.arounds", "x.more").toDF("uid", "place", "gram", "around", "more")
    # Both sides combine or are split by size: a gram of many occurrences is no task of its own.
    shared = each.groupBy("gram").agg(F.count("*").alias("c"), F.max("more").alias("m")).where("c > 1 or m").select("gram")
    found = written(each.join(shared, "gram"), "shared", release=True)
    keys = written(seen.select("uid", "doc_id", "text_hash", "n", "own"), "keys")
    drop_written(seen)  # most of its anchors occur once
    kinds = written(found.groupBy("gram", "around").agg(F.expr("count(*) > 1 or max(more)").alias("settled"), F.min(F.struct("uid", "place")).alias("one")), "kinds")
    settled = written(found.join(kinds.where("settled").select("gram", "around"), ["gram", "around"]).selectExpr("uid", f"place - {LENGTH - GRAM} start", f"place + {LENGTH} end"), "settled", release=True)
    drop_written(found)
    sizes = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = kinds.join(sizes, "gram").select(F.col("one.uid").alias("uid"), F.col("one.place").alias("place"), "gram", "settled", F.expr(f"kinds > {FEW}").alias("many"))
    by_text = wanted.groupBy("uid").agg(F.collect_list(F.struct("place", "gram", "settled", "many")).alias("wanted")).join(keys.drop("n", "own"), "uid")

    ddl = "gram long, uid long, place int, low int, bytes binary, settled boolean, many boolean"
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    schema = arrow_schema(spark, ddl)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = {f.name: [] for f in schema}, 0
        for batch in batches:
            for text, uid, places in zip(*batch.columns, strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for x in places.as_py():
                    low = max(0, x["place"] - (LENGTH - GRAM))
                    row = {"gram": x["gram"], "uid": uid.as_py(), "place": x["place"], "low": low, "bytes": raw[low : x["place"] + LENGTH], "settled": x["settled"], "many": x["many"]}
                    for k, v in row.items():
                        out[k].append(v)
                    size += len(row["bytes"])
                if size >= SHARD_BYTES:
                    yield as_batch(out, schema)
                    out, size = {f.name: [] for f in schema}, 0
        yield as_batch(out, schema)

    # Of rows that come again only the first uid has kinds of surroundings; what its copies bring is the same place again.
    texts = _by_row(_keyed(docs), by_text, "inner").select("text", "uid", "wanted")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "128")  # these are the longer texts, with long arrays
    contexts = written(texts.mapInArrow(cut, ddl), "contexts", release=True)
    few = written(_shards(contexts.where("not many")), "few", release=True)
    strings = written(_strings(contexts.where("many")), "strings")
    # One place can come by several anchors: only another one counts.
    ends = [f(k).alias(f"{name}_{k}") for k in ("uid", "start") for name, f in (("lo", F.min), ("hi", F.max))]
    again = strings.groupBy("a", "b").agg(*ends, F.max("settled").alias("s")).where("lo_uid < hi_uid or lo_start < hi_start or s").select("a", "b")
    many = written(strings.where("not settled").join(again, ["a", "b"]).selectExpr("uid", "start", f"start + {LENGTH} end"), "many", release=True)
    for table in (contexts, strings):
        drop_written(table)
    own = keys.where("size(own) > 0").select("uid", F.expr("inline(transform(sequence(0, size(own) div 2 - 1), i -> struct(own[2 * i] as start, own[2 * i + 1] as end)))"))
    spans = settled.union(few).union(many).union(own)
    gathered = spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans")).join(keys.drop("own"), "uid")

    def join_spans(batch: pa.RecordBatch) -> dict:
        out = []
        for spans, n in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            pairs = np.stack([np.array(spans.values.field(k)) for k in (0, 1)], 1)
            out.append(merged(np.clip(pairs, 0, n)).reshape(-1))
        return {"doc_id": batch.column(0), "text_hash": batch.column(1), "spans": out}

    result = written(mapped(gathered.select("doc_id", "text_hash", "spans", "n"), join_spans, "doc_id long, text_hash long, spans array<int>").dropDuplicates(["doc_id", "text_hash"]), "spans", release=True)
    for table in (keys, settled, kinds, few, many):
        drop_written(table)
    return result


def _kept(raw: bytes, spans: list[int]) -> bytes:
    bounds = [0, *spans, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))


def _with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and the spans of it that go."""
    return _by_row(_keyed(docs), repeated_spans(docs), "left").select("doc_id", "text", "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and the text without its repeated strings; a character cut in two becomes U+FFFD."""

    def rows(batch: pa.RecordBatch) -> dict:
        raw = _raw(batch.column(1))
        return {"doc_id": batch.column(0), "text": [_kept(x, s or []).decode("utf-8", "replace") for x, s in zip(raw, batch.column(2).to_pylist(), strict=True)]}

    return mapped_texts(_with_spans(docs), rows, "doc_id long, text string")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def rows(batch: pa.RecordBatch) -> dict:
        raw = _raw(batch.column(1))
        spans = [s or [] for s in batch.column(2).to_pylist()]
        return {"doc_id": batch.column(0), "n_bytes": [len(x) for x in raw], "n_removed": [sum(s[1::2]) - sum(s[::2]) for s in spans], "n_spans": [len(s) // 2 for s in spans], "kept_sha256": [hashlib.sha256(_kept(x, s)).hexdigest() for x, s in zip(raw, spans, strict=True)]}

    return mapped_texts(_with_spans(docs), rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


SQL = """
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS row_no, doc_id, encode(coalesce(text, '')) AS raw FROM documents
), places AS (
    SELECT row_no, pos, md5(raw[pos:pos + 199]) AS h FROM (SELECT row_no, raw, unnest(range(1, octet_length(raw) - 198)) AS pos FROM docs)
), repeated AS (
    SELECT row_no, pos FROM (SELECT row_no, pos, count(*) OVER (PARTITION BY h) AS n FROM places) WHERE n > 1
), islands AS (
    SELECT row_no, pos, sum(is_new::INT) OVER (PARTITION BY row_no ORDER BY pos) AS island
    FROM (SELECT row_no, pos, coalesce(pos > lag(pos) OVER (PARTITION BY row_no ORDER BY pos) + 200, true) AS is_new FROM repeated)
), spans AS (
    SELECT row_no, min(pos) AS first, max(pos) + 200 AS past FROM islands GROUP BY row_no, island
), gaps AS (
    SELECT row_no, coalesce(lag(past) OVER (PARTITION BY row_no ORDER BY first), 1) AS low, first AS high FROM spans
    UNION ALL SELECT d.row_no, coalesce(max(s.past), 1), octet_length(d.raw) + 1 FROM docs d LEFT JOIN spans s USING (row_no) GROUP BY d.row_no, d.raw
), kept AS (
    SELECT row_no, unhex(string_agg(hex(CASE WHEN high > low THEN raw[low:high - 1] ELSE ''::BLOB END), '' ORDER BY low)) AS rest FROM gaps JOIN docs USING (row_no) GROUP BY row_no
), sums AS (
    SELECT row_no, sum(past - first) AS n_removed, count(*) AS n_spans FROM spans GROUP BY row_no
)
SELECT doc_id, octet_length(raw)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(rest) AS kept_sha256
FROM docs JOIN kept USING (row_no) LEFT JOIN sums USING (row_no)
"""

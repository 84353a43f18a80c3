"""Near-duplicate documents by HyperMinHash sketches, confirmed on full shingle sets.

A document's set is its distinct word shingles as 64-bit hashes. The hash's top bits choose one of 256 buckets; a
bucket's least hash is stored as its count of leading zeros and ten mantissa bits. An empty bucket holds the least value
of its own hash function instead, so that sets of any size agree in a bucket with the probability of their similarity.
Equal sets form classes. Bands of registers propose links between classes, the collision-corrected estimate drops the
unlikely ones, and the rest are confirmed on full sets.

A band's bucket may hold thousands of classes, so its pairs are never listed. First each class meets the least class of
its buckets. Components of the confirmed links follow. Classes of a bucket with several components may still have links
that weren't tried. For these, a prefix of the rarest shingles of each set, so long that two linked sets must share one,
tells which could be linked at all; holders of a shingle whose estimate allows a link across components are put into one
cluster, which takes one row for each holder. Each cluster is then settled once on full sets: members outside of its
largest component meet all others in blocks of bounded size, and only links come out, one for every two components.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of fewer
words than a shingle is one shingle; a very long text has a large set, which is held whole, as one row; equal texts are
linked; rows that repeat a doc_id get a result each, by their text; a null doc_id takes no part and stays; other columns
are ignored by near_duplicates() and kept by keep_one(), whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, LOWERED, arrow_schema, as_batch, drop_written, mapped, mapped_texts, only, texts, written
from .components import components

BUCKETS, MANTISSA = 256, 10
BAND_ROWS = 5
BANDS = BUCKETS // BAND_ROWS
#: Two unequal least hashes agree in leading zeros and mantissa about so often.
COLLISION = 2.0**-MANTISSA / 3
#: An estimate so many standard deviations below the threshold is still confirmed on full sets.
SIGMAS = 5
MEMO_WORDS = 150_000
#: Sketches, and shingles of full sets, that a block holds; a group is two blocks.
BLOCK_SKETCHES, BLOCK_SHINGLES = 500, 1 << 19
#: Tasks at most that share a bucket or shingle where its members meet what is known of it.
SALTS = 16
_U = np.uint64
_WORDS: dict[bytes, int] = {}
_STARTS = np.arange(BUCKETS, dtype=_U) << _U(56)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit moves all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_GOLDEN = 0x9E3779B97F4A7C15
_FACTORS = mixed(np.arange(1, BUCKETS + 1, dtype=_U) * _U(_GOLDEN)) | _U(1)
_ADDENDS = mixed(np.arange(BUCKETS + 1, 2 * BUCKETS + 1, dtype=_U) * _U(_GOLDEN))


def shingles(text: str, size: int) -> np.ndarray:
    """Distinct shingle hashes in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, _U)
    only("op8", _WORDS.clear)
    if len(_WORDS) > MEMO_WORDS:
        _WORDS.clear()
    known, hashes = _WORDS, []
    for w in words:
        if (h := known.get(w)) is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    values = np.array(hashes, _U)
    size = min(size, len(values))
    n = len(values) - size + 1
    out = np.full(n, size, _U)
    for i in range(size):
        out = mixed(out * _U(_GOLDEN) + values[i : i + n])
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set: leading zeros, then mantissa, in 16 bits each."""
    if not len(hashes):
        return np.zeros(BUCKETS, np.uint16)
    at = np.minimum(np.searchsorted(hashes, _STARTS), len(hashes) - 1)
    least = hashes[at]
    full = least >> _U(56) == np.arange(BUCKETS, dtype=_U)
    values = least << _U(8)
    empty = np.flatnonzero(~full)
    if len(empty):
        values[empty] = _U(0xFFFFFFFFFFFFFFFF)
        for start in range(0, len(hashes), 4096):
            part = mixed(hashes[start : start + 4096] * _U(_GOLDEN))
            values[empty] = np.minimum(values[empty], (part[None, :] * _FACTORS[empty, None] + _ADDENDS[empty, None]).min(axis=1))
    # A float's exponent and first mantissa bits are the leading zeros and what follows the first one.
    bits = (values >> _U(11)).astype(np.float64).view(_U) >> _U(52 - MANTISSA)
    zeros = np.clip(1023 + 52 - (bits >> _U(MANTISSA)).astype(np.int64), 0, 63)
    return ((zeros << MANTISSA) | (bits & _U((1 << MANTISSA) - 1)).astype(np.int64)).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key per band for each row of registers."""
    used = registers[:, : BANDS * BAND_ROWS].reshape(len(registers), BANDS, BAND_ROWS).astype(_U)
    out = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=_U) * _U(_GOLDEN)), used.shape[:2])
    for i in range(BAND_ROWS):
        out = mixed(out * _U(_GOLDEN) + used[:, :, i])
    return out.astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of rows of registers, corrected for accidental agreement."""
    return np.maximum(0, ((a == b).mean(axis=-1) - COLLISION) / (1 - COLLISION))


def least_estimate(share: float) -> float:
    return share - SIGMAS * (share * (1 - share) / BUCKETS) ** 0.5


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BUCKETS)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n (size of the set), set_key (128 bits of the set), registers; the last two null for an empty set."""

    def rows(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, size) for t in texts(batch.column(1))]
        return {"doc_id": batch.column(0), "text_hash": batch.column(2), "n": [len(s) for s in sets], "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "registers": [sketch(s).astype("<u2").tobytes() if len(s) else None for s in sets]}

    return mapped_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), rows, "doc_id long, text_hash long, n long, set_key binary, registers binary")


def _bands(classes: DataFrame) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> dict:
        keys = band_keys(_registers(batch.column(1)))
        return {"node": np.repeat(np.array(batch.column(0)), BANDS), "band_key": keys.reshape(-1)}

    return mapped(classes.select("node", "registers"), rows, "node long, band_key long")


def _likely(pairs: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sizes and estimate allow a link."""
    one, two = (members.select("node", "n", "registers").toDF(k, f"n_{k}", f"r_{k}") for k in "ab")
    both = pairs.join(one, "a").join(two, "b").where(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)")
    least = least_estimate(num / den)

    def rows(batch: pa.RecordBatch) -> dict:
        on = pa.array(np.flatnonzero(estimate(_registers(batch.column(2)), _registers(batch.column(3))) >= least))
        return {"a": batch.column(0).take(on), "b": batch.column(1).take(on)}

    return mapped(both.select("a", "b", "r_a", "r_b"), rows, "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one, two = sets.toDF("a", "items_a"), sets.toDF("b", "items_b")
    # The set of b travels to a; nothing here needs an a's rows together, so that one with many partners can be split.
    joined = pairs.join(two, "b").join(one, "a")
    counted = joined.selectExpr("a", "b", "size(array_intersect(items_a, items_b)) common", "size(items_a) + size(items_b) total")
    return counted.where(f"{den}L * common >= {num}L * (total - common)").select("a", "b")


def _sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """node and items, the whole set, of the members' first documents."""

    def rows(batch: pa.RecordBatch) -> dict:
        return {"node": batch.column(0), "items": [shingles(t, size).astype(np.int64) for t in texts(batch.column(1))]}

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    heads = members.select("head.doc_id", "head.text_hash", "node")
    return mapped_texts(keyed.join(heads, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("node", "text"), rows, "node long, items array<long>")


def _prefixes(shared: DataFrame, labels: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(key, node): rare shingles that each class of an undecided bucket must share with any class it is linked to.

    Of two sets with enough in common, the shorter prefix rule holds for both: all but num/den of a set's shingles, and
    one more, rarest first. Shingles that no other undecided class has count, but can't be shared.
    """
    parts = _in_components(shared, labels)
    open_keys = parts.groupBy("band_key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band_key")
    undecided = _met(parts, open_keys, "band_key").select("node").distinct()
    each = sets.join(undecided, "node").select("node", F.size("items").alias("n"), F.explode("items").alias("key"))
    common = each.groupBy("key").agg(F.count("*").alias("holders")).where("holders > 1")
    held = each.join(common, "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("holders", "key"))).alias("found"))
    # A set of n must share at least num * n / den, so a prefix is n - ceil(num * n / den) + 1; its unshared ones come first.
    length = f"n - cast(({num}L * n + {den - 1}) div {den} as int) + 1 - (n - size(found))"
    return held.selectExpr("node", f"explode(slice(found, 1, greatest(0, {length}))) x").selectExpr("x.key", "node")


def _met(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows of nodes with what is known of their keys, one row each; SALTS tasks share the rows of a key."""
    salted = rows.withColumn("salt", F.expr(f"pmod(xxhash64(node), {SALTS})"))
    return salted.join(known.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))), [key, "salt"]).drop("salt")


def _in_components(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with a component; a node without a link is its own."""
    return rows.join(labels, "node", "left").withColumn("component", F.expr("coalesce(component, node)"))


def _dealt(members: DataFrame, weight: str, limit: int) -> DataFrame:
    """Rows (key, x, y, block, node, component) of keys with several components; (x, y) is a group of two blocks.

    Members outside of a key's largest component are compared with all others, those inside of it only with them. Blocks
    hold a weight of about limit, so no group grows with a key; rows grow with the members and, where these are many, with
    those outside times the blocks inside.
    """
    parts = members.groupBy("key", "component").agg(F.sum(F.expr(weight)).alias("w"))
    keys = parts.groupBy("key").agg(F.max(F.struct("w", "component")).alias("most"), F.sum("w").alias("w")).where("most.w < w")
    sized = keys.selectExpr("key", "most.component main", f"cast(ceil((w - most.w) / {limit}) as int) apart", f"cast(ceil(most.w / {limit}) as int) inside")
    rows = _met(members, sized, "key").selectExpr("key", "node", "component", "apart", "inside", "component = main AS is_main", "cast(if(component = main, apart + pmod(xxhash64(node), inside), pmod(xxhash64(node), apart)) as int) block")
    met = rows.withColumn("other", F.explode(F.expr("sequence(0, if(is_main, apart, apart + inside) - 1)")))
    return met.selectExpr("key", "least(block, other) x", "greatest(block, other) y", "block", "node", "component")


def _grouped(rows: DataFrame, made: Callable[[pa.Table], tuple[list, list]]) -> DataFrame:
    """Pairs (a, b) that made finds in each group of (key, x, y)."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    schema = arrow_schema(spark, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def done() -> pa.RecordBatch:
            a, b = made(pa.Table.from_batches(parts).combine_chunks())
            return as_batch({"a": a, "b": b}, schema)

        for batch in batches:
            keys = np.stack([np.array(c) for c in batch.columns[:3]], 1).astype(np.int64)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(starts, starts[1:], strict=False):
                if i < j:
                    if parts and tuple(keys[i]) != now:
                        yield done()
                        parts = []
                    now = tuple(keys[i])
                    parts.append(batch.slice(i, j - i))
        if parts:
            yield done()

    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long")


def _across(group: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member of a group's first block, those of the second that a link is likely to, and a label for each member.

    A label tells a component apart; the caller joins them. Of a pair within one block each comes once.
    """
    blocks, registers = np.array(group["block"]), _registers(group["registers"])
    labels = np.unique(np.array(group["component"]), return_inverse=True)[1]
    x, y = blocks == blocks.min(), blocks == blocks.max()
    later = np.arange(len(blocks))
    for i in np.flatnonzero(x):
        others = np.flatnonzero(y & (labels != labels[i]) & ((later > i) | ~x))
        if len(others):
            yield i, others[estimate(registers[others], registers[i]) >= least], labels


def _clusters(prefixes: DataFrame, members: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """node and key, its cluster: classes joined by likely links between components."""
    least = least_estimate(num / den)

    def made(group: pa.Table) -> tuple[list, list]:
        nodes, out = np.array(group["node"]), ([], [])
        tree = np.arange(len(nodes))
        for i, others, _ in _across(group, least):
            apart, first = np.unique(tree[others], return_index=True)
            new = first[apart != tree[i]]
            out[0].extend([nodes[i]] * len(new))
            out[1].extend(nodes[others[new]])
            tree[np.isin(tree, apart)] = tree[i]
        return out

    dealt = _dealt(_in_components(prefixes, labels), "1L", BLOCK_SKETCHES)
    edges = written(_grouped(dealt.join(members.select("node", "registers"), "node").select("key", "x", "y", "block", "node", "component", "registers"), made).distinct(), "edges", release=True)
    return components(edges).withColumnRenamed("component", "key")


def _links_across(clusters: DataFrame, members: DataFrame, sets: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between components of a cluster, confirmed on full sets; of two components' links in a group one is enough."""
    least = least_estimate(num / den)

    def made(group: pa.Table) -> tuple[list, list]:
        nodes, out = np.array(group["node"]), ([], [])
        items = group["items"].combine_chunks()
        bounds, flat = items.offsets.to_numpy(), items.values.to_numpy()
        distinct, places = np.unique(flat[bounds[0] : bounds[-1]], return_inverse=True)
        places = [places[p - bounds[0] : q - bounds[0]] for p, q in zip(bounds, bounds[1:], strict=False)]
        mark = np.zeros(len(distinct), bool)
        for i, others, part in _across(group, least):
            mark[places[i]] = True
            for j in others:
                if part[i] != part[j]:
                    common = int(np.count_nonzero(mark[places[j]]))
                    if den * common >= num * (len(places[i]) + len(places[j]) - common):
                        part[part == part[j]] = part[i]
                        out[0].append(nodes[i])
                        out[1].append(nodes[j])
            mark[places[i]] = False
        return out

    sized = _in_components(clusters, labels).join(members.select("node", "n"), "node")
    dealt = _dealt(sized, "n", BLOCK_SHINGLES)
    whole = dealt.join(members.select("node", "registers"), "node").join(sets, "node")
    return _grouped(whole.select("key", "x", "y", "block", "node", "component", "registers", "items"), made).distinct()


def groups(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Per row: doc_id, text_hash (xxhash64), n (size of the set), and the least (doc_id, text_hash) of its component, null for rows that take no part."""
    held = written(sketches(docs, size), "sketches")
    whole = held.where("doc_id is not null and n > 0")
    # A class is its set, as rows of one doc_id can have several texts; its number is written, and so stays.
    classes = written(whole.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"), F.first("n").alias("n"), F.first("registers").alias("registers")).withColumn("node", F.monotonically_increasing_id()), "classes", release=True)
    bands = written(_bands(classes), "bands")
    centres = bands.groupBy("band_key").agg(F.min("node").alias("centre"), F.count("*").alias("members")).where("members > 1")
    # Only buckets that classes share go on; buckets of two are done with their one pair.
    shared = written(bands.join(centres, "band_key"), "shared", release=True)
    drop_written(bands)
    members = written(classes.join(shared.select("node").distinct(), "node"), "members", release=True)
    sets = written(_sets(docs, members, size), "sets", release=True)
    first = shared.where("node <> centre").selectExpr("centre a", "node b").distinct()
    pairs = written(_likely(first, members, num, den), "pairs", release=True)
    links = written(_links(pairs, sets, num, den), "links", release=True)
    labels = components(links)
    prefixes = written(_prefixes(shared.where("members > 2").select("band_key", "node"), labels, sets, num, den), "prefixes", release=True)
    clusters = _clusters(prefixes, members, labels, num, den)
    more = written(_links_across(clusters, members, sets, labels, num, den), "links", release=True)
    if not more.isEmpty():
        labels = components(links.union(more))
    heads = _in_components(members.select("node", "head"), labels).groupBy("component").agg(F.min("head").alias("first"))
    firsts = _in_components(members.select("node"), labels).join(heads, "component").select("node", "first")
    of_class = written(classes.select("set_key", "node", "head").join(firsts, "node", "left").select("set_key", F.coalesce("first", "head").alias("first")), "firsts", release=True)
    for table in (shared, sets, members, classes, prefixes):
        drop_written(table)
    keyed = held.select("doc_id", "text_hash", "n", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    return keyed.join(of_class, "set_key", "left").select("doc_id", "text_hash", "n", "first")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id linked, over any number of links), kept, text_hash.

    Sets are linked where den * common >= num * all. text_hash is Spark's xxhash64 of the text, which with doc_id finds the
    row.
    """
    found = groups(docs.select("doc_id", "text"), size, num, den).withColumn("component_id", F.coalesce("first.doc_id", "doc_id"))
    return found.selectExpr("doc_id", "n n_shingles", "component_id", "doc_id <=> component_id kept", "text_hash")


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without all but the first of each component, with all their columns; of equal rows one stays."""
    found = groups(docs.select("doc_id", "text"), size, num, den).where("first is not null").select("doc_id", "text_hash", (F.struct("doc_id", "text_hash") == F.col("first")).alias("stays"))
    keys = found.groupBy("doc_id", "text_hash", "stays").count().where("not stays or count > 1")
    # The caller's columns travel in one struct, so that none of their names can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    marked = written(keys.select("doc_id", "text_hash", "stays"), "decided")
    left = rows.join(marked.where("not stays"), ["doc_id", "text_hash"], "left_anti")
    several = marked.where("stays")
    if not several.isEmpty():
        key = ["doc_id", "text_hash"]
        left = left.join(several, key, "left_anti").unionByName(left.join(several, key, "left_semi").dropDuplicates(key))
    return left.select("row.*")


#: Sets of three words, linked from 85 in 100; equal texts stand for each other.
SQL = rf"""
WITH RECURSIVE texts AS MATERIALIZED (
    SELECT text, min(doc_id) AS head FROM documents WHERE doc_id IS NOT NULL GROUP BY text
), split AS (
    SELECT head, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM texts
), sets AS MATERIALIZED (
    SELECT head, list_distinct(list_transform(range(1, greatest(1, len(w) - 2)::BIGINT + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS items
    FROM split WHERE len(w) > 0
), items AS MATERIALIZED (
    SELECT head, unnest(items) AS item FROM sets
), links AS MATERIALIZED (
    SELECT a, b FROM (SELECT x.head AS a, y.head AS b, count(*) AS common FROM items x JOIN items y ON x.item = y.item AND x.head < y.head GROUP BY ALL)
    JOIN (SELECT head AS a, len(items) AS n_a FROM sets) USING (a) JOIN (SELECT head AS b, len(items) AS n_b FROM sets) USING (b)
    WHERE 100 * common >= 85 * (n_a + n_b - common)
), both_ways AS MATERIALIZED (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other
), heads AS (
    SELECT node AS head, min(other) AS component FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(len(s.items), 0)::BIGINT AS n_shingles,
       CASE WHEN s.items IS NULL THEN d.doc_id ELSE coalesce(h.component, t.head) END AS component_id,
       d.doc_id IS NOT DISTINCT FROM CASE WHEN s.items IS NULL THEN d.doc_id ELSE coalesce(h.component, t.head) END AS kept
FROM documents d LEFT JOIN texts t ON t.text IS NOT DISTINCT FROM d.text AND d.doc_id IS NOT NULL
LEFT JOIN sets s ON s.head = t.head LEFT JOIN heads h ON h.head = t.head
"""

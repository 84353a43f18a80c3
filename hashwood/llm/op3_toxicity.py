"""Toxicity by two Kneser-Ney models of the letters in words, one of toxic and one of ordinary documents.

P(letter | five before) of a class interpolates the class's own counts with a distribution from continuation counts that
both classes share. What a class has hardly seen is therefore near the shared distribution in either, and neither speaks
for it. A word's evidence is the difference of its two log-likelihoods, as it is and by letter; a document's is the mean
over its words with the three strongest, and a logistic curve turns that into the score.

Labels of documents whose crc32(doc_id as text) mod 4 is 2 are never read. The curve is fitted to the evidence that counts
of all labelled rows with 0 or 1 there give for those with 3, at most FIT_ROWS, drawn by a hash of doc_id. Then counts are
taken anew over all three. Every distinct letter group has a count of its own, by its 64-bit hash, so that what workers
get grows with the distinct groups: 16 bytes for each and 24 for each history.

Defined results: a null or empty text, or one without words, has no evidence and gets the curve's value at none; rows are
scored one by one, so repeats and ties stay; a null doc_id is scored but not learned from; of several labels of a doc_id
the largest counts, null ones don't; without labels of both classes every score is 0; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, arrow_schema, as_batch, drop_written, give_back, mapped, only, texts, written
from .pieces import slices

ORDER = 6
DISCOUNT = 0.75
THRESHOLD = 0.3
FIT_ROWS = 20_000
BROADCAST_LABELS = 2_000_000
MEMO_WORDS = 150_000
HELD_COUNTS = 200_000
FEATURES = 8
NAMES = [f"{kind}{m}" for m in range(1, ORDER) for kind in "gh"] + [f"{kind}{ORDER}_{k}" for kind in "gh" for k in (0, 1)]
START, END = "\x02", "\x03"
#: Bits of the number of letters that the lowest level takes for possible.
BITS = {1: 12}
WORDS = re.compile(r"[^\W\d_]+").findall
_U = np.uint64


def words(text: str) -> list[str]:
    return WORDS(text.lower())


def _keys(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of code points."""
    h = np.full(len(codes), codes.shape[1], _U)
    for i in range(codes.shape[1]):
        h = (h * _U(0x9E3779B97F4A7C15)) ^ codes[:, i]
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _codes(grams: list[str]) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(grams), -1).astype(_U)


class Model:
    """Tables by name: 'g6_0' counts of class 0, 'h6_0' counts and kinds after a history, 'g5' and so on for shared continuations.

    A table has the ascending keys of its groups and a column of counts, those of histories one of kinds too.
    """

    def __init__(self, tables: dict[str, tuple[np.ndarray, ...]]):
        self.tables = tables

    def _at(self, name: str, keys: np.ndarray) -> list[np.ndarray]:
        """The columns of a table for keys, 0 for one that it doesn't have."""
        if name not in self.tables:
            return [np.zeros(len(keys))] * 2
        held, *columns = self.tables[name]
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        found = held[at] == keys
        return [np.where(found, c[at], 0) for c in columns]

    def evidence(self, batch: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary)."""
        padded = [START * (ORDER - 1) + w + END for w in batch]
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
        lengths = np.fromiter(map(len, padded), np.int64, len(padded))
        starts = np.cumsum(lengths) - lengths
        first = np.ones(len(codes), bool)
        for i in range(ORDER - 1):
            first[starts + i] = False
        at = np.flatnonzero(first)
        grams = codes[at[:, None] + np.arange(1 - ORDER, 1)]
        # Most groups are in many words of a batch, and ascending keys are found faster.
        keys, back = zip(*(np.unique(_keys(grams[:, -m:]), return_inverse=True) for m in range(1, ORDER + 1)), strict=True)
        histories, behind = zip(*(np.unique(_keys(grams[:, -m:-1]), return_inverse=True) for m in range(2, ORDER + 1)), strict=True)
        seen = lambda name, m: self._at(name, keys[m - 1])[0][back[m - 1]]
        after = lambda name, m: (c[behind[m - 2]] for c in self._at(name, histories[m - 2]))
        shared = (seen("g1", 1) + 0.5) / (self.tables["g1"][1].sum() + 0.5 * (1 << BITS[1]))
        for m in range(2, ORDER):
            shared = self._level(seen(f"g{m}", m), *after(f"h{m}", m), shared)
        logs = [np.log(self._level(seen(f"g{ORDER}_{k}", ORDER), *after(f"h{ORDER}_{k}", ORDER), shared)) for k in (1, 0)]
        ends = np.searchsorted(at, starts)
        return np.add.reduceat(logs[0] - logs[1], ends)

    @staticmethod
    def _level(seen, total, kinds, lower):
        some = np.maximum(total, 1)
        return np.where(total > 0, np.maximum(seen - DISCOUNT, 0) / some + DISCOUNT * np.minimum(kinds, some) / some * lower, lower)


def gather(docs: DataFrame, one: str, count) -> DataFrame:
    """Rows (one, n0, n1) summed over tasks; count adds a batch to a dict of pairs, which is passed on when large."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ddl = f"{one} string, n0 long, n1 long"
    schema = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        flush = lambda: as_batch({one: list(held), "n0": [x[0] for x in held.values()], "n1": [x[1] for x in held.values()]}, schema)
        for batch in batches:
            count(held, batch)
            if len(held) > HELD_COUNTS:
                yield flush()
                held = {}
        if held:
            yield flush()

    return docs.mapInArrow(run, ddl).groupBy(one).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _count_words(held: dict, batch: pa.RecordBatch) -> None:
    only("op3", dict)
    for text, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
        for w in words(text):
            if (pair := held.get(w)) is None:
                pair = held[w] = [0, 0]
            pair[toxic] += 1


def _count_grams(held: dict, batch: pa.RecordBatch) -> None:
    for word, n0, n1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        padded = START * (ORDER - 1) + word + END
        for i in range(len(padded) - ORDER + 1):
            gram = padded[i : i + ORDER]
            if (pair := held.get(gram)) is None:
                held[gram] = [n0, n1]
            else:
                pair[0] += n0
                pair[1] += n1


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits if these hold them all."""
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64)


def learn(labelled: DataFrame) -> Model | None:
    """The model from rows (text, toxic 0 or 1); None without both classes."""
    kinds = written(gather(labelled.select("text", "toxic"), "word", _count_words), "words")
    grams = written(gather(kinds, "gram", _count_grams), "grams")
    part = lambda name, df, gram, n: df.selectExpr(f"{NAMES.index(name)}Y name", f"{gram} gram", f"{n} n")
    parts = []
    for k in (0, 1):
        seen = grams.where(f"n{k} > 0")
        parts += [part(f"g{ORDER}_{k}", seen, "gram", f"n{k}"), part(f"h{ORDER}_{k}", seen, f"left(gram, {ORDER - 1})", f"n{k}")]
    longer = grams.select("gram")
    for m in range(ORDER - 1, 0, -1):
        # Kinds of letters before a group of m: distinct groups of m + 1 that end with it.
        shared = longer.groupBy(F.expr(f"right(gram, {m})").alias("gram")).agg(F.count("*").alias("n"))
        parts.append(part(f"g{m}", shared, "gram", "n"))
        if m > 1:
            parts.append(part(f"h{m}", shared, f"left(gram, {m - 1})", "n"))
        longer = shared.select("gram")

    def rows(batch: pa.RecordBatch) -> dict:
        names, strings = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        key = np.zeros(len(strings), _U)
        for name in np.unique(names):
            on = np.flatnonzero(names == name)
            key[on] = _keys(_codes([strings[i] for i in on]))
        return {"name": batch.column(0), "key": key.view(np.int64), "n": batch.column(2)}

    every = parts[0]
    for other in parts[1:]:
        every = every.union(other)
    # A history comes once for each letter after it, so that its rows are its kinds.
    sums = mapped(every, rows, "name byte, key long, n long").groupBy("name", "key").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
    names, keys = sums["name"].to_numpy(), sums["key"].to_numpy().view(_U)
    counts, several = (narrow(sums[c].to_numpy()) for c in ("n", "kinds"))
    del sums
    tables = {}
    for i, name in enumerate(NAMES):
        on = np.flatnonzero(names == i)
        if len(on):
            on = on[np.argsort(keys[on])]
            tables[name] = (keys[on], counts[on], several[on]) if name[0] == "h" else (keys[on], counts[on])
    for table in (kinds, grams):
        drop_written(table)
    return Model(tables) if f"g{ORDER}_0" in tables and f"g{ORDER}_1" in tables else None


def features(known: dict, model: Model, batch: list[str]) -> np.ndarray:
    """Per text: mean evidence of its words, the three strongest, the three strongest by letter, and the log of its words, as more words have stronger ones by chance."""
    if len(known) > MEMO_WORDS:
        known.clear()
    split = [words(t) for t in batch]
    new = list(set().union(*split).difference(known))
    for start in range(0, len(new), 20_000):
        part = new[start : start + 20_000]
        known.update(zip(part, model.evidence(part).tolist(), strict=True))
    out = np.zeros((len(batch), FEATURES))
    for i, found in enumerate(split):
        if found:
            value = np.fromiter(map(known.__getitem__, found), np.float64, len(found))
            by_letter = value / (np.fromiter(map(len, found), np.float64, len(found)) + 1)
            top = min(3, len(found))
            out[i, 0] = value.mean()
            out[i, 1 : 1 + top] = np.sort(np.partition(value, -top)[-top:])[::-1]
            out[i, 4 : 4 + top] = np.sort(np.partition(by_letter, -top)[-top:])[::-1]
            out[i, 7] = math.log(len(found))
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic curve over columns, scale and shift; Newton's steps with a ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return np.concatenate([w[:-1] / scale, [w[-1] - (w[:-1] * mean / scale).sum()]])


def _fold(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


class Scorer:
    """What workers need: tables and the curve; words are remembered per worker."""

    def __init__(self, model: Model, curve: np.ndarray | None):
        self.model, self.curve = model, curve

    def features(self, batch: list[str]) -> np.ndarray:
        known = self.__dict__.setdefault("known", {})
        only("op3", known.clear)
        parts = [features(known, self.model, batch[a:b]) for a, b in slices(batch, 1 << 20)]
        return np.concatenate(parts) if parts else np.zeros((0, FEATURES))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def score(self, batch: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(batch) @ self.curve[:-1] + self.curve[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """The scorer from documents (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(_fold() != 2)
    known = written(known, "labels")
    if known.count() <= BROADCAST_LABELS:  # at most some 50 MB; more of them are joined by a shuffle
        known = F.broadcast(known)
    labelled = docs.select("doc_id", "text").join(known, "doc_id")
    # One model at a time is held here: that of the curve goes before the other is learned.
    curve = _curve(labelled)
    give_back(spark)
    model = learn(labelled)
    give_back(spark)
    return model and Scorer(model, curve)


def _curve(labelled: DataFrame) -> np.ndarray:
    """Weights that fit the evidence of two thirds' counts to the labels of the rest; without both classes, those of the mean alone."""
    plain = np.array([1.0, *[0.0] * (FEATURES - 1), math.log(THRESHOLD / (1 - THRESHOLD))])
    first = learn(labelled.where(_fold() < 2))
    if first is None:
        return plain
    shared, cache = labelled.sparkSession.sparkContext.broadcast(Scorer(first, None)), {}

    def rows(batch: pa.RecordBatch) -> dict:
        scorer = cache.setdefault("scorer", shared.value)
        return {"h": batch.column(0), "toxic": batch.column(2), "x": list(scorer.features(texts(batch.column(1))))}

    sample = labelled.where(_fold() == 3).select(F.xxhash64("doc_id").alias("h"), "text", "toxic")
    found = mapped(sample, rows, "h long, toxic int, x array<double>").orderBy("h").limit(FIT_ROWS).toArrow()
    shared.destroy()
    x = np.array(found["x"].combine_chunks().values.to_numpy()).reshape(-1, FEATURES) if len(found) else np.zeros((0, FEATURES))
    y = np.array(found["toxic"].to_pylist(), float)
    return fit_curve(x, y) if len(y) and y.min() < y.max() else plain


def score(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    shared, cache = docs.sparkSession.sparkContext.broadcast(scorer), {}

    def rows(batch: pa.RecordBatch) -> dict:
        scorer = cache.setdefault("scorer", shared.value)
        values = np.zeros(batch.num_rows) if scorer is None else scorer.score(texts(batch.column(1)))
        return {"doc_id": batch.column(0), "score": values, "predicted": (values >= THRESHOLD).astype(int)}

    return mapped(docs.select("doc_id", "text"), rows, "doc_id long, score double, predicted int").select("doc_id", F.coalesce(_fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_ordinary(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """The documents that aren't predicted to be toxic, with all their columns."""
    if scorer is None:
        return docs
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shared, cache, at = spark.sparkContext.broadcast(scorer), {}, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(cache.setdefault("scorer", shared.value).score(texts(batch.column(at))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))

"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct words (runs of ASCII letters and digits, lower case, and bytes from 0x80) and the
words' prefixes of ``PREFIX`` bytes, hashed to ``2**HASH_BITS`` places. Over a bounded sample of labelled rows two kinds of
places are kept: those whose presence differs most between the classes, and those of pairs whose common presence says
what neither says alone (among the ``PAIR_TERMS`` most frequent places and the first kind). On these the machine learns a
weight for each term and a vector for each term, whose products weigh pairs of terms: two mild words together can count
for more, or for less, than the sum of their weights.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import WORD_BYTES, remainder, small_batches, staged, text_column, workers_import

HASH_BITS, PREFIX = 22, 6
#: Labelled rows that the machine is fitted on at most: those with the smallest hashes of their doc_id.
SAMPLE_ROWS = 20_000
#: Terms kept for themselves at most, the least rows with a kept term, and the least difference in standard errors.
MAX_TERMS, MIN_ROWS, MIN_Z = 4096, 5, 3.5
#: Frequent terms that are tried in pairs, the least rows with both, and the least interaction in standard errors (a term
#: that tells much alone, met with any frequent one, comes near 6 by its uneven spread).
PAIR_TERMS, PAIR_ROWS, PAIR_Z = 512, 20, 8.0
FACTORS, STEPS, RATE, DECAY = 8, 400, 0.05, 2e-3
#: Cells of the rows' matrix up to which it is held as floats (128 MB).
MATRIX_CELLS = 1 << 25
TABLE_WORDS = 500_000


def words_of(text: str | None) -> set[bytes]:
    return set(text.encode("utf-8", "replace").translate(WORD_BYTES).split()) if text else set()


def places_of(word: bytes) -> tuple[int, ...]:
    mask = (1 << HASH_BITS) - 1
    whole = xxhash.xxh32_intdigest(word, 1) & mask
    return (whole, xxhash.xxh32_intdigest(word[:PREFIX], 2) & mask) if len(word) >= PREFIX else (whole,)


class Terms(dict):
    """word -> its places among the kept ones (None: none of them), remembered in a bounded table."""

    def __init__(self, kept: dict[int, int] | None = None):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: bytes):
        if len(self) >= TABLE_WORDS:
            self.clear()
        found = places_of(word)
        if self.kept is not None:
            found = tuple(self.kept[p] for p in found if p in self.kept) or None
        self[word] = found
        return found


@dataclass
class Machine:
    places: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, rows: list[list[int]]) -> np.ndarray:
        """The probability of label 1 for lists of kept terms."""
        at, n = _flat(rows)
        return _sigmoid(_raw(self.bias, self.weights, self.vectors, at, n)[0])


def _flat(rows) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows], np.int64)
    return np.fromiter((x for r in rows for x in r), np.int64, int(n.sum())), n


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _raw(bias, weights, vectors, at, n):
    of = np.repeat(np.arange(len(n)), n)
    linear = np.bincount(of, weights[at], len(n))
    v = vectors[at]
    total = np.stack([np.bincount(of, v[:, k], len(n)) for k in range(v.shape[1])], 1)
    square = np.stack([np.bincount(of, v[:, k] ** 2, len(n)) for k in range(v.shape[1])], 1)
    return bias + linear + 0.5 * (total**2 - square).sum(1), of, v, total


def dense(rows: list[list[int]], d: int) -> list[np.ndarray]:
    """The rows as blocks of 0 and 1, a byte each: for a sample of 20,000 rows and some thousand terms some ten MB."""
    out = []
    for lo in range(0, len(rows), 2048):
        at, n = _flat(rows[lo : lo + 2048])
        x = np.zeros((len(n), d), np.uint8)
        x[np.repeat(np.arange(len(n)), n), at] = 1
        out.append(x)
    return out


def fit(rows: list[list[int]], labels: np.ndarray, places: dict[int, int], seed: int = 7) -> Machine:
    """Full-batch Adam on the mean log loss with weight decay; the same input gives the same machine. Terms are 0 or 1, so
    that sums and gradients over all rows are products with the rows' matrix."""
    d, y = max(1, len(places)), np.asarray(labels, np.float32)
    rng = np.random.default_rng(seed)
    rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-4), 1 - 1e-4)
    p = [np.array([np.log(rate / (1 - rate))]), np.zeros((d, 1)), rng.normal(0, 0.05, (d, FACTORS))]
    blocks = dense(rows, d)
    if len(y) * d <= MATRIX_CELLS:
        blocks = [x.astype(np.float32) for x in blocks]
    ends = np.cumsum([len(x) for x in blocks])
    m, s = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, STEPS + 1 if len(y) else 1):
        # one product gives linear parts, sums of vectors, and sums of their squares
        all_ = np.concatenate([p[1], p[2], (p[2] ** 2).sum(1, keepdims=True)], 1).astype(np.float32)
        grads = [np.zeros(1), np.zeros((d, 1)), np.zeros((d, FACTORS))]
        for x, end in zip(blocks, ends, strict=True):
            x = x.astype(np.float32, copy=False)
            got = x @ all_
            total = got[:, 1:-1]
            raw = p[0][0] + got[:, 0] + 0.5 * ((total**2).sum(1) - got[:, -1])
            g = ((_sigmoid(raw) - y[end - len(x) : end]) / len(y)).astype(np.float32)[:, None]
            back = x.T @ np.concatenate([g, g * total], 1)
            grads[0] += g.sum()
            grads[1] += back[:, :1]
            grads[2] += back[:, 1:] - p[2] * back[:, :1]
        grads[1] += DECAY / 10 * p[1]
        grads[2] += DECAY / 10 * p[2]
        for i, x in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * x
            s[i] = 0.999 * s[i] + 0.001 * x * x
            p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return Machine(places, float(p[0][0]), p[1][:, 0], p[2])


def paired(rows: list[list[int]], labels: np.ndarray, d: int) -> set[int]:
    """The terms (below d) of telling pairs: with r the label less its mean, the sum of r over the rows with both terms
    differs by ``PAIR_Z`` standard errors from what the terms' own means of r add up to."""
    y = np.asarray(labels, np.float32)
    r = y - y.mean() if len(y) else y
    both, told = np.zeros((d, d), np.float32), np.zeros((d, d), np.float32)
    at = 0
    for x in (x.astype(np.float32) for x in dense(rows, d)):
        both += x.T @ x
        told += x.T @ (x * r[at : at + len(x), None])
        at += len(x)
    n, s = np.diag(both).astype(float), np.diag(told).astype(float)
    mean = s / np.maximum(n, 1)
    free = np.maximum(1 - both / np.maximum(n, 1)[:, None], 0.02) * np.maximum(1 - both / np.maximum(n, 1)[None, :], 0.02)
    z = (told - both * (mean[:, None] + mean[None, :])) / np.sqrt(np.maximum(both * free * float((r * r).mean() if len(r) else 0), 1e-9))
    np.fill_diagonal(z, 0)
    return set(np.unique(np.nonzero((np.abs(z) >= PAIR_Z) & (both >= PAIR_ROWS))[0]).tolist())


def labelled_sample(labels: DataFrame, trains: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled rows (doc_id, toxic) that may be learnt from: one for each doc_id (the larger label
    where rows differ), null ids and labels left out, by the smallest hashes of doc_id."""
    return (
        labels.where("doc_id is not null and toxic is not null").where(trains)
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )


def learn(docs: DataFrame, labels: DataFrame, trains: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit the machine on the labelled documents for which ``trains`` (of doc_id) holds; by default remainder 1 to 4
    of crc32(doc_id as text) modulo 5. Of rows that repeat a doc_id the one with the greatest text counts. What reaches
    the driver is bounded by ``sample_rows``, ``MAX_TERMS`` and ``PAIR_TERMS``."""
    workers_import(docs.sparkSession)
    small_batches(docs.sparkSession)
    trains = remainder(F.col("doc_id"), 5) != 0 if trains is None else trains
    # at most sample_rows rows of 12 bytes
    sample = F.broadcast(labelled_sample(labels, trains, sample_rows).select("doc_id", "toxic"))
    found = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    rows = staged(found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")), "labelled", "snappy")

    def count(batches):
        terms, seen, n = Terms(), [Counter(), Counter()], [0, 0]
        flush = lambda: pa.RecordBatch.from_pylist([{"place": k, "n0": seen[0][k], "n1": seen[1][k]} for k in seen[0].keys() | seen[1].keys()], pa.schema([("place", pa.int32()), ("n0", pa.int64()), ("n1", pa.int64())]))
        for batch in batches:
            for text, y in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                y = int(y == 1)
                n[y] += 1
                seen[y].update({p for w in words_of(text.as_py()) for p in terms[w]})
                if len(seen[0]) + len(seen[1]) > 1_000_000:
                    yield flush()
                    seen = [Counter(), Counter()]
        seen[0][-1], seen[1][-1] = n
        yield flush()

    stats = rows.mapInArrow(count, "place int, n0 long, n1 long").groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n0, n1 = next(iter(stats.where("place = -1").select("n0", "n1").collect()), (0, 0))
    if not n0 or not n1:
        return fit([[]] * (n0 + n1), np.array([1.0] * n1 + [0.0] * n0), {})
    p = (F.col("n0") + F.col("n1") + 1) / (n0 + n1 + 2)
    z = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    kept = staged(stats.where("place >= 0").where(F.col("n0") + F.col("n1") >= MIN_ROWS).select("place", (F.col("n0") + F.col("n1")).alias("n"), z.alias("z")), "toxicity-terms")
    best = [r["place"] for r in kept.where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "place").limit(MAX_TERMS).select("place").collect()]
    often = [r["place"] for r in kept.where(F.col("n") >= PAIR_ROWS).orderBy(F.desc("n"), "place").limit(PAIR_TERMS).select("place").collect()]
    tried = {p: i for i, p in enumerate(dict.fromkeys([*best[:PAIR_TERMS], *often, *best]))}

    def gather(batches):
        terms = Terms(tried)
        for batch in batches:
            found = [sorted({p for w in words_of(t.as_py()) for p in terms[w] or ()}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "at"])

    got = rows.mapInArrow(gather, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, at array<int>").collect()
    got.sort(key=lambda r: str(r["doc_id"]))
    at, y = [r["at"] for r in got], np.array([float(r["toxic"] == 1) for r in got])
    d = min(len(tried), 2 * PAIR_TERMS)
    own = {tried[p] for p in best} | paired([[i for i in r if i < d] for r in at], y, d)
    place = dict(zip(tried.values(), tried, strict=True))
    number = {i: k for k, i in enumerate(sorted(own))}
    return fit([[number[i] for i in r if i in number] for r in at], y, {place[i]: k for i, k in number.items()})


def scored(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """``docs`` with the column ``name`` (replaced if there): the probability that the whole text is toxic. Only the
    text is read; an empty or null text gets the score of no terms."""
    spark = docs.sparkSession
    workers_import(spark)
    small_batches(spark)
    sent = spark.sparkContext.broadcast(machine)
    out = docs.drop(name)
    at = text_column(out)
    schema = StructType([*out.schema.fields, StructField(name, DoubleType())])

    def score(batches):
        terms = Terms(sent.value.places)
        for batch in batches:
            found = [{p for w in words_of(t.as_py()) if (ps := terms[w]) for p in ps} for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(found))], names=[*batch.schema.names, name])

    return out.mapInArrow(score, schema)


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    machine = learn(docs, labels)
    return scored(docs.select("doc_id", "text"), machine).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )

"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``WINDOW`` consecutive words of the test items (an item with fewer words is one window).
For each pattern length a table gives, for the block of the last ``BLOCK`` words under the search position, how far
the search may move on; most blocks of ordinary text occur in no pattern, and the search skips almost a window. Where
the shift is 0, the block's bucket lists the patterns that end in it, and direct comparison confirms them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import WORD_BYTES, small_batches, staged, text_column, workers_import

WINDOW, BLOCK = 10, 2
#: Bytes of item texts that one search table is built from (a table takes some hundred bytes a word); more items are
#: searched for in several passes, one after another.
PASS_BYTES = 4 << 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


class Search:
    """Tables for a set of test items, given as (item_id, text)."""

    def __init__(self, items: list[tuple[str, str | None]]):
        lengths: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            w = words_of(text)
            m = min(WINDOW, len(w))
            for i in range(len(w) - m + 1) if m else ():
                lengths[m][tuple(w[i : i + m])].add(item)
        self.tables = []
        for m, patterns in sorted(lengths.items()):
            block = min(BLOCK, m)
            shift: dict = {}
            bucket: dict = defaultdict(set)
            for p in patterns:
                for end in range(block, m + 1):
                    key = p[end - block : end] if block > 1 else p[end - 1]
                    shift[key] = min(shift.get(key, m), m - end)
                bucket[p[m - block :] if block > 1 else p[-1]].add(p)
            self.tables.append((m, block, shift, dict(bucket), {p: frozenset(x) for p, x in patterns.items()}))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans [a, b) of words inside an occurrence, and the items that occur."""
        spans, items, n = [], set(), len(words)
        for m, block, shift, bucket, patterns in self.tables:
            far, i = m - block + 1, m
            if block > 1:
                while i <= n:
                    key = (words[i - 2], words[i - 1])
                    move = shift.get(key, far)
                    if move:
                        i += move
                        continue
                    under = tuple(words[i - m : i])
                    if under in bucket[key]:
                        spans.append((i - m, i))
                        items |= patterns[under]
                    i += 1
            else:
                for i, w in enumerate(words):
                    if w in bucket:
                        spans.append((i, i + 1))
                        items |= patterns[(w,)]
        return _merge(spans), items


def passes(benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> Iterator[list[tuple[str | None, str]]]:
    """The distinct test items in groups of about ``pass_bytes`` at most (or one item); one group at a time is on the
    driver. There is one group at least."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0))
    n = max(1, 2 * int(-(-(items.agg(F.sum(size).alias("b")).first()["b"] or 0) // pass_bytes)) - 1)
    dealt = staged(items.withColumn("deal", F.pmod(F.xxhash64("item", "text"), F.lit(n))), "items", "snappy")
    for k in range(n):
        yield [(r["item"], r["text"]) for r in dealt.where(F.col("deal") == k).collect()]


def occurrences(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Each document with its columns and n_words, hits (merged word spans inside occurrences) and items (the test
    items with occurring windows, sorted as strings).

    A null or empty text has no words and no hits; items without words match nothing; an item without an id counts for
    hits and is not listed; repeated rows of either table change nothing. Columns of ``docs`` named n_words, hits or
    items are replaced. With several groups of items the result of each pass is staged before the next one.
    """
    spark = docs.sparkSession
    workers_import(spark)
    small_batches(spark)
    out = docs.drop("n_words", "hits", "items")
    kept = list(out.schema.fields)
    span = StructType([StructField("a", LongType()), StructField("b", LongType())])
    found = StructType([*kept, StructField("n_words", LongType()), StructField("hits", ArrayType(span)), StructField("items", ArrayType(StringType()))])
    at = text_column(out)

    def search_with(tables, more):
        def search(batches):
            find = tables.value.find
            for batch in batches:
                n_words, hits, listed = [], [], []
                for i, text in enumerate(batch.column(at)):
                    w = words_of(text.as_py())
                    spans, items = find(w)
                    if more:
                        spans = _merge(spans + [(x["a"], x["b"]) for x in batch.column("hits")[i].as_py()])
                        items = {*items, *batch.column("items")[i].as_py()}
                    n_words.append(len(w))
                    hits.append([{"a": a, "b": b} for a, b in spans])
                    listed.append(sorted(items - {None}))
                cols = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name not in ("n_words", "hits", "items")]
                cols += [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(listed, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in kept] + ["n_words", "hits", "items"])

        return search

    tables = None
    for k, group in enumerate(passes(benchmark, pass_bytes)):
        if tables is not None:
            out = staged(out, "hits", "snappy")
            tables.destroy()
        tables = spark.sparkContext.broadcast(Search(group))
        out = out.mapInArrow(search_with(tables, k > 0), found)
    return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of a test item occurs, with their columns."""
    own = [f"__own_{c}" if c in ("n_words", "hits", "items") else c for c in docs.columns]
    clean = occurrences(docs.toDF(*own), benchmark).where(F.size("hits") == 0)
    return clean.select(*(F.col(f"`{c}`").alias(name) for c, name in zip(own, docs.columns, strict=True)))

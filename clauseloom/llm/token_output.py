"""Token-ID / binary output: documents to ids, ids to checksummed blocks of an adaptive range coder, and back.

File format. A token file set is a Parquet folder, so that it lives in any store Spark can reach. Each row is one
block: ``shard`` and ``block`` (their order is the order of ids), ``ids_before`` (ids of the shard before the block),
``n_docs``, ``n_ids``, ``index`` (the documents' ids and lengths) and ``payload`` (see ``idcoder``). Blocks hold whole
documents; a block closes at the first document that brings it to ``block_ids`` ids. Documents are in ascending
order of doc_id (nulls first, ties by text).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytebpe import encoder
from .common import small_batches, staged, text_slices, workers_import
from .idcoder import CorruptBlock, decode_block, encode_block

BLOCK_IDS = 1 << 22
BLOCKS = "shard int, block int, ids_before long, n_docs int, n_ids long, index binary, payload binary"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _index(doc_ids: list, lengths: np.ndarray) -> bytes:
    null = np.array([d is None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    body = null.tobytes() + ids.tobytes() + lengths.astype("<i8").tobytes()
    return zlib.crc32(body).to_bytes(4, "little") + zlib.compress(body, 1)


def _read_index(index: bytes, n: int) -> tuple[list, np.ndarray]:
    try:
        body = zlib.decompress(index[4:])
    except zlib.error as e:
        raise CorruptBlock("the index cannot be read") from e
    if len(body) != 17 * n or zlib.crc32(body) != int.from_bytes(index[:4], "little"):
        raise CorruptBlock("the index does not fit its checksum")
    ids = np.frombuffer(body, "<i8", n, n).tolist()
    return [None if z else d for z, d in zip(body[:n], ids, strict=True)], np.frombuffer(body, "<i8", n, 9 * n)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks of a token file set (columns ``BLOCKS``) for doc_id and text of ``docs``; a null text is empty.

    Rows are dealt by ranges of doc_id, so that shards follow one another; equal doc_ids stay in one shard, and each
    row stays a document of its own. Other columns are not read. No rows give no blocks.
    """
    workers_import(docs.sparkSession)
    small_batches(docs.sparkSession)

    def blocks(batches):
        shard, k, before = TaskContext.get().partitionId(), 0, 0
        ids, doc_ids, lengths, n = [], [], [], 0

        def close():
            sizes = np.concatenate(lengths)
            row = [shard, k, before, len(doc_ids), n, _index(doc_ids, sizes), encode_block(np.concatenate(ids))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        bpe = encoder(tokenizer)
        for batch in batches:
            doc, text = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_slices(text):
                flat, sizes, *_ = bpe.encode(text[a:b])
                flat = np.insert(flat, np.cumsum(sizes), end_id)
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                i = 0
                while i < b - a:
                    done = int(ends[i - 1]) if i else 0
                    j = min(b - a, int(np.searchsorted(ends, done + block_ids - n)) + 1)
                    ids.append(flat[done : ends[j - 1]])
                    doc_ids += doc[a + i : a + j]
                    lengths.append(sizes[i:j])
                    n += int(ends[j - 1]) - done
                    i = j
                    if n >= block_ids:
                        yield close()
                        k, before = k + 1, before + n
                        ids, doc_ids, lengths, n = [], [], [], 0
        if doc_ids:
            yield close()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return parts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(blocks, BLOCKS)


def decode_documents(files: DataFrame, ids: bool = False) -> DataFrame:
    """The documents of a token file set: doc_id, start (ids before it in the whole set), n_tokens, ids_crc32 and,
    if asked for, the ids. A damaged block raises CorruptBlock."""
    workers_import(files.sparkSession)
    small_batches(files.sparkSession)
    per_shard = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row for each written shard, some tens of bytes
    first = per_shard.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("shard_start"))

    def read(batches):
        for batch in batches:
            for start, before, n, index, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc, sizes = _read_index(index, n)
                flat = decode_block(payload)
                if int(sizes.sum()) != len(flat):
                    raise CorruptBlock("the index does not fit the ids")
                ends = np.cumsum(sizes)
                begins = ends - sizes
                raw = flat.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(doc, pa.int64()), pa.array(start + before + begins), pa.array(sizes), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begins, len(flat)), pa.int32()), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return files.join(F.broadcast(first), "shard").select("shard_start", "ids_before", "n_docs", "index", "payload").mapInArrow(read, DOCS + (", ids array<int>" if ids else ""))


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the token file set of ``docs`` into the shared folder and read its documents back."""
    return decode_documents(staged(encode_documents(docs, tokenizer, end_id), "token-files"))

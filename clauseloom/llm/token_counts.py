"""Token counts: offset-mapped attribution of a whole document's tokens to its fields or sections.

Each document is encoded once. The character span of every token is joined, as an interval, to the spans of the
document's sections, which tile the text. A token inside one section counts there; for a token that crosses a
boundary an explicit rule decides: ``largest`` (the section with most of its characters, the earliest among equals),
``first`` or ``last`` (the section of its first or last character). So the sections' counts always sum to the
document's count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import encoder
from .common import text_slices, workers_import

RULES = ("largest", "first", "last")
SCHEMA = "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long"


def attribute(lo: np.ndarray, hi: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token span [lo, hi) among sections that end at ``ends`` (ascending, the first starts at 0),
    and whether the token crosses a boundary."""
    first = np.searchsorted(ends, lo, "right")
    last = np.searchsorted(ends, np.maximum(hi - 1, lo), "right")
    first, last = np.minimum(first, len(ends) - 1), np.minimum(last, len(ends) - 1)
    crossing = last > first
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    owner = first.copy()
    for i in np.flatnonzero(crossing).tolist():
        cuts = np.concatenate([[lo[i]], ends[first[i] : last[i]], [hi[i]]])
        owner[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return owner, crossing


def section_tokens(docs: DataFrame, tokenizer: str, fields: tuple[str, ...] = ("text",), separator: str = "\n", rule: str = "largest") -> DataFrame:
    """One row for each section of each document: its character span in the whole text, its tokens, and how many
    tokens that touch it cross a boundary.

    With one field the sections are its parts up to and including each ``separator``; with several, the fields joined
    by the separator are the whole text and each field (with the separator after it) is a section. A null field is
    empty. An empty text has one empty section with no tokens. Repeated rows give repeated results; other columns are
    not read. Empty tables give no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if not separator:
        raise ValueError("the separator is not empty")
    workers_import(docs.sparkSession)
    many = len(fields) > 1

    def ends_of(values: tuple) -> tuple[str, np.ndarray]:
        parts = [v or "" for v in values] if many else (values[0] or "").split(separator)
        sizes = np.array([len(p) + len(separator) for p in parts], np.int64)
        sizes[-1] -= len(separator)
        if not many and len(parts) > 1 and not parts[-1]:
            sizes = sizes[:-1]
        return separator.join(parts), np.cumsum(sizes)

    def count(batches):
        bpe = encoder(tokenizer, spans=True)
        for batch in batches:
            doc = batch.column(0).to_pylist()
            whole = [ends_of(v) for v in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            for a, b in text_slices([t for t, _ in whole]):
                _, sizes, lo, hi = bpe.encode([t for t, _ in whole[a:b]])
                n_sections = np.array([len(e) for _, e in whole[a:b]])
                base = np.cumsum(n_sections) - n_sections
                length = np.array([len(t) for t, _ in whole[a:b]], np.int64)
                # texts are laid one after another with a gap, so that one search serves the whole slice
                shift = np.cumsum(length + 1) - (length + 1)
                ends = np.concatenate([e for _, e in whole[a:b]])
                of = np.repeat(np.arange(b - a), n_sections)
                last = np.zeros(len(ends), bool)
                last[base + n_sections - 1] = True
                stops = ends + shift[of] + last
                move = np.repeat(shift, sizes)
                owner, crossing = attribute(lo + move, hi + move, stops, rule)
                n = np.bincount(owner, minlength=len(ends))
                x = np.flatnonzero(crossing)
                touched = np.zeros(len(ends) + 1, np.int64)
                np.add.at(touched, np.searchsorted(stops, (lo + move)[x], "right"), 1)
                np.add.at(touched, np.searchsorted(stops, (hi + move)[x] - 1, "right") + 1, -1)
                start = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                start[base] = 0
                section = np.arange(len(ends)) - base[of]
                cols = [pa.array(doc[a:b], pa.int64()).take(pa.array(of)), pa.array(section, pa.int32()), pa.array(start), pa.array(ends), pa.array(n, pa.int64()), pa.array(np.cumsum(touched)[:-1], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields))).mapInArrow(count, SCHEMA)

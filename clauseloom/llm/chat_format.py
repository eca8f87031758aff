"""Chat formatting: collapse of cumulative snapshots, then rendering.

Loggers often write a conversation again after each turn. A logged conversation that is a prefix of a longer one, or
equal to one with a smaller conv_id, adds nothing. Each conversation's rolling turn-prefix hashes are computed; an
anti-join against the proper prefixes of all conversations retains the maximal ones, and only these are rendered.

Only DataFrame functions are used. The hash of a prefix of k turns is the pair of exclusive ors of two 64-bit hashes
of (position, role, text) over its turns, together with k: 128 bits, so that even 10^12 prefixes collide with a
probability under 10^-14.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, k, a, b and last for each prefix of k turns; last marks the whole conversation. Turns are in order of turn
    (nulls first), then role and text; rows equal in all four columns count once; rows with a null conv_id belong to no
    conversation.

    The hash rolls over a window, row after row: a conversation of any length is sorted (on disk if need be) and read
    once, and never held as one value."""
    said = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = said.withColumn("k", F.row_number().over(order))
    for name, parts in (("a", ("role", "text")), ("b", ("text", "role"))):
        placed = placed.withColumn(f"own_{name}", F.xxhash64("k", F.lit(name), *parts))
    rolled = [F.bit_xor(f"own_{name}").over(so_far).alias(name) for name in "ab"]
    return placed.select("conv_id", "k", *rolled, F.lead("k").over(order).isNull().alias("last"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no prefix of a longer one; of equal ones the smallest id.

    Both sides of the anti-join have one row for each distinct hash, so that a first turn, or a conversation, that
    recurs in a third of all rows is summed before it is dealt out."""
    hashes = prefix_hashes(turns)
    whole = hashes.where("last").groupBy("k", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    proper = hashes.where("not last").select("k", "a", "b").distinct()
    return whole.join(proper, ["k", "a", "b"], "left_anti").select("conv_id", F.col("k").alias("n_turns"))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered: each maximal conversation as one text. A null role or text is empty; other columns
    are not read; an empty table gives no rows."""
    kept = maximal(turns)
    said = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")).join(kept, "conv_id")
    line = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))
    return said.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.array_sort(F.collect_set("t")).alias("ts")).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.array_join(F.transform("ts", line), "").alias("rendered"))

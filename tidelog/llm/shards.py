"""Reproducible shuffle into shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

ROUNDS = 8
WALK = 64  # cycle-walking steps written into the plan


def _round_value(seed: int, step: Column, half: Column) -> Column:
    """Pseudo-random 60-bit number of a round, from MD5 so that other engines can repeat it."""
    text = F.concat_ws(":", F.lit(str(seed)), step.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _grid(rows: int) -> tuple[int, int]:
    """Width and height of the smallest near-square grid with at least ``rows`` cells."""
    wide = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    return wide, max(1, -(-rows // wide))


def _cipher(cell: Column, wide: int, high: int, seed: int, inverse: bool = False) -> Column:
    """One pass of the permutation over the cells of the grid, or its inverse."""
    start = F.struct(F.call_function("div", cell, F.lit(high).cast("long")).alias("l"), (cell % high).alias("r"))
    sign = -1 if inverse else 1
    steps = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def turn(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        left = F.when(even, F.pmod(s["l"] + sign * (_round_value(seed, k, s["r"]) % wide), F.lit(wide).cast("long"))).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * (_round_value(seed, k, s["l"]) % high), F.lit(high).cast("long")))
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.array(*map(F.lit, steps)), start, turn, lambda s: s["l"] * high + s["r"])


def permute(number: Column, rows: int, seed: int = 0, inverse: bool = False) -> Column:
    """Place of row ``number`` (0 to rows-1) in the shuffled order, or the row at a place.

    Cells of the grid past ``rows`` are walked on until the cycle returns into range. They
    number less than sqrt(rows) + 1, so a walk longer than WALK is all but impossible for
    large tables and, being bounded by their number, impossible for small ones; it raises.
    """
    wide, high = _grid(rows)
    walk = min(WALK, wide * high - rows)
    once = _cipher(number.cast("long"), wide, high, seed, inverse)
    if not walk:
        return once
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(walk)), once,
        lambda x, _: F.when(x < rows, x).otherwise(_cipher(x, wide, high, seed, inverse)),
        lambda x: F.when(x < rows, x).otherwise(F.raise_error(F.lit("no place found: choose another seed")).cast("long")))
    return walked


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number_") -> tuple[DataFrame, int]:
    """Global row numbers from 0 in the order of ``order``, and the number of rows.

    Rows are dealt by range, numbered inside their part and shifted by the rows of the parts
    before; the table of parts has one row per part. Rows that agree in all columns are
    interchangeable, so they may be dealt to any part. Nulls come first.
    """
    cols = df.columns
    ties = F.xxhash64(*cols) if cols else F.lit(0)
    keyed = df.withColumn("tie__", ties).withColumn("salt__", F.monotonically_increasing_id())
    keys = [*order, "tie__", "salt__"]
    parted = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        *cols, F.spark_partition_id().alias("part__"), (F.monotonically_increasing_id() % (1 << 33)).alias("at__"))
    written = materialize(parted, "row-numbers")
    sizes = written.groupBy("part__").agg(F.count("*").alias("size__"))
    before = sizes.select("part__", F.coalesce(F.sum("size__").over(
        Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before__"))
    total = sizes.agg(F.sum("size__")).first()[0] or 0
    return written.join(F.broadcast(before), "part__").select(*cols, (F.col("before__") + F.col("at__")).alias(name)), total


def shard_rows(df: DataFrame, shards: int, order: list[str], seed: int = 0) -> DataFrame:
    """``df`` with columns shard (0 to shards-1) and slot (from 0, without gaps inside a shard).

    Law ``rows``: shard sizes differ by at most one. The shuffled place p of a row gives
    shard = p mod shards and slot = p div shards, so both are computed from the row number
    alone and ``row_at`` inverts them. Existing columns named shard or slot are replaced.
    An empty table gives an empty table; null keys sort first; repeated rows get places of their own.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    kept = df.drop("shard", "slot") if not {"shard", "slot"} & set(order) else df
    numbered, total = row_numbers(kept, order)
    place = numbered.withColumn("place__", permute(F.col("row_number_"), total, seed))
    out = [c for c in kept.columns if c not in ("shard", "slot")]
    return place.select(*out, (F.col("place__") % shards).cast("int").alias("shard"), F.expr(f"place__ div {shards}").alias("slot"))


def row_at(shard: Column, slot: Column, shards: int, rows: int, seed: int = 0) -> Column:
    """Row number that ``shard_rows`` put at (shard, slot)."""
    return permute(slot.cast("long") * shards + shard, rows, seed, inverse=True)

"""Joins, ranks and top-k that stay balanced when one key holds a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.session import broadcast_limit, materialise, measured_bytes, stored

SALTS = 64
_ROW_BITS = 33  # low bits of monotonically_increasing_id hold the row position


def _salt(spread: str) -> Column:
    # a hash of the row key, not rand(): a retried task must give the same rows
    return F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS))


def fits_broadcast(dim: DataFrame) -> bool:
    """True when the measured size of the table is within the session's broadcast limit."""
    limit = broadcast_limit(dim.sparkSession)
    return bool(limit) and measured_bytes(dim) <= limit


def lookup_join(facts: DataFrame, dim: DataFrame, on: str, spread: str | None = None, how: str = "left",
                fits: bool | None = None) -> DataFrame:
    """Join many rows to a table with one row per key.

    The table is broadcast only when it fits, which is measured unless the
    caller knows (`fits`).  Otherwise it is written first, so that both sides
    of the join are plain shuffles and Spark's skew join splits the rows of a
    hot key over tasks, repeating only that key's row.  `spread` tells rows of
    one key apart; it is not needed for that and kept for callers.
    """
    if fits_broadcast(dim) if fits is None else fits:
        return facts.join(F.broadcast(dim), on, how)
    return facts.join(stored(dim, "lookup"), on, how)


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], need: str, at_most: int,
                  spread: str) -> DataFrame:
    """First `need` rows of each group; `need` is a column and never above `at_most`.

    Rows are cut per (group, salt) first, so a hot group is ranked by many
    tasks; the constant bound lets Spark cut before the shuffle as well.
    """
    first = Window.partitionBy(group, "_salt").orderBy(*order)
    last = Window.partitionBy(group).orderBy(*order)
    cut = (
        df.withColumn("_salt", _salt(spread))
        .withColumn("_rn", F.row_number().over(first))
        .where((F.col("_rn") <= at_most) & (F.col("_rn") <= F.col(need)))
    )
    return (
        cut.withColumn("_rn", F.row_number().over(last))
        .where((F.col("_rn") <= at_most) & (F.col("_rn") <= F.col(need)))
        .drop("_salt", "_rn")
    )


def distributed_rank(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """1-based position of every row in a global order, without a one-task window.

    Rows are range partitioned on the whole (unique) order, written once, and
    numbered as partition offset + position in the partition.  The offsets have
    one row per partition, so their window and broadcast are bounded.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    stored = materialise(placed).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    position = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_before") + position + 1).cast("bigint"))
        .drop("_part", "_at", "_before")
    )

"""Gapless numbers over a whole table in order, without a task that sees all of it."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.shared import written


def numbered(rows: DataFrame, order: list[Column | str], name: str = "line", first: int = 1, keep: list[str] | None = None) -> DataFrame:
    """rows with `name` (long): their place in the order, from first. keep: the columns that stay, by default all.

    Rows are range-partitioned by the order and numbered in each partition; the numbers of rows of the partitions before, one figure each, are added. The order should
    be total: which of several equal rows comes first is open, and they share a partition. An existing column of that name is replaced.
    """
    rows = rows.drop(*[c for c in rows.columns if c.lower() == name.lower()])
    return counted(rows.repartitionByRange(*order).sortWithinPartitions(*order), name, first, keep)


def counted(placed: DataFrame, name: str = "line", first: int = 1, keep: list[str] | None = None, takes: Column | None = None) -> DataFrame:
    """As numbered, for rows that stand in order already, within partitions and from one to the next.

    takes: how many numbers a row takes, 1 at least; its own is then the first of them. So rows that stand for many lines are written once and not a row a line.
    """
    placed = placed.drop(*[c for c in placed.columns if c.lower() == name.lower()])
    mark, width, nth = "_place", "_width", "_nth"
    while {mark, width, nth} & set(placed.columns):
        mark, width, nth = f"_{mark}", f"_{width}", f"_{nth}"
    rows, keep = placed.withColumn(width, (F.lit(1) if takes is None else takes).cast("long")), keep or placed.columns
    # Spark's ids: the partition's number above 33 bits that count its rows, of which a row has as many as it takes numbers. Written, as ranges are drawn anew in each job.
    one = F.monotonically_increasing_id().alias(mark)
    if takes is None:
        rows = rows.select(*keep, width, one)
    else:
        rows = rows.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), width))).select(*keep, width, nth, one).where(F.col(nth) == 1).drop(nth)
    kept = written(rows, "numbered")
    place = F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in kept.groupBy(F.shiftright(mark, 33).cast("int").alias("p")).agg(F.max(place + F.col(width)).alias("n")).collect()}  # a row a partition
    before = accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0))), initial=first)
    offsets = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    return kept.withColumn(name, F.get(offsets, F.shiftright(mark, 33).cast("int")) + place).drop(mark, width)

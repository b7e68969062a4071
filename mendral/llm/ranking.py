"""Running totals over groups of any size, without a task that holds a whole group.

A group is cut into blocks along its order; totals of blocks are few and are
summed along each group, and only rows of one block are summed row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Rows up to which a table of a few short columns is sent to every executor; beyond, it is shuffled.
BROADCAST_ROWS = 300_000
#: Rows of a block at least; large groups have blocks of the square root of their rows.
BLOCK_ROWS = 400


def near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def block_rows(n: Column) -> Column:
    return F.greatest(F.lit(BLOCK_ROWS), F.sqrt(n).cast("long"))


def running_total(df: DataFrame, by: list[str], block: str, order: list[str | Column], weight: Column, name: str, ties: bool = False) -> DataFrame:
    """``df`` with the total of ``weight`` in its group before each row.

    Rows are in order of (block, order); ``by`` and ``block`` are not null. With
    ``ties`` the total runs to the last row of equal order instead, itself included.
    ``df`` is read twice: give a stored table.
    """
    sums = materialize(df.groupBy(*by, block).agg(F.sum(weight).alias("__sum")), "block-sums")
    along = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, block, F.coalesce(F.sum("__sum").over(along), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, block).orderBy(*order)
    inside = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow) if ties else inside.rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(F.broadcast(before) if sums.count() <= BROADCAST_ROWS else before, [*by, block])
    return joined.withColumn(name, F.col("__before") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).drop("__before")


def places(df: DataFrame, by: list[str], order: list[str | Column], name: str, total: str, label: str) -> DataFrame:
    """``df`` stored, with the place (from 0) of each row in its group and the group's number of rows.

    Rows are dealt once, in ranges of (by, order, a drawn number), so that neither a
    group nor rows that tie gather in one task. A row's place is its distance from
    the first row of its group in its range, and what earlier ranges hold of the group;
    the table of ranges has a row for each task and group that meet. ``by`` is not null.
    """
    draw, at, block = "__draw", "__at", "__block"
    # stored first: the sample of the ranges would otherwise compute the rows a second time
    drawn = materialize(df.withColumn(draw, F.rand(20240229)), f"{label}-drawn")
    dealt = drawn.repartitionByRange(*by, *order, draw).sortWithinPartitions(*by, *order, draw)
    laid = materialize(dealt.drop(draw).withColumn(at, F.monotonically_increasing_id()), label)
    discard(drawn)
    with_block = laid.withColumn(block, F.shiftright(at, 33))
    runs = materialize(with_block.groupBy(*by, block).agg(F.count("*").alias("__n"), F.min(at).alias("__first")), "runs")
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__n").over(group.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(*by, block, (before - F.col("__first")).alias("__shift"), F.sum("__n").over(group).alias(total))
    return with_block.join(near(starts), [*by, block]).withColumn(name, F.col(at) + F.col("__shift")).drop(at, block, "__shift")

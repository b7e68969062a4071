"""Running sums over groups of any size, whatever their values look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendral.plans.storage import materialize


def running_sums(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``rows`` with a column ``name`` for each ``name: value``: what earlier rows of the group add up to, 0 at first.

    Rows are dealt in ranges of (keys, order), whose borders come from sampled
    quantiles, so each task gets about as many however closely values lie. Sums of whole
    ranges (a row for each range and group that meet) are added up along each group, rows only
    inside their range. ``keys`` are not null, rows that tie in the order are in any order.
    """
    dealt = materialize(rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    whole = dealt.groupBy(*keys, "__range").agg(*[F.sum(v).alias(f"__{n}") for n, v in sums.items()])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    start = whole.select(*keys, "__range", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(start, [*keys, "__range"])
    return out.select(*rows.columns, *[(F.col(f"__{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(n) for n, v in sums.items()])

"""Output in slices of a total order, with a manifest from which a stopped run goes on.

Rows get their place in the order without a window over all of them: they are dealt in
ranges, numbered in each range, and a range starts where those before it end. A slice
is so many rows in a row, and a folder of its own. Slices are written a batch at a time;
when a batch is in place, its slices enter the manifest with their number of rows and a
digest of them. A later run writes the slices that are not in the manifest, or that
are there with other rows, over whatever a stopped run has left of them. Readers see
slices of the manifest only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendral.plans.storage import materialize

MANIFEST = "_manifest"


def indexed(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """``rows`` stored, with ``index``: the place of each (from 0) in a total order."""
    at = F.monotonically_increasing_id()
    laid = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at), "indexed")
    ranges = laid.withColumn("__r", F.shiftright("__at", 33))
    sizes = ranges.groupBy("__r").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    starts = sizes.select("__r", (before - F.col("first")).alias("__shift"))
    return ranges.join(F.broadcast(starts), "__r").withColumn("index", F.col("__at") + F.col("__shift")).drop("__r", "__at", "__shift")


def index_slice(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of places ``start`` (included) to ``end`` (not included)."""
    return rows.where((F.col("index") >= start) & (F.col("index") < end))


def finished(spark: SparkSession, path: str) -> DataFrame:
    """(slice, n, digest) of the slices that are complete; the last entry of a slice counts."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "slice long, n long, digest long")
    rows = spark.read.schema("slice long, n long, digest long, at timestamp").parquet(f"{path}/{MANIFEST}")
    return rows.groupBy("slice").agg(F.max_by(F.struct("n", "digest"), "at").alias("m")).select("slice", "m.n", "m.digest")


def write_slices(rows: DataFrame, path: str, size: int, batch: int = 64, most: int | None = None) -> int:
    """Write what is missing of (index, ...) rows; the number of batches written, ``most`` of them at most."""
    spark = rows.sparkSession
    cut = rows.withColumn("slice", F.floor(F.col("index") / size).cast("long"))
    content = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])
    wanted = materialize(cut.groupBy("slice").agg(F.count("*").alias("n"), F.bit_xor(content).alias("digest")), "slices")
    todo = materialize(wanted.join(finished(spark, path), ["slice", "n", "digest"], "left_anti").withColumn("turn", F.floor((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("slice")) - 1) / batch)), "slices-missing")  # a row for each slice
    turns = [r["turn"] for r in todo.select("turn").distinct().orderBy("turn").collect()]
    for turn in turns[:most]:
        now = todo.where(F.col("turn") == turn)
        part = cut.join(F.broadcast(now.select("slice")), "slice", "left_semi")
        part.repartition("slice").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(path)
        now.select("slice", "n", "digest", F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    return len(turns[:most])


def read_slices(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of complete slices, without ``slice``."""
    rows = spark.read.schema(f"{schema}, slice long").parquet(path)
    return rows.join(F.broadcast(finished(spark, path).select("slice")), "slice", "left_semi").drop("slice")

"""Extensions: the batch operators over arriving files and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def repair_arrivals(spark: SparkSession, path: str, schema: str, repair: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch repair on each set of genome files that arrives; outputs are replaced by genome, so a retried batch writes the same."""

    def each(batch: DataFrame, _: int) -> None:
        repair(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("genome").parquet(out)

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_best_hits(hits: DataFrame) -> DataFrame:
    """Greatest bitscore of each pair over a stream of hits (update mode)."""
    return hits.groupBy("query", "subject").agg(F.max("bitscore").alias("bitscore"))


def windowed_events(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts and sums of events per type and tumbling window; what comes later than ``late`` is dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")

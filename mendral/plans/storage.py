"""Cutting lineage: tables written to the folder that the session shares."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

LOCAL_SCRATCH = "/tmp/checkpoints/mendral"


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a single machine has a default; on a cluster it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", LOCAL_SCRATCH)
        named = LOCAL_SCRATCH
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, deleted when the session ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize_counted(df: DataFrame, label: str = "table", what: Column | None = None) -> tuple[DataFrame, int]:
    """The stored table and its number of rows, or another sum ``what``, counted while it is written."""
    path, seen = scratch_path(df.sparkSession, label), Observation()
    df.observe(seen, (F.count(F.lit(1)) if what is None else what).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), int(seen.get["n"])


def width(schema: StructType) -> Column:
    """About how many bytes a row holds in memory: eight a field, and what strings and nested values add."""
    held = F.lit(16 + 8 * len(schema.fields)).cast("long")
    for field in schema.fields:
        c = F.col("`" + field.name.replace("`", "``") + "`")
        if isinstance(field.dataType, StringType | BinaryType):
            held = held + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(field.dataType, ArrayType | MapType | StructType):
            held = held + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return held


def materialize_measured(df: DataFrame, label: str = "table") -> tuple[DataFrame, int]:
    """The stored table and about the bytes its rows hold in memory, added up while it is written."""
    path, seen = scratch_path(df.sparkSession, label), Observation()
    df.observe(seen, F.coalesce(F.sum(width(df.schema)), F.lit(0)).alias("held")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), int(seen.get["held"])


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

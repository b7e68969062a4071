"""Which file belongs to which: names with fallbacks, and the first of several sources that has a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: how annotation files are named, {} being the identifier; earlier ones first
PATTERNS = ["annots_taxon_{}.tsv", "annots_{}.tsv", "{}.tsv", "{}.goa"]


def matching_files(wanted: DataFrame, files: DataFrame, patterns: list[str] = PATTERNS) -> DataFrame:
    """(id, file): for each identifier the file whose name fits the earliest pattern, null if none does; ties to the lesser path.

    ``wanted`` is (id), ``files`` (file) holds paths. A file is looked up by all names it
    may stand for, so the join has no condition but equality.
    """
    tries = [F.struct(F.lit(rank).alias("rank"), F.concat(F.lit(before), F.col("id"), F.lit(after)).alias("name")) for rank, (before, after) in enumerate(p.split("{}") for p in patterns)]
    asked = wanted.select("id").distinct().select("id", F.explode(F.array(*tries)).alias("t")).select("id", "t.rank", "t.name")
    have = files.select("file", F.element_at(F.split("file", "/"), -1).alias("name"))
    best = asked.join(have, "name").groupBy("id").agg(F.min(F.struct("rank", "file")).alias("b")).select("id", F.col("b.file").alias("file"))
    return wanted.select("id").distinct().join(best, "id", "left")


def first_match(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of each key from the first source that has the key; sources have the same columns."""
    ranked = reduce(lambda a, b: a.unionByName(b), [s.withColumn("__rank", F.lit(i)) for i, s in enumerate(sources)])
    first = ranked.groupBy(*keys).agg(F.min("__rank").alias("__rank"))
    return ranked.join(first, [*keys, "__rank"], "left_semi").drop("__rank")

"""Ragged scored-pair and annotation text files, read and written.

A line is an entity and tab-separated ``term|score`` tokens (or bare terms). A
repeated entity replaces its earlier line as a whole, and within a line the last
token of a term counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendral.functions.scalars import file_field

POLICIES = ("raise", "skip")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, row, value): lines with their order inside a file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("row"), F.regexp_replace("value", r"[\r\n]+$", "").alias("value"))


def _tokens(rows: DataFrame, comments: bool) -> DataFrame:
    kept = rows.where(~F.col("value").startswith("#") & (F.trim("value") != "")) if comments else rows
    parts = F.split("value", "\t")
    named = kept.select("file", "row", F.get(parts, F.lit(0)).alias("protein"), F.slice(parts, 2, F.size(parts)).alias("tokens"))
    last = Window.partitionBy("file", "protein").orderBy(F.desc("row"))
    return named.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "row")


def read_scored(spark: SparkSession, path: str | list[str], malformed: str = "raise", comments: bool = False, keep_empty: bool = False, as_text: bool = False) -> DataFrame:
    """(file, genome, fold, protein, term, score) of scored-pair files.

    ``malformed``: a token without exactly one bar, or without a number, fails the
    job or is skipped. Entities without tokens are dropped, or kept with a null term.
    ``as_text`` keeps the score as it is written.
    """
    if malformed not in POLICIES:
        raise ValueError(f"malformed must be one of {POLICIES}")
    rows = _tokens(lines(spark, path), comments)
    part = lambda token, i: F.get(F.split(token, r"\|"), F.lit(i))
    good = lambda token: (F.size(F.split(token, r"\|")) == 2) & part(token, 1).try_cast("double").isNotNull()
    if malformed == "raise":
        checked = F.transform("tokens", lambda t: F.when(good(t), t).otherwise(F.raise_error(F.concat(F.lit("malformed token: "), t)).cast("string")))
    else:
        rows, checked = rows.where((F.size("tokens") == 0) | F.exists("tokens", good)), F.filter("tokens", good)
    # tokens of a term stand together, the last one first: each line folds on its own, without a shuffle of tokens
    sorted_ = F.array_sort(F.transform(checked, lambda t, i: F.struct(part(t, 0).alias("term"), (-i).alias("i"), part(t, 1).alias("score"))))
    rows = rows.select("file", "protein", sorted_.alias("tokens"))
    first = F.filter("tokens", lambda t, i: (i == 0) | (t["term"] != F.get("tokens", i - 1)["term"]))
    rows = rows.select("file", "protein", first.alias("tokens"))
    exploded = rows.select("file", "protein", (F.explode_outer if keep_empty else F.explode)("tokens").alias("t"))
    value = F.col("t.score")
    out = exploded.select("file", "protein", F.col("t.term").alias("term"), (value if as_text else value.cast("double")).alias("score"))
    return out.select("file", file_field(F.col("file"), "taxon").alias("genome"), file_field(F.col("file"), "fold").alias("fold"), "protein", "term", "score")


def read_annotations(spark: SparkSession, path: str | list[str] | None) -> DataFrame:
    """(file, protein, term) of annotation files; ``None`` is an empty table."""
    if path is None:
        return spark.createDataFrame([], "file string, protein string, term string")
    return _tokens(lines(spark, path), comments=True).select("file", "protein", F.explode("tokens").alias("term")).where(F.col("term") != "").distinct()


def sets_above(scored: DataFrame, threshold: float) -> DataFrame:
    """(genome, protein, terms): the terms above a threshold, proteins without any kept with an empty set."""
    return scored.groupBy("genome", "protein").agg(F.array_sort(F.collect_set(F.when(F.col("score") > threshold, F.col("term")))).alias("terms"))


def of_proteins(scored: DataFrame, proteins: DataFrame) -> DataFrame:
    return scored.join(proteins.select("protein").distinct(), "protein", "left_semi")


def repaired(scored: DataFrame) -> DataFrame:
    """Rows of a repaired file that are set."""
    return scored.where(F.col("score") > 0)


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """(protein, term, aspect) of GAF rows: columns 2, 5 and 9; ``!`` lines are comments."""
    p = F.split("value", "\t")
    return spark.read.text(path).where(~F.col("value").startswith("!")).where(F.size(p) >= 9).select(F.get(p, F.lit(1)).alias("protein"), F.get(p, F.lit(4)).alias("term"), F.get(p, F.lit(8)).alias("aspect")).distinct()


def valid_files(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(file, valid): are the tokens of the (first) lines of each file well formed?"""
    rows = lines(spark, path)
    if first is not None:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("file").orderBy("row"))).where(F.col("__n") <= first)
    tokens = rows.select("file", F.explode(F.slice(F.split("value", "\t"), 2, 1 << 30)).alias("token"))
    return tokens.groupBy("file").agg(F.bool_and(F.col("token").rlike(r"^[^|]+\|[+-]?([0-9]*[.])?[0-9]+([eE][+-]?[0-9]+)?$")).alias("valid"))


def _row(tokens: Column) -> Column:
    return F.concat_ws("\t", "protein", F.array_join(F.array_sort(tokens), "\t"))


def scored_lines(scored: DataFrame, proteins: DataFrame | None = None, floor: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, value): lines of a scored-pair file, scores with six decimals.

    With a floor only scores at or above it are written; with a list of proteins
    each has a line, bare if nothing is left.
    """
    keys = keys or []
    rows = scored if floor is None else scored.where(F.col("score") >= floor)
    made = rows.groupBy(*keys, "protein").agg(F.collect_list(F.format_string("%s|%.6f", "term", "score")).alias("t"))
    if proteins is not None:
        made = proteins.select(*keys, "protein").distinct().join(made, [*keys, "protein"], "left")
    empty = F.col("t").isNull() | (F.size("t") == 0)
    return made.select(*keys, F.when(empty, F.col("protein")).otherwise(_row(F.col("t"))).alias("value"))


def write_scored(scored: DataFrame, path: str, **how) -> None:
    """One folder for each genome, if there is that column, under the commit protocol of Spark."""
    keys = [k for k in ("genome",) if k in scored.columns]
    writer = scored_lines(scored, keys=keys, **how).write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).text(path)


def annotation_lines(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("protein").agg(F.collect_set("term").alias("t")).select(_row(F.col("t")).alias("value"))


def missing_only(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has no finished output yet: resume by anti-join on the keys of completed partitions."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def checksummed(terms: DataFrame) -> DataFrame:
    """One row (n, sha256) of a sorted list joined by line breaks: a static list bounded by its vocabulary."""
    return terms.agg(F.count("*").alias("n"), F.sha2(F.concat(F.array_join(F.array_sort(F.collect_set("term")), "\n"), F.lit("\n")), 256).alias("sha256"))


def report_json(report: DataFrame, key: str = "genome") -> DataFrame:
    """(key, value): a nested report as JSON, sets as arrays."""
    return report.select(key, F.to_json(F.struct(*report.columns)).alias("value"))


def read_reports(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Chosen nested fields (``name -> path.in.json``) of one-object JSON files."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.select("file", *[F.expr(f"try_cast(get_json_object(value, '$.{p}') AS DOUBLE)").alias(n) for n, p in fields.items()])

"""Exact deduplication by composable polynomial fingerprints.

Texts are normalised (each run of ``[\\x20\\x09-\\x0D]`` becomes one space),
cut into chunks and each chunk is hashed as a base-256 number modulo two primes.
Chunk hashes combine by ``H(ab) = H(a) * 256^len(b) + H(b)``, so a huge text is
hashed by many tasks and put together by one sum of shifted terms. Rows are then
grouped by (fingerprint, length). Groups of several rows are compared chunk by
chunk: the least and the greatest content of each chunk number must agree, which
aggregates before the shuffle, so a group of any size sends one row per chunk
and task. The SHA-256 that the result carries is part of the key as well; a group
that still differs is taken apart by its whole texts.

Defined results: a null text equals the empty one. Null ids sort after all
others; a group of null ids only has ``keep_id`` null. Repeated rows count in
``group_size``; rows that share the smallest id are all ``kept`` here, and
``keep_first`` leaves one of them. An id that stands for several texts is in the
group of each. Texts of any length are compared in whole. An empty table gives
an empty result. Other columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, small_batches, take_over, unused, utf8

#: Two primes just above 10**18: 120 bits of fingerprint together.
PRIMES = (10**18 + 3, 10**18 + 9)
CHUNK = 1 << 16
#: Texts of more bytes are cut up and hashed by many tasks.
HUGE = 1 << 22

SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def normalise(raw: bytes) -> bytes:
    raw = raw.translate(SPACES)
    while b"  " in raw:
        raw = raw.replace(b"                ", b" ").replace(b"  ", b" ")
    return raw


def hash_chunk(raw: bytes) -> tuple[int, ...]:
    n = int.from_bytes(raw, "big")
    return tuple(n % p for p in PRIMES)


def combine(a: tuple[int, ...], b: tuple[int, ...], len_b: int) -> tuple[int, ...]:
    return tuple((x * pow(256, len_b, p) + y) % p for x, y, p in zip(a, b, PRIMES, strict=True))


def fingerprint(raw: bytes, chunk: int = CHUNK) -> tuple[int, ...]:
    out = (0,) * len(PRIMES)
    for i in range(0, len(raw), chunk):
        part = raw[i : i + chunk]
        out = combine(out, hash_chunk(part), len(part))
    return out


PRINTS = "doc_id long, f0 long, f1 long, n_bytes long, text_sha256 string"


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    take_over("exact_dedup")
    for b in batches:
        data, off = utf8(b.column("text"))
        f0, f1, size, sha = [], [], [], []
        for i in range(len(off) - 1):
            raw = normalise(data[off[i] : off[i + 1]].tobytes())
            x, y = fingerprint(raw)
            f0.append(x)
            f1.append(y)
            size.append(len(raw))
            sha.append(hashlib.sha256(raw).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(f0, pa.int64()), pa.array(f1, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "f0", "f1", "n_bytes", "text_sha256"])


def _chunk_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each chunk shifted by what follows it, so that a sum combines them."""
    for b in batches:
        data, off = utf8(b.column("part"))
        after = b.column("after").to_pylist()
        hashed = [hash_chunk(data[off[i] : off[i + 1]].tobytes()) for i in range(len(off) - 1)]
        shifted = [[h * pow(256, a, p) % p for h, p in zip(hs, PRIMES, strict=True)] for hs, a in zip(hashed, after, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sha"), b.column("total"), *(pa.array([s[k] for s in shifted], pa.int64()) for k in range(len(PRIMES)))], ["doc_id", "text_sha256", "n_bytes", "f0", "f1"])


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def prints(docs: DataFrame, huge: int = HUGE, chunk: int = CHUNK) -> DataFrame:
    """doc_id, f0, f1, n_bytes, text_sha256 of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small = rows.where(F.octet_length(F.coalesce("text", F.lit(""))) <= huge).mapInArrow(_prints, PRINTS)
    long = rows.where(F.octet_length("text") > huge).select("doc_id", F.encode(normalised(), "UTF-8").alias("raw"))
    total = F.octet_length("raw").cast("long")
    parts = (
        long.select("doc_id", "raw", F.sha2("raw", 256).alias("sha"), total.alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / chunk))).alias("k"))
        .select("doc_id", "sha", "total", F.substring("raw", (F.col("k") * chunk + 1).cast("int"), F.lit(chunk)).alias("part"), F.greatest(F.lit(0).cast("long"), F.col("total") - (F.col("k") + 1) * chunk).alias("after"))
        .repartition(F.col("sha"), F.col("after"))
        .mapInArrow(_chunk_prints, "doc_id long, text_sha256 string, n_bytes long, f0 long, f1 long")
        .groupBy("doc_id", "text_sha256", "n_bytes")
        # equal huge rows under one id send their terms together: count them and share the sum out
        .agg(F.sum(F.col("f0").cast("decimal(38,0)")).alias("s0"), F.sum(F.col("f1").cast("decimal(38,0)")).alias("s1"), F.count("*").alias("n"))
    )
    copies = (F.col("n") / F.ceil(F.col("n_bytes") / chunk)).cast("int")
    each = F.explode(F.array_repeat(F.struct((F.col("s0") / copies).cast("decimal(38,0)").alias("s0"), (F.col("s1") / copies).cast("decimal(38,0)").alias("s1")), copies))
    whole = parts.select("doc_id", each.alias("s"), "n_bytes", "text_sha256").select(
        "doc_id", (F.col("s.s0") % F.lit(PRIMES[0])).cast("long").alias("f0"), (F.col("s.s1") % F.lit(PRIMES[1])).cast("long").alias("f1"), "n_bytes", "text_sha256"
    )
    return small.unionByName(whole)


KEY = ["f0", "f1", "n_bytes"]


KEYED = [*KEY, "text_sha256"]


def unequal(docs: DataFrame, hashed: DataFrame, groups: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Groups whose texts differ somewhere, found by comparing chunk after chunk."""
    many = groups.where("group_size > 1").select(*KEYED)
    # a table of its own: the join ends its plan, so the runtime can split a large group of copies
    ids = materialize(hashed.where("doc_id IS NOT NULL").hint("merge").join(many, KEYED, "left_semi").select(F.col("doc_id").alias("i"), *KEYED), "dedup-members").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), "text").hint("merge").join(ids, "i").select(*KEYED, F.encode(normalised(), "UTF-8").alias("raw"))
    last = F.greatest(F.lit(0), F.floor((F.octet_length("raw") - 1) / chunk).cast("int"))
    parts = texts.select(*KEYED, "raw", F.explode(F.sequence(F.lit(0), last)).alias("k")).select(*KEYED, "k", F.substring("raw", F.col("k") * chunk + 1, F.lit(chunk)).alias("part"))
    # a row whose id is repeated over several texts meets each of their groups: compare its own only
    parts = parts.where((F.octet_length("part") == F.least(F.lit(chunk), F.col("n_bytes") - F.col("k") * chunk)))
    return parts.groupBy(*KEYED, "k").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select(*KEYED).distinct()


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    return _deduplicate(docs)[0]


def _deduplicate(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The result of ``deduplicate``, and the fingerprints of the rows."""
    hashed = materialize(prints(docs), "dedup-prints")
    groups = materialize(hashed.groupBy(*KEYED).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "dedup-groups")
    differ = materialize(unequal(docs, hashed, groups), "dedup-unequal")
    # a group that differs is taken apart by the whole text; the others stand as they are
    rows = hashed.hint("merge").join(groups, KEYED).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *KEY)
    if differ.limit(1).count():
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("x")).withColumn("text_sha256", F.sha2("x", 256)).join(differ.select("text_sha256").distinct(), "text_sha256", "left_semi")
        exact = texts.groupBy("x").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        redone = texts.join(exact, "x").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
        rows = rows.join(differ, KEYED, "left_anti").drop(*KEY).unionByName(redone)
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256"), hashed


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with its own columns: that of the least id.

    Rows are told apart by id and text, so an id that stands for several texts
    keeps each of them. Of rows that repeat both, one stays. Groups that only rows
    without an id have keep one of these.
    """
    row, sha, mine, print_ = unused(docs, "keep_id", "keep_sha", "own_id", "own_sha")
    result, hashed = _deduplicate(docs)
    chosen = materialize(result.where("kept").select(F.col("doc_id").alias(row), F.col("text_sha256").alias(sha)).distinct(), "dedup-keep")
    often = materialize(hashed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias(mine)), "dedup-repeated-ids")
    if not often.limit(1).count():
        return docs.join(chosen, F.col("doc_id").cast("long") == F.col(row), "left_semi")
    once = chosen.join(often, F.col(row).eqNullSafe(F.col(mine)), "left_anti")
    plain = docs.join(once, F.col("doc_id").cast("long") == F.col(row), "left_semi")
    several = chosen.join(often, F.col(row).eqNullSafe(F.col(mine)), "left_semi")
    rows = docs.withColumn(mine, F.col("doc_id").cast("long")).join(often.withColumnRenamed(mine, row), F.col(mine).eqNullSafe(F.col(row)), "left_semi").withColumn(print_, F.sha2(normalised(), 256))
    kept = rows.join(several, F.col(mine).eqNullSafe(F.col(row)) & (F.col(print_) == F.col(sha)), "left_semi").dropDuplicates([mine, print_])
    return plain.unionByName(kept.drop(mine, print_))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
FROM t JOIN g ON t.x = g.x
"""

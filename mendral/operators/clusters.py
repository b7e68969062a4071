"""Clusters of similar sequences by banded MinHash over k-mers, for splits that keep relatives together.

A sequence's set is its distinct k-mers (the whole sequence, if shorter). Equal sequences
are one set; pairs move sequences, and their sets are made where they are compared. Each of ``bands * rows`` hash functions keeps the least hash of a set;
rows of a band together are its bucket there. Two sets of similarity s meet in some
bucket with probability 1 - (1 - s^rows)^bands, over 0.9999 at the default least
similarity and settings. In a bucket every set is compared with the least one; those
that are linked to it are in one cluster already, so only pairs with a set that is not
linked to it are compared as well. A dense group of relatives therefore costs as many
comparisons as it has members. Sets that meet by chance, on a frequent k-mer, are compared by
bitmaps of their k-mers within the bucket: a k-mer whose bit the other set lacks is in that set
alone, which bounds what both can share. Only pairs that may be linked are moved and compared
exactly. Clusters are the components of the links.

A null or empty sequence is in a cluster of its own. Rows that repeat an id with another
sequence link both. The representative of a cluster is its longest sequence, ties by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendral.plans.storage import materialize, materialize_counted

from .components import components
from .hierarchy import small

K, BANDS, ROWS = 5, 40, 2
LEAST = 0.5
#: Numbers of 64 bits in a bitmap of k-mers.
WORDS = 8
#: Keys of bands that are sorted in one task.
TASK_KEYS = 1_000_000


def kmers(sequence: str | Column, k: int) -> Column:
    """Hashes of the distinct k-mers of a sequence."""
    s = F.col(sequence) if isinstance(sequence, str) else sequence
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - k + 1))
    return F.sort_array(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring(s, i, F.lit(k))))))


def jaccard(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _keys(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands): a key for each band of each set, made of the least value of each of the band's hash functions."""
    seeds = _mixed(np.arange(1, bands * (rows + 1) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(bands, rows + 1)
    out = np.empty((len(starts), bands), np.uint64)
    for i, (own, *functions) in enumerate(seeds):
        key = np.full(len(starts), own)
        for seed in functions:
            key = _mixed(key ^ np.minimum.reduceat(_mixed(hashes ^ seed), starts))
        out[:, i] = key
    return out.view(np.int64)


def band_keys(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """(n, key): the keys of every set (n, kmers) that is not empty."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kmers = batch.column("kmers")
            hashes, starts = kmers.flatten().to_numpy(zero_copy_only=False).view(np.uint64), kmers.offsets.to_numpy()
            n = batch.column("n").to_numpy(zero_copy_only=False)
            if len(n):
                keys = _keys(hashes, (starts[:-1] - starts[0]).astype(np.int64), bands, rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(n, bands)), pa.array(keys.ravel())], ["n", "key"])

    return sets.where("size(kmers) > 0").select("n", "kmers").mapInArrow(keyed, f"n {sets.schema['n'].dataType.simpleString()}, key long")


def bitmap(of: str) -> list[Column]:
    """``w0`` and on: the bits of all hashes of a set."""
    zero = F.lit(0).cast("long")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    of_word = lambda i: lambda bits, h: bits.bitwiseOR(F.when(F.pmod(F.shiftright(h, 6), F.lit(WORDS)) == i, bit(h)).otherwise(zero))
    return [F.aggregate(of, zero, of_word(i)).alias(f"w{i}") for i in range(WORDS)]


def may_link(least: float, x: str = "x", y: str = "y") -> Column:
    """Can two sets, by their sizes and bitmaps, be linked? Never false for sets that are."""
    c = lambda t, name: F.col(f"{t}.{name}")
    alone = lambda s, t: reduce(add, [F.bit_count(c(s, f"w{i}").bitwiseAND(F.bitwise_not(c(t, f"w{i}")))) for i in range(WORDS)])
    shared = F.least(c(x, "size") - alone(x, y), c(y, "size") - alone(y, x))
    return shared >= least * (c(x, "size") + c(y, "size") - shared) - 1e-9


def within_buckets(members: DataFrame, sets: DataFrame, least: float, tasks: int, value: str, as_set: Callable[[Column], Column]) -> DataFrame:
    """(a, b), a < b: pairs of members (key, n, rest) of a bucket that may be linked, one of them at least of ``rest``."""
    own = members.join(sets.select("n", value), "n").withColumn("kmers", as_set(F.col(value)))
    mapped = materialize(own.select("key", "n", "rest", F.size("kmers").alias("size"), *bitmap("kmers")), "bitmaps").repartition(tasks, "key")
    first = (F.col("y.rest") & (F.col("x.n") < F.col("y.n"))) | (~F.col("y.rest") & (F.col("x.n") != F.col("y.n")))
    pairs = mapped.where("rest").alias("x").join(mapped.alias("y"), (F.col("x.key") == F.col("y.key")) & first & may_link(least))
    return pairs.select(F.least("x.n", "y.n").alias("a"), F.greatest("x.n", "y.n").alias("b")).distinct()


def similar(sets: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, value: str = "kmers", as_set: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(a, b), a < b: pairs of sets (n, value) that are linked, those that a bucket's least set implies aside.

    ``as_set`` makes the set from the column ``value``, which is what is moved.
    """
    made = sets.select("n", as_set(F.col(value)).alias("kmers"))
    keys, n = materialize_counted(band_keys(made, bands, rows), "band-keys")
    tasks = max(sets.sparkSession.sparkContext.defaultParallelism, n // TASK_KEYS + 1)
    pivot = F.min("n").over(Window.partitionBy("key"))
    met = materialize(keys.repartition(tasks, "key").withColumn("pivot", pivot).where("n <> pivot"), "band-members")
    left, right = sets.select(F.col("n").alias("a"), F.col(value).alias("x")), sets.select(F.col("n").alias("b"), F.col(value).alias("y"))

    def compared(pairs: DataFrame) -> DataFrame:
        both = pairs.join(left, "a").join(right, "b").select("a", "b", as_set(F.col("x")).alias("x"), as_set(F.col("y")).alias("y"))
        return both.select("a", "b", (jaccard("x", "y") >= least).alias("linked"))

    first = materialize(compared(met.select(F.col("pivot").alias("a"), F.col("n").alias("b")).distinct()), "pivot-pairs")
    apart = small(first.where("NOT linked").select(F.col("a").alias("pivot"), F.col("b").alias("n"), F.lit(True).alias("apart")))
    marked = met.join(apart, ["pivot", "n"], "left").select("key", "n", F.col("apart").isNotNull().alias("rest"))
    members = marked.join(small(marked.where("rest").select("key").distinct()), "key", "left_semi")
    second = compared(within_buckets(members, sets, least, tasks, value, as_set))
    return first.unionByName(second).where("linked").select("a", "b").distinct()


def sequence_clusters(sequences: DataFrame, k: int = K, least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(rep, member) of every protein of (protein, sequence): clusters as ``splits.cluster_split`` takes them."""
    own = materialize(sequences.select("protein", F.coalesce("sequence", F.lit("")).alias("sequence")).distinct(), "sequences")
    known = own.where("sequence <> ''")
    sets = materialize(known.select("sequence").distinct().withColumn("n", F.monotonically_increasing_id()), "sequence-sets")
    label = components(similar(sets, least, bands, rows, "sequence", lambda s: kmers(s, k))).select(F.col("node").alias("n"), "component")
    numbered = known.join(sets, "sequence").select("protein", F.length("sequence").alias("length"), "n")
    named = numbered.join(label, "n", "left").select("protein", "length", F.coalesce("component", "n").alias("component"))
    # a protein with several sequences makes their clusters one
    first = materialize(named, "sequence-components")
    twice = first.groupBy("protein").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("protein", "a")
    more = components(first.join(twice, "protein").select("a", F.col("component").alias("b"))).withColumnRenamed("component", "joined")
    whole = materialize(first.join(more, F.col("component") == F.col("node"), "left").select("protein", "length", F.coalesce("joined", "component").alias("component")), "clusters")
    rep = whole.groupBy("component").agg(F.min(F.struct((-F.col("length")).alias("l"), "protein")).alias("r")).select("component", F.col("r.protein").alias("rep"))
    lone = own.groupBy("protein").agg(F.max(F.length("sequence")).alias("l")).where("l = 0").select(F.col("protein").alias("rep"), F.col("protein").alias("member"))
    return whole.join(rep, "component").select("rep", F.col("protein").alias("member")).distinct().unionByName(lone)

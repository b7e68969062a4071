"""Near duplicates among embeddings by Euclidean p-stable hashing.

Vectors become unit vectors. Each of several tables draws Gaussian directions and
shifts; a vector's projections, cut into steps of ``WIDTH``, are its bucket in the
table. Vectors at the least cosine share a table's bucket with a known
probability, so the number of directions follows from the number of vectors
(about one chance companion a bucket) and the number of tables from ``MISS``, the
probability of missing a pair at exactly the least cosine: 0.0002, falling fast
above it (at 0.98 under 1e-8). Nothing is dropped from a bucket, whatever its size.

Groups of near copies are counted without their pairs. Equal vectors are one
vector with a multiplicity. In dense buckets the mean of the members is a centre,
and those within half the greatest angle of it form a ball: two of them are within the
greatest angle of each other, so all are linked. Units are balls and single
vectors. Units that share a bucket are compared once: by angles between centres
where these decide for all members (triangle inequality), else member by
member, with exact cosines. Two single vectors also need like signs on 64 more
directions before they are compared (up to 22 may differ; 6.5 are expected at the least cosine).
Vectors that lie densely, but each outside the balls (a shell), are compared pair by pair.

Defined results: null, empty or zero vectors, and those with null or non-finite
components, link with nothing. Vectors of different lengths link with nothing.
Repeated ids are rows of their own; a row without an id links as others do, the
least id skips it, and a group of such rows has ``component_id`` null. An empty
table gives an empty result. Other columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, own, small_batches, table, unused
from .components import components

COSINE = 0.95
#: Step of a projection of unit vectors; near the best for pairs at this cosine.
WIDTH = 2.0
MISS = 0.0002
#: Buckets of so many vectors are looked at for balls.
DENSE = 16
#: Of 64 signs, so many may differ between two vectors that are compared.
SIGNS = 22
#: Angles that are nearer to a bound than this are left to exact cosines.
SLACK = 1e-7
SEED = 20240229
ROWS = 256


def collide(distance: float, width: float = WIDTH) -> float:
    """Probability that two points at this distance fall into one step of a Gaussian projection."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def layout(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(directions of a table, tables) for n vectors."""
    near, far = collide(math.sqrt(2 - 2 * cosine)), collide(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log(1 - near**k)))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, null) of a list array; null components are NaN."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return values, column.offsets.to_numpy().astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


def _array(rows: list[np.ndarray | None]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.float64()))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors and their digests; both null where a vector links with nothing."""
    for b in batches:
        values, off, null = _lists(b.column("v"))
        out: list[np.ndarray | None] = []
        for i in range(b.num_rows):
            v = values[off[i] : off[i + 1]]
            top = 0.0 if null[i] or not len(v) else float(np.abs(v).max())
            if not (0 < top < math.inf):  # NaN fails as well
                out.append(None)
                continue
            v = v / top
            out.append(v / math.sqrt(float(v @ v)))
        digest = [None if u is None else hashlib.blake2b((u + 0.0).tobytes(), digest_size=16).digest() for u in out]
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(digest, pa.binary()), _array(out)], ["vec_id", "digest", "u"])


def _hasher(k: int, tables: int, seed: int) -> Callable:
    """uid, signs and bucket keys of each unit vector: one key for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple] = {}
        for b in batches:
            values, off, _ = _lists(b.column("u"))
            size = np.diff(off)
            uid = b.column("uid").to_numpy()
            for d in np.unique(size):
                if int(d) not in drawn:
                    rng = np.random.default_rng([seed, int(d)])
                    drawn[int(d)] = (rng.standard_normal((d, tables * k)), rng.uniform(0, WIDTH, tables * k), rng.standard_normal((d, 64)))
                directions, shifts, planes = drawn[int(d)]
                at = np.flatnonzero(size == d)
                for i in range(0, len(at), ROWS):
                    part = at[i : i + ROWS]
                    u = values[off[part][:, None] + np.arange(d)]
                    steps = np.floor((u @ directions + shifts) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(part), tables, k)
                    key = np.broadcast_to(mix64(np.arange(tables, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(d)), (len(part), tables))
                    for j in range(k):
                        key = mix64(key * np.uint64(0xD1342543DE82EF95) + steps[:, :, j])
                    signs = ((u @ planes > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables), pa.array(key.reshape(-1).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(uid[part]), pa.array(signs.view(np.int64)), keys], ["uid", "signs", "keys"])

    return run


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def angle(a: str, b: str) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b))))


def _centres(members: DataFrame) -> DataFrame:
    """(home, c): the direction of the mean of the unit vectors of each home."""
    mean = members.select("home", F.posexplode("u").alias("p", "x")).groupBy("home", "p").agg(F.sum("x").alias("x"))
    whole = mean.groupBy("home").agg(F.sort_array(F.collect_list(F.struct("p", "x"))).alias("s"))  # as many values as a vector has
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, s: a + s["x"] * s["x"]))
    return whole.where(norm > 0).select("home", F.transform("s", lambda s: s["x"] / norm).alias("c"))


def _balls(reps: DataFrame, shared: DataFrame, half: float) -> DataFrame:
    """(uid, home, far, c): members of balls with their angle to the centre; at most one ball for each vector."""
    dense = materialize(shared.where(F.col("n") >= DENSE), "dense")
    first = materialize(dense.groupBy("uid").agg(F.max(F.struct("n", "key")).getField("key").alias("home")).join(reps.select("uid", "u"), "uid"), "dense-home")
    centres = materialize(_centres(first), "centres")
    own_ball = first.join(centres, "home").withColumn("far", angle("u", "c")).where(F.col("far") <= half)
    inside = materialize(own_ball.select("uid", "home", "far"), "balls")
    # a group's vectors have several homes: each bucket offers its members the largest ball that it meets
    size = inside.groupBy("home").agg(F.count("*").alias("size"))
    met = dense.join(inside.join(size, "home").select("uid", "home", "size"), "uid").groupBy("key").agg(F.max(F.struct("size", "home")).alias("best"))
    offer = dense.join(met, "key").groupBy("uid").agg(F.max("best").getField("home").alias("home"))
    moved = offer.join(reps.select("uid", "u"), "uid").join(centres, "home").withColumn("far", angle("u", "c")).where(F.col("far") <= half).select("uid", "home", "far")
    moved = materialize(moved, "balls")
    kept = inside.join(moved.select("uid"), "uid", "left_anti")
    return moved.unionByName(kept).join(centres, "home")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    small_batches(spark)
    theta = math.acos(cosine)
    rows = materialize(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(_units, "vec_id long, digest binary, u array<double>"), "unit-vectors")
    once = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("u").alias("u"))
    reps = materialize(once.withColumn("uid", F.monotonically_increasing_id()), "vectors-once")
    k, tables = layout(reps.count(), cosine, miss)
    hashed = materialize(reps.select("uid", "u").mapInArrow(_hasher(k, tables, seed), "uid long, signs long, keys array<long>"), "vector-keys")
    keys = hashed.select("uid", F.explode("keys").alias("key"))
    shared = materialize(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "shared-keys")

    # units: balls, and vectors in none; a unit is named after its least uid
    balls = materialize(_balls(reps, shared, theta / 2 - SLACK), "balls")
    ball = materialize(balls.join(reps.select("uid", "copies"), "uid").groupBy("home").agg(F.min("uid").alias("unit"), F.sum("copies").alias("n"), F.max("far").alias("r"), F.first("c").alias("c")), "ball-units")
    in_ball = balls.select("uid", "home", "far").join(ball.select("home", "unit"), "home").select("uid", "unit", "far")
    members = materialize(reps.select("uid", "copies", "least", "u").join(in_ball, "uid", "left").join(hashed.select("uid", "signs"), "uid").withColumn("single", F.col("unit").isNull()).withColumn("unit", F.coalesce("unit", "uid")), "unit-members")
    units = materialize(ball.select("unit", "n", "r", "c", F.lit(False).alias("single")).unionByName(members.where("single").select("unit", F.col("copies").alias("n"), F.lit(0.0).alias("r"), F.col("u").alias("c"), "single")), "units")
    at = materialize(shared.select("key", "uid").join(members.select("uid", "unit", F.when(F.col("single"), F.col("signs")).alias("signs")), "uid").select("key", "unit", "signs").distinct(), "key-units")
    several = at.groupBy("key").agg(F.min("unit").alias("lo"), F.max("unit").alias("hi")).where("lo < hi").select("key")
    at = materialize(at.join(several, "key", "left_semi"), "key-units")
    right = at.select("key", F.col("unit").alias("b"), F.col("signs").alias("signs_b"))
    alike = F.coalesce(F.bit_count(F.col("signs").bitwiseXOR(F.col("signs_b"))) <= SIGNS, F.lit(True))
    pairs = materialize(at.withColumnRenamed("unit", "a").join(right, "key").where((F.col("a") < F.col("b")) & alike).select("a", "b").distinct(), "unit-pairs")
    discard(shared)

    # what angles between units decide
    side = lambda s: units.select(F.col("unit").alias(s), F.col("n").alias(f"n_{s}"), F.col("r").alias(f"r_{s}"), F.col("c").alias(f"c_{s}"), F.col("single").alias(f"single_{s}"))
    apart = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("cos", dot("c_a", "c_b")).withColumn("angle", angle("c_a", "c_b")).drop("c_a", "c_b")
    both = F.col("single_a") & F.col("single_b")
    reach = F.col("r_a") + F.col("r_b")
    linked = F.when(both, F.col("cos") >= cosine).otherwise(F.col("angle") + reach <= theta - SLACK)
    open_ = ~both & ~linked & (F.col("angle") - reach <= theta + SLACK)
    judged = materialize(apart.select("a", "b", "n_a", "n_b", linked.alias("linked"), open_.alias("open")).where("linked OR open"), "unit-angles")
    sure = judged.where("linked").select("a", "b", "n_a", "n_b")

    # where they don't: the members of the smaller unit against the other, then against its members
    few_first = F.col("n_a") <= F.col("n_b")
    left = judged.where("open").select(F.when(few_first, F.col("a")).otherwise(F.col("b")).alias("unit"), F.when(few_first, F.col("b")).otherwise(F.col("a")).alias("b"))
    mine = left.join(members.select("unit", "uid", "copies", "u"), "unit").join(side("b"), "b").withColumn("angle", angle("u", "c_b"))
    mine = materialize(mine.where(F.col("angle") - F.col("r_b") <= theta + SLACK).select("unit", "uid", "copies", "u", "b", "n_b", "angle", (F.col("angle") + F.col("r_b") <= theta - SLACK).alias("linked")), "member-angles")
    sure_one = mine.where("linked").select("unit", "uid", "copies", "b", "n_b")
    theirs = members.select(F.col("unit").alias("b"), F.col("uid").alias("uid_b"), F.col("copies").alias("copies_b"), F.col("u").alias("u_b"), F.coalesce("far", F.lit(0.0)).alias("far"))
    each = mine.where("NOT linked").join(theirs, "b").where(F.abs(F.col("angle") - F.col("far")) <= theta + SLACK)
    found = F.when(F.col("angle") + F.col("far") <= theta - SLACK, True).otherwise(dot("u", "u_b") >= cosine)
    sure_two = materialize(each.where(found).select("unit", "uid", "copies", "b", "uid_b", "copies_b"), "member-links")

    # links of a vector: its copies, its ball, whole units, single vectors
    by_unit = sure.select(F.col("a").alias("unit"), F.col("n_b").alias("x")).unionByName(sure.select(F.col("b").alias("unit"), F.col("n_a").alias("x"))).unionByName(sure_one.select(F.col("b").alias("unit"), F.col("copies").alias("x")))
    by_one = sure_one.select("uid", F.col("n_b").alias("y")).unionByName(sure_two.select("uid", F.col("copies_b").alias("y"))).unionByName(sure_two.select(F.col("uid_b").alias("uid"), F.col("copies").alias("y")))
    edges = sure.select("a", "b").unionByName(sure_one.select(F.col("unit").alias("a"), "b")).unionByName(sure_two.select(F.col("unit").alias("a"), "b"))
    label = components(edges).select(F.col("node").alias("unit"), "component")
    per_unit = units.select("unit", "n").join(by_unit.groupBy("unit").agg(F.sum("x").alias("x")), "unit", "left").join(label, "unit", "left").select("unit", (F.col("n") + F.coalesce("x", F.lit(0))).alias("x"), F.coalesce("component", "unit").alias("component"))
    known = members.select("uid", "unit", "least").join(per_unit, "unit").join(by_one.groupBy("uid").agg(F.sum("y").alias("y")), "uid", "left").select("uid", "component", "least", (F.col("x") - 1 + F.coalesce("y", F.lit(0))).alias("n_links"))
    known = materialize(known, "vector-links")
    named = known.groupBy("component").agg(F.min("least").alias("component_id"))
    result = materialize(known.join(named, "component").join(reps.select("uid", "digest"), "uid").select("digest", "n_links", "component_id"), "vector-classes")
    good = rows.where("digest IS NOT NULL").select("vec_id", "digest").hint("merge").join(result, "digest").select("vec_id", "n_links", "component_id")
    bad = rows.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def keep_one(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The vectors that stay, one id of each component, with their own columns."""
    (key,) = unused(vectors, "kept_id")
    kept = near_duplicates(vectors, cosine).where("kept").select(F.col("vec_id").alias(key)).distinct()
    return vectors.select(*own(vectors)).join(kept, F.col("vec_id").cast("long").eqNullSafe(F.col(key)), "left_semi")


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))

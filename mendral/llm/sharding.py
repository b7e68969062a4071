"""Sharding by balanced label propagation, under the law ``rows``.

Documents of equal text are linked. Every document starts in the shard its id
hashes to. In each round a group looks at the shards its documents are in, and
those of them that are in a shard with fewer of their neighbours move towards
the fullest one that has room; moves into a shard are accepted in order while
its quota lasts. Documents of one group and shard are alike, so the rounds join
and move their counts. Documents without links follow last and fill all shards
to the quota: counts of rows differ by one at most. A group is cut where a quota
ends, or where rounds end (``ROUNDS`` of them, or one that moves nearly nothing)
before its documents have met.

Defined results: null and empty texts form one group, size 1, crc32 0. Ids are
passed on, null or repeated; repeated rows take a slot each. An empty table gives
an empty result. Texts of any length are hashed in whole. Ties are broken by
hashes. Other columns are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, materialize
from .ranking import block_rows, running_total

SHARDS = 16
ROUNDS = 10
#: Rounds end when fewer than this share of the linked documents move.
SETTLED = 0.002


def _base(docs: DataFrame, shards: int) -> DataFrame:
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return (
        docs.select("doc_id", raw.alias("raw"))
        .select("doc_id", (F.octet_length("raw") + 1).cast("long").alias("size"), F.crc32("raw").alias("text_crc32"), F.xxhash64("raw").alias("k0"), F.xxhash64("raw", F.lit(1)).alias("k1"))
        .withColumn("h", F.xxhash64("doc_id", "k0"))
        .withColumn("start", F.pmod(F.xxhash64("h", F.lit("start")), F.lit(shards)).cast("int"))
    )


def _round(tally: DataFrame, load: dict[int, int], quota: list[int]) -> tuple[DataFrame, int]:
    """One round over (k0, k1, shard, n): the new counts, and how many documents moved."""
    free = F.array(*[F.lit(max(0, q - load.get(j, 0))).cast("long") for j, q in enumerate(quota)])
    best = tally.where(F.get(free, F.col("shard")) > 0).groupBy("k0", "k1").agg(F.max(F.struct("n", F.xxhash64("k0", "shard").alias("tie"), "shard")).alias("b")).select("k0", "k1", F.col("b.shard").alias("to"), F.col("b.n").alias("there"), F.col("b.tie").alias("tie"))
    movers = (
        tally.join(best, ["k0", "k1"])
        .where((F.col("shard") != F.col("to")) & ((F.col("n") < F.col("there")) | ((F.col("n") == F.col("there")) & (F.xxhash64("k0", "shard") < F.col("tie")))))
        .withColumn("block", F.pmod(F.xxhash64("k0", "k1"), F.lit(1 << 10)).cast("int"))
    )
    asked = running_total(movers, ["to"], "block", ["k0", "k1", "shard"], F.col("n"), "before")
    granted = asked.withColumn("moved", F.least("n", F.greatest(F.lit(0).cast("long"), F.get(free, F.col("to")) - F.col("before")))).where("moved > 0")
    # what leaves one shard arrives in another
    change = granted.select("k0", "k1", F.explode(F.array(F.struct("shard", (-F.col("moved")).alias("n"), F.lit(0).cast("long").alias("came")), F.struct(F.col("to").alias("shard"), F.col("moved").alias("n"), F.col("moved").alias("came")))).alias("c")).select("k0", "k1", "c.shard", "c.n", "c.came")
    both = tally.select("k0", "k1", "shard", "n", F.lit(0).cast("long").alias("came")).unionByName(change)
    after = materialize(both.groupBy("k0", "k1", "shard").agg(F.sum("n").alias("n"), F.sum("came").alias("came")).where("n > 0"), "tally")
    return after, after.agg(F.coalesce(F.sum("came"), F.lit(0)).alias("m")).first()["m"]


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    base = materialize(_base(docs, shards), "shard-base")
    total = base.count()
    quota = [total // shards + (j < total % shards) for j in range(shards)]
    tally = base.groupBy("k0", "k1", F.col("start").alias("shard")).agg(F.count("*").alias("n"))
    groups = materialize(base.groupBy("k0", "k1").agg(F.count("*").alias("size_of")).where("size_of > 1"), "groups")
    linked = groups.agg(F.coalesce(F.sum("size_of"), F.lit(0)).alias("n")).first()["n"]
    tally = materialize(tally.join(groups.select("k0", "k1"), ["k0", "k1"], "left_semi"), "tally")
    for _ in range(rounds if linked else 0):
        load = {r["shard"]: r["n"] for r in tally.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row for each shard
        after, moved = _round(tally, load, quota)
        discard(tally)
        tally = after
        if moved <= SETTLED * linked:
            break
    # what a start by hash may have put beyond a quota goes to the documents without links
    load = {r["shard"]: r["n"] for r in tally.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    over = {j: n - quota[j] for j, n in load.items() if n > quota[j]}
    if over:
        ordered = materialize(tally.where(F.col("shard").isin(list(over))).withColumn("block", F.pmod(F.xxhash64("k0", "k1"), F.lit(1 << 10)).cast("int")), "over")
        allowed = F.array(*[F.lit(q).cast("long") for q in quota])
        cut = running_total(ordered, ["shard"], "block", ["k0", "k1"], F.col("n"), "before").withColumn("n", F.greatest(F.lit(0).cast("long"), F.least("n", F.get(allowed, F.col("shard")) - F.col("before"))))
        tally = materialize(tally.where(~F.col("shard").isin(list(over))).select("k0", "k1", "shard", "n").unionByName(cut.select("k0", "k1", "shard", "n")).where("n > 0"), "tally")
    # a group's documents in order of their hash fill its shards one after the other
    plan = materialize(
        groups.join(tally.groupBy("k0", "k1").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("f")), ["k0", "k1"], "left").select(
            "k0", "k1", "size_of", F.coalesce("f.shard", F.array().cast("array<int>")).alias("to"),
            F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce(F.size("f"), F.lit(0)))), lambda i: F.aggregate(F.slice(F.coalesce("f.n", F.array().cast("array<long>")), F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x)).alias("until"),
        ),
        "group-plan",
    )
    known = materialize(base.hint("merge").join(plan, ["k0", "k1"], "left").withColumn("sub", F.when(F.col("size_of").isNotNull(), F.pmod("h", F.ceil(F.col("size_of") / block_rows(F.col("size_of"))))).otherwise(-1).cast("int")), "shard-linked")
    members = known.where("size_of IS NOT NULL")
    placed = running_total(members, ["k0", "k1"], "sub", ["h", "doc_id"], F.lit(1).cast("long"), "r")
    placed = placed.withColumn("shard", F.get("to", F.size(F.filter("until", lambda u: u <= F.col("r")))))
    # a large group is as many blocks as its size asks for
    pieces = F.coalesce(F.ceil(F.col("size_of") / block_rows(F.col("size_of"))), F.lit(1)).cast("int").alias("pieces")
    rows = ["doc_id", "size", "text_crc32", "k0", "h", "pieces"]
    staged = materialize(placed.select(*rows[:-1], pieces, "shard").unionByName(known.where("size_of IS NULL").select(*rows[:-1], pieces, F.lit(None).cast("int").alias("shard"))), "shard-placed")
    discard(known)
    # the rest fills every shard to its quota
    have = {r["shard"]: r["n"] for r in staged.where("shard IS NOT NULL").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    edges, end = [], 0
    for j in range(shards):
        end += quota[j] - have.get(j, 0)
        edges.append(end)
    blocks = max(1, total // (max(400, int(total**0.5))))
    rest = materialize(staged.where("shard IS NULL").drop("shard").withColumn("all", F.lit(0)).withColumn("block", F.pmod("h", F.lit(blocks)).cast("int")), "shard-rest")
    filled = running_total(rest, ["all"], "block", ["h", "doc_id"], F.lit(1).cast("long"), "r")
    ends = F.array(*[F.lit(e).cast("long") for e in edges])
    filled = filled.select(*rows, F.size(F.filter(ends, lambda e: e <= F.col("r"))).alias("shard"))
    final = materialize(staged.where("shard IS NOT NULL").unionByName(filled).withColumn("block", F.pmod("k0", F.lit(max(1, blocks // shards))) * (1 << 31) + F.pmod("h", "pieces")), "shard-final")
    discard(staged, rest)
    slotted = running_total(final, ["shard"], "block", ["k0", "h", "doc_id"], F.lit(1).cast("long"), "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))

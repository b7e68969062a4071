"""A round of label propagation against a plain one, and groups that a quota cuts."""

import random

from pyspark.sql import functions as F

from mendral.llm import sharding


def plain_round(tally, load, quota, tie, block):
    """The new counts of {(k0, k1, shard): n}: groups move towards their fullest shard with room, in order while its quota lasts."""
    free = [max(0, q - load.get(j, 0)) for j, q in enumerate(quota)]
    groups = {}
    for (a, b, s), n in tally.items():
        groups.setdefault((a, b), {})[s] = n
    asks = []
    for (a, b), shards in groups.items():
        able = [(n, tie[a, s], s) for s, n in shards.items() if free[s] > 0]
        if able:
            there, mark, to = max(able)
            asks += [(to, block[a, b], a, b, s, n) for s, n in shards.items() if s != to and (n < there or (n == there and tie[a, s] < mark))]
    out, taken = dict(tally), [0] * len(quota)
    for to, _, a, b, s, n in sorted(asks):
        moved = min(n, max(0, free[to] - taken[to]))
        taken[to] += n
        if moved:
            out[a, b, s] -= moved
            out[a, b, to] = out.get((a, b, to), 0) + moved
    return {k: n for k, n in out.items() if n}


def test_rounds_equal_plain_ones(spark):
    rng = random.Random(6)
    for quota_of in (12, 60):
        tally = {(a, a * 7, s): rng.randint(1, 6) for a in range(25) for s in rng.sample(range(4), rng.randint(1, 4))}
        df = spark.createDataFrame([(*k, n) for k, n in tally.items()], "k0 long, k1 long, shard int, n long")
        tie = {(r.k0, r.shard): r.h for r in df.select("k0", "shard", F.xxhash64("k0", "shard").alias("h")).collect()}
        block = {(r.k0, r.k1): r.b for r in df.select("k0", "k1", F.pmod(F.xxhash64("k0", "k1"), F.lit(1 << 10)).cast("int").alias("b")).collect()}
        load = {s: sum(n for (_, _, t), n in tally.items() if t == s) for s in range(4)}
        quota = [load[s] + quota_of * (s % 2) for s in range(4)]
        after, moved = sharding._round(df, load, quota)
        want = plain_round(tally, load, quota, tie, block)
        assert {(r.k0, r.k1, r.shard): r.n for r in after.collect()} == want
        assert moved == sum(max(0, want.get(k, 0) - tally.get(k, 0)) for k in set(want) | set(tally))
        assert all(sum(n for (_, _, t), n in want.items() if t == s) <= max(quota[s], load[s]) for s in range(4))


def test_a_group_larger_than_a_quota_is_cut_and_shards_stay_even(spark):
    rows = [(i, "same text") for i in range(70)] + [(100 + i, f"text {i}") for i in range(10)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    sizes = [sum(r.shard == j for r in out) for j in range(4)]
    assert sizes == [20, 20, 20, 20]
    assert len({r.shard for r in out if r.doc_id < 70}) == 4
    for j in range(4):
        assert sorted(r.slot for r in out if r.shard == j) == list(range(20))

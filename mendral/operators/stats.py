"""Paired statistics over before and after measures (metric, genome, before, after)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendral.plans.storage import materialize

from .running import running_sums

RESAMPLES = 10_000


def paired(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of measures (keys, value), finite on both sides."""
    rows = before.select(*keys, F.col("value").alias("before")).join(after.select(*keys, F.col("value").alias("after")), keys)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return rows.where(finite("before") & finite("after"))


def deltas(pairs: DataFrame) -> DataFrame:
    """Per metric: medians, means, counts of better and worse, sign-based rank-biserial correlation."""
    d = F.round(F.col("after") - F.col("before"), 12)
    up, down = F.count_if(d > 0), F.count_if(d < 0)
    return pairs.groupBy("metric").agg(
        F.count("*").alias("n"), F.median("before").alias("median_before"), F.median("after").alias("median_after"), F.avg(d).alias("mean_delta"), F.median(d).alias("median_delta"),
        up.alias("improved"), down.alias("worsened"), F.when(up + down > 0, (up - down) / (up + down)).otherwise(0.0).alias("rank_biserial"),
    )


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """Per metric: n of non-zero differences, rank sums of either sign and the tie correction.

    Equal differences are counted first, and distinct ones are ranked in ranges.
    """
    d = pairs.select("metric", F.round(F.col("after") - F.col("before"), 12).alias("d")).where("d <> 0")
    ties = d.groupBy("metric", F.abs("d").alias("a")).agg(F.count("*").alias("k"), F.count_if(F.col("d") > 0).alias("up"))
    r = running_sums(ties, ["metric"], [F.asc("a")], {"before": "k"}).withColumn("rank", F.col("before") + (F.col("k") + 1) / 2)
    k = F.col("k").cast("double")
    return r.groupBy("metric").agg(F.sum("k").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("k") - F.col("up"))).alias("w_minus"), F.sum(k * k * k - k).alias("ties"))


def signed_rank_p(n: int, w: float, ties: float) -> float:
    """Two-sided p: exact for up to 50 differences without ties, else normal with tie correction."""
    if n == 0:
        return 1.0
    if n <= 50 and ties == 0:
        counts = np.zeros(n * (n + 1) // 2 + 1)
        counts[0] = 1
        for i in range(1, n + 1):
            counts[i:] += counts[:-i].copy()
        return float(min(1.0, 2 * counts[: int(w) + 1].sum() / 2.0**n))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return float(math.erfc(abs(w - mean) / math.sqrt(var) / math.sqrt(2))) if var > 0 else 1.0


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Per metric: n, w (the lesser rank sum), p."""

    def test(batches):
        for b in batches:
            w = np.minimum(b["w_plus"], b["w_minus"])
            yield pd.DataFrame({"metric": b["metric"], "n": b["n"], "w": w, "p": [signed_rank_p(int(n), x, t) for n, x, t in zip(b["n"], w, b["ties"], strict=True)]})

    return signed_ranks(pairs).mapInPandas(test, "metric string, n long, w double, p double")


#: Raw numbers of the generator, two draws each, that one row of the work list stands for.
SEGMENT = 1 << 18


def draws(seed: int, start: int, raw: int, n: int) -> np.ndarray:
    """What ``default_rng(seed).integers(0, n, ...)`` makes of raw numbers ``start`` to ``start + raw``, for n from 2 to 2**32 - 1.

    The generator jumps to ``start``. Each raw number is two of 32 bits, low one first; their
    product with n has the draw in its upper half and is thrown away where its
    lower half is under 2**32 modulo n, as numpy does.
    """
    bits = np.random.PCG64(seed).advance(start).random_raw(raw)
    product = np.stack([bits & np.uint64(0xFFFFFFFF), bits >> np.uint64(32)], axis=1).ravel() * np.uint64(n)
    return (product >> np.uint64(32))[(product & np.uint64(0xFFFFFFFF)) >= np.uint64(2**32 % n)].astype(np.int64)


def bootstrap_mean(pairs: DataFrame, resamples: int = RESAMPLES, seed: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Per metric: 95 % interval of the mean difference; differences are taken in order of genome.

    The draws are those of one numpy generator, made apart: segments of its raw
    numbers are counted for the draws they give, so each knows the place of its first one, and
    adds up its share of every resample it reaches. A segment holds the metric's differences, one
    for each genome.
    """
    rows = pairs.groupBy("metric").agg(F.sort_array(F.collect_list(F.struct("genome", (F.col("after") - F.col("before")).alias("d")))).alias("s"))
    known = materialize(rows.select("metric", F.size("s").cast("long").alias("n"), F.transform("s", lambda x: x["d"]).alias("d")), "differences")
    many = known.where("n > 1")
    need = F.lit(resamples) * F.col("n")

    def count(batches):
        for b in batches:
            yield pd.DataFrame({"metric": b["metric"], "n": b["n"], "k": b["k"], "got": [len(draws(seed, k * segment, segment, n)) for k, n in zip(b["k"], b["n"], strict=True)]})

    def add(batches):
        for b in batches:
            for metric, n, k, before, d in zip(b["metric"], b["n"], b["k"], b["before"], b["d"], strict=True):
                v = np.asarray(d)[draws(seed, k * segment, segment, n)[: max(0, resamples * n - before)]]
                first = before // n
                sums = np.bincount((before + np.arange(len(v))) // n - first, weights=v)
                yield pd.DataFrame({"metric": metric, "r": first + np.arange(len(sums)), "x": sums})

    extra = 1
    while True:  # hardly ever more than once: few draws are thrown away
        last = F.ceil(need / (2 * segment)).cast("long") + extra
        work = many.select("metric", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
        counted = materialize(work.repartition("metric", "k").mapInPandas(count, "metric string, n long, k long, got long"), "draws")
        if not counted.groupBy("metric", "n").agg(F.sum("got").alias("got")).where(F.col("got") < need).limit(1).count():
            break
        extra *= 2
    before = F.coalesce(F.sum("got").over(Window.partitionBy("metric").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each segment
    placed = counted.select("metric", "n", "k", before.alias("before")).where(F.col("before") < need)
    sums = placed.join(many.select("metric", "d"), "metric").repartition("metric", "k").mapInPandas(add, "metric string, r long, x double")
    means = sums.groupBy("metric", "r").agg(F.sum("x").alias("x")).join(many.select("metric", "n"), "metric").select("metric", (F.col("x") / F.col("n")).alias("m"))
    ends = means.groupBy("metric").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return ends.unionByName(known.where("n = 1").select("metric", F.col("d")[0].alias("low"), F.col("d")[0].alias("high")))

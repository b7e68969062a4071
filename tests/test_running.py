"""Running sums in ranges: equal to plain ones, and evenly dealt when all values lie close together."""

import random

from pyspark.sql import functions as F

from mendral.operators.running import running_sums


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.random(), rng.randrange(5)) for _ in range(400)] + [("c", 0.5, 2)]
    got = {(r.g, r.x): (r.before, r.twice) for r in running_sums(spark.createDataFrame(rows, "g string, x double, n long").withColumn("m", F.col("n") * 2), ["g"], [F.desc("x")], {"before": "n", "twice": "m"}).collect()}
    for g, x, _ in rows:
        want = sum(n for h, y, n in rows if h == g and y > x)
        assert got[(g, x)] == (want, 2 * want)


def test_values_that_lie_close_together_are_spread(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as they are, ranges would be put together
    rows = spark.range(20_000).select((0.5 + F.col("id") / 1e9).alias("x"), F.lit(1).alias("n"))
    sizes = [r["count"] for r in rows.repartitionByRange("x").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) > 1 and max(sizes) < 3 * sum(sizes) / len(sizes)
    out = running_sums(rows, [], [F.asc("x")], {"before": "n"})
    assert out.agg(F.max("before"), F.count_distinct("before")).first()[:] == (19_999, 20_000)


def test_no_rows(spark):
    assert running_sums(spark.createDataFrame([], "x double, n long"), [], [F.asc("x")], {"b": "n"}).count() == 0

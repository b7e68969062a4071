"""Statistics, splits, models, streaming and edge cases that SQL does not cover."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendral.operators import flips, genomics, hierarchy, metrics, splits, stats, transfer
from mendral.streaming import incremental


def test_closure_survives_cycles_and_empty(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    got = {tuple(r) for r in hierarchy.closure(e).collect()}
    assert got == {(x, y) for x in "abc" for y in "abc"} | {("d", y) for y in "abcd"}
    assert hierarchy.closure(e.where("false")).count() == 0


def test_bucket_compares_as_float32(spark):
    scores = [i / 100 for i in range(101)] + [0.295, 0.999999, 1e-9]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in scores], "s double").select(metrics.bucket(F.col("s"))).collect()]
    want = [max(t for t in range(101) if np.float32(t / 100) <= np.float32(s)) for s in scores]
    assert got == want


def test_wilcoxon_exact_and_normal():
    assert stats.signed_rank_p(0, 0, 0) == 1.0
    # all six positive: two of 64 sign patterns are as extreme
    assert stats.signed_rank_p(6, 0, 0) == pytest.approx(2 / 64)
    n, w = 60, 600.0
    z = abs(w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert stats.signed_rank_p(n, w, 0) == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_infinite_pairs_are_left_out(spark):
    a = spark.createDataFrame([("m", "g1", 1.0), ("m", "g2", float("inf"))], "metric string, genome string, value double")
    assert stats.paired(a, a, ["metric", "genome"]).count() == 1


def test_range_overlap_counts_once(spark):
    rng = random.Random(1)
    left = [(i, s, s + rng.randint(0, 50)) for i, s in enumerate(rng.choices(range(300), k=60))]
    right = [(i, s, s + rng.randint(0, 200)) for i, s in enumerate(rng.choices(range(300), k=60))]
    f = lambda x: spark.createDataFrame(x, "id int, start long, end long")
    got = sorted((r["id"], r["r_id"]) for r in genomics.overlaps(f(left), f(right), 40).collect())
    assert got == sorted((a, b) for a, s, e in left for b, c, d in right if s <= d and e >= c)


def test_contigs_and_samples():
    c = genomics.contigs(1000, [100, 5000], 3, 7)
    assert c == genomics.contigs(1000, [100, 5000], 3, 7) and all(e - s == 100 for _, n, s, e in c if n == 100) and c[3][2:] == (1, 1000)
    names = splits.greedy_sample([(f"o{i}", 37 * (i % 5 + 1)) for i in range(40)], 900)
    assert abs(sum(37 * (int(n[1:]) % 5 + 1) for n in names) - 900) <= 100


def test_bins():
    assert flips.parse_bins("1,2-5,101+") == [(1, 1), (2, 5), (101, None)]


def test_soft_residual_is_the_flip_count_at_a_higher_threshold(spark):
    d = spark.createDataFrame([(0.3 + i / 50,) for i in range(1, 30)], "score double")
    sweep = {r["penalty"]: r["residual"] for r in flips.soft_sweep(d, [0.1, 0.2], 0.3).collect()}
    assert all(n == sum(round(0.3 + i / 50 - 0.3, 9) >= x for i in range(1, 30)) for x, n in sweep.items())


def test_models(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    y = np.stack([x[:, 0] > 0, x[:, 1] > 0], axis=1).astype(float)
    net = transfer.MultiLabelNet(8, 32, ["A", "B"]).fit(x, y, epochs=40)
    assert ((net.forward(x)[2] > 0.5) == (y > 0.5)).mean() > 0.9
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x[:20])], "id long, vector array<float>")
    assert net.predict(d).count() == 40
    z = transfer.zero_shot(d, np.ones((2, 8)), np.zeros(8), np.zeros(2), np.eye(8), np.zeros(8), ["A", "B"])
    first = z.where("id = 0 AND term = 'A'").first()["score"]
    assert first == pytest.approx(1 / (1 + math.exp(-np.maximum(x[0].astype(np.float32), 0).sum())), abs=1e-6)
    assert d.select(transfer.fit_length("vector", 10).alias("v")).first()["v"][8:] == [0.0, 0.0]


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "id long, vector array<float>")
    assert transfer.nearest_by_cosine(none, none, 3).count() == 0


def test_stream_matches_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    source = str(tmp_path / "in")
    events.orderBy("ts").coalesce(1).write.parquet(source)
    stream = incremental.windowed_events(spark.readStream.schema(events.schema).parquet(source), late="400 days")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()


def test_arrivals_are_repaired(spark, tmp_path):
    source, out = str(tmp_path / "p"), str(tmp_path / "o")
    spark.createDataFrame([("g1", "p", "X", 0.9), ("g2", "p", "X", 0.1)], "genome string, protein string, term string, score double").write.parquet(source)
    q = incremental.repair_arrivals(spark, source, "genome string, protein string, term string, score double", lambda d: d.where("score > 0.5"), out, str(tmp_path / "c"))
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_ranking_tables_are_written(spark, tmp_path):
    from mendral.sources.tables import write_table

    before = spark.createDataFrame([("g", "p", "X", 0.9), ("g", "q", "X", 0.8), ("g", "p", "Y", 0.95)], "genome string, protein string, term string, score double")
    after = before.where("term <> 'X'").unionByName(spark.createDataFrame([("g", "q", "Y", 0.7)], before.schema))
    made = flips.ranking_tables(flips.term_changes(before, after, 0.5), 1)
    assert made["by_count"].first()["term"] == "X" and made["summary"].first()["flips"] == 3
    for name, t in made.items():
        write_table(t, str(tmp_path / name))
    assert spark.read.csv(str(tmp_path / "all"), sep="\t", header=True).count() == 2


def test_groups_of_a_task_do_not_grow_with_the_table(spark, sf, monkeypatch):
    from mendral.operators import hierarchy
    from mendral.plans import adapters

    monkeypatch.setattr(adapters, "TASK_ROWS", 500)
    v = adapters.Views(spark, sf)
    tasks = v.table("lineitem").count() // 500 + 1
    rows = v.predictions.select("term", "genome", "protein", "score")
    assert rows.rdd.getNumPartitions() == tasks > 8
    closed = hierarchy.closure(v.edges, reflexive=False)
    up = hierarchy.propagate_scores(rows, closed)
    assert up.rdd.getNumPartitions() == tasks
    assert up._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
    lone = spark.createDataFrame([("g", "p", "alone", 0.5)], "genome string, protein string, term string, score double")
    assert [tuple(r) for r in hierarchy.propagate_scores(lone, closed).collect()] == [("g", "p", "alone", 0.5)]

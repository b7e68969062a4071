"""Clusters of sequences against brute force."""

import random

from mendral.operators import clusters


def brute(rows, k=5, least=0.5):
    sets = [(p, {s[i : i + k] for i in range(max(1, len(s) - k + 1))} if s else None, s or "") for p, s in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (p, a, _) in enumerate(sets):
        for j, (q, b, _) in enumerate(sets[:i]):
            if p == q and a and b or (a and b and len(a & b) >= least * len(a | b)):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), []).append(sets[i])
    return sorted({(min((-len(s), p) for p, _, s in g)[1], p) for g in groups.values() for p, _, _ in g})


def test_clusters_equal_brute_force(spark):
    rng = random.Random(4)
    rows, letters = [], "ACDEFGHIKLMNPQRSTVWY"
    for f in range(25):
        base = "".join(rng.choice(letters) for _ in range(rng.randint(30, 90)))
        for _ in range(rng.choice([1, 2, 5, 12])):
            s = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                s[rng.randrange(len(s))] = rng.choice(letters)
            rows.append((f"p{len(rows)}", "".join(s)))
    rows += [("x", None), ("y", ""), ("z", "AC"), ("w", "AC"), ("p0", rows[-1][1])]
    got = clusters.sequence_clusters(spark.createDataFrame(rows, "protein string, sequence string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_a_dense_group_is_compared_with_its_least_set_only(spark):
    base = "".join(random.Random(1).choice("ACDEFGHIKL") for _ in range(80))
    rows = [(f"p{i}", base + "ACDEFGHIKL"[i % 10] * (i // 10 + 1)) for i in range(60)]
    sets = spark.createDataFrame(rows, "protein string, sequence string").select(clusters.kmers("sequence", 5).alias("kmers")).distinct().selectExpr("row_number() OVER (ORDER BY kmers) AS n", "kmers")
    n = sets.count()
    assert clusters.similar(sets).count() < 3 * n < n * (n - 1) / 2


def test_no_sequences(spark):
    assert clusters.sequence_clusters(spark.createDataFrame([], "protein string, sequence string")).count() == 0


def test_chance_meetings_are_told_apart_by_bitmaps(spark):
    rng, letters = random.Random(7), "ACDEFGHIKLMNPQRSTVWY"
    base = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(30)]
    rows = [(f"p{i}", s) for i, s in enumerate(base)] + [(f"q{i}", s[:52] + "CCCCCCCC") for i, s in enumerate(base)]
    sets = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(rows)], "n long, sequence string")
    members = sets.selectExpr("1L AS key", "n", "n % 2 = 0 AS rest")
    as_set = lambda s: clusters.kmers(s, 5)
    got = {tuple(r) for r in clusters.within_buckets(members, sets, 0.5, 3, "sequence", as_set).collect()}
    of = [{s[i : i + 5] for i in range(56)} for _, s in rows]
    linked = {(i, j) for j in range(60) for i in range(j) if (i % 2 == 0 or j % 2 == 0) and len(of[i] & of[j]) >= 0.5 * len(of[i] | of[j])}
    assert len(linked) == 15 and linked <= got and len(got) < 2 * len(linked)


def test_equal_sets_of_different_sequences_are_one_cluster(spark):
    rows = [("a", "AAAAA"), ("b", "AAAAAAA"), ("c", "ACACACAC"), ("d", "ACACACACACAC"), ("e", "AAAAA")]
    got = clusters.sequence_clusters(spark.createDataFrame(rows, "protein string, sequence string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)

"""Names with fallbacks, first sources, vector and label tables."""

from pyspark.sql import functions as F

from mendral.sources import lookup, vectors


def test_earlier_patterns_win(spark):
    f = spark.createDataFrame
    files = ["d/annots_7.tsv", "d/7.goa", "x/annots_taxon_8.tsv", "a/8.tsv", "b/9.goa", "a/9.goa", "a/notes_10.tsv"]
    got = {r.id: r.file for r in lookup.matching_files(f([("7",), ("8",), ("9",), ("10",), ("7",)], "id string"), f([(x,) for x in files], "file string")).collect()}
    assert got == {"7": "d/annots_7.tsv", "8": "x/annots_taxon_8.tsv", "9": "a/9.goa", "10": None}


def test_first_source_of_a_key(spark):
    f = lambda rows: spark.createDataFrame(rows, "p string, t string")
    got = lookup.first_match([f([("a", "1")]), f([("a", "2"), ("b", "3"), ("b", "4")]), f([("b", "5"), ("c", "6")])], ["p"])
    assert sorted(map(tuple, got.collect())) == [("a", "1"), ("b", "3"), ("b", "4"), ("c", "6")]


def test_features_and_labels(spark, tmp_path):
    rows = [("tr|Q5|A_X words OS=y", [1.0, 2.0, 3.0]), ("plain name", [4.0]), ("sp|P|A_X other", [9.0]), (None, [1.0]), ("sp|P|N_X", None)]
    spark.createDataFrame(rows, "protein string, vector array<double>").write.parquet(str(tmp_path / "v"))
    v = vectors.read_vectors(spark, str(tmp_path / "v"))
    asked = spark.createDataFrame([("A_X",), ("plain",), ("none",), ("A_X",)], "protein string")
    got = {r.protein: (list(r.vector), r.missing) for r in vectors.features(asked, v, 2).collect()}
    assert got == {"A_X": ([1.0, 2.0], False), "plain": ([4.0, 0.0], False), "none": ([0.0, 0.0], True)}
    marks = spark.createDataFrame([("A_X", "t2"), ("A_X", "t2"), ("A_X", "zz"), ("plain", "t1")], "protein string, term string")
    assert {r.protein: r.labels for r in vectors.multi_hot(asked, marks, ["t1", "t2", "t3"]).collect()} == {"A_X": [0, 1, 0], "plain": [1, 0, 0], "none": [0, 0, 0]}
    terms = spark.createDataFrame([("t1", 0), ("t2", 1)], "term string, position int")
    assert {r.protein: r.positions for r in vectors.sparse_labels(marks, terms).collect()} == {"A_X": [1], "plain": [0]}
    assert vectors.features(asked.where(F.lit(False)), v, 2).count() == 0

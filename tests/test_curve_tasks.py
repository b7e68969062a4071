"""The threshold sweep deals its facts once, in tasks whose number follows the facts."""

from mendral.operators import metrics


def test_facts_are_dealt_once_and_repeats_count(spark, monkeypatch):
    rows = [("g", "p", "a", 0.5), ("g", "p", "a", 0.5), ("g", "p", "b", 0.7), ("g", "q", "a", 0.9)]
    p = spark.createDataFrame(rows, "genome string, protein string, term string, score double")
    lab = spark.createDataFrame([("g", "p", "a"), ("g", "p", "a"), ("g", "r", "b")], "genome string, protein string, term string")
    ic = spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 1.0)], "term string, ic double, norm_ic double")
    plans, store = [], metrics.materialize
    monkeypatch.setattr(metrics, "materialize", lambda df, label="table": (plans.append(df._jdf.queryExecution().executedPlan().toString()), store(df, label))[1])
    curve = {r.t: r for r in metrics.threshold_curve(p, lab, ic, ["genome"], rows=5_000_000).collect()}
    assert "SortMergeJoin" not in plans[0] and ", 51)" in plans[0]
    assert (curve[50].tp, curve[50].fp, curve[60].tp, curve[60].fp, curve[80].fp) == (2, 1, 0, 1, 0)
    assert (curve[0].tp, curve[0].fp, len(curve)) == (2, 2, 101)
    assert abs(curve[50].precision - 2 / 3) < 1e-9 and abs(curve[50].recall - 1.0) < 1e-9

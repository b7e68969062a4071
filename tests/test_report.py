"""The full report of genomes on a fixture that is worked out by hand."""

import dataclasses
import json

import pytest

from mendral.operators import coherence, hierarchy, report
from mendral.plans import more_queries
from mendral.plans.adapters import Views

EDGES = [("c1", "complex", "is_a"), ("c2", "complex", "is_a"), ("c3", "c1", "part_of"), ("f1", "f0", "is_a"), ("p1", "p0", "is_a")]


def rules(spark, ec_map=True):
    edges = spark.createDataFrame(EDGES, "child string, parent string, rel string")
    empty_taxa = spark.createDataFrame([], "node string, ancestor string")
    return report.Rules(
        terms=spark.createDataFrame([(t,) for t in ("c1", "c2", "c3", "complex", "f0", "f1", "p0", "p1")], "id string"),
        reach=hierarchy.closure(edges.select("child", "parent")),
        isa_reach=hierarchy.closure(edges.where("rel = 'is_a'").select("child", "parent")),
        essential=spark.createDataFrame([("p0", "Core"), ("f0", "Core"), ("zz", "Core"), ("zz", "Cell")], "term string, category string"),
        has_part=spark.createDataFrame([("p1", "f1"), ("p1", "p0"), ("c1", "f1")], "whole string, part string"),
        combos=spark.createDataFrame([("W1", "p0", 0, "f1"), ("W1", "p0", 0, "x1"), ("W1", "p0", 1, "x2"), ("W2", "f0", None, None), ("W3", "zz", 0, "f0")], "pathway string, term string, combo int, need string"),
        complex_root="complex",
        homodimers=spark.createDataFrame([("c2",)], "term string"),
        constraints=spark.createDataFrame([("p1", "only_in_taxon", "t1"), ("f0", "never_in_taxon", "t1")], "term string, kind string, taxon string"),
        disjoint=spark.createDataFrame([], "a string, b string"),
        taxon_reach=empty_taxa,
        ec_map=spark.createDataFrame([("1.1", "x1"), ("1.2", "x1")], "ec string, term string") if ec_map else None,
    )


ROWS = [("g", "a", "p1"), ("g", "a", "p1"), ("g", "a", "f1"), ("g", "b", "c3"), ("g", "b", "c2"), ("h", "a", "p1"), ("h", "b", "p0"), ("e", "a", "unknown")]


def reports(spark, rows=ROWS, subontology=None, **kw):
    rows = spark.createDataFrame(rows, "genome string, protein string, term string")
    return {r["genome"]: r.asDict(recursive=True) for r in report.full_report(rows, rules(spark, **kw), subontology).collect()}


def test_all_sections(spark):
    r = reports(spark)["g"]
    assert r["essential"]["percentage"] == pytest.approx(200 / 3)
    assert r["essential"]["found_terms"] == ["f0", "p0"]
    assert r["essential"]["categories"] == [{"category": "Cell", "found": 0, "size": 1}, {"category": "Core", "found": 2, "size": 3}]
    # as annotated: p1 has its part f1 but not p0, and c1 is only an ancestor
    assert r["process"] == {"percentage": 50.0, "missing": [{"annotated_term": "p1", "missing_parts": ["p0"]}]}
    # W1 lacks x1 in one combo and x2, which has no enzyme number, in the other
    assert r["pathways"]["details"] == [
        {"pathway": "W1", "original_term": "p0", "complete": False, "missing_components": [["1.1", "1.2"]]},
        {"pathway": "W2", "original_term": "f0", "complete": True, "missing_components": []},
    ]
    assert (r["pathways"]["percentage"], r["pathways"]["completed"], r["pathways"]["annotated"], r["pathways"]["incomplete"]) == (50.0, 1, 2, 1)
    # c3 is part of c1, which is no is_a: it is no complex; c2 is a homodimer, the root has one protein
    assert r["complexes"] == {"percentage": 50.0, "classes": [{"term": "c2", "kind": "coherent"}, {"term": "complex", "kind": "incoherent"}]}
    assert r["satisfiable"] is False
    assert reports(spark)["h"]["satisfiable"] is True


def test_components_without_enzyme_numbers(spark):
    details = reports(spark, ec_map=False)["g"]["pathways"]["details"]
    assert details[0]["missing_components"] == [["x1"], ["x2"]]


def test_unknown_terms_give_shares_of_nothing(spark):
    r = reports(spark)["e"]
    assert r["process"] == {"percentage": 0.0, "missing": []}
    assert r["pathways"]["annotated"] == 0 and r["pathways"]["details"] == []
    assert r["complexes"] == {"percentage": 0.0, "classes": []}
    assert r["information"] == {"depth": 0.0, "breadth": 0.0, "breadth_per_protein": 0.0}


@pytest.mark.parametrize(("subontology", "sections"), [("bp", {"essential", "pathways"}), ("mf", {"pathways"}), ("cc", {"complexes"})])
def test_sections_of_a_subontology(spark, subontology, sections):
    r = reports(spark, subontology=subontology)["g"]
    assert set(r) == {"genome", "process", "information", "satisfiable"} | sections


def test_other_names_are_refused_and_empty_tables_are_empty(spark):
    with pytest.raises(ValueError, match="xx"):
        reports(spark, subontology="xx")
    assert reports(spark, rows=[]) == {}


def test_lines(spark):
    rows = spark.createDataFrame(ROWS, "genome string, protein string, term string")
    lines = {r["genome"]: json.loads(r["value"]) for r in report.report_lines(report.full_report(rows, rules(spark), "bp")).collect()}
    assert lines["g"]["essential"]["percentage"] == 66.67
    assert "complexes" not in lines["g"]


def test_a_genome_whose_terms_are_one_cycle_keeps_its_row(spark):
    edges = spark.createDataFrame([("x", "y"), ("y", "x")], "child string, parent string")
    cyclic = dataclasses.replace(rules(spark), reach=hierarchy.closure(edges))
    rows = spark.createDataFrame([("c", "a", "x"), ("c", "a", "y")], "genome string, protein string, term string")
    assert [r["information"]["depth"] for r in report.full_report(rows, cyclic, "mf").collect()] == [0.0]


def test_facts_dealt_by_genome_are_moved_no_more(spark, monkeypatch):
    plans, store = [], report.materialize_counted
    monkeypatch.setattr(report, "materialize_counted", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), store(df, *a))[1])
    rows = spark.createDataFrame(ROWS, "genome string, protein string, term string").repartition(3, "genome")
    out = report.full_report(rows, rules(spark))
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plans[0]
    assert {r["genome"] for r in out.collect()} == {"g", "h", "e"}
    plan = coherence.process_coherence(rows, rules(spark).has_part)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_processes_of_rows_without_a_genome_lack_their_parts(spark):
    rows = spark.createDataFrame([(None, "a", "p1"), (None, "a", "f1"), ("g", "a", "p1"), ("g", "b", "f1"), ("h", "b", "f1")], "genome string, protein string, term string")
    got = coherence.process_coherence(rows, rules(spark).has_part)
    assert sorted(((r["genome"], r["required"], r["missing"], r["missing_parts"]) for r in got.collect()), key=str) == [("g", 2, 1, ["p0"]), ("h", 0, 0, []), (None, 2, 2, ["f1", "p0"])]


def test_closed_processes_move_their_facts_once(spark, sf):
    plan = more_queries.closed_process(Views(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan

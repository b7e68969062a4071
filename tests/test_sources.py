"""Readers and writers on tiny files: well-formed and malformed records."""

import pytest
from pyspark.sql import functions as F

from mendral.functions import scalars as fn
from mendral.sources import ontology, records, scored, tables


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_scored_file_rules(spark, tmp_path):
    p = write(tmp_path, "predictions_fold_0_taxon_9606.tsv", "a\tX|0.5\tY|0.25\tX|0.75\r\nb\nc\tZ|1\na\tX|0.1\n")
    got = scored.read_scored(spark, p)
    assert rows(got.select("genome", "fold", "protein", "term", "score")) == [("9606", "0", "a", "X", 0.1), ("9606", "0", "c", "Z", 1.0)]
    bad = write(tmp_path, "bad.tsv", "a\tX\tY|1\tZ|q\n")
    assert rows(scored.read_scored(spark, bad, malformed="skip").select("term", "score")) == [("Y", 1.0)]
    with pytest.raises(Exception, match="malformed token"):
        scored.read_scored(spark, bad).collect()
    kept = scored.read_scored(spark, p, keep_empty=True)
    assert kept.where("protein = 'b' AND term IS NULL").count() == 1
    assert rows(scored.read_scored(spark, p, as_text=True).select("term", "score")) == [("X", "0.1"), ("Z", "1")]
    assert not scored.valid_files(spark, bad).first()["valid"]


def test_scored_lines(spark):
    d = spark.createDataFrame([("a", "Y", 0.5), ("a", "X", 0.123456789), ("b", "Z", 0.01)], "protein string, term string, score double")
    assert rows(scored.scored_lines(d, d.select("protein"), 0.1)) == [("a\tX|0.123457\tY|0.500000",), ("b",)]


def test_annotations_and_none(spark, tmp_path):
    p = write(tmp_path, "a.tsv", "# c\n\na\tX\tY\nb\n")
    assert rows(scored.read_annotations(spark, p).select("protein", "term")) == [("a", "X"), ("a", "Y")]
    assert scored.read_annotations(spark, None).count() == 0


def test_dimension_files(spark, tmp_path):
    assert rows(tables.read_homodimers(spark, write(tmp_path, "c.tsv", "GO_term\tclassification\nX h\nY\ta\nZ\tn\n"))) == [("X",), ("Y",)]
    assert rows(tables.read_has_part(spark, write(tmp_path, "h.txt", "part whole\none\na b c\n"))) == [("whole", "part")]
    ec = tables.read_ec_map(spark, write(tmp_path, "ec", "! note\nEC:1.1.1.1 > GO:name ; GO:0000001\nEC:2.1.1.1 > GO:n2 ; GO:0000002\n"))
    assert rows(ec) == [("1.1.1.1", "GO:0000001"), ("2.1.1.1", "GO:0000002")]
    p = write(tmp_path, "p.tsv", "GO\tpathway\tec\nGO:9\tP1\t[['1.1.1.1', '9.9.9.9'], ['8.8.8.8']]\nGO:8\tP2\t\n")
    assert rows(tables.read_pathways(spark, p, ec)) == [("P1", "GO:9", 0, "GO:0000001"), ("P2", "GO:8", None, None)]
    assert rows(tables.read_list(spark, write(tmp_path, "o.txt", "# x\n9606\nabc\n\n7\n"), numbers=True)) == [("7",), ("9606",)]
    with pytest.raises(Exception, match="edge without parent"):
        tables.read_edges(spark, write(tmp_path, "e.tsv", "a\tb\nlonely\n")).collect()
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_proteomes(spark, write(tmp_path, "u.tsv", "TaxonID\tDomain\n1\tX\n"))
    t = tables.read_proteomes(spark, write(tmp_path, "v.tsv", "TaxonID\tProteomeID\tEXPCount\tEntriesCount\tDomain\n1\tUP1\tx\t5\tBacteria\n"))
    assert rows(t) == [("1", "UP1", 0, 5, "bacteria")]
    r = write(tmp_path, "README", "x\nProteome_ID\tTax_ID\tOSCODE\tSUPERREGNUM\t#(1)\nUP1\t9\tA\teukaryota\t12\nend\nUP2\t8\tA\tb\t3\n")
    assert rows(tables.read_reference_proteomes(spark, r)) == [("UP1", "9", "eukaryota", 12)]
    log = write(tmp_path, "log", "=== first_cc_after ===\nF-max threshold (tmax): 0.31\nTerms changed by solver: 5  (FPs removed: 3, TPs lost: 2)  Flip precision: 0.6\n")
    assert rows(tables.read_log(spark, log)) == [("first", "cc", "after", 5, 3, 2, "0.6", "0.31")]
    kv = write(tmp_path, "ani", "Status: ok: yes\nother: 1\n")
    assert rows(tables.read_key_values(spark, kv, {"Status": "status"})) == [("status", "ok: yes")]


def test_obo_and_owl(spark, tmp_path):
    obo = "format-version: 1.2\n\n[Term]\nid: GO:0000002\nname: two\nnamespace: bp\nalt_id: GO:0000009\ndef: \"a \\\"q\\\" b\" [x]\nis_a: GO:0000001 ! one\nrelationship: part_of GO:0000003 ! three\n\n[Term]\nid: GO:0000004\nis_obsolete: true\nis_a: GO:0000001\n\n[Typedef]\nid: part_of\nis_a: GO:0000001\n"
    t = ontology.read_obo(spark, write(tmp_path, "x.obo", obo))
    assert t.count() == 2
    assert rows(ontology.edges_of(t)) == [("GO:0000002", "GO:0000001", "is_a")]
    assert len(rows(ontology.edges_of(t, ["*"]))) == 2
    assert rows(ontology.with_alternatives(t)) == [("GO:0000002", "GO:0000002"), ("GO:0000009", "GO:0000002")]
    owl = '<rdf:RDF><owl:Class rdf:about="http://x/NCBITaxon_2"><rdfs:subClassOf rdf:resource="http://x/NCBITaxon_1"/><owl:disjointWith rdf:resource="http://x/NCBITaxon_3"/></owl:Class></rdf:RDF>'
    assert ("NCBITaxon_3", "disjoint_from", "NCBITaxon_2") in rows(ontology.read_owl(spark, write(tmp_path, "x.owl", owl)))
    ax = "GO_0000001 SubClassOf GO_0000002\nGO_0000001 and GO_0000002 SubClassOf GO_0000003\nr some GO_0000001 SubClassOf GO_0000002\nGO_0000001 SubClassOf r some GO_0000002\nnoise\n"
    assert [r[0] for r in rows(ontology.read_axioms(spark, write(tmp_path, "a.txt", ax)))] == ["nf1", "nf2", "nf3", "nf4"]


ENTRY = """ID   AAA_HUMAN               Reviewed;         10 AA.
DT   23-MAY-2024, integrated into UniProtKB/Swiss-Prot.
DE   RecName: Full=Good name {ECO:1};
OS   Homo sapiens (Human).
OX   NCBI_TaxID=9606;
DR   EMBL; X1; AAA1.1; -; Genomic_DNA.
DR   EMBL; X2; BBB2.1; -; mRNA.
DR   GO; GO:0000001; C:x; IDA:UniProtKB.
DR   GO; GO:0000002; C:y; IEA:UniProtKB.
//
ID   BBB_HUMAN               Unreviewed;         10 AA.
OX   NCBI_TaxID=9606;
DR   EMBL; X1; AAA1.1; -; Genomic_DNA.
//
"""


def test_entries(spark, tmp_path):
    e = records.read_entries(spark, write(tmp_path, "x.dat", ENTRY))
    assert rows(e.select("entry", "reviewed", "taxon", "name", "organism")) == [("AAA_HUMAN", True, "9606", "Good name", "Homo sapiens (Human)"), ("BBB_HUMAN", False, "9606", None, None)]
    assert rows(records.experimental(e)) == [("AAA_HUMAN", "GO:0000001")]
    assert rows(records.embl_index(e)) == [("AAA1.1", "AAA_HUMAN", True)]
    assert rows(records.experimental_by_taxon(e)) == [("9606", "Homo sapiens (Human)", 1)]
    taxa = spark.createDataFrame([("9606",)], "taxon string")
    assert records.integrated_after(e, "2024-05-22", taxa).count() == 1 and records.integrated_after(e, "2024-05-23", taxa).count() == 0


def test_features_gff_fasta_positional(spark, tmp_path):
    embl = "ID   C1; SV 1; linear; genomic DNA; STD; PRO; 5000 BP.\nFT   CDS             complement(join(1..10,\nFT                   20..30))\nFT                   /protein_id=\"AAA1.1\"\nFT   gene            1..3\n//\n"
    assert rows(records.read_features(spark, write(tmp_path, "g.embl", embl)).select("component", "size", "protein_id", "start", "end", "complement")) == [("C1", 5000, "AAA1.1", 1, 30, True)]
    gff = "##gff\nc\ts\tCDS\t1\t9\t.\t+\t0\tID=p1;product=a%20b;Ontology_term=GO:0000001,GO:0000002\nbad\n"
    assert rows(records.gff_predictions(records.read_gff(spark, write(tmp_path, "x.gff", gff)), 0.9)) == [("p1", "GO:0000001", 0.9), ("p1", "GO:0000002", 0.9)]
    assert rows(records.read_fasta(spark, write(tmp_path, "x.fa", ">sp|P|N_ORG d\nAC\nGT\n>plain x\nAA\n")).select("protein", "sequence")) == [("N_ORG", "ACGT"), ("plain", "AA")]
    text = "x\nGO term id and name\nMF:\nGO:1;GO:2\nn1;n2\nBP:\nGO:3\nn3\nCC:\nGO:4\nn4\n\nprot\nMF:\n0.1;0.9\nBP:\n0.5\nCC:\n0.2\n"
    assert records.positional(text, 0.2) == [("MF", "prot", "GO:2", 0.9), ("BP", "prot", "GO:3", 0.5), ("CC", "prot", "GO:4", 0.2)]


def test_scalars(spark):
    d = spark.createDataFrame([("9606", "23-MAY-2024", "complement(join(5..7,1..3))", "ACX", 1.0, 8.0)], "t string, d string, l string, s string, a double, b double")
    r = d.select(fn.taxon_id(F.col("t")), fn.dated(F.col("d")).cast("string"), fn.location(F.col("l")), fn.tokens(F.col("s"), 4), fn.percent(F.col("a"), F.col("b")), fn.signature(F.col("t"), F.lit("GO:1"))).first()
    assert r[0] == "NCBITaxon_9606" and r[1] == "2024-05-23" and tuple(r[2]) == (1, 7, True) and r[3] == [1, 5, 0, 0] and r[4] == 12.5 and r[5] == "9606::GO:1"
    bad = spark.createDataFrame([("31-FEB-2024",)], "d string").select(fn.dated(F.col("d"))).first()[0]
    assert bad is None


def test_gaf_catalogues_and_reports(spark, tmp_path):
    gaf = "!gaf\nDB\tP1\tS\tx\tGO:0000001\tr\tIDA\ty\tC\tz\nshort\trow\n"
    assert rows(scored.read_gaf(spark, write(tmp_path, "a.gaf", gaf))) == [("P1", "GO:0000001", "C")]
    portal = "Taxonomy identifier\tIdentifiers (and stoichiometry) of molecules in complex\tGo Annotations\n9606(Homo)\tP12345(2)|CHEBI:1(1)|Q9H9K5-1(0)\tGO:0000001(a)|GO:0000002(b)\n\tP12345(1)\tGO:0000001(a)\n"
    got = tables.read_complex_portal(spark, write(tmp_path, "cp.tsv", portal))
    assert rows(got) == [("9606", "GO:0000001", ["P12345", "Q9H9K5"]), ("9606", "GO:0000002", ["P12345", "Q9H9K5"])]
    corum = "Organism\tsubunits(UniProt IDs)\tGO ID\nHuman\tP12345;bad,Q9H9K5\tGO:0000001;GO:0000003\nYeti\tP12345\tGO:0000001\n"
    more = tables.read_corum(spark, write(tmp_path, "corum.tsv", corum))
    assert rows(more) == [("9606", "GO:0000001", ["P12345", "Q9H9K5"]), ("9606", "GO:0000003", ["P12345", "Q9H9K5"])]
    assert tables.subunit_index(got.unionByName(more)).count() == 3
    with pytest.raises(ValueError, match="unknown layout"):
        tables.read_corum(spark, write(tmp_path, "x.tsv", "A\tB\n1\t2\n"))
    report = write(tmp_path, "r.json", '{"metrics": {"fmax": 0.5}, "n": "x"}')
    r = scored.read_reports(spark, report, {"fmax": "metrics.fmax", "n": "n", "none": "a.b"}).first()
    assert (r["fmax"], r["n"], r["none"]) == (0.5, None, None)
    assert rows(tables.read_consistent(spark, write(tmp_path, "c1", "Genome\tIsSatisfiable\tE\n9606\tTrue\t\n7\tFalse\tx\n"))) == [("9606",)]
    assert rows(tables.read_consistent(spark, write(tmp_path, "c2", "9606: consistent\n7: inconsistent\n"))) == [("9606",)]
    details = tables.read_details(spark, write(tmp_path, "d.tsv", "a\tok\n1\tTrue\n2\tNone\n3\tFalse\n"), ["ok"])
    assert rows(details) == [("1", True), ("2", None), ("3", False)]
    assert rows(tables.read_ic(spark, write(tmp_path, "ic", "GO:1\t2.5\nGO:2\tx\n"))) == [("GO:1", 2.5)]
    assert rows(ontology.read_definitions(spark, write(tmp_path, "defs", "GO_1: GO_2 and GO_3\n"))) == [("GO:1", ["GO:2", "GO:3"])]
    t = tables.read_test_proteins(spark, write(tmp_path, "t.tsv", "protein_id\ttaxon_id\nP1\t9\nP2\tNA\n"))
    assert rows(t) == [("P1", "9")]


def test_tokens_fold_within_their_line(spark, tmp_path):
    """The last token of a term counts, and no token is shuffled: one exchange, that of lines."""
    p = tmp_path / "fold.tsv"
    p.write_text("a\tX|0.1\tY|0.5\tX|0.3\tX|0.2\nb\tbad\nc\na\tZ|1\tX|0.7\tX|0.4\n")
    got = scored.read_scored(spark, str(p), malformed="skip", keep_empty=True)
    assert sorted(map(tuple, got.select("protein", "term", "score").collect()), key=str) == [("a", "X", 0.4), ("a", "Z", 1.0), ("c", None, None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan

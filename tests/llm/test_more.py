"""Rows that share an id, names that clash, and references written out in plain Python."""

import random
from array import array

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from mendral.llm import common, exact_dedup, jaccard_join, language_id, mixing, quality, sentencepiece_lattice, syncmers

CLASHES = ["__keep", "__sha", "__gone", "__key", "__pass", "__plan", "keep_id", "keep_sha", "own_id", "own_sha", "link_key", "link_text", "linked_away", "mixing_key", "mixing_plan", "mixing_pass", "identified", "again", "low", "Key", "x", "component", "a.b", "d"]


def table(spark, rows, lang=None):
    names = ", ".join(f"`{c}` int" for c in CLASHES)
    return spark.createDataFrame([(i, t, lang, "s", 0, *[7] * len(CLASHES)) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {names}")


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_exact_copies_are_told_apart_by_id_and_text(spark):
    d = table(spark, [(4, "a b"), (5, "a  b"), (5, "!!! unique text"), (6, "zz"), (None, "a b"), (None, "only null"), (None, "only  null"), (None, None), (7, "zz"), (6, "zz")])
    got = exact_dedup.keep_first(d)
    assert got.columns == d.columns
    rows = kept(got)
    assert len(rows) == 5 and {(4, "a b"), (5, "!!! unique text"), (6, "zz"), (None, None)} < set(rows)
    assert kept(exact_dedup.keep_first(table(spark, []))) == []
    assert kept(exact_dedup.keep_first(table(spark, [(1, "a"), (2, "a"), (3, "b")]))) == [(1, "a"), (3, "b")]


def test_near_copies_are_told_apart_by_id_and_text(spark):
    t = " ".join(f"w{i}" for i in range(60))
    d = table(spark, [(1, t), (2, t + " x"), (2, "unique text here"), (3, t), (3, t), (4, "q r s t"), (4, "q r s t"), (None, t), (None, t), (8, t + " y"), (8, "q r s t")])
    got = jaccard_join.keep_one(d)
    assert got.columns == d.columns
    assert kept(got) == sorted([(1, t), (2, "unique text here"), (4, "q r s t"), (None, t), (None, t)], key=str)
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(d).where("doc_id IS NOT NULL").collect()) == sorted([(1, 58, 1), (2, 59, 1), (2, 1, 2), (3, 58, 1), (3, 58, 1), (4, 2, 4), (4, 2, 4), (8, 59, 1), (8, 2, 4)])
    assert kept(jaccard_join.keep_one(table(spark, []))) == []


def test_mixing_passes_clashing_columns_on(spark):
    d = table(spark, [(i, "w " * (i + 1)) for i in range(20)])
    got = mixing.mix(d)
    assert got.columns == d.columns and {r["doc_id"] for r in got.collect()} == set(range(20))
    assert all(r["__pass"] == 7 and r["a.b"] == 7 for r in got.collect())


@pytest.mark.parametrize("target", [0.2, 0.9, 1.09])
def test_entropy_is_met_as_closely_as_the_exponent_allows(spark, target):
    sizes = spark.createDataFrame([(int(n),) for n in (900, 90, 9)], "tokens long")
    tau = mixing.by_entropy(sizes, target)
    share = np.array([900.0, 90.0, 9.0]) ** tau
    share /= share.sum()
    h = -(share * np.log(share)).sum()
    assert h >= target - 1e-9 and (abs(h - target) < 1e-6 or tau > 1 - 1e-9)
    assert mixing.by_entropy(sizes.where("false"), target) is None


# ---- languages ----------------------------------------------------------------------------
def test_numbers_are_no_letters(spark):
    net = language_id.ByteConvNet(["de", "en"])
    d = table(spark, [(0, "½ ²"), (1, "Ⅷ ①"), (2, "٣ ۴"), (3, "ª"), (4, "漢")])
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(d, net).collect()}
    assert [got[i] == "und" for i in range(5)] == [True, True, True, False, False]


def test_documents_stay_where_nothing_teaches(spark):
    d = table(spark, [(0, "some words"), (1, "123"), (2, None), (3, "½")])
    got = language_id.keep_identified(d)
    assert got.columns == d.columns and kept(got) == [(0, "some words")]


def test_responses_equal_a_plain_convolution():
    rng = np.random.default_rng(3)
    net = language_id.ByteConvNet(["a", "b", "c"])
    win = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    got = net.probabilities(win)
    for row, p in zip(win, got, strict=True):
        x = net.p["E"][row]
        pooled = []
        for w in language_id.WIDTHS:
            at = [np.tensordot(x[i : i + w], net.p[f"W{w}"], 2) for i in range(len(x) - w + 1)]
            pooled.append(np.maximum(np.max(at, axis=0) + net.p[f"b{w}"], 0))
        z = np.concatenate(pooled) @ net.p["V"] + net.p["c"]
        z = np.exp(z - z.max())
        assert np.allclose(p, z / z.sum(), atol=1e-5)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(4)
    label = rng.integers(0, 2, 120)
    win = rng.integers(97, 123, (120, language_id.WINDOW)).astype(np.uint8)
    for i, y in enumerate(label):
        win[i, 40:43] = list(b"THE" if y else b"DER")
    net = language_id.ByteConvNet(["x", "y"])
    before = np.log(net.probabilities(win)[np.arange(120), label]).mean()
    net.tables = None
    net.fit(win, label, epochs=30)
    p = net.probabilities(win)
    assert np.log(p[np.arange(120), label]).mean() > before and (p.argmax(axis=1) == label).mean() > 0.95


# ---- fingerprints ----------------------------------------------------------------------------
MASK = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_anchors(text):
    """{hash: first position} by the definition, one k-mer after the other."""
    if not text:
        return {}
    border = [0x110000] * (syncmers.K - 1)
    c, base = [*border, *map(ord, text), *border], int(syncmers.BASE)
    h = []
    for i in range(len(c) - syncmers.S + 1):
        x = 0
        for code in c[i : i + syncmers.S]:
            x = (x * base + code + 1) & MASK
        h.append(mix(x))
    out = {}
    for i in range(len(c) - syncmers.K + 1):
        inner = h[i : i + syncmers.WINDOW]
        if min(inner) in (inner[0], inner[-1]):
            out.setdefault(mix((h[i] * base + mix(h[i + syncmers.S - 1] ^ base) * base + h[i + syncmers.WINDOW - 1]) & MASK) >> 32, i)
    return out


def test_anchors_equal_their_definition():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab c\ndé漢") for _ in range(n)) for n in [0, 1, 2, 5, 11, 12, 35, 36, 80, 700]]
    for t, (hashes, places) in zip(texts, syncmers.sketches([syncmers.codes(t) for t in texts]), strict=True):
        want = plain_anchors(t)
        n = min(len(want), max(syncmers.SKETCH, -(-len(want) // syncmers.SHARE)))
        assert [int(x) for x in hashes] == sorted(want)[:n]
        assert [want[int(x)] for x in hashes] == [int(x) for x in places]
        assert bool(t) == bool(len(hashes))


def test_likeness_has_one_rule_for_all_lengths():
    rng = random.Random(10)
    t = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    s = lambda x: syncmers.sketches([syncmers.codes(x)])[0]
    for n in (12, 13, 35, 36, 37, 300):
        assert syncmers.likeness(s(t[:n]), s(t[:n])) == 1.0
        # of all k-mers between the borders, those without the last character are shared
        assert abs(syncmers.likeness(s(t[:n]), s(t[: n - 1])) - (n - 1) / (n + 22)) < 0.25
    whole, three, other = s(t), s(t[:3000] + t[1000:2000]), s("".join(rng.choice("abcdefgh ") for _ in range(4000)))
    assert 0.5 < syncmers.likeness(whole, three) < 0.95 and syncmers.likeness(whole, other) < 0.05
    assert syncmers.shift(s(t[:500]), s("zz" + t[:500])) == 2


# ---- quality -----------------------------------------------------------------------------------
def test_the_model_equals_a_direct_fit(spark, sf):
    docs, labels = common.documents(spark, sf), common.table(spark, sf, "labels")
    described = common.materialize(docs.select("doc_id", quality.describe("text").alias("s")), "test-described")
    model = quality.fit(described, labels)
    teach = labels.select("doc_id", "quality").where("quality IS NOT NULL").where(common.fold_of(labels["doc_id"]) != 0)
    pdf = described.join(teach, "doc_id").toPandas()
    x, y = np.stack(pdf["s"].to_numpy()), pdf["quality"].to_numpy(float)
    k = quality.Kernel(x.mean(0), x.std(0))
    z = k(x)
    penalty = np.full(z.shape[1], quality.RIDGE)
    penalty[-1] = 1e-6
    k.beta = np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y)
    assert np.allclose(k.raw(x), model.kernel.raw(x), atol=1e-6)
    # pooled adjacent violators by the max-min formula
    bins = np.round(k.raw(x) / quality.BIN).astype(int)
    at = np.unique(bins)
    mean = lambda a, b: y[(bins >= at[a]) & (bins <= at[b])].mean()
    some = range(0, len(at), max(1, len(at) // 12))
    for i in some:
        want = max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1))
        assert np.isclose(model.level[np.searchsorted(model.at, at[i] * quality.BIN)], want, atol=1e-9)


def test_statistics_are_of_the_text_alone(spark):
    a = table(spark, [(1, "x y z"), (2, None)], "en").select("doc_id", quality.describe("text").alias("s")).collect()
    b = table(spark, [(7, "x y z"), (2, "")], "de").select("doc_id", quality.describe("text").alias("s")).collect()
    assert [r["s"] for r in a] == [r["s"] for r in b]


# ---- words of the tokenizer -------------------------------------------------------------------------
def test_packed_dictionary_finds_what_it_holds():
    from mendral.llm.sentencepiece_lattice import Dictionary

    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcé漢▁") for _ in range(rng.randint(1, 9))) for _ in range(3000)})
    find = Dictionary.of(words, [w.encode()[::-1] for w in words]).finder()
    assert sum(find(w) == w.encode()[::-1] for w in words) >= len(words) - 2  # words of equal CRC give way
    assert all(find(w + "#") is None for w in words)
    assert Dictionary().finder()("a") is None


# ---- the pipeline on odd input --------------------------------------------------------------------------
def test_pipeline_on_odd_input(spark, tmp_path):
    odd = [(0, None), (1, ""), (2, " "), (3, "a"), (4, "a b c d e f g h i j k l"), (4, "another text of the same id"), (5, "a b  c d e f g h i j k l"), (None, "no id here"), (6, "word " * 20_000), (7, "!!! ½"), (8, "word " * 20_000)]
    table(spark, odd, "en").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert {3, 4, 6, None} <= ids and not ids & {0, 1, 2, 5, 7, 8}
    assert all(r["n_tokens"] == len(r["ids"]) for r in out)
    empty = tmp_path / "none"
    table(spark, []).write.parquet(str(empty / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_utf8_views_of_sliced_arrays():
    arr = pa.array(["aé", None, "", "漢字"]).slice(1)
    data, off = common.utf8(arr)
    assert [bytes(data[off[i] : off[i + 1]]).decode() for i in range(3)] == ["", "", "漢字"]


def test_words_between_single_spaces_are_those_of_the_pattern():
    p = sentencepiece_lattice.load()
    table = sentencepiece_lattice.Table(sentencepiece_lattice.Dictionary.of([], []), p)
    for text in ["", " ", "a", "a b", "a ", " a", "a  b", "a\nb c", "a \n b", "\n", "\t\ta\r\n", "a▁b", "x" * 100 + " y", "a b\n\nc d\n", "漢字 é"]:
        words = table.pattern.findall(sentencepiece_lattice.prepare(text))
        assert table.ids(text) == b"".join(array(table.kind, sentencepiece_lattice.encode_word(p, w)).tobytes() for w in words)
        assert sentencepiece_lattice.decode(p, array(table.kind, table.ids(text)).tolist()) == text.replace("▁", " ")
    assert table.ids(None) == b""

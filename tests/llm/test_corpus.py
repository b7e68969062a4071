"""The corpus operators on small tables: exact references, brute force, edge cases."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mendral.llm import common, components, exact_dedup, jaccard_join, language_id, licenses, mixing, pii, quality, registry, sentencepiece_lattice, sharding, shingles, syncmers
from tests.oracle import assert_same, connection

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, place string, p string, spans int"
LONG = "word " * 60_000


def table(spark, texts, ids=None, source="s"):
    """Documents with extra columns whose names clash with what operators make."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, source, 0, 1.0, "x", "y", "z", 3) for i, t in zip(ids, texts, strict=True)], SCHEMA)


TEXTS = [None, "", " ", "a", "a  b", "a b", "A b c d e f g h i j k l", "Ünï çödé 漢字 ▁ x", "\n\n\t", "a b", LONG, LONG, "x" * 3000, "1 2 3", "!!!"]
IDS = [*range(len(TEXTS) - 2), None, 5]


@pytest.fixture(scope="module")
def edge(spark):
    return table(spark, TEXTS, IDS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- against SQL --------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, name):
    assert_same(registry.QUERIES[name](spark, sf), registry.ORACLES[name], connection(sf))


# ---- 1 fingerprints -------------------------------------------------------------------------
def test_syncmers_do_not_depend_on_context():
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("abcde f") for _ in range(n))
    core = make(200)
    for _ in range(20):
        text = make(rng.randint(0, 50)) + core + make(rng.randint(0, 50))
        at = text.index(core)
        own = dict(zip(*syncmers.anchors(syncmers.codes(core)), strict=True))
        there = dict(zip(*syncmers.anchors(syncmers.codes(text)), strict=True))
        assert all(there[p + at] == h for p, h in own.items())


def brute_fingerprints(docs):
    order = sorted(docs, key=lambda d: d[0])
    out = {}
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1] or ""
        t = t or ""
        q = len(t) // 4
        mixed = t[: len(t) - q] + nxt[:q]
        a, b, c = (syncmers.sketches([syncmers.codes(x)])[0] for x in (t, mixed, nxt))
        out[d] = (len(t), hashlib.sha256(mixed.encode()).hexdigest(), syncmers.to_string(a), syncmers.to_string(b), syncmers.likeness(a, b), syncmers.likeness(a, c))
    return out


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_fingerprints_equal_brute_force(spark, parts):
    rng = random.Random(parts)
    docs = [(i * 7 - 30, "".join(rng.choice("ab c\ndé") for _ in range(rng.choice([0, 2, 5, 40, 400])))) for i in range(40)]
    got = {r["doc_id"]: tuple(r[c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) for r in rows(syncmers.fingerprints(table(spark, [t for _, t in docs], [d for d, _ in docs]), parts))}
    assert got == brute_fingerprints(docs)


def test_fingerprint_edges(spark, edge, none):
    got = rows(syncmers.fingerprints(edge, 3))
    assert len(got) == len(TEXTS) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = {r["n_chars"]: r["fingerprint"] for r in got if r["n_chars"] == len(LONG)}
    assert len(set(prints.values())) == 1
    assert syncmers.fingerprints(none, 3).count() == 0
    one = rows(syncmers.fingerprints(table(spark, ["hello there"]), 3))
    assert one[0]["near_next"] == 1.0 and syncmers.shift(*[syncmers.sketches([syncmers.codes(x)])[0] for x in ("abcdefghijklmnopqrstuvwxyz" * 3, "ZZZ" + "abcdefghijklmnopqrstuvwxyz" * 3)]) == 3


# ---- 2 tokens ----------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_lattice.load()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=f"{sentencepiece_lattice.TOKENIZERS}/{sentencepiece_lattice.MODEL}")


def test_tokens_equal_the_library(spark, sf, pieces, library):
    docs = common.documents(spark, sf)
    for most in (2000, 50):  # by the lattice in Spark, and nearly all in place
        for r in sentencepiece_lattice.encode_documents(docs, pieces, most).join(docs.select("doc_id", "text"), "doc_id").toLocalIterator():
            assert r["ids"] == library.encode(r["text"])


def test_token_edges(spark, edge, none, pieces, library):
    coded = sentencepiece_lattice.encode_documents(edge, pieces, 100)
    by_text = {(r["doc_id"], len(r["ids"])): r["ids"] for r in rows(coded)}
    want = {(i, len(library.encode(t or ""))): library.encode(t or "") for i, t in zip(IDS, TEXTS, strict=True)}
    assert by_text == want
    back = {(r["doc_id"], r["text"]) for r in rows(sentencepiece_lattice.decode_documents(coded, pieces))}
    assert back == {(i, (t or "").replace("▁", " ")) for i, t in zip(IDS, TEXTS, strict=True)}
    assert sentencepiece_lattice.encode_documents(none, pieces, 100).count() == 0
    assert all(r["round_trip"] for r in rows(sentencepiece_lattice.digest(edge, pieces, 100)))


def test_merges_of_long_and_short_words_agree(pieces):
    rng = random.Random(2)
    for _ in range(500):
        w = "".join(rng.choice("▁thea =n漢") for _ in range(rng.randint(1, 60)))
        assert sentencepiece_lattice.merge_short(pieces, w) == sentencepiece_lattice.merge_long(pieces, w)


def test_unigram_fold_is_the_best_path(spark):
    rng = random.Random(4)
    table_ = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): -rng.random() * 5 for _ in range(14)} | {"a": -3.0, "b": -3.5}
    names = sorted(table_)
    p = sentencepiece_lattice.Pieces("unigram", names, [table_[n] for n in names], [0] * 256, 0, set())
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(60)]

    def best(w):
        if not w:
            return 0.0
        return max(table_[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in table_)

    for r in rows(sentencepiece_lattice.encode_words(spark.createDataFrame([(w,) for w in sorted(set(words))], "word string"), p)):
        cut = [r["word"][a:z] for a, z in zip(r["borders"], r["borders"][1:], strict=False)]
        assert "".join(cut) == r["word"] and sum(table_[c] for c in cut) == pytest.approx(best(r["word"]))
        assert sum(table_[names[i]] for i in sentencepiece_lattice.viterbi(p, r["word"])) == pytest.approx(best(r["word"]))


# ---- 3 quality ----------------------------------------------------------------------------------
def test_quality_on_held_out_labels(spark, sf):
    docs, labels = common.documents(spark, "/root/testdata/sf0.01"), common.table(spark, "/root/testdata/sf0.01", "labels")
    got = registry.QUERIES["op3_quality_classifier"](spark, "/root/testdata/sf0.01")
    x = got.join(labels, "doc_id").where("held_out").toPandas()
    pos, neg = x[x.quality == 1].score.to_numpy(), x[x.quality == 0].score.to_numpy()
    assert ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2) > 0.95
    assert got.count() == docs.count() and set(got.select("predicted").distinct().toPandas()["predicted"]) <= {0, 1}


def test_quality_edges(spark, edge, none):
    described = lambda d: d.select("doc_id", quality.describe("text").alias("s"))
    labels = spark.createDataFrame([(1, None), (3, 1), (3, 1), (99, 0)], "doc_id long, quality int")
    for y in (labels, labels.where("false")):
        got = rows(quality.score(described(edge), quality.fit(described(edge), y)))
        assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(described(none), quality.fit(described(none), labels)).count() == 0
    assert list(quality.pool(np.array([1.0, 0.0, 2.0]), np.array([1.0, 1.0, 1.0]))) == [0.5, 0.5, 2.0]


def test_normal_equations_equal_a_direct_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, quality.STATISTICS))
    k = quality.Kernel(x.mean(0), x.std(0))
    z, y = k(x), (x[:, 0] > 0).astype(float)
    parts = sum(np.column_stack([k(b), c]).T @ np.column_stack([k(b), c]) for b, c in zip(np.array_split(x, 7), np.array_split(y, 7), strict=True))
    assert np.allclose(parts[:-1, :-1], z.T @ z) and np.allclose(parts[:-1, -1], z.T @ y)


# ---- 4 licences -----------------------------------------------------------------------------------
def test_licences(spark, edge, none):
    mit = "\n\n".join(licenses.TEXTS["MIT"])
    texts = [mit, mit.upper().replace(".", " ;"), "Copyright (c) 2020 Somebody\n" + mit, mit + " and more", "prose\nReleased under the MIT License.\nmore\nlicenced under the Apache Licence, version 2.0", None]
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in rows(licenses.scan(table(spark, texts)))}
    assert [got[i][0] for i in range(6)] == ["MIT", "MIT", "MIT", None, None, None]
    assert got[4][1] == "Apache-2.0,MIT"
    assert licenses.scan(edge).count() == len(TEXTS) and licenses.scan(none).count() == 0
    for r in rows(licenses.scan(edge)):
        assert r["license_id"] is None


COMPLETE_TEXTS = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def test_complete_licences(spark):
    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence texts on this machine")
    names = [n for n in COMPLETE_TEXTS if os.path.exists(f"{folder}/{n}")]
    whole = [open(f"{folder}/{n}", encoding="utf-8").read() for n in names]
    end = "END OF TERMS AND CONDITIONS"
    cut = [(n, t[: t.index(end)]) for n, t in zip(names, whole, strict=True) if end in t]
    texts = [*whole, *(t.replace("\n", "\n  ") for t in whole), *(t for _, t in cut), whole[0][:5000]]
    got = {r["doc_id"]: r["license_id"] for r in rows(licenses.scan(table(spark, texts)))}
    want = [*(COMPLETE_TEXTS[n] for n in [*names, *names, *(n for n, _ in cut)]), None]
    assert [got[i] for i in range(len(texts))] == want


# ---- 5 mixing ---------------------------------------------------------------------------------------
def mixture(spark):
    docs = [(i, "w " * (i % 5 + 1), "big" if i % 10 < 7 else "small" if i % 10 < 9 else None) for i in range(400)]
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long")


def test_mixing_meets_its_limits(spark, none, edge):
    docs = mixture(spark)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    times = Counter(r["doc_id"] for r in rows(out))
    assert set(times) == set(range(400)) and set(times.values()) <= {1, 2}
    per = {r["source"]: r["n"] for r in rows(out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")))}
    own = {r["source"]: r["n"] for r in rows(docs.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")))}
    assert per["big"] == own["big"] and own[None] * 1.9 < per[None] <= own[None] * 2
    assert mixing.mix(none).count() == 0 and mixing.mix(edge).columns == edge.columns
    flat = mixing.mix(docs, max_repeats=None, target_entropy=float(np.log(3)) - 0.001)
    share = np.array([r["n"] for r in rows(flat.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")))], float)
    share /= share.sum()
    assert -(share * np.log(share)).sum() >= np.log(3) - 0.05
    small = mixing.mix(docs, budget=300)
    assert small.count() and small.groupBy().agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] <= 301


# ---- 6 joins -----------------------------------------------------------------------------------------
def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets_ = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets_}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets_)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            inter = len(sets_[a] & sets_[b])
            if inter and 100 * inter >= 90 * len(sets_[a] | sets_[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets_[d]), find(d)) for d in ids}


def edited_texts(rng, n):
    out = []
    bases = [[rng.choice("abcdefghijklmnop") + str(rng.randint(0, 400)) for _ in range(rng.choice([2, 9, 12, 30, 150, 400]))] for _ in range(8)]
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 30)}"
        out.append(" ".join(w if rng.random() < 0.8 else [*w, *rng.choice(bases)[: rng.randint(0, 8)]]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = list(enumerate([*edited_texts(rng, 260), "", " ", "one", "one two", "One  TWO", "a b c"]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.jaccard_components(table(spark, [t for _, t in docs])))}
    assert got == brute_components(docs)


def brute_near_copies(docs, size, num, den):
    """Components by a Jaccard similarity of num / den of shingles of ``size`` words, all pairs compared."""
    sets_ = {}
    for d, t in docs:
        w = words(t)
        sets_[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {d: d for d in sets_}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets_:
        for b in range(a):
            inter = len(sets_[a] & sets_[b])
            if inter and den * inter >= num * (len(sets_[a]) + len(sets_[b]) - inter):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets_[d]), find(d)) for d in sets_}


@pytest.mark.parametrize("seed", [3, 4])
def test_join_of_near_copies_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    short = [" ".join(base[: rng.randint(7, 10)]) for _ in range(12)]
    docs = list(enumerate([*edited_texts(rng, 260), *short, "", " ", "one", "one two", "One  TWO", "a b c"]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.jaccard_components(table(spark, [t for _, t in docs]), jaccard_join.NEAR_COPIES))}
    want = brute_near_copies(docs, 5, 4, 5)
    assert got == want
    assert len({c for _, c in want.values()}) < len({c for _, c in brute_components(docs).values()})


def test_parts_are_rarely_empty():
    """Empty parts would make regions of unlike texts; the share expected leaves room for them."""
    rng = np.random.default_rng(5)
    for like in (jaccard_join.OP6, jaccard_join.NEAR_COPIES):
        for n in (60, 300, 2000):
            sets_ = [np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64)) for _ in range(200)]
            size = np.array([len(x) for x in sets_])
            sig, _, _ = jaccard_join.signatures(np.concatenate(sets_), size, np.cumsum(size) - size, like)
            assert len(sig) - len(np.unique(sig)) < len(sig) / 100


def test_join_edges(spark, edge, none):
    got = rows(jaccard_join.jaccard_components(edge))
    assert len(got) == len(TEXTS)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert jaccard_join.jaccard_components(none).count() == 0
    kept = jaccard_join.keep_one(edge)
    assert kept.columns == edge.columns and kept.where("doc_id IS NULL").count() == 1


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in rows(components.components(spark.createDataFrame(pairs, "a long, b long")))}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_shingles_equal_tuples():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbB \n\té") for _ in range(rng.randint(0, 30))) for _ in range(800)] + [None, "", "a b", "A  B"]
    data, off = common.utf8(pa.array(texts))
    h, own = shingles.shingle_sets(data, off)
    seen = {}
    for i, t in enumerate(texts):
        assert len(h[own == i]) == len(shingle_set(t))
        assert seen.setdefault(frozenset(shingle_set(t)), tuple(h[own == i])) == tuple(h[own == i])
    assert len(set(seen.values())) == len(seen)


# ---- 7 language ----------------------------------------------------------------------------------------
def test_language_on_held_out_texts(spark):
    d = "/root/testdata/sf0.01"
    got = registry.QUERIES["op7_language_id"](spark, d).join(common.documents(spark, d).select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97


def test_language_edges(spark, edge, none):
    net = language_id.ByteConvNet(["de", "en"])
    got = rows(language_id.identify(edge, net))
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und >= {0, 1, 2, 8} and all(0 <= r["score"] <= 1 for r in got)
    assert 3 not in und and len(got) == len(TEXTS)
    assert {r["lang_pred"] for r in rows(language_id.identify(edge, None))} == {"und"}
    assert language_id.train(edge) is None and language_id.keep_identified(none).count() == 0
    assert language_id.keep_identified(edge).columns == edge.columns


def test_windows_cover_every_byte():
    texts = ["", "abc", "x" * 256, "y" * 700]
    data, off = common.utf8(pa.array(texts))
    win, count = language_id.cut(data, off)
    assert list(count) == [0, 1, 1, 3]
    assert bytes(win[2:].ravel()).rstrip(b"\0") == b"y" * 700


# ---- 8 copies --------------------------------------------------------------------------------------------
def test_fingerprints_combine():
    rng = random.Random(1)
    raw = rng.randbytes(5000)
    whole = exact_dedup.fingerprint(raw)
    assert whole == exact_dedup.fingerprint(raw, 7) == exact_dedup.hash_chunk(raw)
    assert exact_dedup.combine(exact_dedup.hash_chunk(raw[:999]), exact_dedup.hash_chunk(raw[999:]), len(raw) - 999) == whole


def test_dedup_edges(spark, edge, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in zip(IDS, TEXTS, strict=True):
        groups.setdefault(norm(t), []).append(i)
    got = rows(exact_dedup.deduplicate(edge))
    want = Counter((i, min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in zip(IDS, TEXTS, strict=True))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert exact_dedup.deduplicate(none).count() == 0
    kept = exact_dedup.keep_first(edge)
    assert kept.columns == edge.columns and kept.where("doc_id IS NULL").count() == 1


def test_huge_texts_are_hashed_in_parts(spark):
    docs = table(spark, ["a  b " * 500, "a b " * 500, "c" * 2600, "a  b " * 500], [1, 2, 3, 1])
    small, cut = exact_dedup.prints(docs), exact_dedup.prints(docs, huge=1000, chunk=64)
    key = lambda d: Counter(tuple(r) for r in d.collect())
    assert key(small) == key(cut)


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    docs = table(spark, ["aa", "ab", "aa", "zz"])
    hashed = exact_dedup.prints(docs).withColumns({"f0": F.lit(1).cast("long"), "f1": F.lit(1).cast("long"), "text_sha256": F.lit("same")})
    groups = hashed.groupBy(*exact_dedup.KEYED).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    assert exact_dedup.unequal(docs, hashed, groups).count() == 1


# ---- 9 personal data ----------------------------------------------------------------------------------------
def brute_base(text):
    out, digits = [], lambda m: re.sub("[^0-9]", "", m)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    checks = (lambda m: True, lambda m: all(int(x) <= 255 for x in m.split(".")), lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15)
    for k, (kind, ok) in enumerate(zip(pii.BASE, checks, strict=True)):
        out += [(m.start(), k, m.end(), kind.name) for m in re.finditer(kind.pattern, text, re.ASCII) if ok(m.group())]
    return [f"{n}:{s}:{e}" for s, _, e, n in sorted(out)]


def test_pii_equals_brute_force(spark, edge, none):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a@b.c", ".", "1", "2", "@", " ", "-", "+4", "(", "1.2.3.4", "é", "4111 1111 1111 1111", "a", "_x@d.e.f", "256.1.1.1", "+1 202 555 0100", "漢"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += ["mail me a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "0001.2.3.255", " ".join(["a@b.cd"] * 300), None, ""]
    got = {r["doc_id"]: r for r in rows(pii.report(table(spark, texts)))}
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("iban")] == base
        assert [got[i][f"n_{k.name}"] for k in pii.BASE] == [sum(s.startswith(k.name) for s in base) for k in pii.BASE]
    assert pii.report(edge).count() == len(TEXTS) and pii.report(none).count() == 0


def test_pii_added_spans_context_and_redaction(spark):
    docs = table(spark, ["account DE89370400440532013000 ok", "DE89370400440532013001", "card 4111-1111-1111-1111 and x@y.zz"])
    got = {r["doc_id"]: r for r in rows(pii.report(docs))}
    assert got[0]["spans"].endswith("iban:8:30") and got[0]["scores"].endswith("95")
    assert "iban" not in got[1]["spans"]
    assert got[2]["scores"] == "85,80"
    assert {r["doc_id"]: r["text"] for r in rows(pii.redact(docs))}[2] == "card [CARD] and [EMAIL]"


# ---- 10 shards ------------------------------------------------------------------------------------------------
def check_shards(got, docs):
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by.get(j, [])) for j in range(sharding.SHARDS)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} <= {"rows"} and {r["grown_shard"] for r in got} <= {None}


def test_shards_hold_their_law_and_keep_groups(spark, edge, none):
    rng = random.Random(8)
    docs = [(i, f"group {rng.randint(0, 60)}" if i % 3 else f"own {i}") for i in range(1500)]
    got = rows(sharding.shard(table(spark, [t for _, t in docs])))
    check_shards(got, docs)
    where = {}
    for r in got:
        where.setdefault(dict(docs)[r["doc_id"]], set()).add(r["shard"])
    assert sum(len(v) > 1 for v in where.values()) <= sharding.SHARDS
    check_shards(rows(sharding.shard(edge)), list(zip(IDS, TEXTS, strict=True)))
    assert sharding.shard(none).count() == 0


def test_a_group_of_a_third_of_all_rows(spark):
    docs = [(i, "hot" if i % 3 == 0 else f"own {i}") for i in range(1200)]
    got = rows(sharding.shard(table(spark, [t for _, t in docs])))
    check_shards(got, docs)
    hot = Counter(r["shard"] for r in got if r["doc_id"] % 3 == 0)
    assert len(hot) <= 9  # 400 of 1200 rows fill six of sixteen shards; a start by hash may leave remainders

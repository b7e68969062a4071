"""Exact Jaccard join of word shingle sets in the metric space of symmetric differences.

Documents link when ``den * |A & B| >= num * |A | B|``, that is when
``(den - num) * (|A| + |B|) >= (den + num) * |A ^ B|``; the result names each
document's component. ``Likeness`` holds the words of a shingle and the bound:
3 words and 9/10 in op6, other values for stages of pipelines.

1. Equal sets collapse to one node each (the least id).
2. Regions. Random pivots are at distance 1 from almost every text, so pivots are
   chosen where texts are dense: a set is cut into one part more than the largest
   difference of linked sets has elements (and a few spare ones), so linked sets
   agree in a whole part that is not empty. Sets that share a part form a region;
   regions of the same members count once. How many parts linked sets share at least
   is known for each set, and sets and replicas that share fewer are left out.
3. Pivots and Voronoi cells. The member of a region that meets most others is its
   pivot. A document's home cell is that of the pivot it shares most regions with.
   It is replicated to the home cells of all members of its regions, so each
   linked pair meets in the home cell of either; replicas whose distance to the
   pivot is outside the window of the triangle inequality are left out again.
4. Cells join recursively and exactly. In a cell with pivot P, ``D(X) = X ^ P``.
   Members with a small D link to the pivot (and so, by the triangle inequality,
   any two with small enough D are connected already). For the others
   ``X ^ Y = D(X) ^ D(Y)``: the join recurses on the residual sets D, which are
   small and rare, by prefix filtering with rare elements first; the triangle
   inequality bounds ``||D(X)| - |D(Y)|| <= |X ^ Y|``. Candidates are compared
   exactly on D.

Nothing is capped: every step is a filter that no linked pair can fail.

Defined results: without words or text the set is empty, links with nothing and
``component_id`` is the own id. A null id has a null component and links with
nothing. Rows that repeat an id and its text are one node; an id that stands for
several texts is a node for each. Texts of any length are taken in whole. Shingles
are compared as 64-bit hashes. An empty table gives an empty result. Other columns
are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, materialize, mix64, own, small_batches, spans, take_over, unused, utf8
from .components import components
from .shingles import shingle_sets

#: Rows up to which a list of ids is sent to every executor (16 bytes each); beyond, it is shuffled.
BROADCAST_ROWS = 400_000
SEED = np.uint64(0xA0761D6478BD642F)


def size_classes(most: int) -> list[int]:
    """Upper bounds of the size classes up to ``most``."""
    out = [10]
    while out[-1] < most:
        out.append(int(out[-1] * 1.35) + 1)
    return out


CLASSES = np.array(size_classes(1 << 40), dtype=np.int64)


@dataclass(frozen=True)
class Likeness:
    """Sets of shingles of ``words`` words link from a Jaccard similarity of ``num / den`` up.

    ``spare`` is the share of parts that may be empty before empty parts count as
    shared ones: it decides costs, never results.
    """

    words: int = 3
    num: int = 9
    den: int = 10
    spare: float = 0.004

    def __post_init__(self) -> None:
        # a linked set is at most one size class smaller
        if not 0 < self.num < self.den or 100 * self.den > 135 * self.num:
            raise ValueError(f"no bound of the join: {self.num}/{self.den}")

    @property
    def gap(self) -> int:
        return self.den - self.num

    @property
    def sum(self) -> int:
        return self.den + self.num

    @property
    def least(self) -> int:
        """Below this size only equal sets link."""
        return -(-self.num // self.gap)

    @cached_property
    def difference(self) -> np.ndarray:
        """The largest difference of two linked sets of which the smaller is in each size class."""
        return CLASSES * self.gap // self.num

    @cached_property
    def spares(self) -> np.ndarray:
        return 1 + (self.difference * self.spare).astype(np.int64)

    @cached_property
    def parts(self) -> np.ndarray:
        return self.difference + 1 + self.spares


OP6 = Likeness()
#: The bound of near copies in a corpus. Spare parts make linked sets share more of them.
NEAR_COPIES = Likeness(words=5, num=4, den=5, spare=0.15)


def signatures(h: np.ndarray, size: np.ndarray, start: np.ndarray, like: Likeness = OP6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set number) of the parts of each set; ``h`` holds sets one after the other.

    Third, for each set the least number of parts that it shares with any linked set:
    all parts less those that differences can touch and its empty ones.
    """
    sigs, owners = [], []
    need = np.full(len(size), np.iinfo(np.int64).max)
    own_class = np.searchsorted(CLASSES, size)
    # linked sets meet in the class of the smaller one: a set shows its parts in its own class and in that below
    lower = np.searchsorted(CLASSES, -(-size * like.num // like.den))
    for extra in (False, True):
        sets = np.flatnonzero((size >= like.least) & ((lower < own_class) if extra else True))
        if not len(sets):
            continue
        cls = (lower if extra else own_class)[sets]
        parts, counts = like.parts[cls], size[sets]
        first = np.concatenate([[0], np.cumsum(parts)])
        own = np.repeat(np.arange(len(sets)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(start[sets], counts)
        e = mix64(h[at] ^ SEED)
        slot = first[own] + ((e >> np.uint64(33)) % parts[own].astype(np.uint64)).astype(np.int64)
        total = np.zeros(first[-1], np.uint64)
        np.add.at(total, slot, mix64(e))
        filled = np.bincount(slot, minlength=first[-1]) > 0
        of = np.repeat(np.arange(len(sets)), parts)
        # sets with more empty parts than spare ones must show these too
        empty = np.bincount(of, weights=~filled, minlength=len(sets))
        keep = filled | (empty > like.spares[cls])[of]
        touched = np.minimum(like.difference[cls], (CLASSES[cls] + counts) * like.gap // like.sum if extra else counts * like.gap // like.num)
        need[sets] = np.minimum(need[sets], np.maximum(1, parts - touched - empty.astype(np.int64)))
        number = np.arange(first[-1]) - first[of]
        sig = mix64(total + mix64((cls[of].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) + np.uint64(1)))
        sigs.append(sig[keep])
        owners.append(sets[of[keep]])
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), need
    return np.concatenate(sigs), np.concatenate(owners), need


SETS = "doc_id long, n_shingles long, d0 long, d1 long, need long, sigs array<long>"


def _sets(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    take_over("jaccard_join")
    for b in batches:
        data, off = utf8(b.column("text"))
        ids = b.column("doc_id")
        for i, j in spans(off):
            h, own = shingle_sets(data, off[i : j + 1], like.words)
            size = np.bincount(own, minlength=j - i)
            start = np.cumsum(size) - size
            d0, d1 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
            np.add.at(d0, own, mix64(h))
            np.add.at(d1, own, mix64(h + SEED))
            sig, of, need = signatures(h, size, start, like)
            order = np.argsort(of, kind="stable")
            edge = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=j - i))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(sig[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(d0.view(np.int64)), pa.array(d1.view(np.int64)), pa.array(need), lists], ["doc_id", "n_shingles", "d0", "d1", "need", "sigs"])


RESIDUALS = "p long, y long, home boolean, ny long, np long, added int, d array<long>"


def _residuals(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """D(y) = y ^ p for rows (p, y, text, pivot_text): first the ``added`` elements, then those y lacks."""
    take_over("jaccard_join")
    last: tuple[int | None, np.ndarray | None] = (None, None)
    for b in batches:
        ps, ys = b.column("p").to_numpy(zero_copy_only=False), b.column("y").to_numpy(zero_copy_only=False)
        data, off = utf8(b.column("text"))
        pdata, poff = utf8(b.column("pivot_text"))
        for i, j in spans(off):
            h, own = shingle_sets(data, off[i : j + 1], like.words)
            edge = np.searchsorted(own, np.arange(j - i + 1))
            diff, sizes, pivots, new = [], [], [], []
            for k in range(i, j):
                if last[0] != ps[k] or last[1] is None:
                    last = (ps[k], shingle_sets(pdata, poff[k : k + 2], like.words)[0])
                own_set = h[edge[k - i] : edge[k - i + 1]]
                added, gone = np.setdiff1d(own_set, last[1], assume_unique=True), np.setdiff1d(last[1], own_set, assume_unique=True)
                diff.append(np.concatenate([added, gone]).view(np.int64))
                new.append(len(added))
                sizes.append(len(own_set))
                pivots.append(len(last[1]))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in diff])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(diff)))
            yield pa.RecordBatch.from_arrays([pa.array(ps[i:j], pa.int64()), pa.array(ys[i:j], pa.int64()), b.column("home").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(pivots, pa.int64()), pa.array(new, pa.int32()), lists], ["p", "y", "home", "ny", "np", "added", "d"])


def near(df: DataFrame) -> DataFrame:
    """A broadcast hint if the rows are few enough (two longs each), else the frame as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def regions(nodes: DataFrame) -> DataFrame:
    """(sig, y, times, need): the members of each region of at least two; regions of equal members once, with their number.

    A linked document meets others in ``need`` parts at least; those that do not are in no region.
    """
    every = nodes.select(F.col("rep").alias("y"), F.explode("sigs").alias("sig"))
    shared = materialize(every.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig"), "shared-parts")
    met = materialize(every.hint("merge").join(shared, "sig"), "shared-rows")
    counts = met.groupBy("y").agg(F.count("*").alias("k")).join(nodes.select(F.col("rep").alias("y"), "need"), "y").where("k >= need").select("y", "need")
    enough = materialize(counts, "meeting")
    rows = materialize(met.join(near(enough), "y"), "meeting-parts")
    discard(shared, met)
    grouped = rows.groupBy("sig").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.bit_xor(F.xxhash64("y")).alias("x"), F.bit_xor(F.xxhash64("y", F.lit(1))).alias("z")).where("n > 1")
    distinct = materialize(grouped.groupBy("n", "lo", "hi", "x", "z").agg(F.min("sig").alias("sig"), F.count("*").alias("times")), "regions")
    members = materialize(rows.join(near(distinct.select("sig", "times")), "sig").select("sig", "y", "times", "need"), "members")
    discard(enough, rows, distinct)
    return members


def cells(members: DataFrame) -> DataFrame:
    """(p, y, home): the documents of each Voronoi cell; ``home`` marks those whose own cell it is.

    A home is the heaviest of the pivots that a document shares at least half as
    many regions with as with its best one, so that a dense group has few cells.
    """
    size_of = materialize(members.groupBy("sig").agg(F.count("*").alias("n")), "region-sizes")
    weight = materialize(members.join(size_of, "sig").groupBy("y").agg(F.sum("n").alias("w")), "weights")
    pivot = materialize(members.join(weight, "y").groupBy("sig").agg(F.max(F.struct("w", (-F.col("y")).alias("m"))).alias("best")).select("sig", (-F.col("best.m")).alias("p"), F.col("best.w").alias("w")), "pivots")
    shared = materialize(members.join(pivot, "sig").groupBy("y", "p").agg(F.count("*").alias("k"), F.max("w").alias("w")), "shared")
    most = materialize(shared.groupBy("y").agg(F.max("k").alias("most")), "most-shared")
    home = materialize(shared.join(most, "y").where("2 * k >= most").groupBy("y").agg(F.max(F.struct("w", (-F.col("p")).alias("m"))).alias("best")).select("y", (-F.col("best.m")).alias("home")), "homes")
    homes = materialize(members.join(home, "y").select("sig", F.col("home").alias("p")).distinct(), "region-homes")
    met = members.join(homes, "sig").groupBy("p", "y", "need").agg(F.sum("times").alias("k")).where("k >= need").select("p", "y")
    found = materialize(met.join(home, "y").select("p", "y", (F.col("home") == F.col("p")).alias("home")), "cells")
    discard(size_of, weight, pivot, shared, most, home, homes)
    return found


def residuals(docs: DataFrame, found: DataFrame, like: Likeness = OP6) -> DataFrame:
    """(p, y, home, ny, np, added, d) of each cell member except the pivot itself."""
    texts = docs.select(F.col("doc_id").alias("y"), "text")
    of_members = texts.join(near(found.where("p <> y")), "y")
    of_pivots = texts.join(near(found.select(F.col("p").alias("y")).distinct()), "y", "left_semi").select(F.col("y").alias("p"), F.col("text").alias("pivot_text"))
    return of_members.hint("merge").join(of_pivots, "p").select("p", "y", "home", "text", "pivot_text").mapInArrow(lambda batches: _residuals(batches, like), RESIDUALS)


def links(residual: DataFrame, like: Likeness = OP6) -> DataFrame:
    """(a, b) that connect exactly the documents which links connect."""
    r = residual.withColumn("s", F.size("d")).withColumn("ball", F.expr(f"(ny + np) * {like.gap} >= {like.sum} * s"))
    to_pivot = r.where("ball").select(F.col("p").alias("a"), F.col("y").alias("b"))
    # Every pair meets in the cell that is home to one of its two. By the triangle
    # inequality a replica can only link to a home member whose D is about as large;
    # and a cell needs someone outside the ball and two members besides the pivot.
    k_most = f"int(ny * {like.gap} div {like.num})"
    cell = r.groupBy("p").agg(F.count("*").alias("n"), F.count_if(~F.col("ball")).alias("out"), F.max(F.when(F.col("home"), F.col("s"))).alias("reach")).where("n > 1 AND out > 0 AND reach IS NOT NULL").select("p", "reach")
    inner = materialize(r.join(near(materialize(cell, "open-cells")), "p").where(f"home OR s <= reach + {k_most}").drop("reach"), "open-residuals")
    # One order of elements for a whole cell, rare ones first: what members add, by
    # how many add it, then what they lack. The largest linked difference bounds the
    # prefix of this order in which two linked members meet.
    inner = inner.withColumn("most", F.expr(f"s - greatest(1, s - {k_most}) + 1"))
    member = ["p", "y", "home", "ny", "s", "ball"]
    elements = inner.select("p", "y", F.explode(F.slice("d", F.lit(1), F.col("added"))).alias("e"))
    common = materialize(elements.groupBy("p", "e").agg(F.count("*").alias("f")).where("f > 1"), "residual-counts")
    ranked = materialize(elements.join(common, ["p", "e"]).groupBy("p", "y").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("o")), "residual-order")
    added = (
        inner.join(ranked, ["p", "y"])
        .select(*member, "most", (F.col("added") - F.size("o")).alias("alone"), F.posexplode("o").alias("k", "fe"))
        .select(*member, "most", F.col("fe.e").alias("e"), (F.col("alone") + F.col("k") + 1).alias("pos"))
    )
    lacking = inner.where("added < most").select(*member, "most", "added", F.posexplode(F.expr("slice(d, added + 1, greatest(0, most - added))")).alias("k", "e")).select(*member, "most", "e", (F.col("added") + F.col("k") + 1).alias("pos"))
    index = materialize(added.unionByName(lacking).where("pos <= most").drop("most"), "residual-index")
    x, y = index.where("NOT ball").alias("x"), index.alias("y")
    k = f"int((x.ny + y.ny) * {like.gap} div {like.sum})"
    t = f"greatest(1, int(ceil((x.s + y.s - {k}) / 2.0)))"
    meet = F.expr(
        f"x.p = y.p AND x.e = y.e AND x.y <> y.y AND (y.ball OR x.y < y.y) AND (x.home OR y.home) AND abs(x.s - y.s) <= {k} "
        f"AND {like.den} * least(x.ny, y.ny) >= {like.num} * greatest(x.ny, y.ny) AND x.pos <= x.s - {t} + 1 AND y.pos <= y.s - {t} + 1"
    )
    pairs = materialize(x.join(y, meet).select("x.p", F.col("x.y").alias("a"), F.col("y.y").alias("b")).distinct(), "residual-pairs")
    d = inner.select("p", "y", "ny", "d")
    both = pairs.join(d.select("p", F.col("y").alias("a"), F.col("ny").alias("na"), F.col("d").alias("da")), ["p", "a"]).join(d.select("p", F.col("y").alias("b"), F.col("ny").alias("nb"), F.col("d").alias("db")), ["p", "b"])
    inside = both.where(f"(na + nb) * {like.gap} >= {like.sum} * (size(da) + size(db) - 2 * size(array_intersect(da, db)))").select("a", "b")
    return to_pivot.unionByName(inside)


def keyed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """``docs`` with a ``key`` for each (id, text), and whether any id is repeated.

    The key is the id; an id that stands for several texts has a hash of both as key
    in each of its rows. ``text`` names a column for the hash of the text.
    """
    low, high, n, again = unused(docs, "low", "high", "rows", "again")
    ids = docs.select(F.col("doc_id").cast("long").alias(again), F.xxhash64(F.coalesce("text", F.lit(""))).alias(text))
    often = materialize(ids.where(F.col(again).isNotNull()).groupBy(again).agg(F.count("*").alias(n), F.min(text).alias(low), F.max(text).alias(high)).where(F.col(n) > 1).select(again, (F.col(low) < F.col(high)).alias(low)), "repeated-ids")
    if not often.limit(1).count():
        return docs.withColumn(key, F.col("doc_id").cast("long")), False
    marked = docs.join(often, F.col("doc_id").cast("long") == F.col(again), "left").withColumn(text, F.xxhash64(F.coalesce("text", F.lit(""))))
    named = F.when(F.col(low), F.xxhash64(F.col(again), F.col(text), F.lit("text"))).otherwise(F.col("doc_id").cast("long"))
    return marked.withColumn(key, named).select(*own(docs), key, text, F.col(again).isNotNull().alias(again)), True


def linked(rows: DataFrame, like: Likeness) -> DataFrame:
    """(doc_id, n_shingles, component_id) of rows (doc_id, text) in which no id but null is repeated."""
    small_batches(rows.sparkSession)
    full = materialize(rows.mapInArrow(lambda batches: _sets(batches, like), SETS), "shingle-sets")
    small = materialize(full.drop("need", "sigs"), "shingle-sizes")
    equal = ["d0", "d1", "n_shingles"]
    named = small.where("doc_id IS NOT NULL AND n_shingles > 0")
    reps = materialize(named.groupBy(*equal).agg(F.min("doc_id").alias("rep")), "set-representatives")
    # those that another document's equal set stands for; the parts themselves stay where they are
    copies = materialize(named.where(f"n_shingles >= {like.least}").join(reps, equal).where("doc_id <> rep").select("doc_id").distinct(), "equal-sets")
    nodes = full.where(f"doc_id IS NOT NULL AND n_shingles >= {like.least}").join(near(copies), "doc_id", "left_anti")
    members = regions(nodes.select(F.col("doc_id").alias("rep"), "need", "sigs"))
    discard(full, copies)
    found = cells(members)
    discard(members)
    residual = materialize(residuals(rows, found, like), "residuals")
    discard(found)
    joined = components(links(residual, like))
    named_reps = materialize(reps.join(joined, F.col("rep") == F.col("node"), "left").select(*equal, F.coalesce("component", "rep").alias("component")), "set-components")
    return (
        small.hint("merge").join(named_reps, equal, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    )


def _by_key(docs: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame, bool]:
    """(key, n_shingles, component), a row for each of ``docs``; rows (key, own, text, x, again); is any id repeated?"""
    rows, repeated = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "key", "x")
    once = rows.where("NOT again").unionByName(rows.where("again").dropDuplicates(["key"])) if repeated else rows
    result = linked(once.select(F.col("key").alias("doc_id"), "text"), like).select(F.col("doc_id").alias("key"), "n_shingles", F.col("component_id").alias("component"))
    if repeated:
        result = materialize(result, "linked-once")
        result = result.where("key IS NULL").unionByName(rows.where("key IS NOT NULL").select("key").hint("merge").join(result.where("key IS NOT NULL"), "key"))
    return result, rows, repeated


def jaccard_components(docs: DataFrame, like: Likeness = OP6) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    result, rows, repeated = _by_key(docs, like)
    if not repeated:
        return result.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    ids = materialize(rows.where("key IS NOT NULL").select("key", "doc_id").distinct(), "linked-ids")
    result = materialize(result.hint("merge").join(ids, "key", "left"), "linked")
    least = result.where("key IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return result.hint("merge").join(least, "component", "left").select("doc_id", "n_shingles", "component_id")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def keep_one(docs: DataFrame, like: Likeness = OP6) -> DataFrame:
    """One row of each component, with its own columns: that of the least id.

    Rows are told apart by id and text, so an id that stands for several texts
    loses those only that another row's text is linked with. Of rows that repeat
    both, one stays. Rows without an id and rows without words all stay.
    """
    result, rows, repeated = _by_key(docs, like)
    if not repeated:
        (gone,) = unused(docs, "linked_away")
        away = materialize(result.where("component < key").select(F.col("key").alias(gone)).distinct(), "linked-away")
        return docs.join(away, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    key, text, gone = unused(docs, "link_key", "link_text", "linked_away")
    ids = materialize(rows.where("key IS NOT NULL").select("key", "doc_id").distinct(), "linked-ids")
    named = materialize(result.where("key IS NOT NULL").select("key", "component").distinct().join(ids, "key"), "linked")
    stays = named.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("s")).select("component", F.col("s.key").alias("stay"))
    away = materialize(named.join(stays, "component").where("key <> stay").select(F.col("key").alias(gone)), "linked-away")
    every, _ = keyed(docs, key, text)
    again = next(c for c in every.columns if c not in {*docs.columns, key, text})
    left = every.join(away, F.col(key) == F.col(gone), "left_anti")
    once = left.where(F.col(again)).dropDuplicates([key, text])
    return left.where(~F.col(again)).unionByName(once).select(*own(docs))

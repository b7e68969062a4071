"""Annotation transfer from similar proteins, neighbours of vectors, small model operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendral.plans.storage import materialize


def best_hits(hits: DataFrame) -> DataFrame:
    """(query, subject, bitscore, evalue): the hit of greatest bitscore, then least e-value, of each pair."""
    return hits.groupBy("query", "subject").agg(F.max(F.struct("bitscore", (-F.col("evalue")).alias("m"))).alias("b")).select("query", "subject", "b.bitscore", (-F.col("b.m")).alias("evalue"))


def transfer(hits: DataFrame, training: DataFrame) -> DataFrame:
    """(query, term, score): bitscore-weighted share of annotated subjects that have the term.

    Subjects without annotations are no evidence either way: they are left out of
    the denominator too.
    """
    known = best_hits(hits).join(training.select(F.col("protein").alias("subject")).distinct(), "subject", "left_semi")
    total = known.groupBy("query").agg(F.sum("bitscore").alias("total"))
    per = known.join(training.select(F.col("protein").alias("subject"), "term").distinct(), "subject").groupBy("query", "term").agg(F.sum("bitscore").alias("part"))
    return per.join(total, "query").where("total > 0").select("query", "term", (F.col("part") / F.col("total")).alias("score"))


def ensemble_mean(scores: DataFrame) -> DataFrame:
    """Mean over models of (model, protein, term, score)."""
    return scores.groupBy("protein", "term").agg(F.avg("score").alias("score"))


def merge_chunks(scores: DataFrame) -> DataFrame:
    """Greatest score of a pair over chunks."""
    return scores.groupBy("protein", "term").agg(F.max("score").alias("score"))


def mean_pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, mean): mean of vectors of one key, element by element."""
    return rows.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("mean"))


def fit_length(vector: str, n: int):
    """A vector cut or padded with zeros to n elements."""
    return F.slice(F.concat(F.col(vector), F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


#: Angles this near to a bound are searched: what rounds to one cosine of nine places differs by less.
SLACK = 1e-4
#: Vectors of a bin, queries of a block that are compared with them in one group, and rows of one product.
PART, BLOCK, CHUNK = 4096, 8192, 256
FOUND = "query long, neighbour long, cosine double"


def _units(pdf: pd.DataFrame) -> np.ndarray:
    """Unit vectors; those of length 0 stay."""
    x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def nearest_by_cosine(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(query, neighbour, cosine, rank): the ``k`` nearest vectors, exact.

    As many vectors as the square root of the base, the least by a hash, are centres
    (a bounded sample on the driver: 31,623 of a thousand million); a vector's cell is its nearest
    centre. A query first searches the cells nearest to it until they hold k others. That
    gives an upper bound of the angle to its k-th neighbour, and by the triangle
    inequality only cells whose centre is nearer than the bound and the cell's radius
    together can hold a nearer one: these are searched as well. Cells are searched in bins of several
    (or parts of a large one), each by matrix products with blocks of queries. Vectors of length 0 have
    cosine 0 with all others, and a cell of their own that is always searched. ``queries`` and ``base``
    are (id, vector); ties in nine places go to the lesser id.
    """
    n = base.count()
    if not n:
        return queries.sparkSession.createDataFrame([], FOUND + ", rank int")
    sample = base.select("id", "vector").where(F.size("vector") > 0).orderBy(F.xxhash64("id"), "id").limit(math.isqrt(n - 1) + 1).toPandas()
    centres = _units(sample)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _units(pdf)
                angle = _angles(x, centres)
                cell = np.where(np.abs(x).sum(axis=1) > 0, angle.argmin(axis=1), -1)
                yield pd.DataFrame({"id": pdf["id"], "u": list(x), "cell": cell, "far": angle.min(axis=1)})

    dealt = materialize(base.select("id", "vector").mapInPandas(cells, "id long, u array<double>, cell long, far double"), "vector-cells")
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).toPandas()  # a row for each centre
    count, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    own = sizes[sizes["cell"] >= 0]
    count[own["cell"]], radius[own["cell"]] = own["n"], own["far"]
    blanks = int(sizes.loc[sizes["cell"] < 0, "n"].sum())
    # cells in a row share a bin of some PART vectors, larger ones have several; the last cell is that of vectors of length 0
    whole = np.append(count, blanks)
    low, many = (np.cumsum(whole) - whole) // PART, np.maximum(1, -(-whole // PART))
    bins = int((low + many).max())
    spread = F.broadcast(queries.sparkSession.createDataFrame(pd.DataFrame({"cell": np.append(np.arange(len(count)), -1), "low": low, "many": many}), "cell long, low long, many long"))
    blocks = -(-queries.count() // BLOCK)

    def marked(of: int, at: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Which bins each of ``of`` queries searches for these cells."""
        n = many[cell]
        mark = np.zeros((of, bins), bool)
        mark[np.repeat(at, n), np.repeat(low[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = True
        return mark

    def nearest_bins(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bins searched first, angles to centres, cells among these)."""
        angle = _angles(x, centres)
        order = np.argsort(angle, axis=1, kind="stable")
        before = np.empty_like(order)
        np.put_along_axis(before, order, np.cumsum(count[order], axis=1) - count[order], axis=1)
        near = (before <= k) & (count > 0)  # the query itself may be one of them
        mark = marked(len(x), *np.nonzero(near))
        if blanks:
            mark |= marked(len(x), np.arange(len(x)), np.full(len(x), len(count)))
        return mark, angle, near

    def asked_bins(pdf: pd.DataFrame, x: np.ndarray, mark: np.ndarray) -> pd.DataFrame:
        at, bin_ = np.nonzero(mark)
        return pd.DataFrame({"query": pdf["id"].to_numpy()[at], "q": pd.Series([x[i] for i in at], dtype=object), "bin": bin_})

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), CHUNK):
                rows = pdf.iloc[i : i + CHUNK]
                x = _units(rows)
                yield asked_bins(rows, x, nearest_bins(x)[0])

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), CHUNK):
                rows = pdf.iloc[i : i + CHUNK]
                x = _units(rows)
                done, angle, near = nearest_bins(x)
                least = np.where(np.abs(x).sum(axis=1, keepdims=True) > 0, angle - radius, 0)
                open_ = ~near & (count > 0) & (least <= rows["bound"].to_numpy()[:, None] + SLACK)
                yield asked_bins(rows, x, marked(len(x), *np.nonzero(open_)) & ~done)

    def products(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": np.empty(0, np.int64), "neighbour": np.empty(0, np.int64), "cosine": np.empty(0)})]
        if len(asked) and len(held):
            held = held.sort_values("id")
            ids, y, name, x = held["id"].to_numpy(), np.stack(held["u"].to_numpy()).T, asked["query"].to_numpy(), np.stack(asked["q"].to_numpy())
            for i in range(0, len(x), CHUNK):
                cosine, names = x[i : i + CHUNK] @ y, name[i : i + CHUNK]
                value = np.round(cosine, 9)
                value[names[:, None] == ids] = -np.inf
                last = -np.partition(-value, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                # all nearer ones than the last, and of those that tie with it the lesser ids
                over, tie = value > last[:, None], (value == last[:, None]) & np.isfinite(value)
                at, j = np.nonzero(over | (tie & (tie.cumsum(axis=1) <= k - over.sum(axis=1, keepdims=True))))
                out.append(pd.DataFrame({"query": names[at], "neighbour": ids[j], "cosine": cosine[at, j]}))
        return pd.concat(out)

    def compared(pairs: DataFrame) -> DataFrame:
        """The ``k`` nearest of each query in each bin that it searches: matrix products of a bin and a block of queries."""
        wanted = pairs.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(max(1, blocks))))
        held = dealt.join(spread, "cell").select((F.col("low") + F.pmod(F.xxhash64("id"), F.col("many"))).alias("bin"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, blocks) - 1).cast("long"))).alias("block"), "id", "u")
        return wanted.groupBy("bin", "block").cogroup(held.groupBy("bin", "block")).applyInPandas(products, FOUND)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "neighbour")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    searched = "query long, q array<double>, bin long"
    near = materialize(best(compared(queries.select("id", "vector").mapInPandas(first, searched))), "nearest-cells")
    bound = near.groupBy("query").agg(F.min("cosine").alias("c"), F.count("*").alias("n")).select(F.col("query").alias("id"), F.when(F.col("n") < k, math.pi).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "c")))).alias("bound"))
    asked = queries.select("id", "vector").join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(math.pi)))
    return best(near.drop("rank").unionByName(compared(asked.mapInPandas(rest, searched))))


def zero_shot(x: DataFrame, go: np.ndarray, rel: np.ndarray, rad: np.ndarray, weight: np.ndarray, bias: np.ndarray, terms: list[str]) -> DataFrame:
    """(id, term, score): sigmoid of net(x) . (go + rel) + |rad|, one matrix product a batch; net is one linear layer with ReLU."""
    target = (go + rel).T

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            v = np.maximum(np.stack(pdf["vector"].to_numpy()).astype(np.float64) @ weight + bias, 0)
            s = 1 / (1 + np.exp(-(v @ target + np.abs(rad))))
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), len(terms)), "term": np.tile(terms, len(pdf)), "score": s.ravel()})

    return x.select("id", "vector").mapInPandas(score, "id long, term string, score double")


class MultiLabelNet:
    """A residual perceptron on vectors with one sigmoid per term, trained by Adam: on arrays (``fit``), or on the rows of a table (``fit_rows``)."""

    def __init__(self, inputs: int, hidden: int, terms: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.terms = terms
        self.p = {
            "W1": rng.normal(0, inputs**-0.5, (inputs, hidden)), "b1": np.zeros(hidden),
            "W2": rng.normal(0, hidden**-0.5, (hidden, hidden)), "b2": np.zeros(hidden),
            "W3": rng.normal(0, hidden**-0.5, (hidden, len(terms))), "b3": np.zeros(len(terms)),
        }

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.p["W1"] + self.p["b1"], 0)
        r = h + np.maximum(h @ self.p["W2"] + self.p["b2"], 0)
        return h, r, 1 / (1 + np.exp(-(r @ self.p["W3"] + self.p["b3"])))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 256, rate: float = 3e-3, seed: int = 0) -> MultiLabelNet:
        rng = np.random.default_rng(seed)
        m, s, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                a, b = x[order[i : i + batch]], y[order[i : i + batch]]
                g = self.gradients(a, b, len(a))
                t += 1
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def gradients(self, x: np.ndarray, y: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """Derivatives of the cross entropy over these rows, divided by ``n``: what rows of one batch give adds up."""
        h, r, q = self.forward(x)
        d = (q - y) / n
        g = {"W3": r.T @ d, "b3": d.sum(0)}
        dr = d @ self.p["W3"].T
        du = dr * ((r - h) > 0)
        g |= {"W2": h.T @ du, "b2": du.sum(0)}
        dh = (dr + du @ self.p["W2"].T) * (h > 0)
        return g | {"W1": x.T @ dh, "b1": dh.sum(0)}

    def fit_rows(self, rows: DataFrame, epochs: int = 10, rate: float = 3e-3, block: int = 4096) -> MultiLabelNet:
        """Train on all (vector, positions) rows, a step of Adam for each pass over them.

        ``positions`` are the places of a row's terms (``vectors.sparse_labels``); dense labels exist
        for one Arrow batch at a time. Each task adds up the derivatives of its rows and gives
        them in blocks, Spark adds up each block over tasks, and the driver gets as many
        numbers as the network has. A lost task is a task computed again.
        """
        names = sorted(self.p)
        stored = materialize(rows.select("vector", "positions"), "training-rows")
        n = stored.count()
        if not n:
            return self
        m, s = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}

        def add(batches: Iterator[pd.DataFrame], net=self) -> Iterator[pd.DataFrame]:
            total = None
            for pdf in batches:
                if len(pdf):
                    y = np.zeros((len(pdf), len(net.terms)))
                    for i, at in enumerate(pdf["positions"]):
                        if at is not None:
                            y[i, np.asarray(at, np.int64)] = 1
                    g = net.gradients(np.stack(pdf["vector"].to_numpy()).astype(np.float64), y, n)
                    flat = np.concatenate([g[k].ravel() for k in names])
                    total = flat if total is None else total + flat
            if total is not None:
                for i in range(0, len(total), block):
                    yield pd.DataFrame({"block": [i // block], "g": [total[i : i + block]]})

        def summed(pdf: pd.DataFrame) -> pd.DataFrame:  # a row for each task
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "g": [np.sum(np.stack(pdf["g"].to_numpy()), axis=0)]})

        for t in range(1, epochs + 1):
            parts = stored.mapInPandas(add, "block int, g array<double>").groupBy("block").applyInPandas(summed, "block int, g array<double>").toPandas()
            flat, at = np.concatenate(list(parts.sort_values("block")["g"])), 0
            for k in names:
                v = flat[at : at + self.p[k].size].reshape(self.p[k].shape)
                at += self.p[k].size
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def predict(self, x: DataFrame) -> DataFrame:
        """(id, term, score) of rows (id, vector)."""
        net = self

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    s = net.forward(np.stack(pdf["vector"].to_numpy()).astype(np.float64))[2]
                    yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), len(net.terms)), "term": np.tile(net.terms, len(pdf)), "score": s.ravel()})

        return x.select("id", "vector").mapInPandas(score, "id long, term string, score double")

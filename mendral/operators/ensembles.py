"""Networks of balls, and scores of several networks at once, handed up the hierarchy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hierarchy import propagate_scores
from .transfer import MultiLabelNet, fit_length

#: Pairs of a closure (two short names each) that the driver hands to tasks; larger closures are joined.
REACH_PAIRS = 2_000_000
#: Numbers that a task holds at once while it hands scores up.
HELD = 4_000_000
SCORES = "id long, term string, score double"


class BallNet(MultiLabelNet):
    """Terms are balls in the space that a residual perceptron maps vectors to.

    A term has a centre and a radius, one relation moves all centres. The score of a term is
    the sigmoid of the product of the mapped vector with the moved centre, plus the radius;
    ``distances`` tells how far outside its ball a vector is. Trained like its parent, on
    arrays or on the rows of a table.
    """

    def __init__(self, inputs: int, hidden: int, terms: list[str], seed: int = 0, margin: float = 0.1):
        super().__init__(inputs, hidden, terms, seed)
        rng = np.random.default_rng(seed + 1)
        self.margin = margin
        self.p["centre"] = self.p.pop("W3").T.copy()
        self.p["radius"] = np.abs(rng.normal(0, 0.1, len(terms)))
        self.p["relation"] = rng.normal(0, hidden**-0.5, hidden)
        del self.p["b3"]

    def moved(self) -> np.ndarray:
        return self.p["centre"] + self.p["relation"]

    def mapped(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.p["W1"] + self.p["b1"], 0)
        return h, h + np.maximum(h @ self.p["W2"] + self.p["b2"], 0)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, r = self.mapped(x)
        return h, r, 1 / (1 + np.exp(-(r @ self.moved().T + np.abs(self.p["radius"]))))

    def gradients(self, x: np.ndarray, y: np.ndarray, n: int) -> dict[str, np.ndarray]:
        h, r, q = self.forward(x)
        d = (q - y) / n
        toward = d.T @ r
        g = {"centre": toward, "relation": toward.sum(0), "radius": np.sign(self.p["radius"]) * d.sum(0)}
        dr = d @ self.moved()
        du = dr * ((r - h) > 0)
        g |= {"W2": h.T @ du, "b2": du.sum(0)}
        dh = (dr + du @ self.p["W2"].T) * (h > 0)
        return g | {"W1": x.T @ dh, "b1": dh.sum(0)}

    def outside(self, x: np.ndarray) -> np.ndarray:
        """How far each vector is from the ball of each term, less the margin; 0 inside."""
        r, c = self.mapped(x)[1], self.moved()
        apart = (r * r).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * r @ c.T
        return np.maximum(np.sqrt(np.maximum(apart, 0)) - np.abs(self.p["radius"]) - self.margin, 0)

    def distances(self, x: DataFrame) -> DataFrame:
        """(id, term, score) of rows (id, vector); the score is the distance, so less is nearer."""
        net = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield _long(pdf["id"].to_numpy(), net.terms, net.outside(_matrix(pdf)), None)

        return x.select("id", "vector").mapInPandas(run, SCORES)


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["vector"].to_numpy()).astype(np.float64)


def _long(ids: np.ndarray, terms: Sequence[str], s: np.ndarray, floor: float | None) -> pd.DataFrame:
    at, term = np.nonzero(np.ones_like(s, bool) if floor is None else s >= floor)
    return pd.DataFrame({"id": ids[at], "term": np.asarray(terms, object)[term], "score": s[at, term]})


def mean_scores(nets: Sequence[MultiLabelNet], x: np.ndarray) -> np.ndarray:
    """The mean score of all networks, which share their terms."""
    total = np.zeros((len(x), len(nets[0].terms)))
    for net in nets:
        total += net.forward(x)[2]
    return total / len(nets)


class Upward:
    """The closure of a vocabulary as places: every term's score is the greatest of those below it and its own."""

    def __init__(self, terms: Sequence[str], pairs: pd.DataFrame):
        at = {t: i for i, t in enumerate(terms)}
        own = pd.DataFrame({"node": list(terms), "ancestor": list(terms)})
        known = pd.concat([pairs[pairs["node"].isin(at)], own]).drop_duplicates().sort_values("ancestor", kind="stable")
        self.terms, self.start = np.unique(known["ancestor"].to_numpy(str), return_index=True)
        self.below = known["node"].map(at).to_numpy(np.int64)

    def blocks(self, s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, scores of all terms) of so many rows at a time that memory is bounded."""
        step = max(1, HELD // max(1, len(self.below)))
        for i in range(0, len(s), step):
            yield i, np.maximum.reduceat(s[i : i + step][:, self.below], self.start, axis=1)


def predict(nets: Sequence[MultiLabelNet], x: DataFrame, reach: DataFrame, floor: float = 0.0, most_pairs: int = REACH_PAIRS) -> DataFrame:
    """(id, term, score) of rows (id, vector): mean of the networks, ancestors included, scores from ``floor`` up.

    A row holds all scores of its protein, so the task that computes them hands them up
    the hierarchy as well, without a shuffle. A closure of more than ``most_pairs`` pairs is
    not sent to tasks but joined (``propagate_scores``), with the same result. Vectors are cut or
    padded with zeros to what the networks read; rows without a vector have no scores, and rows
    that repeat an id have theirs each (the joined way keeps the greatest). An empty table
    has no scores.
    """
    if not nets or any(n.terms != nets[0].terms for n in nets):
        raise ValueError("networks of one vocabulary are needed")
    terms, width = nets[0].terms, len(nets[0].p["W1"])
    rows = x.where("vector IS NOT NULL").select("id", fit_length("vector", width).alias("vector"))
    own = reach.select("node", "ancestor").where(F.col("node").isin(terms)) if len(terms) <= 1000 else reach.select("node", "ancestor")
    pairs = own.limit(most_pairs + 1).toPandas()  # bounded
    local = len(pairs) <= most_pairs
    up = Upward(terms, pairs) if local else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            s, ids = mean_scores(nets, _matrix(pdf)), pdf["id"].to_numpy()
            if up is None:
                yield _long(ids, terms, s, floor)
            else:
                for i, higher in up.blocks(s):
                    yield _long(ids[i : i + len(higher)], up.terms, higher, floor)

    scored = rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, term string, score double")
    return scored if local else propagate_scores(scored, reach, ["id"])

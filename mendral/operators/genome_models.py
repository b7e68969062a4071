"""The full model of many genomes that fit a task each, as columns of numbers.

The same problem as ``repair_complex.solve_full``, which deals a genome's pairs over tasks: every term, every
protein, every complex, from what is violated on, solved again while the solution violates more. Here
many genomes are looked at together, and only pairs that may change are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .annotate import COST_SCALE
from .batches import changes, whole
from .pair_search import settle
from .repair_complex import Upward

CHANGED = "genome string, protein string, term string, annotated boolean, scaled long, present boolean, status string"
#: Rows of genomes that are looked at together.
ROWS = 20_000


def margins(scores: np.ndarray, tau: float) -> np.ndarray:
    """What ``repair_complex.margin`` says of scores."""
    m = np.abs(scores - tau)
    scaled = np.floor(np.round(m, 9) * COST_SCALE).astype(np.int64)
    return np.where((scaled == 0) & (m > 0), 1, scaled)


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


class Genomes:
    """Scores of whole genomes: ``key`` is a protein's row times ``up.n`` plus a term, sorted, and ``genome`` that of each row."""

    def __init__(self, key: np.ndarray, score: np.ndarray, genome: np.ndarray, up: Upward, listed: np.ndarray, tau: float):
        self.key, self.genome, self.up, self.listed, self.n = key, genome, up, listed, up.n
        self.cost, self.none = margins(score, tau), int(margins(np.array([0.0]), tau)[0])
        self.has = score > tau
        self.have = key[self.has]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Genome and term of pairs, as a key."""
        return self.genome[keys // self.n] * self.n + keys % self.n

    def price(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, self.cost[at], self.none)

    def above(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``keys``, and all that is above each of these; each with itself."""
        first, to = self.up.above
        term = keys % self.n
        many = first[term + 1] - first[term]
        at = np.repeat(np.arange(len(keys)), many)
        over = to[np.repeat(first[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        high = np.concatenate([keys, (keys - term)[at] + over])
        at = np.concatenate([np.arange(len(keys)), at])
        kept = np.unique(at * (self.key[-1] // self.n * self.n + self.n) + high, return_index=True)[1]
        return at[kept], high[kept]

    def violated(self, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Complexes on one protein, as genome and term, and pairs that lack a parent, with that parent."""
        alike, many = np.unique(self.of(now[self.listed[now % self.n]]), return_counts=True)
        low, parents = self.links(now)
        torn = ~among(parents, now)
        return alike[many == 1], np.unique(np.concatenate([now[low[torn]], parents[torn]]))

    def links(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``keys`` and the parents of each."""
        return np.repeat(np.arange(len(keys)), np.diff(self.up.first)[keys % self.n]), self.up.step(keys)

    def every(self, active: np.ndarray) -> np.ndarray:
        """Active complexes (genome and term) on all proteins of their genomes."""
        order = np.argsort(self.genome, kind="stable")
        g, term = np.divmod(active, self.n)
        first, last = (np.searchsorted(self.genome[order], g, side) for side in ("left", "right"))
        many = last - first
        row = order[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        return row * self.n + np.repeat(term, many)

    def candidates(self, active: np.ndarray, torn_genomes: np.ndarray) -> np.ndarray:
        """Candidates that may be on in a cheapest assignment; all of genomes in which a pair lacks a parent."""
        on = self.have[among(self.of(self.have), active)]
        low = self.have[np.isin(self.have // self.n, on // self.n)]
        at, high = self.above(low)
        inside = np.unique(at[among(high, on)])
        mine = np.isin(at, inside)
        term, place = np.unique(self.of(high[mine]), return_inverse=True)
        worth = np.bincount(place, self.price(low)[at[mine]], len(term))
        limit = np.zeros(len(active))
        known = among(active, term)
        limit[known] = worth[np.searchsorted(term, active[known])]
        whole = np.isin(active // self.n, torn_genomes)
        off = self.key[~self.has]
        near = among(self.of(off), active)
        off, cost = off[near], self.cost[~self.has][near]
        off = off[cost < limit[np.searchsorted(active, self.of(off))]]
        return np.unique(np.concatenate([on, off, self.unscored(active[~whole & (limit > self.none)]), self.every(active[whole])]))

    def unscored(self, active: np.ndarray) -> np.ndarray:
        keys = self.every(active)
        return keys[~among(keys, self.key)]

    def solve(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that change, and whether each is then present."""
        now, active, extra = self.have, np.empty(0, np.int64), np.empty(0, np.int64)
        changed, present = np.empty(0, np.int64), np.empty(0, bool)
        while True:
            alone, torn = self.violated(now)
            new = alone[~among(alone, active)]
            again = np.unique(np.concatenate([new // self.n, self.genome[torn // self.n]]))
            if not len(again):
                return changed, present
            active = np.union1d(active, new)
            extra = np.union1d(extra, torn)
            asked = active[among(active // self.n, again)]
            more = extra[among(self.genome[extra // self.n], again)]
            part = self.candidates(asked, np.unique(self.genome[more // self.n]))
            rows = np.unique(part // self.n)
            pairs = np.union1d(self.up.decided(part, self.have[among(self.have // self.n, rows)]), more)
            pairs = pairs[np.lexsort((pairs // self.n, pairs % self.n))]
            order = np.argsort(pairs)
            low, parents = self.links(pairs)
            inside = among(parents, pairs[order])
            a, b = low[inside], order[np.searchsorted(pairs, parents[inside], sorter=order)]
            kind, term = np.unique(self.of(pairs), return_inverse=True)
            has = among(pairs, self.have)
            found = settle(term, has, self.price(pairs), among(kind, asked)[term], a, b)
            flip = found.present != has
            keep = ~among(self.genome[changed // self.n], again)
            changed, present = np.concatenate([changed[keep], pairs[flip]]), np.concatenate([present[keep], found.present[flip]])
            now = np.union1d(np.setdiff1d(self.have, changed[~present]), changed[present])


def numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Places in the sorted names, and the names."""
    coded = pc.dictionary_encode(column.combine_chunks())
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(order)


def solve_genomes(rows: DataFrame, tau: float, edges: DataFrame, complexes: DataFrame, tasks: int) -> DataFrame:
    """Pairs that change (genome, protein, term, annotated, scaled, present, status) in the full model of each genome.

    ``rows`` (genome, protein, term, score) may tell a pair repeatedly; each term has the greatest score of itself and
    what is below it. A genome is in one of ``tasks``, and only the hierarchy comes to the driver.
    """
    known, named = edges.select("child", "parent").distinct().toPandas(), complexes.select("term").distinct().toPandas()["term"]
    names = pd.Index(known["child"]).union(known["parent"]).union(named).unique()
    child, parent, listed = names.get_indexer(known["child"]), names.get_indexer(known["parent"]), names.get_indexer(named)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Upward(len(names), child, parent)
        for table in whole(batches, "genome", ROWS):
            code, found = numbers(table["term"])
            place = names.get_indexer(found.to_pylist())
            strange = place < 0
            up = plain if not strange.any() else Upward(len(names) + int(strange.sum()), child, parent)
            place[strange] = len(names) + np.arange(strange.sum())
            mark = np.zeros(up.n, bool)
            mark[listed] = True
            term, genome = place[code].astype(np.int64), np.cumsum(changes(table["genome"])) - 1
            protein, proteins = numbers(table["protein"])
            row, at = np.unique(genome * len(proteins) + protein, return_inverse=True)
            first, to = up.above
            many = first[term + 1] - first[term]
            over = to[np.repeat(first[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            key = np.concatenate([at * up.n + term, np.repeat(at * up.n, many) + over])
            score = table["score"].to_numpy()
            score = np.concatenate([score, np.repeat(score, many)])
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            model = Genomes(key[order[starts]], np.maximum.reduceat(score[order], starts), row // len(proteins), up, mark, tau)
            pairs, present = model.solve()
            if len(pairs):
                every = pa.array([*names, *found.filter(pa.array(strange)).to_pylist()], pa.string())
                of = np.flatnonzero(changes(table["genome"]))[model.genome[pairs // up.n]]
                out = {"genome": table["genome"].take(pa.array(of)), "protein": proteins.take(pa.array(row[pairs // up.n] % len(proteins))), "term": every.take(pa.array(pairs % up.n)), "annotated": ~present, "scaled": model.price(pairs), "present": present}
                yield from pa.table(out | {"status": pa.array(["OPTIMAL"] * len(pairs), pa.string())}).to_batches()

    return rows.select("genome", "protein", "term", "score").repartition(tasks, "genome").sortWithinPartitions("genome").mapInArrow(solve, CHANGED)

"""Document quality by random Fourier features, ridge regression and isotonic calibration.

Each text becomes a few statistics (lengths, character classes, repetition).
Random Fourier features of the standardised statistics approximate a Gaussian
kernel; every partition sums its part of the normal equations, the driver adds
one bounded matrix per partition and solves the ridge system. Raw scores are
counted into bins of fixed width and the pool-adjacent-violators rule turns the
bins into a monotone calibration.

Only rows outside the held-out fold (crc32 of the id's text modulo 5 is not 0)
with a non-null ``quality`` teach; at most ``MAX_TRAIN`` of them, drawn by a hash
of the id. Labels, lang, source and doc_id are never inputs of a score.

Defined results: null text counts as empty, and the empty text has a score like
any other. Without labelled rows, or with one class only, every score is the
share of label 1 (0.5 without rows). Repeated rows get equal scores, repeated
labels each count. Other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fold_of, materialize, small_batches, spans, table, utf8

FEATURES = 256
RIDGE = 3.0
#: Bound of the labelled sample, and how many tasks sum the normal equations.
MAX_TRAIN = 200_000
SUM_TASKS = 12
BIN = 1 / 512
THRESHOLD = 0.3

#: Byte classes whose shares are statistics.
CLASSES = ("upper", "lower", "digit", "space", "newline", "stop", "bang", "pipe", "symbol", "other", "high")


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES.index("other"), np.uint8)
    t[65:91], t[97:123], t[48:58] = 0, 1, 2
    for c in b" \t\v\f\r":
        t[c] = 3
    t[10] = 4
    for names, k in ((b".,;:", 5), (b"!?", 6), (b"|", 7), (b"#$%&*@^~<>{}[]\\=+_/", 8)):
        for c in names:
            t[c] = k
    t[128:] = 10
    return t


CLASS = _class_table()
STATISTICS = len(CLASSES) + 10


def statistics(raw: bytes, counts: np.ndarray) -> list[float]:
    n = len(raw)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    distinct = set(words)
    w, k = len(words), max(1, len(lines))
    caps = sum(x[:1].isupper() for x in distinct)
    return [
        *(counts / max(1, n)),
        np.log1p(n),
        np.log1p(w),
        (n / w if w else 0.0) ** 0.5,
        len(distinct) / max(1, w),
        len(distinct) / max(1.0, w**0.8),
        len(set(lines)) / k,
        np.log1p(n / k),
        caps / max(1, len(distinct)),
        len(zlib.compress(raw, 1)) / max(8, n),
        max((len(x) for x in distinct), default=0) ** 0.5,
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for arr in batches:
        data, off = utf8(arr)
        out = np.zeros((len(arr), STATISTICS))
        for i, j in spans(off):
            cls = CLASS[data[off[i] : off[j]]]
            for k in range(i, j):
                a, b = off[k] - off[i], off[k + 1] - off[i]
                out[k] = statistics(data[off[k] : off[k + 1]].tobytes(), np.bincount(cls[a:b], minlength=len(CLASSES)))
        yield pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), STATISTICS).cast(pa.list_(pa.float64()))


class Kernel:
    """Standardise, then cosines of random projections, the statistics themselves and a constant."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int = FEATURES, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        d = len(mean)
        self.w, self.b = rng.normal(0, 1, (d, features)) / (1.2 * d**0.5), rng.uniform(0, 2 * np.pi, features)
        self.beta = np.zeros(features + d + 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.concatenate([np.cos(z @ self.w + self.b) * (2 / len(self.b)) ** 0.5, z / len(self.mean) ** 0.5, np.ones((len(z), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self(x) @ self.beta, -1, 2)


def pool(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nearest non-decreasing sequence."""
    out: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        out.append([v, w, 1])
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            (v1, w1, n1), (v0, w0, n0) = out.pop(), out.pop()
            out.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return np.repeat([x[0] for x in out], [x[2] for x in out])


class Model:
    def __init__(self, kernel: Kernel | None, at: np.ndarray, level: np.ndarray):
        self.kernel, self.at, self.level = kernel, at, level

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(x), self.level[0])
        raw = self.kernel.raw(x)
        # a small strictly rising part keeps the order of texts that share a calibrated level
        return np.clip(0.98 * np.interp(raw, self.at, self.level) + 0.02 * (raw + 1) / 3, 0, 1)


def fit(described: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """``described`` has doc_id and s (statistics); ``labels`` has doc_id and quality."""
    y = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where(F.col("y").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    known = y.count()
    if known > most:
        y = y.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_003)) < int(most / known * 1_000_003))
    rows = materialize(described.join(y, "doc_id").select("s", "y").repartition(SUM_TASKS), "quality-train")
    moments = rows.select("y", *[F.col("s")[k].alias(f"s{k}") for k in range(STATISTICS)])
    m = moments.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[f(f"s{k}").alias(f"{a}{k}") for k in range(STATISTICS) for a, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    if not m["n"] or m["y"] in (0.0, 1.0):
        return Model(None, np.zeros(1), np.array([0.5 if not m["n"] else m["y"]]))
    kernel = Kernel(np.array([m[f"m{k}"] for k in range(STATISTICS)]), np.array([m[f"d{k}"] for k in range(STATISTICS)]))
    width = len(kernel.beta) + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            if len(b):
                z = np.column_stack([kernel(np.stack(b["s"].to_numpy())), b["y"].to_numpy()])
                total += z.T @ z
        yield pd.DataFrame({"part": [total.tobytes()]})

    total = np.zeros((width, width))
    for r in rows.mapInPandas(sums, "part binary").toLocalIterator():
        total += np.frombuffer(r["part"]).reshape(width, width)
    a, b = total[:-1, :-1], total[:-1, -1]
    penalty = np.full(len(a), RIDGE)
    penalty[-1] = 1e-6
    kernel.beta = np.linalg.solve(a + np.diag(penalty), b)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"bin": np.round(kernel.raw(np.stack(b["s"].to_numpy())) / BIN).astype(int), "y": b["y"].to_numpy()})

    bins = rows.mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).toPandas().sort_values("bin")
    level = pool((bins["y"] / bins["n"]).to_numpy(), bins["n"].to_numpy(float))
    return Model(kernel, bins["bin"].to_numpy() * BIN, level)


def score(described: DataFrame, model: Model) -> DataFrame:
    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array(model.score(arr.flatten().to_numpy(zero_copy_only=False).reshape(len(arr), STATISTICS)) if len(arr) else np.zeros(0))

    return described.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), scored("s").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    described = materialize(documents(spark, sf_dir).select("doc_id", describe("text").alias("s")), "quality-statistics")
    return score(described, fit(described, table(spark, sf_dir, "labels")))

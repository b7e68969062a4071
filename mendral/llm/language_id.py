"""Language identification with a byte convolutional network trained in numpy.

Filters of several widths slide over byte embeddings of fixed-length windows,
max pooling keeps each filter's strongest response and a softmax layer turns
those into language probabilities. Prediction covers every window of a text
and averages; it is local to a row, so nothing is shuffled.

Defined results: a null text, or one without any letter, is ``und`` with score
0. An empty training set predicts ``und`` everywhere. Of languages with equal
probability the first by name wins. Null ids fall in the fold of the empty
string. Repeated rows get equal predictions. Texts of any length are read in
whole, some at a time. An empty table gives an empty result. Other columns of the
input, whatever their names, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold_of, materialize, small_batches, spans, take_over, unused, utf8

WINDOW = 256
WIDTHS = (4, 3, 2)
FILTERS = 16
EMBED = 8
#: Bounds of the training sample: documents of a language, of all languages together (no
#: language less than LEAST_DOCS of its own), windows of a document. Languages are not bounded.
DOCS_PER_LANGUAGE = 700
TRAIN_DOCS = 12_000
LEAST_DOCS = 8
WINDOWS_PER_DOC = 4

#: A letter by its Unicode category (L); numbers like ½ or Ⅷ are none.
LETTER = regex.compile(r"\p{L}")
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts (zero padded) and how many each text has."""
    lens = np.diff(offsets)
    count = -(-lens // WINDOW)
    out = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    start = np.concatenate([[0], np.cumsum(count)[:-1]]) * WINDOW
    at = np.arange(int(offsets[-1] - offsets[0])) + np.repeat(start - (offsets[:-1] - offsets[0]), lens)
    out[at] = FOLD[data[offsets[0] : offsets[-1]]]
    return out.reshape(-1, WINDOW), count


class ByteConvNet:
    """widths x FILTERS max-pooled responses, then a softmax layer."""

    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"E": rng.normal(0, 0.5, (256, EMBED))}
        self.p |= {f"W{w}": rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)) for w in WIDTHS}
        self.p |= {f"b{w}": np.zeros(FILTERS) for w in WIDTHS}
        h = FILTERS * len(WIDTHS)
        self.p |= {"V": rng.normal(0, h**-0.5, (h, len(languages))), "c": np.zeros(len(languages))}
        self.tables: list[np.ndarray] | None = None

    def _tables(self) -> list[np.ndarray]:
        """For each shift, the response each byte adds to the filters that reach so far."""
        return [
            np.concatenate([self.p["E"] @ self.p[f"W{w}"][j] for w in WIDTHS if w > j], axis=1).astype(np.float32)
            for j in range(max(WIDTHS))
        ]

    def responses(self, win: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        tables = self.tables or self._tables()
        n = len(win)
        acc = tables[0][win]
        for j, t in enumerate(tables[1:], 1):
            acc[:, :-j, : t.shape[1]] += t[win[:, j:]]
        pooled, at = [], []
        for i, w in enumerate(WIDTHS):
            part = acc[:, : WINDOW - w + 1, i * FILTERS : (i + 1) * FILTERS]
            if where:
                k = part.argmax(axis=1)
                at.append(k)
                pooled.append(np.take_along_axis(part, k[:, None, :], 1)[:, 0] + self.p[f"b{w}"])
            else:
                pooled.append(part.max(axis=1) + self.p[f"b{w}"].astype(np.float32))
        return np.maximum(np.concatenate(pooled, axis=1), 0).reshape(n, -1), (np.stack(at) if where else None)

    def probabilities(self, win: np.ndarray, step: int = 16) -> np.ndarray:
        self.tables = self.tables or self._tables()
        out = np.empty((len(win), len(self.languages)))
        for i in range(0, len(win), step):
            h, _ = self.responses(win[i : i + step])
            out[i : i + step] = softmax(h @ self.p["V"] + self.p["c"])
        return out

    def fit(self, win: np.ndarray, label: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 4e-3, seed: int = 5) -> None:
        """Adam on the cross entropy; only the pooled positions carry a gradient."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = 1.0 / np.maximum(np.bincount(label, minlength=len(self.languages)), 1)
        weight = weight / weight[label].mean()
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(win))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                x, y = win[pick], label[pick]
                h, at = self.responses(x, where=True)
                q = softmax(h @ self.p["V"] + self.p["c"])
                q[np.arange(len(y)), y] -= 1
                q *= (weight[y] / len(y))[:, None]
                g = {"V": h.T @ q, "c": q.sum(0)}
                dh = (q @ self.p["V"].T) * (h > 0)
                ge = np.zeros_like(self.p["E"])
                for k, w in enumerate(WIDTHS):
                    d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    pos = at[k][:, :, None] + np.arange(w)
                    patch = x[np.arange(len(y))[:, None, None], pos]
                    g[f"W{w}"] = np.einsum("nf,nfwe->wef", d, self.p["E"][patch])
                    g[f"b{w}"] = d.sum(0)
                    np.add.at(ge, patch, np.einsum("nf,wef->nfwe", d, self.p[f"W{w}"]))
                g["E"] = ge
                t += 1
                step = rate * (1 - epoch / epochs * 0.8)
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.p[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        self.tables = self._tables()


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, windows: int = WINDOWS_PER_DOC) -> ByteConvNet | None:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    The sample is the documents whose id and text hash below a threshold that leaves
    about ``docs_per_language`` of them, and evenly spaced windows of each.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return None
    most = min(docs_per_language, max(LEAST_DOCS, TRAIN_DOCS // languages))
    rows = rows.join(counts, "lang")  # a row for each language: the optimizer sends it along if it is small
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)

    def windows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_over("language_id")
        for b in batches:
            out = []
            for doc_id, text, lang in zip(b["doc_id"], b["text"], b["lang"], strict=True):
                raw = text.encode()
                if not LETTER.search(text):
                    continue
                for k, at in enumerate(sorted({int(x) for x in np.linspace(0, max(0, len(raw) - WINDOW), windows)})):
                    out.append((doc_id, k, raw[at : at + WINDOW], lang))
            yield pd.DataFrame(out, columns=["doc_id", "k", "win", "lang"])

    got = rows.where(draw < F.lit(most) / F.col("n")).select("doc_id", "text", "lang").distinct().mapInPandas(windows_of, "doc_id long, k int, win binary, lang string").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["doc_id", "k", "lang", "win"], kind="stable")
    languages = sorted(got["lang"].unique())
    win = np.zeros((len(got), WINDOW), np.uint8)
    for i, raw in enumerate(got["win"]):
        win[i, : len(raw)] = FOLD[np.frombuffer(raw, np.uint8)]
    net = ByteConvNet(languages)
    net.fit(win, np.searchsorted(languages, got["lang"].to_numpy()))
    return net


def predict(net: ByteConvNet | None):
    """Arrow function text -> struct(lang_pred, score)."""

    @F.arrow_udf("lang_pred string, score double")
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        take_over("language_id")
        for arr in batches:
            lang, score = ["und"] * len(arr), np.zeros(len(arr))
            if net is not None:
                data, off = utf8(arr)
                raw = data.tobytes() if len(data) < 1 << 16 else None
                for i, j in spans(off):
                    win, count = cut(data, off[i : j + 1])
                    p = net.probabilities(win)
                    ends = np.cumsum(count)
                    for k in np.flatnonzero(count):
                        a, b = off[i + k], off[i + k + 1]
                        text = (raw[a:b] if raw is not None else data[a:b].tobytes()).decode()
                        if LETTER.search(text):
                            mean = p[ends[k] - count[k] : ends[k]].mean(axis=0)
                            lang[i + k], score[i + k] = net.languages[int(mean.argmax())], float(mean.max())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], ["lang_pred", "score"])

    return classify


def identify(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), predict(net)("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return identify(docs, train(docs))


#: A text stays in a corpus when its language is known at least this surely.
LEAST_SCORE = 0.3


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is known; ``und`` and very doubtful ones go.

    Where no row teaches a language, none can be doubted: all texts with a letter stay.
    """
    small_batches(docs.sparkSession)
    (name,) = unused(docs, "identified")
    net = train(docs)
    if net is None:
        return docs.where(F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    return docs.withColumn(name, predict(net)("text")).where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= LEAST_SCORE)).drop(name)

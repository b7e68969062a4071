"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the least hash of its s-mers is that of
its first or its last s-mer. Whether a k-mer is chosen depends on its own
characters alone, so equal passages give equal anchors wherever they stand, and
their positions can be matched. Texts stand between borders of K - 1 code points
that are no characters, so texts of any length, one character up, have anchors by
this one rule. A fingerprint keeps the anchors of least hash of the whole text (the
first position of each): ``SKETCH`` of them, or one in ``SHARE`` if these are more.
Likeness is the Jaccard similarity of two anchor sets as estimated on the hashes
that both sketches cover; a shared anchor counts if another one has moved by as
many code points, or if it has moved as most have, so that chance matches of
scattered anchors do not count.

Fingerprint string: hashes in ascending order as 8 hex digits each, a dot, their
positions (from the beginning of the border) as 8 hex digits each. The empty text
has the fingerprint ``.``.

Defined results: a null text counts as empty. Two empty fingerprints have
likeness 1, an empty and another one 0. Rows are ordered by doc_id (nulls first),
then by a hash of the text; repeated rows follow each other. Rows of one id go to one
task, which reads them in runs of bounded size. The only row of a table is its own
next document. A very long text is a run of its own. An empty table gives an empty
result. Other columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix64, small_batches

S = 5
WINDOW = 8
K = S + WINDOW - 1
#: Anchors of a sketch at least (or all of them), and the share of a long text's anchors it holds.
SKETCH = 64
SHARE = 8
#: What stands before and after each text: no code point has this number.
BORDER = np.full(K - 1, 0x110000, np.uint32)
#: Odd 64-bit multiplier of the rolling hash.
BASE = np.uint64(0x9E3779B97F4A7C15)
EMPTY = "."

Sketch = tuple[np.ndarray, np.ndarray]


def anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of each closed syncmer of a sequence of code points."""
    if len(codes) < K:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c = codes.astype(np.uint64) + np.uint64(1)
    n = len(c) - S + 1
    h = np.zeros(n, np.uint64)
    for j in range(S):
        h = h * BASE + c[j : j + n]
    h = mix64(h)
    low, step = h, 1
    while step < WINDOW:  # running minimum by doubling
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    m = len(low)
    at = np.flatnonzero((h[:m] == low) | (h[WINDOW - 1 : WINDOW - 1 + m] == low))
    whole = mix64(h[at] * BASE + mix64(h[at + S - 1] ^ BASE) * BASE + h[at + WINDOW - 1])
    return at, whole >> np.uint64(32)


def sketches(texts: list[np.ndarray], most: int = SKETCH) -> list[Sketch]:
    """The distinct anchor hashes of each text in ascending order with their first positions: the least ``most`` or one in ``SHARE``."""
    if not texts:
        return []
    sizes = np.array([len(t) + 2 * len(BORDER) for t in texts])
    start = np.concatenate([[0], np.cumsum(sizes)])
    at, hashed = anchors(np.concatenate([x for t in texts for x in (BORDER, t, BORDER)]))
    doc = np.searchsorted(start, at, side="right") - 1
    inside = at + K <= start[doc + 1]  # no k-mer crosses texts
    at, hashed, doc = at[inside] - start[doc[inside]], hashed[inside], doc[inside]
    order = np.lexsort((at, hashed, doc))
    at, hashed, doc = at[order], hashed[order], doc[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
    at, hashed, doc = at[first], hashed[first], doc[first]
    edge = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for i, t in enumerate(texts):
        a, n = edge[i], edge[i + 1] - edge[i]
        b = a + min(n, max(most, -(-n // SHARE))) if len(t) else a
        out.append((hashed[a:b], at[a:b]))
    return out


def to_string(s: Sketch) -> str:
    return f"{s[0].astype('>u4').tobytes().hex()}.{s[1].astype('>u4').tobytes().hex()}"


def from_string(s: str) -> Sketch:
    h, p = (np.frombuffer(bytes.fromhex(x), ">u4") for x in s.split("."))
    return h.astype(np.uint64), p.astype(np.int64)


def likeness(a: Sketch, b: Sketch, most: int = SKETCH) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    # a sketch that is not full holds all anchors; a full one those up to its last hash
    covered = min((x[0][-1] for x in (a, b) if len(x[0]) >= most), default=None)
    ends = [len(x[0]) if covered is None else int(np.searchsorted(x[0], covered, side="right")) for x in (a, b)]
    shared, i, j = np.intersect1d(a[0][: ends[0]], b[0][: ends[1]], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    _, which, times = np.unique(b[1][j] - a[1][i], return_inverse=True, return_counts=True)
    matched = int(np.count_nonzero((times[which] > 1) | (which == times.argmax())))
    return matched / (ends[0] + ends[1] - len(shared))


def shift(a: Sketch, b: Sketch) -> int | None:
    """By how many code points the anchors that two texts share have moved, at their median."""
    _, i, j = np.intersect1d(a[0], b[0], return_indices=True)
    return int(np.median(b[1][j] - a[1][i])) if len(i) else None


def codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def edited(own: np.ndarray, following: np.ndarray) -> np.ndarray:
    q = len(own) // 4
    return np.concatenate([own[: len(own) - q], following[:q]])


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(own: list[tuple[int | None, np.ndarray]], following: list[np.ndarray]) -> pa.RecordBatch:
    """Fingerprints of a run of texts; ``following`` holds the next text of each."""
    texts = [t for _, t in own]
    mixed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    every = sketches([*texts, following[-1], *mixed])
    mine, last = every[: len(texts)], every[len(texts)]
    after = [mine[i + 1] if i + 1 < len(texts) else last for i in range(len(texts))]
    changed = every[len(texts) + 1 :]
    shas = [hashlib.sha256(m.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")).hexdigest() for m in mixed]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([d for d, _ in own], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array(shas, pa.string()),
            "fingerprint": pa.array([to_string(x) for x in mine], pa.string()),
            "edited_fingerprint": pa.array([to_string(x) for x in changed], pa.string()),
            "near_edited": pa.array([likeness(x, y) for x, y in zip(mine, changed, strict=True)], pa.float64()),
            "near_next": pa.array([likeness(x, y) for x, y in zip(mine, after, strict=True)], pa.float64()),
        }
    )


#: Code points that are fingerprinted together.
RUN = 1 << 20
#: Sampled ids for each range of ids.
DRAWS = 40


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint sorted rows; the row after the last one comes flagged as ``beyond``."""
    held: list[tuple[int | None, np.ndarray]] = []
    size, after = 0, None
    for b in batches:
        for doc_id, text, beyond in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("beyond").to_pylist(), strict=True):
            row = (doc_id, codes(text))
            if beyond:
                after = row[1] if after is None else after
                continue
            held.append(row)
            size += len(row[1])
            if size > RUN and len(held) > 1:
                yield _rows(held[:-1], [t for _, t in held[1:]])
                held, size = held[-1:], len(held[-1][1])
    if held:
        yield _rows(held, [*(t for _, t in held[1:]), after])


def bounds(docs: DataFrame, parts: int) -> list[int]:
    """First ids of ``parts`` ranges or fewer: the least id and ids that occur, drawn by their hash."""
    ids = docs.select(order_key().alias("o"))
    total = ids.agg(F.count("*").alias("n"), F.min("o").alias("least")).first()
    if not total["n"]:
        return []
    share = min(1.0, parts * DRAWS / total["n"])
    drawn = sorted(r["o"] for r in ids.where(F.pmod(F.xxhash64("o"), F.lit(1_000_003)) <= int(share * 1_000_003)).distinct().collect())
    step = max(1, -(-len(drawn) // parts))
    return sorted({total["least"], *drawn[step // 2 :: step]})


def order_key():
    """Ids in order as longs; nulls first."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def range_of(first: list[int]):
    """Number of the range an id falls into, looked up in two short arrays."""
    width = max(1, int(len(first) ** 0.5))
    coarse = F.array(*[F.lit(x) for x in first[::width]])
    fine = F.array(*[F.array(*[F.lit(x) for x in first[i : i + width]]) for i in range(0, len(first), width)])
    o = order_key()
    c = F.size(F.filter(coarse, lambda x: x <= o)) - 1
    return c * width + F.size(F.filter(F.get(fine, c), lambda x: x <= o)) - 1


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and the next.

    Rows are dealt into ranges of ids, each sorted in a task of its own. The first
    ids of the ranges are known beforehand, so those rows are also sent, flagged,
    to the range before, and every task has the text that follows its last.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    rows = docs.select("doc_id", "text")
    first = bounds(rows, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not first:
        return rows.mapInArrow(_along, FIELDS)
    n = len(first)
    heads = F.array(*[F.lit(x) for x in first])
    part = F.col("part")
    targets = F.when(F.get(heads, part) == order_key(), F.array(F.struct(part.alias("to"), F.lit(False).alias("beyond")), F.struct(F.pmod(part - 1, F.lit(n)).alias("to"), F.lit(True).alias("beyond")))).otherwise(
        F.array(F.struct(part.alias("to"), F.lit(False).alias("beyond")))
    )
    dealt = (
        rows.withColumn("part", range_of(first))
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.explode(targets).alias("t"))
        .select("doc_id", "text", "t.to", "t.beyond")
        .repartitionById(n, F.col("to").cast("int"))
    )
    return dealt.sortWithinPartitions("beyond", "doc_id", F.xxhash64("text")).select("doc_id", "text", "beyond").mapInArrow(_along, FIELDS)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))

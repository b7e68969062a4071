"""Importance resampling towards a target distribution, by hashed n-gram counts.

A batch's texts are joined with a separator that no word holds; one pass of a
pattern finds all words of the batch, a binary search in the documents' offsets
tells whose they are, and n-grams that reach over a border are masked. Checksums
of words are computed for all words of the batch at once, byte by byte of the
words, and go on over the next word for longer n-grams. Each task adds up the
buckets of all its texts before anything is shuffled. The gain of a bucket is the
logarithm of its share among the target's n-grams over its share among the
corpus's, each smoothed by one; a document's weight is the mean gain of its
n-grams. Adding Gumbel noise, drawn from a hash of the id, to the weights and
keeping the highest draws without replacement in proportion to the weights' exponentials.
The places of all documents come from one range sort (``ranking.places``).

Defined results: null and empty texts have no words, weight 0 and no rank, as have
texts of fewer than ``LEAST_WORDS`` words. A null id counts as the empty text in
the noise and ranks first among equal scores. Rows that repeat an id are drawn
each by its own weight; equal rows rank in any order. Texts of any length count
in whole. An empty table gives an empty result; an empty target smooths to equal
shares. Other columns are never read, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, own, small_batches, spans, table, unused
from .ranking import places

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7

#: Lower-cased bytes: digits, letters and all that is not ASCII are in words.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Between texts; in no word.
SEPARATOR = b"\x00"
#: Words of more bytes are checksummed one by one.
LONG_WORD = 64


def _crc_table() -> np.ndarray:
    """The remainders of single bytes for the polynomial of CRC-32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


TABLE = _crc_table()
START = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return TABLE[(state ^ byte) & 255] ^ (state >> 8)


def checksum(data: bytes, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The running CRC-32 of each word ``data[start:end]`` after what its ``state`` has read."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    at, state = start[order], state[order]
    raw = np.frombuffer(data, np.uint8)
    falling = -length[order]
    long = int(np.searchsorted(falling, -LONG_WORD, side="left"))  # these are longer
    for j in range(long):
        a = at[j]
        state[j] = ~np.uint32(zlib.crc32(data[a : a - falling[j]], int(~state[j])))
    at, state_, falling = at[long:], state[long:], falling[long:]
    for k in range(int(-falling[0]) if len(falling) else 0):
        n = int(np.searchsorted(falling, -k, side="left"))  # words of more than k bytes
        state_[:n] = _step(state_[:n], raw[at[:n] + k])
    out = np.empty_like(state)
    out[order] = state
    return out


def features(texts: list[bytes | None], buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text number) of every n-gram of the texts, and the number of words of each text."""
    lower = [(t or b"").translate(LOWER) for t in texts]
    joined = SEPARATOR.join(lower)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower])])
    found = np.fromiter((x for m in WORD.finditer(joined) for x in m.span()), np.int64).reshape(-1, 2)
    start, end = found[:, 0], found[:, 1]
    doc = np.searchsorted(begin, start, side="right") - 1
    state = checksum(joined, start, end, np.full(len(start), START, np.uint32))
    kept, owners = [~state % np.uint32(buckets)], [doc]
    for n in range(2, longest + 1):
        # a run that ends at a word is the shorter one before it, a space and the word
        inside = doc[n - 1 :] == doc[: len(doc) - n + 1] if len(doc) >= n else np.zeros(0, bool)
        before = _step(state[: len(state) - 1], 32)
        state = checksum(joined, start[n - 1 :], end[n - 1 :], before) if len(doc) >= n else state[:0]
        kept.append((~state % np.uint32(buckets))[inside])
        owners.append(doc[n - 1 :][inside])
    return np.concatenate(kept), np.concatenate(owners), np.bincount(doc, minlength=len(texts))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts) of about a megabyte each."""
    texts = batch.column("text").cast(pa.large_binary()).to_pylist()
    for i, j in spans(np.concatenate([[0], np.cumsum([len(t or b"") for t in texts])])):
        yield i, texts[i:j]


def _counter(buckets: int, longest: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, texts in _parts(b):
                total += np.bincount(features(texts, buckets, longest)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How often each bucket is hit by the n-grams of all texts: as many numbers as there are buckets."""
    small_batches(texts.sparkSession)
    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(_counter(buckets, longest), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed share in the target over that in the corpus."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + n) / ((x + 1) * (t + n)))) for x, y in zip(map(int, corpus), map(int, target), strict=True)], np.int64)


WEIGHED = "doc_id long, n_words long, n_features long, weight long"


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for i, texts in _parts(b):
                bucket, doc, words = features(texts, len(gain), longest)
                at = slice(i, i + len(texts))
                n_words[at] = words
                n[at] = np.bincount(doc, minlength=len(texts))
                total[at] = np.bincount(doc, weights=gain[bucket], minlength=len(texts)).astype(np.int64)
            weight = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (n_words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, WEIGHED)


def noise(seed: int) -> F.Column:
    """Thousandths of a Gumbel number from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row."""
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = weigh(docs, gain, longest).select("doc_id", "n_features", "weight", (F.col("weight") + noise(seed)).alias("score"), (F.col("n_words") < least_words).alias("few"))
    placed = places(scored, ["few"], [F.desc("score"), F.col("doc_id")], "i", "n", "resampled")
    drawn = ~F.col("few") & (F.col("i") < F.expr(f"{percent} * n div 100"))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("i") + 1).alias("rank"))


def keep_drawn(docs: DataFrame, target: DataFrame, **settings: int) -> DataFrame:
    """The documents that are drawn, with their own columns; rows that share an id with a drawn one stay with it."""
    (key,) = unused(docs, "drawn_id")
    chosen = resample(docs, target, **settings).where("rank IS NOT NULL").select(F.col("doc_id").alias(key)).distinct()
    return docs.select(*own(docs)).join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left_semi")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH bytes AS (SELECT list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
low AS (SELECT 'd' AS of, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
  UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT of, id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
f AS (SELECT of, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
once AS (SELECT f, count(*) FILTER (of = 'd') AS s, count(*) FILTER (of = 'b') AS t, hex(f) AS hx FROM f GROUP BY f),
hashed AS (SELECT f, s, t, xor(list_reduce(list_transform(range(len(hx) // 2), lambda k: ('0x' || substr(hx, 2 * k + 1, 2))::BIGINT), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM once, bytes),
totals AS (SELECT sum(s)::BIGINT AS big_s, sum(t)::BIGINT AS big_t FROM hashed),
gain AS (SELECT bucket, floor(1000 * ln((sum(t)::DOUBLE + 1) * (any_value(big_s) + 10000) / ((sum(s)::DOUBLE + 1) * (any_value(big_t) + 10000))))::BIGINT AS gain FROM hashed, totals GROUP BY bucket),
one AS (SELECT f, gain FROM hashed JOIN gain USING (bucket)),
m AS (SELECT id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN one USING (f) WHERE of = 'd' GROUP BY id),
scored AS (SELECT w.id AS doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(w.w) >= 20 AS enough,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN m ON w.id = m.id WHERE of = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS r, count(*) FILTER (enough) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND r <= 25 * n // 100 THEN r END AS rank FROM placed
"""

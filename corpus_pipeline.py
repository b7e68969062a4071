"""A corpus pipeline in five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last one returns their tokens. Every stage
calls one operator of ``mendral.llm``:

1. language_id: texts of no known language go (``und`` or a score under 0.3).
2. exact_dedup: of texts equal up to white space the one of least id stays.
3. jaccard_join: of each component of near copies (Jaccard similarity 0.8 of
   shingles of 5 words) the one of least id stays.
4. source_mixing: sources are read as often as the mixture wants, each document
   once at least and at most twice; a document read twice is two rows.
5. sentencepiece: the ids of every row's text.

Defined results, each stage on its own input: a null or empty text has no language and
goes in stage 1. Ids are passed on, null or repeated: an id that stands for several
texts keeps each of them, rows that repeat id and text are one row after stage 2.
Of equal or near texts the least id stays, and of rows without an id one. Texts of
any length are read in whole. An empty table passes all stages as an empty table.
``lang`` is read to learn from, in stage 1 only; other columns are passed on and never
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendral.llm import exact_dedup, jaccard_join, language_id, mixing, sentencepiece_lattice
from mendral.llm.common import discard, documents, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, with their own columns. Null and empty texts go, as do texts without a letter."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal up to white space, with its own columns: that of the least id. Null and empty texts are equal."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (5 words, similarity 0.8), with its own columns: that of the least id. Texts without words are in no component and stay, as do rows without an id."""
    return jaccard_join.keep_one(docs, jaccard_join.NEAR_COPIES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once at least and at most twice, as its source is to be repeated. A null source is a source of its own; rows without tokens stay once."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ``ids`` and ``n_tokens`` of every row's text; null and empty texts have none."""
    return sentencepiece_lattice.encode_documents(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: A trained network and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written before the next reads them."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            after = materialize(after, f"pipeline-{name}")
            discard(docs)
        docs = after
    return docs

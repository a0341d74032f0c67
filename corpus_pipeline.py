"""From raw documents to token ids: language, exact and near-duplicates, mixture, encoding.

Each stage works on all that the one before kept; its result is written as Parquet to the shared
folder and read again. A stage that fails can so be run again by itself.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelane.llm import common, exact, langid, mixing, pieces, simhash

#: Tokens of the SentencePiece model; no SQL expresses them, nor fingerprints or learned languages.
ORACLE_SQL = None

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WEIGHTS, SHARE, MOST = [3, 1, 2], 1.5, 2.0
#: The SimHash contract: shingles of three words, links within three differing bits.
SHINGLE_WORDS, MOST_BITS = 3, 3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model labels; those it calls ``und`` (null text, no letter) go.

    The model learns from the documents that carry a ``lang``. Without any such document it knows no
    language, and then only texts without a letter go. The document's columns travel under positional
    names, so columns of its own called ``score``, ``spans``, ``lang_pred`` or ``_text`` stay untouched."""
    model = langid.train(docs)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("text").alias("_text")
    )
    known = langid.predict(renamed, model, text="_text")
    kept = known.filter("lang_pred <> 'und'") if model.languages else known.filter(F.col("_text").rlike(r"\p{L}"))
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those with the same text, white space aside."""
    return exact.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the operator of ``op2`` with its contract's shingle
    length and bit distance; no word-similarity check beside the bits."""
    return simhash.simhash_kept(docs, distance=MOST_BITS, width=SHINGLE_WORDS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target weights."""
    return mixing.mixed(docs, WEIGHTS, SHARE, MOST)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document that the mixture takes, and the text they decode to."""
    encoded = pieces.encode(docs.select("doc_id", "source", "text"), MODEL)
    return encoded.select("doc_id", "source", "n_tokens", "ids", "decoded")


STAGES = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixture", mixture),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

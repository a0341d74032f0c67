"""Batch scoring of reviews: prompts in, raw text out, then parsing into categories and sentiment.

A scorer adds two text columns, ``raw_categories`` and ``raw_sentiment``, from a review column. Rows
scored earlier hand it a null, so their text is never analysed again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelane import fixed_values as V
from voicelane.functions import labels as L
from voicelane.functions import prompts as P
from voicelane.functions.matching import groups_in, word_mask

Scorer = Callable[[Column], tuple[Column, Column]]
# A loaded model: prompts in, one reply per prompt out.
Generate = Callable[[list[str]], list[str]]


def lexicon_scorer(review: Column) -> tuple[Column, Column]:
    """The built-in scorer: keyword categories and word-list sentiment, found in one pass."""
    mask = word_mask(
        review, {**V.LEXICON, "_good": V.POSITIVE_WORDS, "_bad": V.NEGATIVE_WORDS}
    )
    good, bad = (
        mask.bitwiseAND(F.lit(1 << (len(V.LEXICON) + i))) != 0 for i in range(2)
    )
    categories = L.labels_or_default(groups_in(mask, list(V.LEXICON)))
    return L.format_labels(categories), L.sentiment_of(good, bad)


def model_scorer(load: Callable[[], Generate], batch: int = V.CHUNK_SIZE) -> Scorer:
    """A scorer around any text model. ``load`` runs once per task, each call of the model gets at
    most ``batch`` prompts; only the prompts travel to Python, other columns stay in the JVM."""

    def replies(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        generate = load()
        for prompts in batches:
            texts = prompts.to_pylist()
            todo = [i for i, t in enumerate(texts) if t is not None]
            out: list[str | None] = [None] * len(texts)
            for start in range(0, len(todo), batch):
                chosen = todo[start : start + batch]
                for i, reply in zip(chosen, generate([texts[i] for i in chosen]), strict=True):
                    out[i] = reply
            yield pa.array(out, pa.string())

    ask = F.arrow_udf(replies, "string")

    def score(review: Column) -> tuple[Column, Column]:
        return ask(P.category_prompt(review)), ask(P.sentiment_prompt(review))

    return score


def score_reviews(reviews: DataFrame, scorer: Scorer = lexicon_scorer) -> DataFrame:
    """Complete sentiment and categories of every review; ``precomputed`` tells which were there.

    One pass over the input: rows scored earlier pass through, the rest goes to the scorer.
    """
    done = L.is_precomputed(F.col("sentiment"), F.col("categories"))
    marked = reviews.withColumn("precomputed", done)
    waiting = F.when(~F.col("precomputed"), F.col("review"))
    raw_categories, raw_sentiment = scorer(waiting)
    kept = [c for c in marked.columns if c not in ("sentiment", "categories")]
    raw = marked.select(
        "*", raw_categories.alias("_raw_categories"), raw_sentiment.alias("_raw_sentiment")
    )
    return raw.select(
        *kept,
        F.when(F.col("precomputed"), F.col("sentiment"))
        .otherwise(L.parse_sentiment(F.col("_raw_sentiment")))
        .alias("sentiment"),
        F.when(F.col("precomputed"), F.col("categories"))
        .otherwise(L.parse_categories(F.col("_raw_categories")))
        .alias("categories"),
    )


def split_precomputed(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored earlier, still to score): every review is in exactly one of the two."""
    done = L.is_precomputed(F.col("sentiment"), F.col("categories"))
    return reviews.filter(done), reviews.filter(~done)


def union_scored(precomputed: DataFrame, scored: DataFrame) -> DataFrame:
    """Both parts again as one bag; the ``precomputed`` column carries which part comes first."""
    return precomputed.withColumn("precomputed", F.lit(True)).unionByName(
        scored.withColumn("precomputed", F.lit(False))
    )


def enrichment(scored: DataFrame, language: Column, keep: Sequence[str] = ()) -> DataFrame:
    """The enrichment of scored reviews, keyed by ``database_id``."""
    categories = F.col("categories")
    return scored.select(
        *keep,
        "database_id",
        language.alias("language"),
        "sentiment",
        L.primary_category(categories).alias("primary_category"),
        "categories",
        *[c.alias(name) for name, c in L.category_flags(categories).items()],
    )


def enrich_reviews(
    reviews: DataFrame,
    language: Callable[[Column], Column],
    scorer: Scorer = lexicon_scorer,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Language, sentiment, categories and flags of every review. No shuffle."""
    return enrichment(score_reviews(reviews, scorer), language(F.col("review")), keep)

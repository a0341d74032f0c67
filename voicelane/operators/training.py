"""Training examples from labelled reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelane import fixed_values as V
from voicelane.functions import labels as L
from voicelane.functions import prompts as P
from voicelane.functions.text import is_blank, strip


class DatasetTooSmall(ValueError):
    """Raised by the size gate."""


def nonempty(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose text is not blank, with the text trimmed."""
    return rows.filter(~is_blank(F.col(text))).withColumn(text, strip(F.col(text)))


def oversampled(rows: DataFrame, factor: int = V.OVERSAMPLE_FACTOR) -> DataFrame:
    """``factor`` copies of rows with a rare category, one of the others; ``copy`` counts from 1."""
    repeat = F.when(L.is_rare(F.col("categories")), factor).otherwise(1)
    return rows.select("*", F.explode(F.sequence(F.lit(1), repeat)).alias("copy"))


def multitask_examples(labelled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Input/output pairs: a category example per review (rare ones repeated) and a sentiment
    example where the sentiment is known. Row by row, in one pass over the reviews: nothing is
    shuffled. ``keys`` are carried along to tell rows apart."""
    body = F.col("_body")
    sentiment = F.col("_sentiment")
    categories = F.col("_categories")
    clean = labelled.filter(~is_blank(F.col("review_body"))).select(
        *keys,
        strip(F.col("review_body")).alias("_body"),
        L.normalise_sentiment(F.col("sentiment")).alias("_sentiment"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("_categories"),
    )
    label = F.when(F.size(categories) > 0, L.format_labels(categories)).otherwise(
        V.DEFAULT_CATEGORY
    )
    copies = F.when(L.is_rare(categories), V.OVERSAMPLE_FACTOR).otherwise(1)
    plan = F.concat(
        F.transform(
            F.sequence(F.lit(1), copies), lambda n: F.struct(F.lit("category").alias("task"), n.alias("copy"))
        ),
        F.when(
            sentiment.isin(*V.SENTIMENTS),
            F.array(F.struct(F.lit("sentiment").alias("task"), F.lit(1).alias("copy"))),
        ).otherwise(F.array().cast("array<struct<task:string,copy:int>>")),
    )
    is_category = F.col("task") == "category"
    return clean.select("*", F.inline(plan)).select(
        *keys,
        "task",
        "copy",
        F.when(is_category, P.category_prompt(body))
        .otherwise(P.sentiment_prompt(body))
        .alias("input"),
        F.when(is_category, label).otherwise(sentiment).alias("output"),
    )


def dataset_counts(examples: DataFrame) -> DataFrame:
    """Rows of a split dataset in all, in train and in test."""
    return examples.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "test").alias("test"),
    )


def require_size(examples: DataFrame, above: int = V.MIN_TRAIN_ROWS) -> int:
    """The number of training rows; an error unless it exceeds ``above``."""
    rows = examples.filter(F.col("split") == "train").count()
    if rows <= above:
        raise DatasetTooSmall(f"{rows} training rows, more than {above} needed")
    return rows


def sample_preview(labelled: DataFrame, order: str, text: str = "review_body") -> DataFrame:
    """The first row, its text cut for display."""
    return (
        labelled.orderBy(order)
        .limit(1)
        .select(
            F.substring(text, 1, V.SAMPLE_PREVIEW_CHARS).alias("review_preview"), "categories"
        )
    )

"""Streaming enrichment and running scope counters.

Both jobs write each micro-batch to a folder named after it, replacing the folder if the batch is
replayed, so delivery is effectively once and nothing that is stored gets rewritten. The current
state is a query over those folders: the newest row of each key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voicelane.operators.aggregate import scope_measures, scope_summary, summarise
from voicelane.operators.merge import latest_per_key
from voicelane.operators.scoring import Scorer, enrich_reviews, lexicon_scorer, score_reviews
from voicelane.schema import ALL_RATINGS, SCOPE


def _into_batch_folders(rows: DataFrame, store: str, checkpoint: str, mode: str) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return (
        rows.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_enrichment(
    reviews: DataFrame,
    store: str,
    checkpoint: str,
    language: Callable[[Column], Column],
    scorer: Scorer = lexicon_scorer,
) -> StreamingQuery:
    """Enrich reviews as they arrive. Stateless; ``ordinal`` orders deliveries inside a batch."""
    enriched = enrich_reviews(reviews, language, scorer, keep=["ordinal"])
    return _into_batch_folders(enriched, store, checkpoint, "append")


def current_enrichment(spark: SparkSession, store: str) -> DataFrame:
    """The newest enrichment of every review: a later delivery replaces an earlier one. Reviews
    without id replace nothing and all stay."""
    return _newest_deliveries(spark, store).drop("ordinal")


def _newest_deliveries(spark: SparkSession, store: str) -> DataFrame:
    rows = spark.read.parquet(store)
    versioned = rows.withColumn("version", F.struct("batch", "ordinal")).drop("batch")
    newest = latest_per_key(versioned, "database_id", "version")
    return newest.unionByName(rows.filter(F.col("database_id").isNull()).select(*newest.columns))


def start_scored(
    reviews: DataFrame,
    store: str,
    checkpoint: str,
    by: Sequence[str] = SCOPE,
    scorer: Scorer = lexicon_scorer,
) -> StreamingQuery:
    """Score reviews as they arrive. Stateless; the store keeps what a summary needs."""
    kept = ["database_id", *by, "ordinal", "precomputed", "sentiment", "categories", *ALL_RATINGS]
    scored = score_reviews(reviews, scorer).select(*kept)
    return _into_batch_folders(scored, store, checkpoint, "append")


def latest_summary(spark: SparkSession, store: str, by: Sequence[str] = SCOPE) -> DataFrame:
    """The full summary of stored scored reviews. A review counts once, with its newest delivery,
    however often it was delivered; running counters (below) count deliveries."""
    return scope_summary(_newest_deliveries(spark, store), by)


def start_counters(
    reviews: DataFrame,
    store: str,
    checkpoint: str,
    by: Sequence[str] = SCOPE,
    scorer: Scorer = lexicon_scorer,
) -> StreamingQuery:
    """Running counters per scope and category. The state is one row per (scope, category), so every
    delivery counts: for sources that deliver each review once."""
    measures = scope_measures(score_reviews(reviews, scorer), by)
    return _into_batch_folders(measures, store, checkpoint, "update")


def current_measures(
    spark: SparkSession, store: str, by: Sequence[str] = SCOPE
) -> DataFrame:
    keys = [*by, "is_review", "category"]
    rows = spark.read.parquet(store)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("_newest")
    return rows.groupBy(*keys).agg(newest).select(
        *keys, *[F.col(f"_newest.{v}").alias(v) for v in values]
    )


def current_summary(spark: SparkSession, store: str, by: Sequence[str] = SCOPE) -> DataFrame:
    """The full summary from the running counters: ranking and wording happen on read."""
    return summarise(current_measures(spark, store, by), by)

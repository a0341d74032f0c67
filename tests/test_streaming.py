"""Streams give what batches give, also after a restart and with repeated deliveries."""

import pytest
from pyspark.sql import functions as F

from voicelane.operators import aggregate as A
from voicelane.operators import scoring as S
from voicelane.plans.reviews import reviews
from voicelane.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def rows(spark):
    cached = reviews(spark, FOLDER).cache()
    yield cached
    cached.unpersist()


def language(text):
    return F.lit("en")


def deliver(rows, path):
    rows.coalesce(1).write.mode("append").parquet(path)


def test_enrichment_with_restart_and_repeated_delivery(spark, tmp_path, rows):
    source, store, check = (str(tmp_path / n) for n in ("in", "store", "checkpoint"))
    deliver(rows.filter("database_id % 2 = 0"), source)

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(source)
        jobs.start_enrichment(stream, store, check, language).awaitTermination()

    run()
    assert jobs.current_enrichment(spark, store).count() == rows.filter("database_id % 2 = 0").count()
    # New rows, a repetition, and a corrected review of a known key.
    deliver(rows.filter("database_id % 2 = 1 or database_id = 0"), source)
    corrected = rows.filter("database_id = 2").withColumn("sentiment", F.lit("positive")).withColumn(
        "categories", F.array(F.lit("Corrected"))
    )
    deliver(corrected.withColumn("ordinal", F.lit(10**9)), source)
    run()
    current = jobs.current_enrichment(spark, store)
    batch = S.enrich_reviews(rows, language)
    names = sorted(batch.columns)
    expected = [r for r in batch.select(*names).collect() if r["database_id"] != 2]
    found = current.select(*names).collect()
    assert sorted(map(str, (r for r in found if r["database_id"] != 2))) == sorted(map(str, expected))
    assert [r["categories"] for r in found if r["database_id"] == 2] == [["Corrected"]]


def test_running_counters_equal_the_batch_summary(spark, tmp_path, rows):
    source, store, check = (str(tmp_path / n) for n in ("in", "store", "checkpoint"))
    for part in range(3):
        deliver(rows.filter(F.col("database_id") % 3 == part), source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        jobs.start_counters(stream, store, check).awaitTermination()
    expected = A.scope_summary(S.score_reviews(rows)).collect()
    found = jobs.current_summary(spark, store).collect()
    assert sorted(map(str, found)) == sorted(map(str, expected))


def test_latest_summary_counts_a_review_once(spark, tmp_path, rows):
    source, store, check = (str(tmp_path / n) for n in ("in", "store", "checkpoint"))

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(source)
        jobs.start_scored(stream, store, check).awaitTermination()

    deliver(rows, source)
    run()
    # A repetition, and a correction; reviews without id each count.
    corrected = rows.filter("database_id = 1").withColumn("provider", F.lit("other"))
    deliver(rows.filter("database_id % 2 = 0").unionByName(corrected), source)
    run()
    deliver(rows.filter("database_id = 2").withColumn("database_id", F.lit(None).cast("bigint")), source)
    run()
    found = jobs.latest_summary(spark, store, ["provider"]).collect()
    assert sum(r["total_reviews"] for r in found) == rows.count() + 1
    assert {r["provider"]: r["total_reviews"] for r in found}["other"] == 1

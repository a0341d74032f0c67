"""A third of all rows on one key: same result, and no task gets all of them."""

import pytest
from pyspark.sql import functions as F

from voicelane.operators import merge


@pytest.fixture
def no_broadcast_by_size(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def candidates(spark):
    """10,000 rows share a prefix, 20,000 have their own."""
    hot = F.concat(F.lit("h" * 90), F.col("id"))
    own = F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit("-" * 30))
    return spark.range(0, 30_000, 1, 8).select(
        "id", F.when(F.col("id") % 3 == 0, hot).otherwise(own).alias("review")
    )


@pytest.mark.parametrize("hot_is_done", [True, False])
def test_resume_with_a_hot_prefix(spark, no_broadcast_by_size, hot_is_done):
    rows = candidates(spark)
    done = rows.filter(F.col("id") % 10 == 1).filter(F.col("id") % 3 != 0)
    if hot_is_done:
        done = done.unionByName(rows.filter("id = 3"))
    labelled = done.select(F.col("review").alias("review_body"))
    left = {r["id"] for r in merge.resume(rows, labelled).collect()}
    expected = {
        i
        for i in range(30_000)
        if not (i % 3 != 0 and i % 10 == 1) and not (hot_is_done and i % 3 == 0)
    }
    assert left == expected


def test_rows_of_a_hot_key_are_spread(spark):
    rows = candidates(spark).select("id", F.substring("review", 1, 80).alias("k"))
    hot = merge.hot_keys(rows, "k")
    assert [r["k"] for r in hot.collect()] == ["h" * 80]
    parts = merge._spread_hot(rows, "k", hot)
    by_part = {r["hot"]: r["n"] for r in parts.groupBy(F.col("k").startswith("hh").alias("hot")).agg(
        F.countDistinct("_part").alias("n")).collect()}
    assert by_part[False] == 1 and by_part[True] > 500


def test_merge_with_a_hot_key(spark, no_broadcast_by_size):
    stored = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100).alias("database_id"),
        F.col("id").alias("row"),
        F.lit("old").alias("sentiment"),
    )
    updates = spark.createDataFrame(
        [(7, "older", 1), (7, "hot", 2), (101, "cold", 1)],
        "database_id bigint, sentiment string, version bigint",
    )
    found = {r["row"]: r["sentiment"] for r in merge.merge_enrichment(stored, updates).collect()}
    assert len(found) == 3_000
    assert all(found[i] == "hot" for i in range(0, 3_000, 3))
    assert found[1] == "cold" and found[2] == "old"

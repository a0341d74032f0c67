"""Examples, splits, numbering and quotas."""

import math

import pytest
from pyspark.sql import functions as F

from voicelane.operators import numbering as N
from voicelane.operators import training as T

LABELLED = "review_body string, sentiment string, categories array<string>"


def test_examples_per_review(spark):
    rows = spark.createDataFrame(
        [
            (" Rare one ", " Positive ", ["Cleanliness"]),
            ("Common", "unknown", ["Vehicle Condition", "Pickup Experience"]),
            ("No labels", None, None),
            (" 　", "mixed", ["Cleanliness"]),
            (None, "mixed", ["Cleanliness"]),
        ],
        LABELLED,
    )
    found = T.multitask_examples(rows).collect()
    outputs = sorted((r["task"], r["output"]) for r in found)
    assert outputs == [
        ("category", "Cleanliness"),
        ("category", "Cleanliness"),
        ("category", "Cleanliness"),
        ("category", "Staff & Communication"),
        ("category", "Vehicle Condition, Pickup Experience"),
        ("sentiment", "positive"),
    ]
    rare = next(r for r in found if r["output"] == "Cleanliness")
    assert rare["input"].endswith("Review: Rare one\n\nCategories:")
    assert next(r for r in found if r["task"] == "sentiment")["input"].endswith(
        "Review: Rare one\n\nSentiment:"
    )


def test_oversampling(spark):
    rows = spark.createDataFrame([(1, ["Cleanliness"]), (2, ["Vehicle Condition"]), (3, None)], "id int, categories array<string>")
    counts = {r["id"]: r["count"] for r in T.oversampled(rows).groupBy("id").count().collect()}
    assert counts == {1: 3, 2: 1, 3: 1}


@pytest.mark.parametrize("n", [1, 9, 10, 11, 1003])
def test_exact_split_size(spark, n):
    counts = T.dataset_counts(N.split_exact(spark.range(n), ["id"])).first()
    assert tuple(counts) == (n, n - math.ceil(n / 10), math.ceil(n / 10))


def test_exact_split_is_stable_and_depends_on_the_seed(spark):
    def test_ids(rows, seed):
        split = N.split_exact(rows, ["id"], seed=seed)
        return {r["id"] for r in split.filter("split = 'test'").collect()}

    rows = spark.range(500)
    assert test_ids(rows, 42) == test_ids(rows.repartition(9).orderBy(F.rand(3)), 42)
    assert test_ids(rows, 42) != test_ids(rows, 43)


def test_grouped_split_keeps_a_hot_group_together(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100).alias("g"))
    split = N.split_exact(rows, ["g"], grouped=True)
    sides = split.groupBy("g").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert all(r["n"] == 1 for r in sides)
    assert sum(r["s"] == "test" for r in sides) == math.ceil(len(sides) / 10)


def test_hash_split_keeps_copies_together(spark):
    rows = spark.range(3000).select((F.col("id") % 700).alias("k"), N.split_hash(F.col("id") % 700).alias("split"))
    assert rows.groupBy("k").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    share = rows.filter("split = 'test'").count() / 3000
    assert 0.05 < share < 0.15


@pytest.mark.parametrize("bits", [3, 16])
def test_row_numbers_without_gaps(spark, bits):
    """Sparse, negative and huge order values, one group with most rows, one with a null key."""
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 9 == 0, F.lit(None)).otherwise("cold").alias("g"),
        F.when(F.col("id") < 300, F.col("id") * 3 - 450)
        .when(F.col("id") < 600, F.col("id") * 1_000_003)
        .otherwise(F.col("id") * 9_000_000_000_000_000)
        .alias("o"),
    )
    found = N.number_rows(rows, "o", ["g"], bits=bits).collect()
    assert len(found) == 900
    for group in {r["g"] for r in found}:
        ordered = sorted((r for r in found if r["g"] == group), key=lambda r: r["o"])
        assert [r["row_number"] for r in ordered] == list(range(1, len(ordered) + 1))


def test_quota(spark):
    candidates, existing = spark.range(100), spark.range(30)
    def taken(total):
        return [r["id"] for r in N.quota_limit(candidates, existing, "id", total).orderBy("id").collect()]

    assert taken(37) == list(range(7))
    assert taken(30) == [] and taken(10) == []
    assert taken(10_000) == list(range(100))


def test_size_gate(spark):
    examples = spark.range(10).select(F.lit("train").alias("split"))
    assert T.require_size(examples, above=9) == 10
    with pytest.raises(T.DatasetTooSmall):
        T.require_size(examples)


def test_sample_preview(spark):
    rows = spark.createDataFrame([(2, "b", ["X"]), (1, "a" * 300, ["Y"])], "o int, review_body string, categories array<string>")
    assert tuple(T.sample_preview(rows, "o").first()) == ("a" * 200, ["Y"])

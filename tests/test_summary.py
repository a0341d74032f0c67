"""Scope summaries: worked examples, edges, and independence from how rows are spread."""

from pyspark.sql import functions as F

from voicelane.operators import aggregate as A
from voicelane.operators.scoring import score_reviews
from voicelane.schema import SCOPE
from voicelane.sources.readers import requests_to_reviews

COLUMNS = (
    "provider string, location string, renter string, ordinal bigint, sentiment string, "
    "categories array<string>, car_condition_rating double, processing_speed_rating double, "
    "service_level_rating double, recommendation_rating double, review string"
)


def reviews(spark, rows, scope=("P", "L", "R"), ratings=None):
    """``rows`` are (sentiment, categories) pairs of one scope, in order."""
    ratings = ratings or [(None,) * 4] * len(rows)
    data = [
        (*scope, i, sentiment, categories, *rating, "text")
        for i, ((sentiment, categories), rating) in enumerate(zip(rows, ratings, strict=True))
    ]
    return score_reviews(spark.createDataFrame(data, COLUMNS))


WORKED = [
    ("negative", ["Pickup Experience", "Return Experience", "Staff & Communication"]),
    (
        "positive",
        ["Cleanliness", "Pickup Experience", "Staff & Communication", "Return Experience"],
    ),
    ("mixed", ["Pickup Experience", "Insurance & Upselling"]),
    (
        "negative",
        ["Cleanliness", "Vehicle Condition", "Staff & Communication", "Hidden Fees & Billing"],
    ),
    ("positive", ["Pickup Experience", "Return Experience"]),
]
WORKED_RATINGS = [
    (3.0, 2.0, 1.0, 2.0),
    (10.0, 9.0, 9.0, 10.0),
    (None, 3.0, None, 6.0),
    (2.0, None, 2.0, 0.0),
    (None, None, None, 8.0),
]
WORKED_TEXT = (
    "The majority of reviews for Harbour Wheels at Luz are positive (40%), especially around "
    "the pickup process and return process. Some customers also had issues with "
    "unexpected charges and staff and communication."
)


def test_worked_example(spark):
    rows = reviews(spark, WORKED, ("Broker", "Luz", "Harbour Wheels"), WORKED_RATINGS)
    row = A.scope_summary(rows).first()
    assert row["total_reviews"] == 5
    assert tuple(row["sentiment_distribution"]) == (2, 2, 1, 40, 40, 20)
    assert row["top_categories"] == [
        "Pickup Experience",
        "Return Experience",
        "Staff & Communication",
    ]
    assert tuple(row["flags"]) == (1, 1, 1)
    assert tuple(row["ratings"]) == (5.0, 4.67, 4.0)
    assert tuple(row["nps"]) == (1, 1, 3, -40)
    assert row["aggregate_summary"] == WORKED_TEXT
    ranked = A.praise_and_complaints(rows, SCOPE).orderBy("side", "rank").collect()
    assert [(r["side"], r["category"]) for r in ranked] == [
        ("complained", "Hidden Fees & Billing"),
        ("complained", "Staff & Communication"),
        ("praised", "Pickup Experience"),
        ("praised", "Return Experience"),
    ]


def test_result_does_not_depend_on_partitioning(spark):
    rows = reviews(spark, WORKED * 20, ratings=WORKED_RATINGS * 20)
    expected = A.scope_summary(rows.coalesce(1)).collect()
    for shuffled in (rows.orderBy(F.rand(1)), rows.repartition(7), rows.orderBy(F.desc("ordinal"))):
        assert A.scope_summary(shuffled).collect() == expected


def test_ties_follow_first_appearance_with_scored_reviews_first(spark):
    # The first review is not scored: what it mentions is met after the scored ones.
    rows = reviews(
        spark,
        [(None, None), ("mixed", ["Vehicle Condition", "Booking & App"]), ("mixed", ["Zeta"])],
    ).withColumn(
        "categories",
        F.when(F.col("precomputed"), F.col("categories")).otherwise(F.array(F.lit("Cleanliness"))),
    )
    assert A.scope_summary(rows).first()["top_categories"] == [
        "Vehicle Condition",
        "Booking & App",
        "Zeta",
    ]


def test_repeated_category_counts_twice_but_flags_count_reviews(spark):
    rows = reviews(spark, [("positive", ["Vehicle Condition"] * 2), ("negative", ["Cleanliness"])])
    counts = {r["category"]: r["mentions"] for r in A.category_counts(rows, SCOPE).collect()}
    assert counts == {"Vehicle Condition": 2, "Cleanliness": 1}
    assert tuple(A.scope_summary(rows).first()["flags"]) == (0, 0, 1)


def test_scope_without_scores_or_ratings(spark):
    row = A.scope_summary(reviews(spark, [("mixed", [])])).first()
    assert tuple(row["nps"]) == (0, 0, 0, None)
    assert tuple(row["ratings"]) == (None, None, None)
    assert row["top_categories"] == []
    assert row["aggregate_summary"].count(".") == 1


def test_fractional_scores_are_passive(spark):
    ratings = [(None, None, None, s) for s in (6.0, 6.5, 8.5, 9.0)]
    rows = reviews(spark, [("mixed", [])] * 4, ratings=ratings)
    assert tuple(A.scope_summary(rows).first()["nps"]) == (1, 2, 1, 0)


def test_empty_request_keeps_its_scope(spark):
    payload = '{"provider": "Solo", "reviews": []}'
    requests = spark.createDataFrame([(payload,)], "payload string")
    row = A.scope_summary(score_reviews(requests_to_reviews(requests))).first()
    assert (row["provider"], row["total_reviews"]) == ("Solo", 0)
    assert tuple(row["sentiment_distribution"]) == (0,) * 6
    assert "Solo" in row["aggregate_summary"]


def test_null_and_empty_scope_values_stay_apart(spark):
    rows = reviews(spark, [("mixed", [])], (None, None, None)).unionByName(
        reviews(spark, [("mixed", [])], ("", "", ""))
    )
    found = A.scope_summary(rows).select("provider", "total_reviews").collect()
    assert sorted(map(tuple, found), key=str) == [("", 1), (None, 1)]


def test_open_category_names_with_quotes(spark):
    rows = reviews(spark, [("positive", ["Driver's Seat", 'The "Seat"'])] * 3)
    row = A.scope_summary(rows).first()
    assert "driver's seat" in row["aggregate_summary"]


def test_praised_and_complained_never_overlap(spark):
    folder = "/root/testdata/sf0.001"
    from voicelane.plans.reviews import scored

    ranked = A.praise_and_complaints(scored(spark, folder), ["provider"])
    both = ranked.groupBy("provider", "category").agg(F.countDistinct("side").alias("sides"))
    assert both.filter("sides > 1").count() == 0


def test_roll_up_equals_direct_summary(spark):
    parts = [
        reviews(spark, WORKED[i:] + WORKED[:i], scope, WORKED_RATINGS).withColumn(
            "ordinal", F.col("ordinal") + 10 * i
        )
        for i, scope in enumerate([("P", "L", "R"), ("P", "M", None), ("Q", "L", "R")])
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rolled = A.scope_grouping_sets(rows, [["provider"], ["location", "renter"], []])
    for chosen, name in ((["provider"], "provider"), (["location", "renter"], "location,renter")):
        direct = A.scope_summary(rows, chosen)
        level = rolled.filter(F.col("scope_level") == name).drop("scope_level")
        assert sorted(map(str, level.collect())) == sorted(map(str, direct.collect()))
    assert rolled.filter("scope_level = ''").first()["total_reviews"] == 15


def test_one_hot_scope_with_many_category_names(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("provider"),
        F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("renter"),
        F.col("id").alias("ordinal"),
        F.lit("positive").alias("sentiment"),
        F.array(F.concat(F.lit("c"), F.col("id")), F.lit("Common")).alias("categories"),
        *[F.lit(None).cast("double").alias(r) for r in A.ALL_RATINGS],
        F.lit("t").alias("review"),
    )
    found = {
        r["provider"]: r for r in A.scope_summary(score_reviews(rows), ["provider"]).collect()
    }
    assert found["hot"]["total_reviews"] == 10_000
    assert found["hot"]["top_categories"] == ["Common", "c0", "c3"]

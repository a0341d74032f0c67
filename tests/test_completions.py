"""Stored completions of a text model."""

import json

from pyspark.sql import functions as F

from voicelane.operators import completions as C

FENCE = "`" * 3


def reply(**changes):
    body = {"review_body": "Body", "sentiment": "positive", "categories": ["Cleanliness"]}
    return json.dumps({**body, **changes})


def parsed(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string")
    found = rows.select("i", C.parse_label_reply(F.col("text")).alias("x")).orderBy("i").collect()
    return [None if r["x"] is None else tuple(r["x"]) for r in found]


def test_valid_and_repaired_replies(spark):
    default = ["Staff & Communication"]
    found = parsed(
        spark,
        reply(),
        f"{FENCE}json\n{reply(extra=1)}\n{FENCE}",
        reply(sentiment="neutral", categories=["X"]),
        reply(sentiment=None),
        reply(sentiment=["positive"]),
        reply(categories="Cleanliness"),
        reply(categories={"Cleanliness": 1, "X": 2}),
        reply(categories=[1, "Booking & App", None]),
        reply(categories=[]),
    )
    assert found == [
        ("Body", "positive", ["Cleanliness"]),
        ("Body", "positive", ["Cleanliness"]),
        ("Body", "negative", default),
        ("Body", "negative", ["Cleanliness"]),
        ("Body", "negative", ["Cleanliness"]),
        ("Body", "positive", default),
        ("Body", "positive", ["Cleanliness"]),
        ("Body", "positive", ["Booking & App"]),
        ("Body", "positive", default),
    ]


def test_rejected_replies(spark):
    assert parsed(
        spark,
        '{"review_body": "cut',
        "no json at all",
        "[1, 2]",
        '"review_body sentiment categories"',
        '{"review_body": "a", "sentiment": "mixed"}',
        reply(categories=None),
        reply(categories=3),
        reply(categories=True),
        "",
    ) == [None] * 9


def test_first_valid_attempt_of_three(spark):
    rows = [
        (1, 0, "bad"),
        (1, 1, reply(review_body="second")),
        (1, 2, reply(review_body="third")),
        (2, 2, "bad"),
        (2, 3, reply(review_body="too late")),
    ]
    completions = spark.createDataFrame(rows, "request_id bigint, attempt bigint, text string")
    found = C.ingest_label_completions(completions).collect()
    assert [(r["request_id"], r["review_body"]) for r in found] == [(1, "second")]


def lines(*bodies):
    return "Sure:\r\n" + " ".join(f'  {{"review_body": "{b}", "categories": ["X"]}} ' for b in bodies)


def test_generated_batches_are_accepted_as_a_whole(spark):
    rows = [
        (1, 0, 4, lines("a")),  # too few
        (1, 1, 4, lines("b", "c")),  # half of what was asked for is enough
        (2, 0, 5, lines("d", "e")),  # five asked for: two suffice
        (3, 0, 2, lines("f", "g") + "\n{broken"),  # one bad line rejects all
        (4, 0, 1, "no objects, one asked for"),  # nothing is enough for one
    ]
    completions = spark.createDataFrame(
        rows, "request_id bigint, attempt bigint, requested_n bigint, text string"
    )
    found = C.ingest_generated(completions).orderBy("request_id", "line_no").collect()
    assert [(r["request_id"], r["review_body"], r["categories"]) for r in found] == [
        (1, "b", ["X"]),
        (1, "c", ["X"]),
        (2, "d", ["X"]),
        (2, "e", ["X"]),
    ]
    accepted = C.accept_batches(C.completion_lines(completions), ["request_id", "attempt"])
    assert sorted((r["request_id"], r["attempt"], r["lines"]) for r in accepted.collect()) == [
        (1, 1, 2),
        (2, 0, 2),
    ]

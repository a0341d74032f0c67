"""Files in, files out."""

import json

import pytest
from pyspark.errors import AnalysisException, NumberFormatException
from pyspark.sql import functions as F

from voicelane.operators import aggregate as A
from voicelane.operators import merge as M
from voicelane.sources import readers as R
from voicelane.sources import writers as W

HITS = [
    {
        "_id": "1",
        "_score": None,
        "fields": {
            "databaseId": [11],
            "renterQuote": ["Sehr gut, größer als gedacht. \n"],
            "carConditionRating": [1],
            "serviceLevelRating": [2.5],
            "recommendationRating": [9],
            "provider": ["Alpha"],
            "location": ["Porto"],
            "customerFirstName": ["Someone"],
        },
    },
    {"_id": "2", "fields": {"databaseId": [], "renterQuote": ["Only text"]}},
    {"_id": "3", "fields": {"databaseId": [13], "renterQuote": ["   "]}},
    {"_id": "4", "fields": {"databaseId": [14]}},
    {"_id": "5", "fields": {"databaseId": [15], "renterQuote": ["Line one\nline two"]}},
]


@pytest.mark.parametrize("as_array", [True, False])
def test_read_hits(spark, tmp_path, as_array):
    path = tmp_path / "hits.json"
    text = json.dumps(HITS) if as_array else "\n".join(json.dumps(h) for h in HITS)
    path.write_text(text, encoding="utf-8")
    rows = R.read_hits(spark, str(path), as_array).orderBy("ordinal").collect()
    assert [(r["database_id"], r["review"]) for r in rows] == [
        (11, "Sehr gut, größer als gedacht."),
        (None, "Only text"),
        (15, "Line one\nline two"),
    ]
    first = rows[0]
    assert (first["car_condition_rating"], first["service_level_rating"]) == (1.0, 2.5)
    assert first["processing_speed_rating"] is None and first["renter"] is None
    assert "customerFirstName" not in first.asDict()


CSV = (
    "renterQuote,_id,recommendationRating,carConditionRating,processingSpeedRating,"
    "serviceLevelRating,provider\r\n"
    "  ,1,,,,,Naming Provider\r\n"
    '"Good, with ""quotes""\nand a second line ",489.9,10,4,,3.5,Other\r\n'
    "Plain text,,7,,,,Other\r\n"
)


def test_read_csv_export(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(CSV, encoding="utf-8", newline="")
    rows = R.csv_rows(spark, str(path))
    scope = A.first_row_scope(rows).first()
    assert (scope["provider"], scope["renter"]) == ("Naming Provider", None)
    found = R.read_csv_export(spark, str(path)).orderBy("ordinal").collect()
    assert [(r["review"], r["database_id"], r["recommendation_rating"]) for r in found] == [
        ('Good, with "quotes"\nand a second line', 489, 10.0),
        ("Plain text", None, 7.0),
    ]
    assert found[0]["processing_speed_rating"] is None


def test_csv_junk_fails_or_goes_to_quarantine(spark, tmp_path):
    path = tmp_path / "junk.csv"
    path.write_text("_id,renterQuote,carConditionRating\n1,fine,4\n2,odd,four\n")
    with pytest.raises(NumberFormatException):
        R.read_csv_export(spark, str(path)).collect()
    good, bad = R.split_junk(R.csv_rows(spark, str(path)))
    assert [r["database_id"] for r in R.csv_to_reviews(good).collect()] == [1]
    assert [r["_id"] for r in bad.collect()] == ["2"]


def test_file_order_survives_split_files(spark, tmp_path):
    path = tmp_path / "many.json"
    lines = [json.dumps({"_id": str(i), "fields": {"databaseId": [i], "renterQuote": ["x" * 400]}}) for i in range(20_000)]
    path.write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    try:
        rows = R.read_hits(spark, str(path), json_array=False)
        assert rows.rdd.getNumPartitions() > 1
        ids = [r["database_id"] for r in rows.select("database_id", "ordinal").orderBy("ordinal").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
    assert ids == list(range(20_000))


def review_rows(spark, n):
    return spark.range(n).select(
        F.col("id").alias("ordinal"),
        F.concat(F.lit('Grüße "no" '), F.col("id")).alias("review"),
        F.col("id").alias("database_id"),
        F.lit(None).cast("double").alias("car_condition_rating"),
        F.lit(2.0).alias("processing_speed_rating"),
        F.lit(None).cast("double").alias("service_level_rating"),
        F.lit(9.0).alias("recommendation_rating"),
        F.lit("Pro\"v").alias("provider"),
        F.when(F.col("id") % 2 == 0, "").otherwise("R").alias("renter"),
    )


def test_batch_payloads_hold_sixteen_reviews_in_order(spark):
    payloads = W.payload_batch(review_rows(spark, 40)).orderBy("chunk").collect()
    decoded = [json.loads(p["payload"]) for p in payloads]
    assert [len(d["reviews"]) for d in decoded] == [16, 16, 8]
    flat = [r for d in decoded for r in d["reviews"]]
    assert [r["database_id"] for r in flat] == list(range(40))
    assert flat[0]["review"] == 'Grüße "no" 0' and flat[0]["car_condition_rating"] is None
    assert "ü" in payloads[0]["payload"]


def test_aggregate_payload_leaves_out_empty_scope_keys(spark):
    payloads = [json.loads(p["payload"]) for p in W.payload_aggregate(review_rows(spark, 4)).collect()]
    keys = sorted(sorted(p) for p in payloads)
    assert keys == [["provider", "renter", "reviews"], ["provider", "reviews"]]
    assert {p["provider"] for p in payloads} == {'Pro"v'}
    assert payloads[0]["reviews"][0]["service_level_rating"] is None


def test_payload_round_trip(spark):
    payloads = W.payload_aggregate(review_rows(spark, 10))
    back = R.requests_to_reviews(payloads.select("payload")).orderBy("database_id").collect()
    assert [r["database_id"] for r in back] == list(range(10))
    assert back[0]["renter"] is None and back[1]["renter"] == "R"


def test_requests_ignore_unknown_keys(spark):
    payload = json.dumps(
        {"provider": "P", "reviews": [{"review": "a", "renter_rating": 4, "database_id": 7}]}
    )
    row = R.requests_to_reviews(spark.createDataFrame([(payload,)], "payload string")).first()
    assert (row["provider"], row["renter"], row["database_id"], row["ordinal"]) == ("P", None, 7, 0)


def test_written_reviews_keep_nulls(spark, tmp_path):
    out = str(tmp_path / "reviews")
    W.write_reviews(review_rows(spark, 3), out)
    lines = [r["value"] for r in spark.read.text(out).collect()]
    assert len(lines) == 3 and all(json.loads(t)["car_condition_rating"] is None for t in lines)


def labelled(spark, *texts):
    return spark.createDataFrame(
        [(t, "positive", ["Cleanliness"]) for t in texts],
        "review_body string, sentiment string, categories array<string>",
    )


def test_append_then_resume(spark, tmp_path):
    out = str(tmp_path / "done")
    candidates = spark.createDataFrame(
        [(t * 30 + "end",) for t in ("abc", "abc", "xyz", "new")] + [("too short",)], "review string"
    )
    assert M.resume(candidates, R.read_done(spark, out)).count() == 4
    W.append_labelled(labelled(spark, "abc" * 30 + "another end"), out)
    W.append_labelled(labelled(spark, "xyz" * 30), out)
    (tmp_path / "done" / "broken.json").write_text('{"review_body": "cut\n{"sentiment": "mixed"}\n')
    done = R.read_done(spark, out)
    left = M.resume(candidates, done).collect()
    assert [r["review"][:3] for r in left] == ["new"]
    stats = M.label_run_stats(candidates, done).first()
    assert tuple(stats) == (5, 1, 2, 1)


def test_first_existing_path_is_read(spark, tmp_path):
    present = str(tmp_path / "b")
    W.append_labelled(labelled(spark, "text"), present)
    missing = str(tmp_path / "a")
    assert R.read_labelled(spark, [missing, present]).count() == 1
    with pytest.raises(AnalysisException):
        R.read_labelled(spark, [missing])


def test_publish_replaces_as_a_whole(spark, tmp_path):
    out = str(tmp_path / "set")
    W.publish(spark.range(5).selectExpr("id", "id AS old"), out)
    rows, schema = W.publish(labelled(spark, "a", "b"), out)
    assert rows == 2 and schema.names == ["review_body", "sentiment", "categories"]


def test_raw_reviews(spark, tmp_path):
    path = tmp_path / "raw.json"
    path.write_text(json.dumps([{"review": "one", "x": 1}, {"review": "two"}]))
    rows = R.read_raw_reviews(spark, str(path)).orderBy("ordinal").collect()
    assert [r["review"] for r in rows] == ["one", "two"]


def test_merge_takes_the_newest_and_never_matches_null_keys(spark):
    stored = spark.createDataFrame(
        [(1, "a", "old"), (2, "b", "old"), (None, "c", "old")],
        "database_id bigint, text string, sentiment string",
    )
    updates = spark.createDataFrame(
        [(1, "first", 1), (1, "last", 2), (None, "nobody", 3), (9, "unknown", 1)],
        "database_id bigint, sentiment string, version bigint",
    )
    merged = M.merge_enrichment(stored, updates).orderBy("text").collect()
    assert [(r["text"], r["sentiment"]) for r in merged] == [
        ("a", "last"),
        ("b", "old"),
        ("c", "old"),
    ]

"""Whole JSON values, mixed exports, whole-text resuming, one pass over texts, exact classifiers."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voicelane.operators import bayes, language, merge
from voicelane.operators import completions as C
from voicelane.sources import readers
from voicelane.streaming import jobs


@pytest.mark.parametrize(
    ("text", "good"),
    [
        ('{"a": 1}', True), (' {"a": 1}\n', True), ('{"a": 1, "a": 2}', True), ("[1, 2]", True), ("null", True),
        ('{"a": 1} trailing', False), ('{"a": 1}{"b": 2}', False), ('{"a": 1},{"b": 2}', False),
        ('{"a": 1},', False), ('{"a": 1}]', False), ('{"a": 1}],["b"', False), ("", False), (",", False), (None, False),
    ],
)
def test_whole_json(spark, text, good):
    frame = spark.createDataFrame([(text,)], "text string")
    assert frame.select(C.whole_json(F.col("text")).isNotNull()).first()[0] is good


def test_the_last_of_repeated_keys_counts(spark):
    text = '{"review_body": "r", "sentiment": "mixed", "categories": [], "sentiment": "positive"}'
    label = spark.createDataFrame([(text,)], "text string").select(C.parse_label_reply(F.col("text"))).first()[0]
    assert label["sentiment"] == "positive"


def test_exports_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('provider,_id,renterQuote\nP,1,"one,\nmore"\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('﻿renterQuote,"renter",extra,_id\ntwo,R,x,2\nshort\n', encoding="utf-8")
    rows = {r["renterQuote"]: r for r in readers.csv_rows(spark, str(tmp_path)).collect()}
    assert set(rows) == {"one,\nmore", "two", "short"}
    assert (rows["one,\nmore"]["provider"], rows["one,\nmore"]["renter"], rows["one,\nmore"]["_id"]) == ("P", None, "1")
    assert (rows["two"]["provider"], rows["two"]["renter"], rows["two"]["_id"]) == (None, "R", "2")
    assert rows["short"]["_id"] is None


def test_resume_by_whole_texts(spark):
    start = "the same eighty characters at the start of two reviews that differ only later, namely "
    rows = spark.createDataFrame([(1, start + "here"), (2, start + "there")], "id int, review string")
    done = rows.filter("id = 1").select(F.col("review").alias("review_body"))
    assert merge.resume(rows, done).count() == 0
    assert [r["id"] for r in merge.resume(rows, done, key_chars=None).collect()] == [2]


def test_stored_reviews_without_id_stay(spark, tmp_path):
    rows = [(1, "a", 1), (None, "b", 2), (None, "c", 3)]
    frame = spark.createDataFrame(rows, "database_id bigint, sentiment string, ordinal bigint")
    for batch in (0, 1):
        frame.filter("database_id is not null or ordinal = 2 + %d" % batch).write.parquet(f"{tmp_path}/batch={batch}")
    found = jobs.current_enrichment(spark, str(tmp_path))
    assert sorted(r["sentiment"] for r in found.collect()) == ["a", "b", "c"]


@pytest.mark.parametrize(
    "name",
    ["category_counts", "category_by_sentiment", "top_categories", "net_category_sentiment", "praise_complaints"],
)
def test_texts_go_through_python_once(spark, name):
    text = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    plan = text.split("== Physical Plan ==")[1]
    assert len(re.findall(r"ArrowEvalPython", plan)) <= 1


def test_profile_keeps_all_grams_and_is_stored(spark, tmp_path):
    rows = [("de", "straße über größe"), ("en", "the street over there"), ("xx", "ξένος")]
    frame = spark.createDataFrame(rows, "lang string, text string")
    profile = language.language_profile(frame)
    grams = {r["gram"] for r in profile.filter("lang = 'en'").collect()}
    expected = {f" {w} "[i : i + n] for w in rows[1][1].split() for n in (1, 2, 3) for i in range(len(w) + 3 - n)}
    assert grams == expected - {" "}
    assert language.language_profile(frame, grams=2).count() == 6
    language.save_profile(profile, str(tmp_path / "profile"))
    detect = language.detector(language.load_profile(spark, str(tmp_path / "profile")))
    again = language.detector(profile)
    found = frame.select(detect(F.col("text")).alias("a"), again(F.col("text")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in found)


def test_classifiers_learn_and_are_stored(spark, tmp_path):
    words = {"positive": "lovely tidy quick", "negative": "horrid slow late", "mixed": "so so partly"}
    rows = []
    for i in range(300):
        sentiment = sorted(words)[i % 3]
        rows.append((i, f"{words[sentiment]} number {i}", sentiment, ["Cleanliness"] if i % 2 else ["Pricing"]))
    frame = spark.createDataFrame(rows, "database_id bigint, review string, sentiment string, categories array<string>")
    report = {r["task"]: r for r in bayes.evaluate(frame).collect()}
    assert report["sentiment"]["accuracy"] == 1.0 and report["sentiment"]["majority"] < 0.6
    model = bayes.train(bayes.labelled_rows(frame))
    bayes.save_model(model, str(tmp_path / "model"))
    new = spark.createDataFrame([(1, "lovely"), (2, "never seen"), (3, None)], "key bigint, review string")
    found = bayes.predict(new, bayes.load_model(spark, str(tmp_path / "model"))).collect()
    assert {r["key"]: r["predicted"][-1] for r in found}[1] == bayes.V.SENTIMENTS.index("positive")
    assert len(found) == 3

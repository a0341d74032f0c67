"""Physical plans: what must not appear in any query, and what must in the important ones."""

import re

import pytest

import __spark_entry__ as entry
from voicelane.operators.language import language_profile

FOLDER = "/root/testdata/sf0.001"
LAZY = sorted(set(entry.queries()) - {"train_eval", "stream_enrich", "stream_scope_summary", "stream_latest_summary"})


def plan(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_products_and_no_row_by_row_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_summary_counts_before_it_shuffles(spark):
    text = plan(spark, "scope_summary").split("== Physical Plan ==")[1]
    assert "SortAggregate" not in text
    exchange = text.index("is_review#", text.index("Exchange hashpartitioning"))
    assert "partial_count" in text[exchange:]
    assert "WindowGroupLimit" in text and "Partial" in text
    # One pass: the review text is read by a single scan.
    assert len(re.findall(r"FileScan parquet [^\n]*text#", text)) == 1


def test_rankings_limit_groups_before_the_shuffle(spark):
    for name in ("top_categories", "praise_complaints"):
        assert "WindowGroupLimit" in plan(spark, name)
    # A profile keeps all grams, unless the caller limits them.
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    limited = language_profile(documents, grams=100)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in limited


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "nps_lineitem")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == [
        "l_discount", "l_linestatus", "l_returnflag",
    ]
    assert "text:string" not in plan(spark, "nps")


def test_row_local_jobs_do_not_shuffle_on_their_own(spark):
    for name in ("multitask_examples", "enrich_reviews", "keyword_labels", "lang_detect"):
        text = plan(spark, name).split("== Physical Plan ==")[1]
        # The only exchange is the spreading of the small one-file input over the cores.
        assert re.findall(r"Exchange hashpartitioning\([^)]*\), ENSURE", text) == []

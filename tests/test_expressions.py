"""Expression semantics, with expected values worked out by hand."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voicelane import fixed_values as V
from voicelane.functions import labels as L
from voicelane.functions import text as X
from voicelane.operators.narrative import scope_context


def strings(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def test_parse_categories_keeps_order_and_duplicates(one):
    assert one(L.parse_categories(F.lit("Cleanliness, Bad ,Cleanliness,")))[0] == [
        "Cleanliness",
        "Cleanliness",
    ]
    assert one(L.parse_categories(F.lit("cleanliness")))[0] == []


def test_parse_sentiment_prefers_positive(one):
    row = one(*[L.parse_sentiment(F.lit(t)) for t in ("Not positive, negative", "neutral", "NEGATIVE")])
    assert list(row) == ["positive", "mixed", "negative"]


def test_primary_category_has_a_default(one):
    row = one(L.primary_category(strings()), L.primary_category(strings("Cleanliness", "X")))
    assert list(row) == ["Staff & Communication", "Cleanliness"]


def test_keyword_labels_match_substrings(one):
    cases = {
        "I am happy": ["Booking & App"],
        "Business trip": ["Pickup Experience"],
        "Alles super, danke!": ["Staff & Communication"],
        "Filthy seats, a broken key and a RUDE agent": [
            "Cleanliness",
            "Vehicle Condition",
            "Pickup Experience",
            "Staff & Communication",
        ],
    }
    row = one(*[L.keyword_labels(F.lit(t)) for t in cases])
    assert [list(v) for v in row] == list(cases.values())


def test_keyword_labels_native_pruned_and_full_agree(spark):
    folder = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("text")
    words = [(w,) for listed in V.LEXICON.values() for w in listed]
    texts = texts.unionAll(spark.createDataFrame(words, "text string"))
    text = F.col("text")
    different = texts.select(
        L.keyword_labels(text).alias("a"),
        L.native_keyword_labels(text).alias("b"),
        L.native_keyword_labels(text, prune=False).alias("c"),
    ).filter("a != b or b != c")
    assert different.count() == 0


def test_spam_border_is_twenty_characters(one):
    row = one(
        L.is_spam(F.lit("Alles super, danke!")),
        L.is_spam(F.lit("Alles super, danke!!")),
        L.is_spam(F.lit("  padded to be long  ")),
        L.is_spam(F.lit("This is a TEST Review of the form")),
    )
    assert list(row) == [True, False, False, True]


def test_precomputed_is_total(one):
    none, empty = F.lit(None).cast("array<string>"), strings()
    row = one(
        L.is_precomputed(F.lit("positive"), empty),
        L.is_precomputed(F.lit("Positive"), empty),
        L.is_precomputed(F.lit("mixed"), none),
        L.is_precomputed(F.lit(None).cast("string"), empty),
    )
    assert list(row) == [True, False, False, False]


def test_repair(one):
    row = one(
        L.repair_sentiment(F.lit("neutral")),
        L.repair_sentiment(F.lit(None).cast("string")),
        L.repair_categories(strings("X")),
        L.repair_categories(strings("X", "Cleanliness")),
    )
    assert list(row) == ["negative", "negative", ["Staff & Communication"], ["Cleanliness"]]


def test_join_with_and(one):
    row = one(*[X.join_with_and(strings(*v)) for v in (["a"], ["a", "b"], ["a", "b", "c"])])
    assert list(row) == ["a", "a and b", "a, b and c"]


def test_pick_template_known_values(one):
    row = one(
        X.pick_template(2, F.lit("this rental location"), F.lit(0)),
        X.pick_template(2, F.lit("Harbour Wheels"), F.lit(3)),
    )
    assert list(row) == [1, 0]


def test_tuple_text_quotes(one):
    row = one(
        X.tuple_text(strings("a")),
        X.tuple_text(strings("a", "b")),
        X.tuple_text(strings("driver's")),
        X.tuple_text(strings("it's \"x\"")),
        X.tuple_text(strings("back\\slash\n")),
        X.tuple_text(strings()),
    )
    values = [("a",), ("a", "b"), ("driver's",), ("it's \"x\"",), ("back\\slash\n",), ()]
    assert list(row) == [str(v) for v in values]


def test_scope_context(one):
    def context(*scope):
        return scope_context(*[F.lit(v).cast("string") for v in scope])

    row = one(
        context("P", "L", "R"),
        context("P", "L", None),
        context("P", "", ""),
        context(None, "L", None),
        context("", None, ""),
    )
    assert list(row) == ["R at L", "P at L", "P", "L", "this rental location"]


def test_render_leaves_braces_in_values(one):
    value = F.lit("{pct} {context}")
    assert one(X.render("{{{context}}} x", context=value))[0] == "{{pct} {context}} x"


def test_strip_fence(one):
    fence = "`" * 3
    row = one(
        X.strip_fence(F.lit(f' {fence}json\n{{"a":1}}\n{fence} ')),
        X.strip_fence(F.lit(f'{fence}\n{{"a":1}}{fence} tail')),
        X.strip_fence(F.lit(' {"a":1}\n')),
    )
    assert list(row) == ['{"a":1}'] * 3


def test_half_even(one):
    row = one(*[X.half_even(F.lit(v)) for v in (0.5, 1.5, 2.5, 3.5, -0.5)])
    assert list(row) == [0, 2, 2, 4, 0]


def test_csv_casts(one):
    row = one(
        X.csv_bigint(F.lit(" 489.9\t")),
        X.csv_bigint(F.lit("")),
        X.csv_double(F.lit(" 2.5 ")),
        X.csv_is_junk(F.lit("n/a")),
        X.csv_is_junk(F.lit(" ")),
    )
    assert list(row) == [489, None, 2.5, True, False]


def test_first_of_missing_and_empty(one):
    row = one(
        X.first_of(strings("a", "b")),
        X.first_of(strings()),
        X.first_of(F.lit(None).cast("array<string>")),
    )
    assert list(row) == ["a", None, None]


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.text(alphabet=st.sampled_from("ab \t\n\x1c\x85  　​"), max_size=8),
        min_size=40,
        max_size=60,
    )
)
def test_strip_equals_text_strip(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "t string")
    assert [r[0] for r in rows.select(X.strip(F.col("t"))).collect()] == [v.strip() for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=40, max_size=60), st.sampled_from([2, 3, 7]))
def test_md5_mod_equals_big_number(spark, values, n):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    rows = spark.createDataFrame([(v,) for v in values], "t string")
    found = [r[0] for r in rows.select(X.md5_mod(F.col("t"), n)).collect()]
    assert found == [int(hashlib.md5(v.encode()).hexdigest(), 16) % n for v in values]


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.floats(min_value=-1000, max_value=1000, allow_nan=False), min_size=100, max_size=200
    )
)
def test_two_decimals_round_the_exact_value(spark, values):
    values = [*values, 2.675, 0.125, 0.375, 1.005, 2.665]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    found = [r[0] for r in rows.select(X.half_even_2(F.col("x"))).collect()]
    assert found == [round(v, 2) for v in values]

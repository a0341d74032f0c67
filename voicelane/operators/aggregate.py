"""Summaries per scope.

All figures of a scope come from one pass. Each review is exploded into one review-level entry and
one entry per category mention; the entries are counted per (scope, category) with map-side partial
aggregation, so what is shuffled is counters, never reviews, and a scope that holds a third of all
reviews costs no more than any other. Ranking runs on those counters, where the planner adds a
group limit below the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voicelane import fixed_values as V
from voicelane.functions import labels as L
from voicelane.functions.matching import Groups, words_found
from voicelane.functions.text import empty_to_null, half_even, half_even_2, percent
from voicelane.operators import narrative as N
from voicelane.schema import ALL_RATINGS, RATINGS, SCOPE

_NPS_PARTS = ("nps_scores", "promoters", "detractors")
_COUNTS = ("n", "positive", "negative", "mixed", *V.FLAG_CATEGORIES, *_NPS_PARTS)



# --- review grain -----------------------------------------------------------------------------


def total_reviews(reviews: DataFrame, by: Sequence[str]) -> DataFrame:
    return reviews.groupBy(*by).agg(F.count("*").alias("total_reviews"))


def sentiment_distribution(reviews: DataFrame, by: Sequence[str]) -> DataFrame:
    counted = reviews.groupBy(*by).agg(
        F.count("*").alias("total_reviews"),
        *[F.count_if(F.col("sentiment") == s).alias(s) for s in V.SENTIMENTS],
    )
    total = F.col("total_reviews")
    return counted.select(
        *by, *V.SENTIMENTS, *[percent(F.col(s), total).alias(f"{s}_pct") for s in V.SENTIMENTS]
    )


def flag_counts(reviews: DataFrame, by: Sequence[str]) -> DataFrame:
    """Reviews (not mentions) that carry each flag."""
    flags = L.category_flags(F.col("categories"))
    return reviews.groupBy(*by).agg(
        F.count_if(flags["has_upselling"]).alias("upselling_count"),
        F.count_if(flags["has_hidden_fees"]).alias("hidden_fees_count"),
        F.count_if(flags["has_damage_claim"]).alias("damage_claims_count"),
    )


def avg_ratings(
    reviews: DataFrame, by: Sequence[str], ratings: Sequence[str] = RATINGS
) -> DataFrame:
    """Two-decimal averages without nulls; null where a scope has none."""
    return reviews.groupBy(*by).agg(*[half_even_2(F.avg(r)).alias(r) for r in ratings])


def _nps_score(promoters: Column, detractors: Column, scores: Column) -> Column:
    lead = (promoters - detractors) / F.nullif(scores.cast("double"), F.lit(0.0))
    return half_even(lead * 100)


def nps(
    reviews: DataFrame, by: Sequence[str], score: str = "recommendation_rating"
) -> DataFrame:
    """Promoters, passives, detractors and the net score (null where nobody scored)."""
    value = F.col(score)
    counted = reviews.groupBy(*by).agg(
        F.count(value).alias("scores"),
        F.count_if(value >= V.PROMOTER_FROM).alias("promoters"),
        F.count_if(value <= V.DETRACTOR_TO).alias("detractors"),
    )
    promoters, detractors, scores = (
        F.col("promoters"), F.col("detractors"), F.col("scores"),
    )
    return counted.select(
        *by,
        promoters,
        (scores - promoters - detractors).alias("passives"),
        detractors,
        _nps_score(promoters, detractors, scores).alias("score"),
    )


# --- mention grain ----------------------------------------------------------------------------


# First appearance of a category: reviews scored earlier come first, then request order, then the
# place inside the review. Kept as four plain numbers, not one struct, because hash aggregation
# takes only fixed-size buffers and would otherwise become a sort of all mentions.
_FIRST = ["first_before", "first_before_at", "first_now", "first_now_at"]


def _first_seen() -> list[Column]:
    before, now = F.col("precomputed"), ~F.col("precomputed")
    found = []
    for prefix, part in (("first_before", before), ("first_now", now)):
        place = F.when(part, F.col("ordinal"))
        found += [
            F.min(place).alias(prefix),
            F.min_by("position", place).alias(f"{prefix}_at"),
        ]
    return found


def _first_order() -> list[Column]:
    return [F.asc_nulls_last(c) for c in _FIRST]


def mentions(reviews: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per category mention; a category listed twice in a review counts twice.

    ``position`` is where the review lists the category first.
    """
    # Not explode: from it the optimizer derives a filter that would ask for the categories, and so
    # for the words of the text, a second time.
    listed = F.inline(F.transform("categories", lambda c: F.struct(c.alias("category"))))
    return reviews.select(*keep, "categories", listed).select(
        *keep,
        "category",
        F.array_position("categories", F.col("category")).cast("int").alias("position"),
    )


def category_counts(reviews: DataFrame, by: Sequence[str]) -> DataFrame:
    return mentions(reviews, by).groupBy(*by, "category").agg(F.count("*").alias("mentions"))


def category_by_sentiment(reviews: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mentions in positive and in negative reviews; mixed reviews count in neither."""
    return (
        mentions(reviews, [*by, "sentiment"])
        .groupBy(*by, "category")
        .agg(
            F.count_if(F.col("sentiment") == "positive").alias("positive_mentions"),
            F.count_if(F.col("sentiment") == "negative").alias("negative_mentions"),
        )
    )


def top_categories(reviews: DataFrame, by: Sequence[str], k: int = V.MAX_TOP) -> DataFrame:
    """The ``k`` most mentioned categories of each scope, ties by first appearance."""
    counted = (
        mentions(reviews, [*by, "precomputed", "ordinal"])
        .groupBy(*by, "category")
        .agg(F.count("*").alias("mentions"), *_first_seen())
    )
    order = Window.partitionBy(*by).orderBy(
        F.desc("mentions"), *_first_order(), F.asc("category")
    )
    return (
        counted.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(*by, F.col("rank").cast("bigint").alias("rank"), "category", "mentions")
    )


def net_category_sentiment(reviews: DataFrame, by: Sequence[str]) -> DataFrame:
    """Positive minus negative mentions; a category that balances out is dropped."""
    net = F.col("positive_mentions") - F.col("negative_mentions")
    return (
        category_by_sentiment(reviews, by)
        .select(*by, "category", net.alias("net"))
        .filter(F.col("net") != 0)
        .withColumn("side", F.when(F.col("net") > 0, "praised").otherwise("complained"))
    )


def praise_and_complaints(
    reviews: DataFrame,
    by: Sequence[str],
    praised: int = V.MAX_PRAISED,
    complained: int = V.MAX_COMPLAINED,
) -> DataFrame:
    """Most praised and most complained-about categories by size of net, ties by name."""
    order = Window.partitionBy(*by, "side").orderBy(
        F.desc(F.abs("net")), F.asc("category")
    )
    cap = F.when(F.col("side") == "praised", praised).otherwise(complained)
    return (
        net_category_sentiment(reviews, by)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= max(praised, complained))
        .filter(F.col("rank") <= cap)
        .select(*by, "side", F.col("rank").cast("bigint").alias("rank"), "category", "net")
    )


def keyword_hits(
    reviews: DataFrame, text: str = "review", lexicon: Groups = V.LEXICON
) -> DataFrame:
    """Reviews per (category, keyword). The lexicon is compiled into the plan: no join, and what is
    shuffled is one counter per keyword and task."""
    words = list(dict.fromkeys(w for listed in lexicon.values() for w in listed))
    # A keyword of several categories counts for each of them.
    entries = F.array(
        *[
            F.array(
                *[
                    F.struct(F.lit(name).alias("category"), F.lit(word).alias("keyword"))
                    for name, listed in lexicon.items()
                    if word in listed
                ]
            )
            for word in words
        ]
    )
    counted = (
        reviews.select(F.explode(words_found(F.col(text), words)).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("reviews"))
    )
    return counted.select(
        F.explode(F.get(entries, F.col("word"))).alias("entry"), "reviews"
    ).select("entry.*", "reviews")


def category_share(reviews: DataFrame) -> DataFrame:
    """Share of reviews that carry each category. Duplicates inside a review are removed in the
    row, so no distinct count is shuffled."""
    total = reviews.agg(F.count("*")).scalar()
    return (
        reviews.select(F.explode(F.array_distinct("categories")).alias("category"))
        .groupBy("category")
        .agg(F.count("*").alias("reviews"))
        .select("category", "reviews", (F.col("reviews") / total.cast("double")).alias("share"))
    )


# --- the full summary -------------------------------------------------------------------------


def scope_measures(reviews: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Counters per (scope, category) plus one review-level row per scope.

    ``reviews`` needs the scope columns, ordinal, precomputed, sentiment, categories and ratings.
    A row without an ordinal stands for a scope with no review: it keeps the scope, counts nothing.
    Only counts, sums and minima are used, so the result also works as streaming state and can be
    rolled up to coarser scopes.
    """
    present = F.col("ordinal").isNotNull()
    flags = L.category_flags(F.col("categories"))
    score = F.col("recommendation_rating")
    entry = "is_review boolean, category string, position int"
    review_entry = F.array(F.struct(F.lit(True), F.lit(None).cast("string"), F.lit(-1))).cast(
        f"array<struct<{entry}>>"
    )
    mention_entries = F.transform(
        "categories",
        lambda c: F.struct(F.lit(False), c, F.array_position("categories", c).cast("int")),
    ).cast(f"array<struct<{entry}>>")
    entries = F.when(present & F.col("categories").isNotNull(),
                     F.concat(review_entry, mention_entries)).otherwise(review_entry)
    exploded = reviews.select(
        *by,
        "precomputed",
        "ordinal",
        F.when(present, F.col("sentiment")).alias("sentiment"),
        *[c.alias(name) for name, c in flags.items()],
        *ALL_RATINGS,
        F.inline(entries),
    )
    is_review = F.col("is_review")
    counted = F.col("ordinal").isNotNull()
    return exploded.groupBy(*by, "is_review", "category").agg(
        F.count("ordinal").alias("n"),
        *[F.count_if(F.col("sentiment") == s).alias(s) for s in V.SENTIMENTS],
        *[F.count_if(is_review & counted & F.col(f)).alias(f) for f in flags],
        F.count_if(is_review & score.isNotNull()).alias("nps_scores"),
        F.count_if(is_review & (score >= V.PROMOTER_FROM)).alias("promoters"),
        F.count_if(is_review & (score <= V.DETRACTOR_TO)).alias("detractors"),
        *[F.sum(F.when(is_review, F.col(r))).alias(f"{r}_sum") for r in RATINGS],
        *[F.count(F.when(is_review, F.col(r))).alias(f"{r}_n") for r in RATINGS],
        *_first_seen(),
    )


def _merged_measures() -> list[Column]:
    return [
        *[F.sum(c).alias(c) for c in _COUNTS],
        *[F.sum(f"{r}_sum").alias(f"{r}_sum") for r in RATINGS],
        *[F.sum(f"{r}_n").alias(f"{r}_n") for r in RATINGS],
        F.min("first_before").alias("first_before"),
        F.min_by("first_before_at", "first_before").alias("first_before_at"),
        F.min("first_now").alias("first_now"),
        F.min_by("first_now_at", "first_now").alias("first_now_at"),
    ]


def roll_up(
    measures: DataFrame, sets: Sequence[Sequence[str]], by: Sequence[str] = SCOPE
) -> DataFrame:
    """Measures of several scope subsets at once, from the finest ones (not from reviews again).

    ``scope_level`` names the columns a row is grouped by, so "all" and a null value stay apart.
    """
    keys = ["is_review", "category"]
    level = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in by])
    return measures.groupingSets(
        [[F.col(c) for c in (*chosen, *keys)] for chosen in sets],
        *[F.col(c) for c in (*by, *keys)],
    ).agg(level.alias("scope_level"), *_merged_measures())


def summarise(
    measures: DataFrame, by: Sequence[str] = SCOPE, level: Sequence[str] = ()
) -> DataFrame:
    """Measures to the typed summary. ``level`` holds extra key columns (``scope_level``); keys in
    ``by`` that are no scope (a request id) are kept as well."""
    level = [*level, *[c for c in by if c not in SCOPE]]
    keys = [*level, *[c for c in by if c in SCOPE]]
    net = F.col("positive") - F.col("negative")
    side = "struct<side:string,weight:bigint>"
    sides = F.when(
        F.col("is_review"), F.array(F.struct(F.lit("review"), F.lit(0)).cast(side))
    ).otherwise(
        F.array_compact(
            F.array(
                F.struct(F.lit("top"), F.col("n")).cast(side),
                F.when(net > 0, F.struct(F.lit("praised"), net).cast(side)),
                F.when(net < 0, F.struct(F.lit("complained"), -net).cast(side)),
            )
        )
    )
    values = [*_COUNTS, *[f"{r}_sum" for r in RATINGS], *[f"{r}_n" for r in RATINGS]]
    entries = measures.select(
        *keys, "category", *values, *_FIRST, F.inline(sides).alias("side", "weight")
    ).select(
        *keys,
        "category",
        *values,
        "side",
        "weight",
        # Ties are broken by first appearance among top categories, by name on the other sides.
        *[F.when(F.col("side") == "top", F.col(c)).alias(c) for c in _FIRST],
    )
    order = Window.partitionBy(*keys, "side").orderBy(
        F.desc("weight"), *_first_order(), F.asc("category")
    )
    # At most three rows per scope and side are left here, which bounds the lists below.
    kept = entries.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= max(V.MAX_TOP, V.MAX_PRAISED, V.MAX_COMPLAINED)
    )

    def ranked(name: str, cap: int) -> Column:
        chosen = (F.col("side") == name) & (F.col("rank") <= cap)
        pairs = F.collect_list(F.when(chosen, F.struct("rank", "category")))
        return F.transform(F.array_sort(pairs), lambda p: p["category"]).alias(name)

    review_row = F.col("side") == "review"
    per_scope = kept.groupBy(*keys).agg(
        *[F.max(F.when(review_row, F.col(v))).alias(v) for v in values],
        ranked("top", V.MAX_TOP),
        ranked("praised", V.MAX_PRAISED),
        ranked("complained", V.MAX_COMPLAINED),
    )
    total = F.col("n")
    scope = {name: F.col(name) if name in by else F.lit(None).cast("string") for name in SCOPE}
    told = N.with_narrative(
        per_scope.withColumn("_context", N.scope_context(**scope)),
        "aggregate_summary",
        context="_context",
        total="n",
        positive="positive",
        negative="negative",
        praised="praised",
        complained="complained",
        upselling="has_upselling",
        fees="has_hidden_fees",
        damage="has_damage_claim",
    )
    promoters, detractors, scores = (
        F.col("promoters"), F.col("detractors"), F.col("nps_scores"),
    )
    return told.select(
        *level,
        *[c.alias(name) for name, c in scope.items()],
        total.alias("total_reviews"),
        F.struct(
            *V.SENTIMENTS, *[percent(F.col(s), total).alias(f"{s}_pct") for s in V.SENTIMENTS]
        ).alias("sentiment_distribution"),
        F.col("top").alias("top_categories"),
        F.struct(
            F.col("has_upselling").alias("upselling_count"),
            F.col("has_hidden_fees").alias("hidden_fees_count"),
            F.col("has_damage_claim").alias("damage_claims_count"),
        ).alias("flags"),
        F.struct(
            *[
                half_even_2(
                    F.col(f"{r}_sum") / F.nullif(F.col(f"{r}_n").cast("double"), F.lit(0.0))
                ).alias(r)
                for r in RATINGS
            ]
        ).alias("ratings"),
        F.struct(
            promoters,
            (scores - promoters - detractors).alias("passives"),
            detractors,
            _nps_score(promoters, detractors, scores).alias("score"),
        ).alias("nps"),
        "aggregate_summary",
    )


def scope_summary(reviews: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """The full summary of every scope in scored ``reviews``. With a request id in ``by``, of every
    request: also of several with one scope."""
    return summarise(scope_measures(reviews, by), by)


def scope_grouping_sets(
    reviews: DataFrame, sets: Sequence[Sequence[str]], by: Sequence[str] = SCOPE
) -> DataFrame:
    """Summaries for several subsets of the scope columns."""
    return summarise(roll_up(scope_measures(reviews, by), sets, by), by, ["scope_level"])


def first_row_scope(rows: DataFrame, file: str = "source_file") -> DataFrame:
    """Provider and renter of the first row of each export, even one with a blank review."""
    return rows.groupBy(file).agg(
        empty_to_null(F.min_by("provider", "ordinal")).alias("provider"),
        empty_to_null(F.min_by("renter", "ordinal")).alias("renter"),
    )

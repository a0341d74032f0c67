"""Queries that summarise scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from voicelane.operators import aggregate as A
from voicelane.plans import check_sql as Q
from voicelane.plans.registry import query
from voicelane.plans.reviews import reviews, scored, table
from voicelane.schema import RATINGS, SCOPE

_BY = ["provider", "location"]
_KEY = "provider, location"


@query(
    "total_reviews",
    Q.with_reviews(f"SELECT {_KEY}, count(*) AS total_reviews FROM reviews_v GROUP BY {_KEY}"),
)
def total_reviews(spark, folder):
    return A.total_reviews(reviews(spark, folder), _BY)


@query(
    "sentiment_distribution",
    Q.with_scored(
        f"SELECT {_KEY}, p AS positive, n AS negative, m AS mixed, "
        f"{Q.percent('p', 't')} AS positive_pct, {Q.percent('n', 't')} AS negative_pct, "
        f"{Q.percent('m', 't')} AS mixed_pct FROM (SELECT {_KEY}, count(*) AS t, "
        "count(*) FILTER (WHERE sentiment = 'positive') AS p, count(*) FILTER (WHERE sentiment = 'negative') AS n, "
        f"count(*) FILTER (WHERE sentiment = 'mixed') AS m FROM scored_v GROUP BY {_KEY})"
    ),
)
def sentiment_distribution(spark, folder):
    return A.sentiment_distribution(scored(spark, folder), _BY)


@query(
    "category_counts",
    Q.with_mentions(
        f"SELECT {_KEY}, category, count(*) AS mentions FROM mentions_v GROUP BY {_KEY}, category"
    ),
)
def category_counts(spark, folder):
    return A.category_counts(scored(spark, folder), _BY)


_BY_SENTIMENT = (
    f"SELECT {_KEY}, category, count(*) FILTER (WHERE sentiment = 'positive') AS positive_mentions, "
    "count(*) FILTER (WHERE sentiment = 'negative') AS negative_mentions "
    f"FROM mentions_v GROUP BY {_KEY}, category"
)


@query("category_by_sentiment", Q.with_mentions(_BY_SENTIMENT))
def category_by_sentiment(spark, folder):
    return A.category_by_sentiment(scored(spark, folder), _BY)


@query(
    "top_categories",
    Q.with_mentions(
        f"SELECT {_KEY}, rank, category, mentions FROM (SELECT {_KEY}, category, count(*) AS mentions, "
        f"row_number() OVER (PARTITION BY {_KEY} ORDER BY count(*) DESC, "
        "min((CASE WHEN precomputed THEN 0 ELSE 1 END, ordinal, place)), category) AS rank "
        f"FROM mentions_v GROUP BY {_KEY}, category) WHERE rank <= 3"
    ),
)
def top_categories(spark, folder):
    return A.top_categories(scored(spark, folder), _BY)


@query(
    "flag_counts",
    Q.with_scored(
        f"SELECT {_KEY}, "
        "count(*) FILTER (WHERE list_contains(categories, 'Insurance & Upselling')) AS upselling_count, "
        "count(*) FILTER (WHERE list_contains(categories, 'Hidden Fees & Billing')) AS hidden_fees_count, "
        "count(*) FILTER (WHERE list_contains(categories, 'Vehicle Condition')) AS damage_claims_count "
        f"FROM scored_v GROUP BY {_KEY}"
    ),
)
def flag_counts(spark, folder):
    return A.flag_counts(scored(spark, folder), _BY)


_NET = (
    f"SELECT {_KEY}, category, positive_mentions - negative_mentions AS net, "
    "CASE WHEN positive_mentions > negative_mentions THEN 'praised' ELSE 'complained' END AS side "
    f"FROM ({_BY_SENTIMENT}) WHERE positive_mentions <> negative_mentions"
)


@query("net_category_sentiment", Q.with_mentions(_NET))
def net_category_sentiment(spark, folder):
    return A.net_category_sentiment(scored(spark, folder), _BY)


@query(
    "praise_complaints",
    Q.with_mentions(
        f"SELECT {_KEY}, side, rank, category, net FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {_KEY}, side ORDER BY abs(net) DESC, category) AS rank FROM ({_NET})) "
        "WHERE rank <= CASE side WHEN 'praised' THEN 3 ELSE 2 END"
    ),
)
def praise_complaints(spark, folder):
    return A.praise_and_complaints(scored(spark, folder), _BY)


@query(
    "avg_ratings",
    Q.with_reviews(
        f"SELECT {_KEY}, "
        + ", ".join(f"{Q.two_decimals(f'avg({r})')} AS {r}" for r in RATINGS)
        + f" FROM reviews_v GROUP BY {_KEY}"
    ),
)
def avg_ratings(spark, folder):
    return A.avg_ratings(reviews(spark, folder), _BY)


def _nps_sql(key: str, score: str, source: str) -> str:
    return (
        f"SELECT {key}, p AS promoters, n - p - d AS passives, d AS detractors, "
        f"{Q.nps_score('p', 'd', 'n')} AS score FROM (SELECT {key}, count({score}) AS n, "
        f"count(*) FILTER (WHERE {score} >= 9) AS p, count(*) FILTER (WHERE {score} <= 6) AS d FROM {source} GROUP BY {key})"
    )


@query("nps", Q.with_reviews(_nps_sql(_KEY, "recommendation_rating", "reviews_v")))
def nps(spark, folder):
    return A.nps(reviews(spark, folder), _BY)


_LINE_SCOPE = ["l_returnflag", "l_linestatus"]


@query(
    "nps_lineitem",
    _nps_sql(
        ", ".join(_LINE_SCOPE),
        "score",
        "(SELECT *, round_even(l_discount * 100, 0) AS score FROM lineitem)",
    ),
)
def nps_lineitem(spark, folder):
    """The score at volume: line items as answers, their discount in percent as the 0-10 score."""
    lines = table(spark, folder, "lineitem").select(
        *_LINE_SCOPE, F.bround(F.col("l_discount") * 100, 0).alias("score")
    )
    return A.nps(lines, _LINE_SCOPE, "score")


@query(
    "ratings_lineitem",
    "SELECT l_suppkey, "
    f"{Q.two_decimals('avg(l_quantity)')} AS l_quantity, "
    f"{Q.two_decimals('avg(l_discount * 100)')} AS discount_pct FROM lineitem GROUP BY l_suppkey",
)
def ratings_lineitem(spark, folder):
    """Two-decimal averages at volume: one scope per supplier."""
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_quantity", (F.col("l_discount") * 100).alias("discount_pct")
    )
    return A.avg_ratings(lines, ["l_suppkey"], ["l_quantity", "discount_pct"])


@query(
    "keyword_hits",
    Q.with_reviews(
        ", words(category, keyword) AS (VALUES "
        + ", ".join(
            f"({Q.text(name)}, {Q.text(word)})"
            for name, words in A.V.LEXICON.items()
            for word in words
        )
        + ") SELECT category, keyword, count(*) AS reviews FROM "
        "(SELECT lower(review) AS low FROM reviews_v) JOIN words ON contains(low, keyword) "
        "GROUP BY category, keyword"
    ),
)
def keyword_hits(spark, folder):
    return A.keyword_hits(reviews(spark, folder))


@query(
    "category_share",
    Q.with_scored(
        "SELECT category, count(DISTINCT database_id) AS reviews, count(DISTINCT database_id) / "
        "CAST((SELECT count(*) FROM scored_v) AS DOUBLE) AS share FROM "
        "(SELECT database_id, unnest(categories) AS category FROM scored_v) GROUP BY category"
    ),
)
def category_share(spark, folder):
    return A.category_share(scored(spark, folder))


def flat_summary(summary, *level):
    """The typed summary as plain columns."""
    return summary.select(
        *level,
        "provider",
        "location",
        "renter",
        "total_reviews",
        "sentiment_distribution.*",
        F.array_join("top_categories", " | ").alias("top_categories"),
        "flags.*",
        "ratings.*",
        "nps.promoters",
        "nps.passives",
        "nps.detractors",
        F.col("nps.score").alias("nps_score"),
        "aggregate_summary",
    )


@query("scope_summary", Q.summary())
def scope_summary(spark, folder):
    return flat_summary(A.scope_summary(scored(spark, folder)))


@query("request_summary", Q.summary(request="database_id % 3"))
def request_summary(spark, folder):
    """Reviews that came in three requests: each request is summarised by itself, scope by scope."""
    rows = scored(spark, folder).withColumn("request_id", F.pmod("database_id", F.lit(3)))
    found = A.scope_summary(rows, ["request_id", *SCOPE]).withColumnRenamed("request_id", "scope_level")
    return flat_summary(found, "scope_level")


_SETS = [["provider"], ["provider", "location"], ["location", "renter"], []]


@query("scope_grouping_sets", Q.summary(_SETS))
def scope_grouping_sets(spark, folder):
    return flat_summary(A.scope_grouping_sets(scored(spark, folder), _SETS), "scope_level")


@query(
    "scope_narrative",
    f"SELECT provider, aggregate_summary FROM ({Q.summary([['provider']])})",
)
def scope_narrative(spark, folder):
    return A.scope_summary(scored(spark, folder), ["provider"]).select(
        "provider", "aggregate_summary"
    )


@query(
    "first_row_scope",
    Q.with_reviews(
        "SELECT source_file, nullif(arg_min(p, ordinal), '') AS provider, "
        "nullif(arg_min(coalesce(renter, ''), ordinal), '') AS renter FROM (SELECT *, "
        "coalesce(location, 'none') AS source_file, "
        "CASE WHEN car_condition_rating IS NULL THEN '' ELSE provider END AS p FROM reviews_v) "
        "GROUP BY source_file"
    ),
)
def first_row_scope(spark, folder):
    """Each location stands for one export; its first row names the scope."""
    rows = reviews(spark, folder).select(
        F.coalesce("location", F.lit("none")).alias("source_file"),
        F.when(F.col("car_condition_rating").isNull(), "")
        .otherwise(F.col("provider"))
        .alias("provider"),
        F.coalesce("renter", F.lit("")).alias("renter"),
        "ordinal",
    )
    return A.first_row_scope(rows)

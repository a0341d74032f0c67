"""Queries over single rows: expressions, filters, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelane import fixed_values as V
from voicelane.functions import labels as L
from voicelane.functions import prompts as P
from voicelane.functions import text as X
from voicelane.operators import completions as C
from voicelane.operators import merge as M
from voicelane.operators import narrative as N
from voicelane.operators import scoring as S
from voicelane.operators import training as TR
from voicelane.plans import check_sql as Q
from voicelane.plans.registry import query
from voicelane.plans.reviews import reviews, scored, spread, table
from voicelane.schema import ALL_RATINGS, HIT, LABELLED
from voicelane.sources import readers, writers

_PIPE = " | "


def _list(column) -> F.Column:
    return F.array_join(column, _PIPE)


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations")


_RATING_LIST = ", ".join(ALL_RATINGS)

# --- sources ----------------------------------------------------------------------------------


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    """The reviews in the shape of search-index hits, as JSON text parsed with the export schema."""
    wrapped = F.struct(
        F.array("database_id").alias("databaseId"),
        F.array(F.concat("review", F.lit(" \n"))).alias("renterQuote"),
        *[
            F.when(F.col(ours).isNotNull(), F.array(ours)).alias(theirs)
            for theirs, ours in readers.EXPORT_RATINGS.items()
        ],
        F.array("provider").alias("provider"),
        F.when(F.col("location").isNotNull(), F.array("location")).alias("location"),
        F.coalesce(F.array_compact(F.array("renter")), F.array()).alias("renter"),
        F.array(F.lit("A")).alias("customerFirstName"),
    )
    hit = F.struct(F.col("database_id").cast("string").alias("_id"), wrapped.alias("fields"))
    return reviews(spark, folder).select("ordinal", F.from_json(F.to_json(hit), HIT).alias("hit"))


@query(
    "src_hits",
    Q.with_reviews(
        f"SELECT database_id, md5({Q.strip('review')}) AS review_md5, {_RATING_LIST}, provider, "
        f"location, renter FROM reviews_v WHERE length({Q.strip('review')}) > 0"
    ),
)
def src_hits(spark, folder):
    hits = _hits(spark, folder).select("ordinal", "hit.*")
    return readers.hits_to_reviews(hits).select(
        "database_id", F.md5("review").alias("review_md5"), *ALL_RATINGS,
        "provider", "location", "renter",
    )


@query(
    "src_csv",
    Q.with_reviews(
        f"SELECT database_id, md5({Q.strip('review')}) AS review_md5, {_RATING_LIST} "
        f"FROM reviews_v WHERE length({Q.strip('review')}) > 0"
    ),
)
def src_csv(spark, folder):
    """Reviews as quoted CSV records (line breaks and quotes inside), parsed as all-text rows."""
    ours = {"_id": F.concat(F.col("database_id").cast("string"), F.lit(".9")),
            "renterQuote": F.concat(F.lit("  "), F.col("review"))}
    for theirs, name in readers.EXPORT_RATINGS.items():
        ours[theirs] = F.col(name).cast("string")
    ours |= {"provider": F.col("provider"), "renter": F.col("renter")}
    options = {"quote": '"', "escape": '"', "lineSep": "\x00"}
    row = F.struct(*[c.alias(name) for name, c in ours.items()])
    schema = ", ".join(f"{name} string" for name in ours)
    parsed = F.from_csv(
        F.to_csv(row, {**options, "quoteAll": "true"}), schema, {**options, "maxCharsPerColumn": "-1"}
    )
    rows = reviews(spark, folder).select("ordinal", parsed.alias("row")).select("ordinal", "row.*")
    return readers.csv_to_reviews(rows).select(
        "database_id", F.md5("review").alias("review_md5"), *ALL_RATINGS
    )


@query(
    "src_labelled",
    Q.with_reviews(
        "SELECT database_id, md5(review) AS body_md5, sentiment, "
        "array_to_string(categories, ' | ') AS categories FROM reviews_v"
    ),
)
def src_labelled(spark, folder):
    line = F.to_json(F.struct(F.col("review").alias("review_body"), "sentiment", "categories"))
    return reviews(spark, folder).select(
        "database_id", F.from_json(line, LABELLED).alias("row")
    ).select(
        "database_id",
        F.md5("row.review_body").alias("body_md5"),
        "row.sentiment",
        _list("row.categories").alias("categories"),
    )


_REQUEST_CHUNK = """numbered AS (SELECT *, row_number() OVER (PARTITION BY provider
    ORDER BY ordinal) - 1 AS place FROM reviews_v)"""


@query(
    "unnest_requests",
    f"WITH {Q.REVIEWS}, {_REQUEST_CHUNK} SELECT provider, place // 16 AS chunk, "
    f"place % 16 AS ordinal, database_id, md5({Q.strip('review')}) AS review_md5, {_RATING_LIST} "
    "FROM numbered",
)
def unnest_requests(spark, folder):
    """Requests of 16 reviews per provider, written as payloads and taken apart again."""
    clean = TR.nonempty(reviews(spark, folder), "review")
    payloads = writers.payload_aggregate(clean, ["provider"], size=V.CHUNK_SIZE)
    return readers.requests_to_reviews(payloads, keep=["chunk"]).select(
        "provider", "chunk", "ordinal", "database_id",
        F.md5("review").alias("review_md5"), *ALL_RATINGS,
    )


@query(
    "sample_preview",
    Q.with_reviews(
        "SELECT substring(review, 1, 200) AS review_preview, "
        "array_to_string(categories, ' | ') AS categories FROM reviews_v ORDER BY ordinal LIMIT 1"
    ),
)
def sample_preview(spark, folder):
    return TR.sample_preview(reviews(spark, folder), "ordinal", "review").withColumn(
        "categories", _list("categories")
    )


# --- sinks ------------------------------------------------------------------------------------

_REVIEW_OBJECT = (
    "to_json({'review': review, 'database_id': database_id, "
    + ", ".join(f"'{r}': {r}" for r in ALL_RATINGS)
    + "})"
)


@query(
    "payload_batch",
    f"WITH {Q.REVIEWS}, numbered AS (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS place "
    f"FROM reviews_v) SELECT place // 16 AS chunk, '{{\"reviews\":[' || "
    f"string_agg(CAST({_REVIEW_OBJECT} AS VARCHAR), ',' ORDER BY ordinal) || ']}}' AS payload "
    "FROM numbered GROUP BY 1",
)
def payload_batch(spark, folder):
    return writers.payload_batch(reviews(spark, folder))


@query(
    "payload_aggregate",
    f"WITH {Q.REVIEWS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY provider, renter "
    "ORDER BY ordinal) - 1 AS place FROM reviews_v) SELECT provider, renter, place // 1000 AS chunk, "
    f"'{{\"reviews\":[' || string_agg(CAST({_REVIEW_OBJECT} AS VARCHAR), ',' ORDER BY ordinal) || ']'"
    " || CASE WHEN coalesce(provider, '') = '' THEN '' ELSE ',\"provider\":' || "
    "CAST(to_json(provider) AS VARCHAR) END"
    " || CASE WHEN coalesce(renter, '') = '' THEN '' ELSE ',\"renter\":' || "
    "CAST(to_json(renter) AS VARCHAR) END || '}' AS payload FROM numbered GROUP BY 1, 2, 3",
)
def payload_aggregate(spark, folder):
    return writers.payload_aggregate(reviews(spark, folder))


@query(
    "merge_enrichment",
    Q.with_scored(
        "SELECT d.doc_id AS database_id, d.lang, coalesce(e.sentiment, d.source) AS sentiment, "
        "e.primary_category FROM documents d LEFT JOIN (SELECT database_id, sentiment, "
        f"coalesce(categories[1], {Q.text(V.DEFAULT_CATEGORY)}) AS primary_category FROM scored_v "
        "WHERE precomputed) e ON d.doc_id = e.database_id"
    ),
)
def merge_enrichment(spark, folder):
    """Documents with the enrichment of those that have one; each key is delivered twice, the
    newer delivery has to win."""
    stored = table(spark, folder, "documents").select(
        F.col("doc_id").alias("database_id"), "lang", F.col("source").alias("sentiment")
    )
    newer = reviews(spark, folder).filter(
        L.is_precomputed(F.col("sentiment"), F.col("categories"))
    ).select(
        "database_id",
        "sentiment",
        L.primary_category(F.col("categories")).alias("primary_category"),
        F.lit(2).alias("version"),
    )
    older = newer.select(
        "database_id",
        F.lit("mixed").alias("sentiment"),
        F.lit(V.DEFAULT_CATEGORY).alias("primary_category"),
        F.lit(1).alias("version"),
    )
    return M.merge_enrichment(stored, newer.unionByName(older)).select(
        "database_id", "lang", "sentiment", "primary_category"
    )


# --- expressions ------------------------------------------------------------------------------


@query(
    "first_of_array",
    Q.with_reviews("SELECT database_id, categories[1] AS first_category FROM reviews_v"),
)
def first_of_array(spark, folder):
    """Null both where the array is missing and where it is empty."""
    return reviews(spark, folder).select(
        "database_id", X.first_of(F.col("categories")).alias("first_category")
    )


@query(
    "csv_casts",
    Q.with_reviews(
        "SELECT database_id, CAST(trunc(database_id + 0.9) AS BIGINT) AS parsed_id, "
        "service_level_rating AS parsed_rating FROM reviews_v"
    ),
)
def csv_casts(spark, folder):
    id_text = F.concat(F.lit(" "), F.col("database_id").cast("string"), F.lit(".9\t"))
    rating_text = F.coalesce(F.col("service_level_rating").cast("string"), F.lit(" "))
    return reviews(spark, folder).select(
        "database_id",
        X.csv_bigint(id_text).alias("parsed_id"),
        X.csv_double(rating_text).alias("parsed_rating"),
    )


_RAW_REPLY = "concat(array_to_string(categories, ', '), ', bad ,', coalesce(provider, ''))"


@query(
    "parse_categories",
    Q.with_scored(
        "SELECT database_id, array_to_string(list_filter(list_transform("
        f"string_split({_RAW_REPLY}, ','), lambda c: {Q.strip('c')}), "
        f"lambda c: c IN {Q.in_list(V.CATEGORIES)}), ' | ') AS parsed FROM scored_v"
    ),
)
def parse_categories(spark, folder):
    raw = F.concat(F.array_join("categories", ", "), F.lit(", bad ,"), F.coalesce("provider", F.lit("")))
    return scored(spark, folder).select(
        "database_id", _list(L.parse_categories(raw)).alias("parsed")
    )


@query(
    "parse_sentiment",
    Q.with_reviews(
        "SELECT database_id, CASE WHEN contains(lower(raw), 'positive') THEN 'positive' "
        "WHEN contains(lower(raw), 'negative') THEN 'negative' ELSE 'mixed' END AS parsed FROM "
        "(SELECT database_id, concat(' Clearly ', upper(coalesce(sentiment, 'neutral')), ' ', "
        "CASE WHEN car_condition_rating > 3 THEN 'not negative' ELSE '' END) AS raw FROM reviews_v)"
    ),
)
def parse_sentiment(spark, folder):
    raw = F.concat(
        F.lit(" Clearly "),
        F.upper(F.coalesce("sentiment", F.lit("neutral"))),
        F.lit(" "),
        F.when(F.col("car_condition_rating") > 3, "not negative").otherwise(""),
    )
    return reviews(spark, folder).select("database_id", L.parse_sentiment(raw).alias("parsed"))


@query(
    "category_flags",
    Q.with_scored(
        "SELECT database_id, list_contains(categories, 'Vehicle Condition') AS has_damage_claim, "
        "list_contains(categories, 'Hidden Fees & Billing') AS has_hidden_fees, "
        "list_contains(categories, 'Insurance & Upselling') AS has_upselling FROM scored_v"
    ),
)
def category_flags(spark, folder):
    flags = L.category_flags(F.col("categories"))
    return scored(spark, folder).select(
        "database_id", *[c.alias(name) for name, c in flags.items()]
    )


@query(
    "primary_category",
    Q.with_reviews(
        f"SELECT database_id, coalesce(categories[1], {Q.text(V.DEFAULT_CATEGORY)}) "
        "AS primary_category, coalesce(len(categories), 0) AS n_categories FROM reviews_v"
    ),
)
def primary_category(spark, folder):
    return reviews(spark, folder).select(
        "database_id",
        L.primary_category(F.col("categories")).alias("primary_category"),
        F.coalesce(F.size("categories"), F.lit(0)).cast("bigint").alias("n_categories"),
    )


@query(
    "keyword_labels",
    Q.with_reviews(
        f"SELECT database_id, array_to_string({Q.keyword_labels('low')}, ' | ') AS labels FROM "
        "(SELECT database_id, lower(review) AS low FROM reviews_v)"
    ),
)
def keyword_labels(spark, folder):
    return reviews(spark, folder).select(
        "database_id", _list(L.keyword_labels(F.col("review"))).alias("labels")
    )


@query(
    "format_labels",
    Q.with_scored(
        "SELECT database_id, array_to_string(categories, ', ') AS formatted FROM scored_v"
    ),
)
def format_labels(spark, folder):
    return scored(spark, folder).select(
        "database_id", L.format_labels(F.col("categories")).alias("formatted")
    )


@query(
    "natural_phrase",
    Q.with_reviews(
        f"SELECT database_id, {Q.natural('category')} AS phrase FROM (SELECT database_id, "
        "coalesce(categories[1], upper(provider)) AS category FROM reviews_v)"
    ),
)
def natural_phrase(spark, folder):
    """An unscored review stands in for an unknown category (its provider in capitals)."""
    category = F.coalesce(F.get("categories", F.lit(0)), F.upper("provider"))
    return reviews(spark, folder).select(
        "database_id", L.natural_phrase(category).alias("phrase")
    )


@query(
    "natural_phrase_join",
    Q.with_mentions(
        f"SELECT category, {Q.natural('category')} AS phrase, count(*) AS mentions "
        "FROM mentions_v GROUP BY 1, 2"
    ),
)
def natural_phrase_join(spark, folder):
    """The lookup as a join with a phrase table, on counted categories rather than on mentions."""
    phrases = spark.createDataFrame(
        list(V.NATURAL_PHRASES.items()), "category string, phrase string"
    )
    counted = (
        scored(spark, folder)
        .select(F.explode("categories").alias("category"))
        .groupBy("category")
        .agg(F.count("*").alias("mentions"))
    )
    return M.phrase_lookup(counted, phrases).select("category", "phrase", "mentions")


@query(
    "join_with_and",
    Q.with_scored(
        f"SELECT database_id, {Q.join_and('items')} AS joined FROM (SELECT database_id, "
        f"{Q.phrases('categories')} AS items FROM scored_v) WHERE len(items) > 0"
    ),
)
def join_with_and(spark, folder):
    items = F.transform("categories", lambda c: L.natural_phrase(c))
    return scored(spark, folder).filter(F.size("categories") > 0).select(
        "database_id", X.join_with_and(items).alias("joined")
    )


@query(
    "pick_template",
    Q.with_scored(
        f"SELECT database_id, {Q.md5_mod('seed', 2)} AS pick_of_2, {Q.md5_mod('seed', 3)} "
        "AS pick_of_3 FROM (SELECT database_id, coalesce(renter, 'x') || '|' || database_id || '|' "
        f"|| {Q.tuple_text('categories')} AS seed FROM scored_v)"
    ),
)
def pick_template(spark, folder):
    parts = (
        F.coalesce("renter", F.lit("x")),
        F.col("database_id"),
        X.tuple_text(F.col("categories")),
    )
    return scored(spark, folder).select(
        "database_id",
        X.pick_template(2, *parts).alias("pick_of_2"),
        X.pick_template(3, *parts).alias("pick_of_3"),
    )


@query(
    "scope_context",
    Q.with_reviews(
        f"SELECT database_id, {Q.context('p', 'location', 'renter')} AS context FROM (SELECT *, "
        "CASE WHEN car_condition_rating IS NULL THEN '' ELSE provider END AS p FROM reviews_v)"
    ),
)
def scope_context(spark, folder):
    provider = F.when(F.col("car_condition_rating").isNull(), "").otherwise(F.col("provider"))
    return reviews(spark, folder).select(
        "database_id",
        N.scope_context(provider, F.col("location"), F.col("renter")).alias("context"),
    )


_ROUND_CASES = (
    "CAST(database_id AS DOUBLE) / 2",
    "CAST(database_id * 7 % 1000 AS DOUBLE) / 8",
)


@query(
    "half_even",
    Q.with_reviews(
        f"SELECT database_id, CAST(round_even({_ROUND_CASES[0]}, 0) AS BIGINT) AS whole, "
        f"{Q.two_decimals(_ROUND_CASES[1])} AS two_decimals FROM reviews_v"
    ),
)
def half_even(spark, folder):
    number = F.col("database_id")
    return reviews(spark, folder).select(
        "database_id",
        X.half_even(number.cast("double") / 2).alias("whole"),
        X.half_even_2((number * 7 % 1000).cast("double") / 8).alias("two_decimals"),
    )


@query(
    "build_prompts",
    Q.with_reviews(
        "SELECT database_id, "
        + ", ".join(
            f"md5({Q.choose('0', [t], cats=Q.text(', '.join(V.CATEGORIES)), n=Q.text('16'), review='review')})"
            f" AS {name}"
            for name, t in (
                ("category_prompt", V.CATEGORY_PROMPT),
                ("open_category_prompt", V.OPEN_CATEGORY_PROMPT),
                ("sentiment_prompt", V.SENTIMENT_PROMPT),
                ("label_user_prompt", V.LABEL_USER_PROMPT),
                (
                    "generation_prompt",
                    V.GENERATION_PROMPT.replace("{{", "{").replace("}}", "}"),
                ),
            )
        )
        + ", md5("
        + Q.text(
            V.LABEL_SYSTEM_PROMPT.replace(
                "{cats_json}", "[" + ", ".join(f'"{c}"' for c in V.CATEGORIES) + "]"
            )
        )
        + ") AS label_system_prompt FROM reviews_v"
    ),
)
def build_prompts(spark, folder):
    review = F.col("review")
    prompts = {
        "category_prompt": P.category_prompt(review),
        "open_category_prompt": P.open_category_prompt(review),
        "sentiment_prompt": P.sentiment_prompt(review),
        "label_user_prompt": P.label_user_prompt(review),
        "generation_prompt": P.generation_prompt(F.lit(V.CHUNK_SIZE)),
        "label_system_prompt": P.label_system_prompt(),
    }
    return reviews(spark, folder).select(
        "database_id", *[F.md5(c).alias(name) for name, c in prompts.items()]
    )


@query(
    "log_preview",
    Q.with_reviews(
        "SELECT database_id, replace(substring(review, 1, 60), chr(10), ' ') AS preview "
        "FROM reviews_v"
    ),
)
def log_preview(spark, folder):
    return reviews(spark, folder).select(
        "database_id",
        X.one_line_preview(F.col("review"), V.LOG_PREVIEW_CHARS).alias("preview"),
    )


# --- stored completions -----------------------------------------------------------------------


def _fenced(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as replies: answers in a tagged fence, system turns in a plain one."""
    fenced = (
        F.when(F.col("role") == "assistant", F.concat(F.lit(" ```json\n"), "text", F.lit("\n``` ")))
        .when(F.col("role") == "system", F.concat(F.lit("```\n"), "text", F.lit("\n```\nend")))
        .otherwise(F.concat(F.lit("\n"), "text", F.lit("\t")))
    )
    return _conversations(spark, folder).select("conv_id", "turn", fenced.alias("reply"))


@query(
    "strip_fence",
    f"SELECT conv_id, turn, {Q.strip('text')} AS body FROM conversations",
)
def strip_fence(spark, folder):
    return _fenced(spark, folder).select(
        "conv_id", "turn", X.strip_fence(F.col("reply")).alias("body")
    )


def _label_reply(valid: F.Column) -> F.Column:
    """A stored label reply for a review: fenced JSON, or none that may pass where it is not valid."""
    body = F.to_json(
        F.struct(
            F.col("review").alias("review_body"),
            F.coalesce("sentiment", F.lit("neutral")).alias("sentiment"),
            F.coalesce("categories", F.array(F.lit("Weather"))).alias("categories"),
        )
    )
    # Every other valid one names its sentiment twice, of which the second counts.
    twice = F.concat(F.lit('{"sentiment":"not this",'), F.substring(body, 2, 1 << 30))
    body = F.when(F.col("database_id") % 2 == 0, body).otherwise(twice)
    text = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    # What is not valid is cut off, or has a remark, a second object or a list end after it.
    broken = (
        F.when(F.col("database_id") % 5 == 0, F.concat(body, F.lit("\nHope this helps!")))
        .when(F.col("database_id") % 5 == 1, F.concat(body, body))
        .when(F.col("database_id") % 5 == 2, F.concat(body, F.lit(","), body))
        .when(F.col("database_id") % 5 == 3, F.concat(body, F.lit("]")))
        .otherwise(F.concat(F.lit("```json\n"), F.substring(body, 1, 30)))
    )
    return F.when(valid, text).otherwise(broken)


def _label_completions(spark: SparkSession, folder: str) -> DataFrame:
    """Three stored attempts per review; which of them is the first valid one depends on the id."""
    rows = reviews(spark, folder).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(2))))
    valid = F.col("attempt") >= F.col("database_id") % 4
    return rows.select(
        F.col("database_id").alias("request_id"),
        F.col("attempt").cast("bigint").alias("attempt"),
        _label_reply(valid).alias("text"),
    )


_REPAIRED = (
    f"CASE WHEN sentiment IN {Q.in_list(V.SENTIMENTS)} THEN sentiment ELSE 'negative' END "
    "AS sentiment, "
    "array_to_string(coalesce(nullif(list_filter(coalesce(categories, []), "
    f"lambda c: c IN {Q.in_list(V.CATEGORIES)}), CAST([] AS VARCHAR[])), "
    f"[{Q.text(V.DEFAULT_CATEGORY)}]), ' | ') AS categories"
)


@query(
    "parse_label_response",
    Q.with_reviews(
        f"SELECT database_id AS request_id, attempt, md5(review) AS body_md5, {_REPAIRED} "
        "FROM reviews_v, range(3) t(attempt) WHERE attempt >= database_id % 4"
    ),
)
def parse_label_response(spark, folder):
    label = C.parse_label_reply(F.col("text")).alias("label")
    return (
        _label_completions(spark, folder)
        .select("request_id", "attempt", label)
        .filter(F.col("label").isNotNull())
        .select(
            "request_id",
            "attempt",
            F.md5("label.review_body").alias("body_md5"),
            "label.sentiment",
            _list("label.categories").alias("categories"),
        )
    )


@query(
    "ingest_completions",
    Q.with_reviews(
        f"SELECT database_id AS request_id, md5(review) AS body_md5, {_REPAIRED} FROM reviews_v "
        "WHERE database_id % 4 < 3"
    ),
)
def ingest_completions(spark, folder):
    return C.ingest_label_completions(_label_completions(spark, folder)).select(
        "request_id",
        F.md5("review_body").alias("body_md5"),
        "sentiment",
        _list("categories").alias("categories"),
    )


@query(
    "repair_labels",
    Q.with_reviews(f"SELECT database_id, {_REPAIRED} FROM reviews_v"),
)
def repair_labels(spark, folder):
    return reviews(spark, folder).select(
        "database_id",
        L.repair_sentiment(F.col("sentiment")).alias("sentiment"),
        _list(
            L.repair_categories(F.coalesce("categories", F.array().cast("array<string>")))
        ).alias("categories"),
    )


def _generated(spark: SparkSession, folder: str) -> DataFrame:
    """One generated batch per conversation: every turn becomes its lines, answers as JSON objects
    (every third with something after it), system turns as broken ones, user turns as plain prose."""
    answer = F.to_json(F.struct(F.col("text").alias("review_body")))
    line = (
        F.when(
            F.col("role") == "assistant",
            F.concat(answer, F.when(F.col("conv_id") % 3 == 0, F.lit(' {"and": "more"}')).otherwise("")),
        )
        .when(F.col("role") == "system", F.concat(F.lit("{"), F.translate("text", "\n{", "  ")))
        .otherwise(F.concat(F.lit("Note: "), F.col("text")))
    )
    return _conversations(spark, folder).select(
        F.col("conv_id").alias("request_id"),
        F.col("turn").alias("attempt"),
        F.lit(2).cast("bigint").alias("requested_n"),
        F.concat(F.lit("Here you are:\r\n  "), line).alias("text"),
    )


@query(
    "completion_lines",
    "SELECT conv_id AS request_id, turn AS attempt, CAST(0 AS BIGINT) AS line_no, "
    f"CASE WHEN role = 'assistant' THEN md5({Q.strip('CAST(to_json({review_body: text}) AS VARCHAR)')} || "
    "CASE WHEN conv_id % 3 = 0 THEN ' {\"and\": \"more\"}' ELSE '' END)"
    f" ELSE md5({Q.strip(chr(39) + '{' + chr(39) + ' || replace(replace(text, chr(10), chr(32)), chr(123), chr(32))')}) END"
    " AS line_md5 FROM conversations WHERE role IN ('assistant', 'system')",
)
def completion_lines(spark, folder):
    return C.completion_lines(_generated(spark, folder)).select(
        "request_id", "attempt", F.col("line_no").cast("bigint").alias("line_no"),
        F.md5("line").alias("line_md5"),
    )


@query(
    "accept_batches",
    "SELECT conv_id AS request_id, count(*) FILTER (WHERE role = 'assistant') AS lines FROM conversations "
    "WHERE role IN ('assistant', 'system') GROUP BY conv_id "
    "HAVING count(*) FILTER (WHERE role = 'system' OR conv_id % 3 = 0) = 0 AND count(*) >= 1",
)
def accept_batches(spark, folder):
    lines = C.completion_lines(_generated(spark, folder))
    return C.accept_batches(lines, ["request_id"])


@query(
    "ingest_generated",
    "SELECT conv_id AS request_id, md5(arg_min(text, turn)) AS body_md5 FROM conversations "
    "WHERE role = 'assistant' AND turn < 3 AND conv_id % 3 <> 0 GROUP BY conv_id",
)
def ingest_generated(spark, folder):
    return C.ingest_generated(_generated(spark, folder)).select(
        "request_id", F.md5("review_body").alias("body_md5")
    )


# --- filters ----------------------------------------------------------------------------------


@query(
    "nonempty_reviews",
    f"SELECT doc_id, md5({Q.strip('text')}) AS text_md5 FROM documents "
    f"WHERE length({Q.strip('text')}) > 0",
)
def nonempty_reviews(spark, folder):
    documents = spread(table(spark, folder, "documents"), "doc_id")
    return TR.nonempty(documents, "text").select("doc_id", F.md5("text").alias("text_md5"))


_SPAM = f"length(text) < 20 OR {Q.any_word('lower(text)', V.SPAM_PHRASES)}"


@query("spam_filter", f"SELECT doc_id, ({_SPAM}) AS is_spam FROM documents")
def spam_filter(spark, folder):
    documents = spread(table(spark, folder, "documents"), "doc_id")
    return documents.select("doc_id", L.is_spam(F.col("text")).alias("is_spam"))


@query(
    "precomputed_split",
    Q.with_reviews(
        f"SELECT {Q.PRECOMPUTED} AS precomputed, count(*) AS reviews FROM reviews_v GROUP BY 1"
    ),
)
def precomputed_split(spark, folder):
    done = L.is_precomputed(F.col("sentiment"), F.col("categories"))
    return (
        reviews(spark, folder)
        .groupBy(done.alias("precomputed"))
        .agg(F.count("*").alias("reviews"))
    )


@query(
    "union_scored",
    Q.with_scored(
        "SELECT database_id, precomputed, sentiment, array_to_string(categories, ' | ') "
        "AS categories FROM scored_v"
    ),
)
def union_scored(spark, folder):
    """The two-branch form: split, score one branch, put both together again."""
    done, waiting = S.split_precomputed(reviews(spark, folder))
    kept = ["database_id", "sentiment", "categories"]
    return S.union_scored(
        done.select(*kept), S.score_reviews(waiting).select(*kept)
    ).select("database_id", "precomputed", "sentiment", _list("categories").alias("categories"))


@query(
    "resume_anti_join",
    Q.with_reviews(
        "SELECT database_id FROM reviews_v WHERE NOT (length(review) < 20 OR "
        f"{Q.any_word('lower(review)', V.SPAM_PHRASES)}) AND substring(review, 1, 80) NOT IN "
        "(SELECT substring(review, 1, 80) FROM reviews_v WHERE sentiment IS NOT NULL)"
    ),
)
def resume_anti_join(spark, folder):
    """Reviews still to label; those with a label count as done, and so do their near copies."""
    rows = reviews(spark, folder)
    done = rows.filter(F.col("sentiment").isNotNull()).select(F.col("review").alias("review_body"))
    return M.resume(rows, done).select("database_id")


@query(
    "label_run_stats",
    Q.with_reviews(
        ", r AS (SELECT *, substring(review, 1, 80) AS k, length(review) < 20 OR "
        f"{Q.any_word('lower(review)', V.SPAM_PHRASES)} AS spam FROM reviews_v), "
        "done AS (SELECT DISTINCT k FROM r WHERE sentiment IS NOT NULL) "
        "SELECT count(*) AS total, count(*) FILTER (WHERE spam) AS spam, (SELECT count(*) FROM done) AS done, "
        "count(*) FILTER (WHERE NOT spam AND k NOT IN (SELECT k FROM done)) AS remaining FROM r"
    ),
)
def label_run_stats(spark, folder):
    rows = reviews(spark, folder)
    done = rows.filter(F.col("sentiment").isNotNull()).select(F.col("review").alias("review_body"))
    return M.label_run_stats(rows, done)

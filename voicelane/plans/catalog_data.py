"""Queries for training data, splits, languages, vocabulary, classifiers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelane import fixed_values as V
from voicelane.operators import encoding, language, numbering
from voicelane.operators import scoring as S
from voicelane.operators import training as TR
from voicelane.plans import check_sql as Q
from voicelane.plans.catalog_scopes import flat_summary
from voicelane.plans.registry import query
from voicelane.plans.reviews import (
    document_stream,
    review_view,
    reviews,
    scored,
    spread,
    table,
)
from voicelane.session import shared_folder
from voicelane.streaming import jobs


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return reviews(spark, folder).select(
        "database_id", F.col("review").alias("review_body"), "sentiment", "categories"
    )


# --- examples ---------------------------------------------------------------------------------

_CATS = Q.text(", ".join(V.CATEGORIES))
_RARE = Q.text_list(V.RARE_CATEGORIES)
_CAT_PROMPT = Q.choose("0", [V.CATEGORY_PROMPT], cats=_CATS, review="body")
_SENT_PROMPT = Q.choose("0", [V.SENTIMENT_PROMPT], review="body")
_EXAMPLES = f"""clean AS (SELECT database_id, {Q.strip('review')} AS body,
    lower({Q.strip("coalesce(sentiment, '')")}) AS sent, coalesce(categories, []) AS cats
  FROM reviews_v WHERE length({Q.strip('review')}) > 0),
examples AS (
  SELECT database_id, 'category' AS task, c AS copy, {_CAT_PROMPT} AS input,
    CASE WHEN len(cats) > 0 THEN array_to_string(cats, ', ') ELSE {Q.text(V.DEFAULT_CATEGORY)} END
      AS output
  FROM clean, range(1, 4) t(c) WHERE c <= CASE WHEN list_has_any(cats, {_RARE}) THEN 3 ELSE 1 END
  UNION ALL
  SELECT database_id, 'sentiment', 1, {_SENT_PROMPT}, sent FROM clean
  WHERE sent IN {Q.in_list(V.SENTIMENTS)})"""


def _with_examples(body: str, *more: str) -> str:
    return f"WITH {', '.join([Q.REVIEWS, _EXAMPLES, *more])} {body}"


def _examples(spark: SparkSession, folder: str) -> DataFrame:
    return TR.multitask_examples(_labelled(spark, folder), ["database_id"])


@query(
    "multitask_examples",
    _with_examples(
        "SELECT database_id, task, copy, md5(input) AS input_md5, output FROM examples"
    ),
)
def multitask_examples(spark, folder):
    return _examples(spark, folder).select(
        "database_id", "task", F.col("copy").cast("bigint").alias("copy"),
        F.md5("input").alias("input_md5"), "output",
    )


@query(
    "oversample",
    Q.with_scored(
        "SELECT database_id, c AS copy FROM scored_v, range(1, 4) t(c) "
        f"WHERE c <= CASE WHEN list_has_any(categories, {_RARE}) THEN 3 ELSE 1 END"
    ),
)
def oversample(spark, folder):
    return TR.oversampled(scored(spark, folder).select("database_id", "categories")).select(
        "database_id", F.col("copy").cast("bigint").alias("copy")
    )


_HASH_SIDE = (
    f"CASE WHEN {Q.md5_bucket(chr(39) + '42|' + chr(39) + ' || review', 10)} = 0 "
    "THEN 'test' ELSE 'train' END"
)


@query(
    "split_hash", Q.with_reviews(f"SELECT database_id, {_HASH_SIDE} AS split FROM reviews_v")
)
def split_hash(spark, folder):
    """By review text: copies of a review are on one side."""
    return reviews(spark, folder).select(
        "database_id", numbering.split_hash(F.col("review")).alias("split")
    )


_EXACT = """hashed AS (SELECT *,
  md5('42|' || database_id || '|' || task || '|' || copy) AS h FROM examples),
placed AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY h) <= (SELECT ceil(count(*) / 10.0)
  FROM examples) THEN 'test' ELSE 'train' END AS split FROM hashed)"""
_EXAMPLE_KEY = ["database_id", "task", "copy"]


@query(
    "split_exact",
    _with_examples("SELECT database_id, task, copy, split FROM placed", _EXACT),
)
def split_exact(spark, folder):
    """Exact size, copies of an example apart from each other as drawn (the default)."""
    examples = _examples(spark, folder).select(*_EXAMPLE_KEY)
    return numbering.split_exact(examples, _EXAMPLE_KEY).select(
        "database_id", "task", F.col("copy").cast("bigint").alias("copy"), "split"
    )


@query(
    "split_exact_grouped",
    _with_examples(
        "SELECT database_id, task, copy, CASE WHEN rank <= (SELECT ceil(count(DISTINCT database_id)"
        " / 10.0) FROM examples) THEN 'test' ELSE 'train' END AS split FROM (SELECT *, "
        "dense_rank() OVER (ORDER BY md5('42|' || database_id)) AS rank FROM examples)"
    ),
)
def split_exact_grouped(spark, folder):
    """Exact size in reviews: all examples of a review on one side."""
    examples = _examples(spark, folder).select(*_EXAMPLE_KEY)
    return numbering.split_exact(examples, ["database_id"], grouped=True).select(
        "database_id", "task", F.col("copy").cast("bigint").alias("copy"), "split"
    )


@query(
    "dataset_counts",
    _with_examples(
        "SELECT count(*) AS rows, count(*) FILTER (WHERE split = 'train') AS train, "
        "count(*) FILTER (WHERE split = 'test') AS test FROM placed",
        _EXACT,
    ),
)
def dataset_counts(spark, folder):
    examples = _examples(spark, folder).select(*_EXAMPLE_KEY)
    return TR.dataset_counts(numbering.split_exact(examples, _EXAMPLE_KEY))


@query(
    "chunk_ids",
    Q.with_reviews(
        "SELECT database_id, provider, (row_number() OVER w - 1) // 16 AS chunk, "
        "(row_number() OVER w - 1) % 16 AS chunk_row FROM reviews_v "
        "WINDOW w AS (PARTITION BY provider ORDER BY ordinal)"
    ),
)
def chunk_ids(spark, folder):
    rows = reviews(spark, folder).select("database_id", "provider", "ordinal")
    return numbering.chunk_ids(rows, "ordinal", ["provider"]).select(
        "database_id", "provider", "chunk", "chunk_row"
    )


@query(
    "quota_limit",
    Q.with_reviews(
        "SELECT database_id FROM (SELECT database_id, row_number() OVER (ORDER BY ordinal) AS n "
        "FROM reviews_v WHERE sentiment IS NULL) WHERE n <= greatest("
        "(SELECT count(*) * 3 // 5 FROM documents) - (SELECT count(*) FROM labels), 0)"
    ),
)
def quota_limit(spark, folder):
    """Unscored reviews to add until three fifths of all documents are labelled."""
    documents = table(spark, folder, "documents")
    target = documents.agg(F.floor(F.count("*") * 3 / 5)).scalar()
    candidates = reviews(spark, folder).filter(F.col("sentiment").isNull())
    return numbering.quota_limit(
        candidates.select("database_id", "ordinal"),
        table(spark, folder, "labels"),
        "ordinal",
        target,
    ).select("database_id")


# --- language ---------------------------------------------------------------------------------


def _words(expression: str) -> str:
    return (
        f"string_split(trim(regexp_replace(lower(coalesce({expression}, '')), "
        "'[^\\p{L}]+', ' ', 'g')), ' ')"
    )


_GRAMS = (
    "list_concat(string_split(word, ''), "
    "list_transform(range(1, length(word) + 2), lambda i: substr(' ' || word || ' ', i, 2)), "
    "list_transform(range(1, length(word) + 1), lambda i: substr(' ' || word || ' ', i, 3)))"
)
_PROFILE = f"""lang_words AS (SELECT lang, word, count(*) AS n FROM
    (SELECT lang, unnest({_words('text')}) AS word FROM documents WHERE lang IS NOT NULL)
  WHERE word <> '' GROUP BY lang, word),
lang_grams AS (SELECT lang, gram, CAST(sum(n) AS BIGINT) AS n FROM
    (SELECT lang, n, unnest({_GRAMS}) AS gram FROM lang_words) GROUP BY lang, gram),
lang_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram)
    AS rank FROM lang_grams)),
profile AS (SELECT lang, gram, n, rank,
    CAST(round_even(ln(n / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE)) * 1000, 0) AS BIGINT)
      AS weight,
    CAST(round_even(ln(0.5 / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE)) * 1000, 0) AS BIGINT)
      AS floor_weight FROM lang_top)"""


def _profile(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(table(spark, folder, "documents"), "doc_id")
    return language.language_profile(documents)


@query(
    "lang_profile",
    f"WITH {_PROFILE} SELECT lang, gram, n, rank, weight, floor_weight FROM profile",
)
def lang_profile(spark, folder):
    return _profile(spark, folder)


_DETECTED = f"""seen AS (SELECT database_id, gram, sum(n) AS n FROM (
    SELECT database_id, n, unnest({_GRAMS}) AS gram FROM (
      SELECT database_id, word, count(*) AS n FROM (
        SELECT database_id, unnest({_words('review')}) AS word FROM reviews_v)
      WHERE word <> '' GROUP BY 1, 2)) GROUP BY 1, 2),
known AS (SELECT s.* FROM seen s WHERE gram IN (SELECT gram FROM profile)),
floors AS (SELECT DISTINCT lang, floor_weight FROM profile),
points AS (SELECT k.database_id, f.lang, sum(k.n * coalesce(p.weight, f.floor_weight)) AS score
  FROM known k CROSS JOIN floors f LEFT JOIN profile p ON p.gram = k.gram AND p.lang = f.lang
  GROUP BY 1, 2),
best AS (SELECT database_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY database_id
  ORDER BY score DESC, lang) AS place FROM points) WHERE place = 1),
detected AS (SELECT r.database_id, coalesce(b.lang, 'en') AS language FROM reviews_v r
  LEFT JOIN best b ON r.database_id = b.database_id)"""


@query(
    "lang_detect",
    f"WITH {Q.REVIEWS}, {_PROFILE}, {_DETECTED} SELECT database_id, language FROM detected",
)
def lang_detect(spark, folder):
    detect = language.detector(_profile(spark, folder))
    return reviews(spark, folder).select(
        "database_id", detect(F.col("review")).alias("language")
    )


_FLAGS = ", ".join(
    f"list_contains(categories, {Q.text(c)}) AS {flag}" for flag, c in V.FLAG_CATEGORIES.items()
)
_ENRICHED_SQL = Q.with_scored(
    "SELECT s.database_id, d.language, sentiment, "
    f"coalesce(categories[1], {Q.text(V.DEFAULT_CATEGORY)}) AS primary_category, "
    f"array_to_string(categories, ' | ') AS categories, {_FLAGS} FROM scored_v s "
    "JOIN detected d ON s.database_id = d.database_id",
    _PROFILE,
    _DETECTED,
)


def _flat_enrichment(rows: DataFrame) -> DataFrame:
    return rows.withColumn("categories", F.array_join("categories", " | "))


@query("enrich_reviews", _ENRICHED_SQL)
def enrich_reviews(spark, folder):
    detect = language.detector(_profile(spark, folder))
    return _flat_enrichment(S.enrich_reviews(reviews(spark, folder), detect))


# --- sequences and classifiers ----------------------------------------------------------------


def _tokens(expression: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({expression}), '[^\\p{{L}}\\p{{N}}]+'), "
        "lambda t: t <> '')"
    )


_VOCAB = f"""vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 258 AS id FROM
  (SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('input')}) AS token FROM examples
    UNION ALL SELECT unnest({_tokens('output')}) FROM examples) GROUP BY token))"""


def _vocab(examples: DataFrame) -> DataFrame:
    return encoding.vocabulary(examples, ["input", "output"])


@query("vocab", _with_examples("SELECT token, n, id FROM vocab", _VOCAB))
def vocab(spark, folder):
    return _vocab(_examples(spark, folder))


def _ids(column: str, limit: int) -> str:
    return (
        "(SELECT database_id, task, copy, string_agg(CAST(coalesce(v.id, 2) AS VARCHAR), ',' "
        "ORDER BY i) AS ids, count(*) AS n FROM (SELECT database_id, task, copy, "
        f"unnest(({_tokens(column)})[1:{limit - 1}]) AS token, "
        f"unnest(range(1, len(({_tokens(column)})[1:{limit - 1}]) + 1)) AS i FROM examples) t "
        "LEFT JOIN vocab v ON t.token = v.token GROUP BY 1, 2, 3)"
    )


@query(
    "encode",
    _with_examples(
        "SELECT e.database_id, e.task, e.copy, md5(coalesce(a.ids || ',', '') || '1') AS input_md5, "
        "coalesce(a.n, 0) + 1 AS input_length, coalesce(b.ids || ',', '') || '1' AS labels "
        f"FROM examples e LEFT JOIN {_ids('input', 512)} a USING (database_id, task, copy) "
        f"LEFT JOIN {_ids('output', 128)} b USING (database_id, task, copy)",
        _VOCAB,
    ),
)
def encode(spark, folder):
    examples = _examples(spark, folder)
    encoded = encoding.encode(examples, _vocab(examples))
    return encoded.select(
        "database_id",
        "task",
        F.col("copy").cast("bigint").alias("copy"),
        F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("input_md5"),
        F.size("attention_mask").cast("bigint").alias("input_length"),
        F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"),
    )


# --- streams ----------------------------------------------------------------------------------


def _review_stream(spark: SparkSession, folder: str) -> DataFrame:
    return review_view(document_stream(spark, folder), table(spark, folder, "labels"))


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_enrich", _ENRICHED_SQL)
def stream_enrich(spark, folder):
    """Documents replayed as a stream, enriched and stored; the current state of the store."""
    run = _run_folder(spark)
    detect = language.detector(_profile(spark, folder))
    jobs.start_enrichment(
        _review_stream(spark, folder), f"{run}/store", f"{run}/checkpoint", detect
    ).awaitTermination()
    return _flat_enrichment(jobs.current_enrichment(spark, f"{run}/store"))


@query("stream_scope_summary", Q.summary())
def stream_scope_summary(spark, folder):
    """Documents replayed as a stream into running counters; the summary read from them."""
    run = _run_folder(spark)
    jobs.start_counters(
        _review_stream(spark, folder), f"{run}/store", f"{run}/checkpoint"
    ).awaitTermination()
    return flat_summary(jobs.current_summary(spark, f"{run}/store"))


@query("stream_latest_summary", Q.summary())
def stream_latest_summary(spark, folder):
    """Documents replayed as a stream that delivers each of them twice; a review counts once."""
    run, stream = _run_folder(spark), _review_stream(spark, folder)
    jobs.start_scored(
        stream.unionByName(_review_stream(spark, folder)), f"{run}/store", f"{run}/checkpoint"
    ).awaitTermination()
    return flat_summary(jobs.latest_summary(spark, f"{run}/store"))

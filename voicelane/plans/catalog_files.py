"""Queries that write whole tables to the shared folder and read them back with the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelane import fixed_values as V
from voicelane.operators import bayes, numbering
from voicelane.operators import merge as M
from voicelane.operators import training as TR
from voicelane.plans import check_sql as Q
from voicelane.plans.catalog_rows import _hits, _list
from voicelane.plans.registry import query
from voicelane.plans.reviews import reviews
from voicelane.schema import ALL_RATINGS
from voicelane.session import shared_folder
from voicelane.sources import readers, writers

_RATINGS = ", ".join(ALL_RATINGS)


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "file_hits",
    Q.with_reviews(
        f"SELECT database_id, md5({Q.strip('review')}) AS review_md5, {_RATINGS}, provider, "
        f"location, renter FROM reviews_v WHERE length({Q.strip('review')}) > 0"
    ),
)
def file_hits(spark, folder):
    """An export of hits, one per line, read from files."""
    path = _new_folder(spark, "hits")
    _hits(spark, folder).select("hit.*").write.json(path)
    return readers.read_hits(spark, path, json_array=False).select(
        "database_id", F.md5("review").alias("review_md5"), *ALL_RATINGS, "provider", "location", "renter"
    )


def _export(rows: DataFrame, party: str, path: str) -> None:
    columns = [F.col("database_id").alias("_id"), F.col(party), F.col("review").alias("renterQuote")]
    columns += [F.col(ours).alias(theirs) for theirs, ours in readers.EXPORT_RATINGS.items()]
    rows.select(*columns).write.options(header=True, quoteAll=True, escape='"').csv(path)


@query(
    "file_csv",
    Q.with_reviews(
        f"SELECT database_id, md5({Q.strip('review')}) AS review_md5, {_RATINGS}, "
        "CASE WHEN database_id % 2 = 0 THEN provider END AS provider, "
        "CASE WHEN database_id % 2 = 1 THEN renter END AS renter "
        f"FROM reviews_v WHERE length({Q.strip('review')}) > 0"
    ),
)
def file_csv(spark, folder):
    """A folder of exports with different headers: some name the provider, some the renter."""
    path, rows = _new_folder(spark, "exports"), reviews(spark, folder)
    _export(rows.filter("database_id % 2 = 0"), "provider", f"{path}/providers")
    _export(rows.filter("database_id % 2 = 1"), "renter", f"{path}/renters")
    found = readers.csv_rows(spark, f"{path}/*")
    return readers.csv_to_reviews(found, ["provider", "renter"]).select(
        "database_id", F.md5("review").alias("review_md5"), *ALL_RATINGS, "provider", "renter"
    )


@query(
    "src_raw",
    Q.with_reviews("SELECT md5(review) AS review_md5, count(*) AS n FROM reviews_v GROUP BY review"),
)
def src_raw(spark, folder):
    """Raw reviews, one object per line."""
    path = _new_folder(spark, "raw")
    reviews(spark, folder).select("review").write.json(path)
    rows = readers.read_raw_reviews(spark, path, json_array=False)
    return rows.groupBy(F.md5("review").alias("review_md5")).agg(F.count("*").alias("n"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    rows = reviews(spark, folder).filter(F.col("sentiment").isNotNull())
    return rows.select("database_id", F.col("review").alias("review_body"), "sentiment", "categories")


@query(
    "append_labelled",
    Q.with_reviews(
        "SELECT md5(review) AS body_md5, sentiment, array_to_string(categories, ' | ') AS categories, "
        "count(*) AS n FROM reviews_v WHERE sentiment IS NOT NULL GROUP BY review, sentiment, categories"
    ),
)
def append_labelled(spark, folder):
    """Labelled rows appended in two runs, read from the first path that exists."""
    path, rows = _new_folder(spark, "labelled"), _labelled(spark, folder)
    for part in (0, 1):
        writers.append_labelled(rows.filter(F.pmod("database_id", F.lit(2)) == part), path)
    found = readers.read_labelled(spark, [f"{path}-missing", path])
    key = [F.md5("review_body").alias("body_md5"), "sentiment", _list("categories").alias("categories")]
    return found.select(*key).groupBy("body_md5", "sentiment", "categories").agg(F.count("*").alias("n"))


@query(
    "resume_from_file",
    Q.with_reviews(
        "SELECT database_id FROM reviews_v WHERE NOT (length(review) < 20 OR "
        f"{Q.any_word('lower(review)', V.SPAM_PHRASES)}) AND review NOT IN "
        "(SELECT review FROM reviews_v WHERE sentiment IS NOT NULL)"
    ),
)
def resume_from_file(spark, folder):
    """Reviews still to label after an earlier run, by whole texts; lines of its output that are cut
    off are skipped."""
    path = _new_folder(spark, "done")
    rows = _labelled(spark, folder)
    writers.append_labelled(rows, path)
    cut = rows.select(F.concat(F.lit('{"review_body": "'), F.substring("review_body", 1, 5)).alias("value"))
    cut.select(F.regexp_replace("value", r"[\r\n]", " ").alias("value")).write.mode("append").text(path)
    done = readers.read_done(spark, path)
    return M.resume(reviews(spark, folder), done, key_chars=None).select("database_id")


@query(
    "publish_dataset",
    Q.with_reviews(
        "SELECT database_id, sentiment, (SELECT count(*) FROM reviews_v) AS rows, 2 AS columns FROM reviews_v"
    ),
)
def publish_dataset(spark, folder):
    """A dataset published twice; the second one replaces the first."""
    path, rows = _new_folder(spark, "published"), reviews(spark, folder).select("database_id", "sentiment")
    writers.publish(rows.filter("database_id % 2 = 0").withColumn("old", F.lit(1)), path)
    count, schema = writers.publish(rows, path)
    found = spark.read.parquet(path)
    return found.select(
        "database_id", "sentiment", F.lit(count).cast("bigint").alias("rows"), F.lit(len(schema)).alias("columns")
    )


@query(
    "size_gate",
    Q.with_reviews(
        f"SELECT train, train > {V.MIN_TRAIN_ROWS} AS enough FROM (SELECT count(*) FILTER (WHERE "
        f"NOT ({Q.md5_bucket(chr(39) + '42|' + chr(39) + ' || review', 10)} = 0)) AS train FROM reviews_v)"
    ),
)
def size_gate(spark, folder):
    """Whether there is enough to train on; the gate raises where there is not."""
    split = reviews(spark, folder).select(numbering.split_hash(F.col("review")).alias("split"))
    rows = TR.dataset_counts(split).select("train")
    try:
        TR.require_size(split)
        enough = True
    except TR.DatasetTooSmall:
        enough = False
    return rows.withColumn("enough", F.lit(enough))


def _bayes_sql() -> str:
    cells = bayes._cells()
    labels = [f"CAST(list_contains(categories, {Q.text(c)}) AS BIGINT)" for c in V.CATEGORIES]
    labels.append(f"list_position({Q.text_list(V.SENTIMENTS)}, sentiment) - 1")
    side = f"CASE WHEN {Q.md5_bucket(chr(39) + '42|' + chr(39) + ' || review', 10)} = 0 THEN 'test' ELSE 'train' END"
    names = ", ".join(f"{label} AS y{t}" for t, label in enumerate(labels))
    pieces = "list_filter(regexp_split_to_array(lower(review), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"

    def per_cell(form: str) -> str:
        return ", ".join(form.format(t=t, y=y, n=n, k=bayes.TASKS[t][1]) for t, y, n in cells)

    def weight(part: str, whole: str) -> str:
        return f"CAST(round_even(ln(({part}) / CAST({whole} AS DOUBLE)) * 1000, 0) AS BIGINT)"

    predicted = []
    for t, (_, count) in enumerate(bayes.TASKS):
        scores = [f"s{t}_{y}" for y in range(count)]
        highest = f"greatest({', '.join(scores)})"
        cases = " ".join(f"WHEN {s} = {highest} THEN {y}" for y, s in enumerate(scores))
        predicted.append(f"CASE {cases} END AS p{t}")
    report = " UNION ALL ".join(
        f"SELECT {Q.text(name)} AS task, y{t} AS label, p{t} = y{t} AS right_ FROM guessed"
        for t, (name, _) in enumerate(bayes.TASKS)
    )
    return Q.with_reviews(
        f""", used AS (SELECT database_id, {side} AS split, {pieces} AS words, {names} FROM reviews_v
    WHERE {Q.PRECOMPUTED}),
  tokens AS (SELECT database_id, token, count(*) AS n FROM
    (SELECT database_id, unnest(words) AS token FROM used) GROUP BY ALL),
  counts AS (SELECT token, {per_cell('coalesce(sum(n) FILTER (WHERE y{t} = {y}), 0) AS {n}')}
    FROM tokens JOIN used USING (database_id) WHERE split = 'train' GROUP BY token),
  totals AS (SELECT count(*) AS size, {per_cell('sum({n}) AS {n}')} FROM counts),
  docs AS (SELECT count(*) AS size, {per_cell('count(*) FILTER (WHERE y{t} = {y}) AS {n}')}
    FROM used WHERE split = 'train'),
  weights AS (SELECT token, {per_cell(weight('c.{n} + 1', '(t.{n} + t.size)') + ' AS {n}')}
    FROM counts c, totals t),
  sums AS (SELECT database_id, {per_cell('sum(k.n * w.{n}) AS {n}')}
    FROM tokens k JOIN weights w USING (token) GROUP BY database_id),
  scores AS (SELECT u.*, {per_cell('coalesce(s.{n}, 0) + ' + weight('d.{n} + 1', '(d.size + {k})') + ' AS s{t}_{y}')}
    FROM used u LEFT JOIN sums s USING (database_id), docs d WHERE split = 'test'),
  guessed AS (SELECT *, {', '.join(predicted)} FROM scores),
  report AS ({report}),
  per_label AS (SELECT task, label, count(*) AS n, count(*) FILTER (WHERE right_) AS good FROM report GROUP BY ALL)
  SELECT task, CAST(sum(n) AS BIGINT) AS test_rows, sum(good) / sum(n) AS accuracy, max(n) / sum(n) AS majority
  FROM per_label GROUP BY task"""
    )


@query("train_eval", _bayes_sql())
def train_eval(spark, folder):
    """Held-out accuracy of all classifiers."""
    rows = reviews(spark, folder).select("database_id", "review", "sentiment", "categories")
    return bayes.evaluate(rows)

"""The review table the queries run on, bound to the given tables.

No review table is among them, so one is derived row by row: text from ``documents``, scope from its
source and language, scores from ``labels``, ratings by integer arithmetic on the id. One wording
of the view serves Spark and the checking database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voicelane.fixed_values import CATEGORIES
from voicelane.operators.scoring import score_reviews


def _category(expression: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(CATEGORIES))
    return f"CASE {expression} {cases} END"


VIEW = f"""
SELECT d.doc_id AS database_id, d.doc_id AS ordinal,
  concat(d.text, ' ', CASE d.doc_id % 9
    WHEN 0 THEN 'the seats were filthy' WHEN 1 THEN 'bald tires'
    WHEN 2 THEN 'long queue at the counter' WHEN 3 THEN 'drop-off took ages'
    WHEN 4 THEN 'a surcharge on the invoice' WHEN 5 THEN 'pushed to buy a waiver'
    WHEN 6 THEN 'rude staff' WHEN 7 THEN 'the website had a glitch' ELSE '' END) AS review,
  d.source AS provider,
  CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE concat('city_', d.lang) END AS location,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL
       ELSE concat('renter_', CAST(d.doc_id % 5 AS VARCHAR(5))) END AS renter,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL
       ELSE CAST((d.doc_id % 97) % 5 + 1 AS DOUBLE) END AS car_condition_rating,
  CASE WHEN d.doc_id % 6 = 0 THEN NULL
       ELSE CAST((d.doc_id % 89) % 5 + 1 AS DOUBLE) END AS processing_speed_rating,
  CASE WHEN d.doc_id % 10 = 0 THEN NULL
       ELSE CAST(d.doc_id * 11 % 9 AS DOUBLE) / 2 + 1 END AS service_level_rating,
  CASE WHEN d.doc_id % 8 = 0 THEN NULL
       ELSE CAST(d.doc_id * 13 % 11 AS DOUBLE) END AS recommendation_rating,
  CASE WHEN l.doc_id IS NULL THEN NULL
       WHEN l.toxic = 1 OR (l.quality = 1 AND d.doc_id % 3 = 0) THEN 'negative'
       WHEN l.quality = 1 THEN 'positive' ELSE 'mixed' END AS sentiment,
  CASE WHEN l.doc_id IS NULL THEN NULL ELSE split(concat_ws(';',
    {_category('d.doc_id % 8')},
    CASE WHEN d.doc_id % 5 <> 0 THEN {_category('(d.doc_id * 3 + 1) % 8')} END,
    CASE WHEN d.doc_id % 4 = 1 THEN {_category('(d.doc_id + d.doc_id % 7) % 8')} END), ';')
  END AS categories
FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """All cores for a table that is a single split, so at most ``maxPartitionBytes`` of it are moved.

    Any other table is read as it is: no text is shuffled, whatever the number of cores.
    """
    wanted = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(wanted, key) if rows.rdd.getNumPartitions() == 1 else rows


def review_view(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The view over given (also streaming) documents and labels."""
    return documents.sparkSession.sql(VIEW, documents=documents, labels=labels)


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(table(spark, folder, "documents"), "doc_id")
    return review_view(documents, table(spark, folder, "labels"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """All reviews with sentiment and categories, from the labels or the built-in scorer."""
    return score_reviews(reviews(spark, folder))


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as a stream of files."""
    schema = table(spark, folder, "documents").schema
    # The brackets make the path a pattern, which the file source takes for files and folders alike.
    return spark.readStream.schema(schema).parquet(f"{folder}/documents.parque[t]")

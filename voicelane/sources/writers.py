"""Writers: request payloads, labelled rows, published datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voicelane import fixed_values as V
from voicelane.functions.text import empty_to_null
from voicelane.operators.numbering import chunk_ids
from voicelane.schema import ALL_RATINGS

_PAYLOAD_FIELDS = ["review", "database_id", *ALL_RATINGS]
AGGREGATE_CHUNK = 1_000  # reviews per aggregate payload
_KEEP_NULLS = {"ignoreNullFields": "false"}


def review_json() -> Column:
    """One review as JSON; missing ratings stay as ``null``."""
    return F.to_json(F.struct(*_PAYLOAD_FIELDS), _KEEP_NULLS)


def _ordered_reviews(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Reviews of each chunk as one JSON list. A chunk has a fixed size, so lists are bounded."""
    entries = F.array_sort(F.collect_list(F.struct(order, review_json().alias("json"))))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(entries, lambda e: e["json"]), ",").alias("list")
    )


def payload_batch(
    reviews: DataFrame, order: str = "ordinal", within: Sequence[str] = (), size: int = V.CHUNK_SIZE
) -> DataFrame:
    """Batch payloads ``{"reviews":[...]}`` of at most ``size`` consecutive reviews."""
    chunks = chunk_ids(reviews, order, within, size)
    return _ordered_reviews(chunks, [*within, "chunk"], order).select(
        *within, "chunk", F.concat(F.lit('{"reviews":['), "list", F.lit("]}")).alias("payload")
    )


def _scope_key(name: str) -> Column:
    """``,"name":"value"``, or nothing where the value is null or empty."""
    value = empty_to_null(F.col(name))
    # An object with one key, without its braces, escapes the value as JSON does.
    text = F.to_json(F.struct(value.alias(name)))
    inner = F.regexp_extract(text, r"(?s)^\{(.*)\}$", 1)
    return F.when(value.isNotNull(), F.concat(F.lit(","), inner)).otherwise("")


def payload_aggregate(
    reviews: DataFrame,
    scope: Sequence[str] = ("provider", "renter"),
    order: str = "ordinal",
    size: int = AGGREGATE_CHUNK,
) -> DataFrame:
    """Aggregate payloads: nulls stay inside reviews, scope keys without a value are left out.

    A scope of any size is written as numbered chunks, since one text for a whole large scope fits
    in no task; ``size`` decides how many reviews share a payload.
    """
    chunks = chunk_ids(reviews, order, scope, size)
    keys = F.concat(*[_scope_key(name) for name in scope])
    return _ordered_reviews(chunks, [*scope, "chunk"], order).select(
        *scope,
        "chunk",
        F.concat(F.lit('{"reviews":['), "list", F.lit("]"), keys, F.lit("}")).alias("payload"),
    )


def write_reviews(reviews: DataFrame, path: str) -> None:
    """One review per line, missing values as ``null``."""
    reviews.select(*_PAYLOAD_FIELDS).write.option("ignoreNullFields", "false").json(path)


def append_labelled(rows: DataFrame, path: str) -> None:
    rows.select("review_body", "sentiment", "categories").write.mode("append").option(
        "ignoreNullFields", "false"
    ).json(path)


def publish(rows: DataFrame, path: str) -> tuple[int, T.StructType]:
    """Replace a published dataset as a whole; returns its row count and schema."""
    rows.write.mode("overwrite").parquet(path)
    published = rows.sparkSession.read.parquet(path)
    return published.count(), published.schema

"""Stored completions of a text model: unfencing, parsing, repair, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelane import fixed_values as V
from voicelane.functions import labels as L
from voicelane.functions.matching import bound
from voicelane.functions.text import strip, strip_fence
from voicelane.schema import LABELLED

_LABELLED_DDL = "struct<review_body:string,sentiment:string,categories:array<string>>"


# Follows a text that should be one JSON value; the parser itself stops after the first value.
_END = "voicelane: end of text"


def whole_json(text: Column) -> Column:
    """The JSON value that a text is as a whole, or null. Of a repeated key the last value counts.

    The text becomes the first of two elements of an array, which must then have just these two.
    """
    session = SparkSession.getActiveSession()
    if session is not None:
        session.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))

    def only(pair: Column) -> Column:
        second = F.try_variant_get(pair, "$[1]", "string") == _END
        more = F.try_variant_get(pair, "$[2]", "variant").isNotNull()
        return F.when(second & ~more, F.try_variant_get(pair, "$[0]", "variant"))

    return bound(both, only)


def parse_label_reply(text: Column) -> Column:
    """A reply as a labelled review, or null where it has to be rejected.

    Rejected: text that is no JSON object or has something after it, a missing key, categories that
    cannot be iterated (null, number, boolean). An unknown sentiment and unknown categories are
    repaired; of a repeated key the last value counts.
    """
    return bound(whole_json(strip_fence(text)), _label_of)


def _label_of(reply: Column) -> Column:
    keys = F.try_variant_get(reply, "$", "map<string,variant>")
    complete = F.startswith(F.schema_of_variant(reply), F.lit("OBJECT")) & bound(
        F.map_keys(keys),
        lambda found: F.array_contains(found, "review_body")
        & F.array_contains(found, "sentiment")
        & F.array_contains(found, "categories"),
    )
    kind = F.schema_of_variant(F.try_variant_get(reply, "$.categories", "variant"))
    # Text is iterable too but holds no category name; an object is iterated by its keys.
    names = bound(
        kind,
        lambda k: F.when(
            F.startswith(k, F.lit("ARRAY")),
            F.try_variant_get(reply, "$.categories", "array<string>"),
        )
        .when(
            F.startswith(k, F.lit("OBJECT")),
            F.map_keys(F.try_variant_get(reply, "$.categories", "map<string,variant>")),
        )
        .when(k == "STRING", F.array().cast("array<string>")),
    )
    body = F.try_variant_get(reply, "$.review_body", "string")
    sentiment = F.try_variant_get(reply, "$.sentiment", "string")
    return bound(
        F.when(F.coalesce(complete, F.lit(False)), names),
        lambda found: F.when(
            found.isNotNull(),
            F.struct(
                body.alias("review_body"),
                L.repair_sentiment(sentiment).alias("sentiment"),
                L.repair_categories(found).alias("categories"),
            ),
        ),
    ).cast(_LABELLED_DDL)


def completion_lines(completions: DataFrame) -> DataFrame:
    """Trimmed lines that start with ``{``, one row each."""
    lines = F.transform(F.split(F.col("text"), V.LINE_BREAKS), strip)
    objects = F.filter(lines, lambda line: F.startswith(line, F.lit("{")))
    kept = [c for c in completions.columns if c != "text"]
    return completions.select(*kept, F.posexplode(objects).alias("line_no", "line"))


def _line_ok(line: Column) -> Column:
    return whole_json(line).isNotNull()


def accept_batches(lines: DataFrame, by: list[str], requested: str = "requested_n") -> DataFrame:
    """Batches whose lines all parse and number at least half of what was asked for."""
    return (
        lines.groupBy(*by)
        .agg(
            F.every(_line_ok(F.col("line"))).alias("all_ok"),
            F.count("*").alias("lines"),
            F.max(requested).alias("requested"),
        )
        .filter(F.col("all_ok") & (F.col("lines") >= F.floor(F.col("requested") / 2)))
        .select(*by, "lines")
    )


def first_valid(replies: DataFrame, key: str = "request_id") -> DataFrame:
    """Per request the first attempt (of at most three) whose reply is valid."""
    return (
        replies.filter((F.col("attempt") < V.MAX_ATTEMPTS) & F.col("label").isNotNull())
        .groupBy(key)
        .agg(F.min_by("label", "attempt").alias("label"))
        .select(key, "label.*")
    )


def ingest_label_completions(completions: DataFrame) -> DataFrame:
    """Stored label replies to labelled reviews."""
    return first_valid(
        completions.select(
            "request_id", "attempt", parse_label_reply(F.col("text")).alias("label")
        )
    )


def ingest_generated(completions: DataFrame) -> DataFrame:
    """Stored generation replies to labelled reviews: the lines of the first accepted attempt.

    Whether an attempt is accepted is decided inside its row, so nothing but accepted lines moves.
    """
    lines = F.filter(
        F.transform(F.split(F.col("text"), V.LINE_BREAKS), strip),
        lambda line: F.startswith(line, F.lit("{")),
    )
    judged = completions.filter(F.col("attempt") < V.MAX_ATTEMPTS).select(
        "request_id", "attempt", "requested_n", lines.alias("lines")
    )
    accepted = judged.filter(
        F.forall("lines", _line_ok)
        & (F.size("lines") >= F.floor(F.col("requested_n") / 2))
    )
    first = accepted.groupBy("request_id").agg(F.min_by("lines", "attempt").alias("lines"))
    return first.select("request_id", F.posexplode("lines").alias("line_no", "line")).select(
        "request_id", "line_no", F.from_json("line", LABELLED).alias("label")
    ).select("request_id", "line_no", "label.*")

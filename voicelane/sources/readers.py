"""Readers: search-index hits, CSV exports, request payloads, raw and labelled review files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelane.functions.text import (
    csv_bigint,
    csv_double,
    csv_is_junk,
    first_of,
    is_blank,
    strip,
)
from voicelane.schema import CSV_COLUMNS, EXPORT_RATINGS, HIT, LABELLED, RAW_REVIEW, REQUEST

CSV_MOST_COLUMNS = 64
_ROW_BITS = 33  # the bits of a generated id that count rows inside one task


def file_order() -> Column:
    """Position of a row inside its file, right after the scan.

    The start of the file split (in MiB) above the row count inside the task: ordered inside a file,
    and unique per file as splits start at least 1 MiB apart.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    split = F.shiftright(F.col("_metadata.file_block_start"), 20)
    return F.shiftleft(split, _ROW_BITS).bitwiseOR(row)


def _located(rows: DataFrame) -> DataFrame:
    return rows.select(
        "*", F.col("_metadata.file_path").alias("source_file"), file_order().alias("ordinal")
    )


def hits_to_reviews(hits: DataFrame, keep: Sequence[str] = ("ordinal",)) -> DataFrame:
    """Search-index hits to reviews: first value of every field, trimmed text, blank ones dropped."""
    field = {name: first_of(F.col(f"fields.{name}")) for name in HIT["fields"].dataType.names}
    return hits.filter(~is_blank(field["renterQuote"])).select(
        *keep,
        strip(field["renterQuote"]).alias("review"),
        field["databaseId"].alias("database_id"),
        *[field[name].alias(alias) for name, alias in EXPORT_RATINGS.items()],
        *[field[c].alias(c) for c in ("provider", "location", "renter")],
    )


def read_hits(spark: SparkSession, path: str, json_array: bool = True) -> DataFrame:
    """An export as one JSON array per file, or (splittable, for large ones) one hit per line."""
    hits = spark.read.schema(HIT).option("multiLine", json_array).json(path)
    return hits_to_reviews(_located(hits), ["source_file", "ordinal"])


def _csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """Column names of each file, from its first line: one row per file."""
    first = F.min_by("value", "ordinal")
    lines = _located(spark.read.text(path))
    names = F.transform(
        F.split(F.regexp_replace("value", "^\ufeff", ""), ","), lambda n: F.trim(F.trim(n), F.lit('"'))
    )
    return lines.groupBy("source_file").agg(first.alias("value")).select("source_file", names.alias("_names"))


def csv_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV export rows as text by header name; columns an export lacks are null.

    Each file of a folder is read by its own header (of at most ``CSV_MOST_COLUMNS`` names). Records
    may have line breaks inside, so a file is one task; ``multi_line=False`` splits large files whose
    records have none.
    """
    fields = [f"_c{i}" for i in range(CSV_MOST_COLUMNS)]
    rows = (
        spark.read.schema(", ".join(f"{name} string" for name in fields))
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )
    # One row per file, small next to any of its files.
    named = _located(rows).join(F.broadcast(_csv_headers(spark, path)), "source_file")

    def value(name: str) -> Column:
        # Of columns with the same name the first counts.
        return F.get(F.array(*fields), (F.array_position("_names", name) - 1).cast("int")).alias(name)

    return named.select(*[value(c) for c in CSV_COLUMNS], "source_file", "ordinal")


def csv_to_reviews(rows: DataFrame, keep: Sequence[str] = ("ordinal",)) -> DataFrame:
    """Typed reviews from CSV text rows; a number that cannot be read fails the job."""
    return rows.filter(~is_blank(F.col("renterQuote"))).select(
        *keep,
        strip(F.col("renterQuote")).alias("review"),
        csv_bigint(F.col("_id")).alias("database_id"),
        *[csv_double(F.col(name)).alias(alias) for name, alias in EXPORT_RATINGS.items()],
    )


def split_junk(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, quarantined) CSV rows, for callers that prefer not to fail on bad numbers."""
    junk = csv_is_junk(F.col("_id"))
    for name in EXPORT_RATINGS:
        junk = junk | csv_is_junk(F.col(name))
    return rows.filter(~junk), rows.filter(junk)


def read_csv_export(spark: SparkSession, path: str) -> DataFrame:
    return csv_to_reviews(csv_rows(spark, path), ["source_file", "ordinal"])


def requests_to_reviews(
    requests: DataFrame, payload: str = "payload", keep: Sequence[str] = ()
) -> DataFrame:
    """One row per review of each JSON request, with its scope and place in the request.

    A request without reviews gives one row whose ordinal is null, so its scope is not lost.
    """
    parsed = requests.select(*keep, F.from_json(payload, REQUEST).alias("request"))
    return parsed.select(
        *keep,
        F.col("request.provider").alias("provider"),
        F.col("request.location").alias("location"),
        F.col("request.renter").alias("renter"),
        F.posexplode_outer("request.reviews").alias("position", "_review"),
    ).select(
        *keep,
        "provider",
        "location",
        "renter",
        F.col("position").cast("bigint").alias("ordinal"),
        "_review.*",
    )


def read_raw_reviews(spark: SparkSession, path: str, json_array: bool = True) -> DataFrame:
    """Objects with a ``review``: a JSON array per file, or (splittable) one object per line."""
    return _located(spark.read.schema(RAW_REVIEW).option("multiLine", json_array).json(path))


def read_labelled(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Labelled reviews, one per line, from the first path that exists."""
    missing: AnalysisException | None = None
    for path in paths:
        try:
            return spark.read.schema(LABELLED).json(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing = error
    raise missing or ValueError("no path given")


def read_done(spark: SparkSession, path: str) -> DataFrame:
    """Earlier output of a labelling run; lines that cannot be read are skipped, a missing file
    means that nothing is done."""
    try:
        rows = spark.read.schema(LABELLED).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], LABELLED)
    return rows.filter(F.col("review_body").isNotNull())

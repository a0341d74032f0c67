"""Declared schemas. Every reader uses one of these, so no read infers types."""

from pyspark.sql import types as T


def _fields(**types: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, dtype, True) for name, dtype in types.items()]


_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_STRINGS = T.ArrayType(_S)

SCOPE = ["provider", "location", "renter"]
RATINGS = ["car_condition_rating", "processing_speed_rating", "service_level_rating"]
ALL_RATINGS = [*RATINGS, "recommendation_rating"]

# One review as a caller sends it.
REVIEW = T.StructType(
    _fields(
        review=_S,
        database_id=_L,
        car_condition_rating=_D,
        processing_speed_rating=_D,
        service_level_rating=_D,
        recommendation_rating=_D,
        sentiment=_S,
        categories=_STRINGS,
    )
)

# A request: reviews plus the scope they belong to. Keys not named here are ignored.
REQUEST = T.StructType(
    [
        *_fields(provider=_S, location=_S, renter=_S),
        T.StructField("reviews", T.ArrayType(REVIEW), True),
    ]
)

# What enrichment adds to a stored review.
ENRICHED = T.StructType(
    _fields(
        database_id=_L,
        language=_S,
        sentiment=_S,
        primary_category=_S,
        categories=_STRINGS,
        has_damage_claim=_B,
        has_hidden_fees=_B,
        has_upselling=_B,
    )
)

# Search-index hit: every value is wrapped in an array. Customer names stay out of the schema.
HIT = T.StructType(
    [
        T.StructField("_id", _S, True),
        T.StructField(
            "fields",
            T.StructType(
                _fields(
                    databaseId=T.ArrayType(_L),
                    renterQuote=_STRINGS,
                    carConditionRating=T.ArrayType(_D),
                    processingSpeedRating=T.ArrayType(_D),
                    serviceLevelRating=T.ArrayType(_D),
                    recommendationRating=T.ArrayType(_D),
                    provider=_STRINGS,
                    location=_STRINGS,
                    renter=_STRINGS,
                )
            ),
            True,
        ),
    ]
)

# Export column -> review column.
EXPORT_RATINGS = {
    "carConditionRating": "car_condition_rating",
    "processingSpeedRating": "processing_speed_rating",
    "serviceLevelRating": "service_level_rating",
    "recommendationRating": "recommendation_rating",
}
CSV_COLUMNS = ["_id", "renterQuote", *EXPORT_RATINGS, "provider", "renter"]

LABELLED = T.StructType(_fields(review_body=_S, sentiment=_S, categories=_STRINGS))
RAW_REVIEW = T.StructType(_fields(review=_S))
COMPLETION = T.StructType(
    _fields(request_id=_L, attempt=_L, requested_n=_L, text=_S)
)

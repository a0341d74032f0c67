"""Review classifiers by exact counts (multinomial naive Bayes): one per category, one for sentiment.

Weights are whole thousandths of a natural logarithm, so sums are exact in any order and a query can
check them. A token is one row with a counter per label of every classifier; nothing iterates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelane import fixed_values as V
from voicelane.functions import labels as L
from voicelane.operators.numbering import split_hash

SCALE = 1000
#: Classifier name and its labels; a category has label 1 where a review lists it.
TASKS = [*[(c, 2) for c in V.CATEGORIES], ("sentiment", len(V.SENTIMENTS))]


def labelled_rows(reviews: DataFrame, key: str = "database_id") -> DataFrame:
    """Reviews with usable labels: key, text, side of the hash split, ``labels`` in task order."""
    usable = reviews.filter(L.is_precomputed(F.col("sentiment"), F.col("categories")))
    of_category = [F.array_contains("categories", c).cast("int") for c in V.CATEGORIES]
    sentiment = F.array_position(F.array(*[F.lit(s) for s in V.SENTIMENTS]), F.col("sentiment")) - 1
    return usable.select(
        F.col(key).alias("key"),
        "review",
        split_hash(F.col("review")).alias("split"),
        F.array(*of_category, sentiment.cast("int")).alias("labels"),
    )


def _token_counts(rows: DataFrame, *keep: str) -> DataFrame:
    pieces = F.split(F.lower(F.coalesce("review", F.lit(""))), r"[^\p{L}\p{N}]+")
    tokens = rows.select("key", *keep, F.explode(pieces).alias("token")).filter("token <> ''")
    return tokens.groupBy("key", *keep, "token").agg(F.count("*").alias("n"))


def _cells() -> list[tuple[int, int, str]]:
    return [(t, y, f"c{t}_{y}") for t, (_, labels) in enumerate(TASKS) for y in range(labels)]


def train(rows: DataFrame) -> DataFrame:
    """The model as a table: a row per token (null: no token) with a weight per task and label.

    ``rows``: as :func:`labelled_rows` gives them. Weights are smoothed by one per token and label;
    the row without token has the priors. Two small rows of totals pass the driver.
    """

    def sums(value: Column) -> list[Column]:
        return [
            F.coalesce(F.sum(F.when(F.get("labels", F.lit(t)) == y, value)), F.lit(0)).alias(name)
            for t, y, name in _cells()
        ]

    counts = _token_counts(rows, "labels").groupBy("token").agg(*sums(F.col("n")))
    totals = counts.agg(F.count("*").alias("size"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for *_, n in _cells()])
    total = totals.first()
    docs = rows.agg(F.count("*").alias("size"), *sums(F.lit(1))).first()

    def weight(part: Column, whole: float) -> Column:
        return F.bround(F.log(part / F.lit(float(whole))) * SCALE, 0).cast("bigint")

    weights = counts.select(
        "token", *[weight(F.col(n) + 1, total[n] + total["size"]).alias(n) for *_, n in _cells()]
    )
    priors = [
        weight(F.lit(float(docs[n] + 1)), docs["size"] + TASKS[t][1]).alias(n) for t, _, n in _cells()
    ]
    prior = rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("token"), *priors)
    return weights.unionByName(prior)


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def predict(rows: DataFrame, model: DataFrame, *keep: str) -> DataFrame:
    """``key`` and ``predicted`` (a label per task) of reviews (``key``, ``review``); of equal scores
    the first label. Tokens that the model does not know say nothing."""
    names = [n for *_, n in _cells()]
    prior = model.filter("token IS NULL").drop("token").select(*[F.col(n).alias(f"p_{n}") for n in names])
    prior_row = prior.first()
    known = model.filter("token IS NOT NULL")
    scored = _token_counts(rows).join(known, "token").groupBy("key")
    scored = scored.agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in names])
    joined = rows.select("key", *keep).join(scored, "key", "left")

    def best(task: int) -> Column:
        scores = [F.coalesce(F.col(n), F.lit(0)) + F.lit(prior_row[f"p_{n}"]) for t, _, n in _cells() if t == task]
        highest = F.greatest(*scores)
        return reduce(lambda a, y: F.when(scores[y] == highest, y).otherwise(a), reversed(range(len(scores))), F.lit(0))

    return joined.select("key", *keep, F.array(*[best(t) for t in range(len(TASKS))]).alias("predicted"))


def evaluate(reviews: DataFrame, key: str = "database_id") -> DataFrame:
    """Accuracy of each classifier on the test side next to the majority class: ``task``,
    ``test_rows``, ``accuracy``, ``majority``."""
    rows = labelled_rows(reviews, key)
    model = train(rows.filter("split = 'train'"))
    tested = predict(rows.filter("split = 'test'"), model, "labels")
    results = F.array(
        *[
            F.struct(
                F.lit(name).alias("task"),
                F.get("labels", F.lit(t)).alias("label"),
                (F.get("labels", F.lit(t)) == F.get("predicted", F.lit(t))).alias("right"),
            )
            for t, (name, _) in enumerate(TASKS)
        ]
    )
    per_label = tested.select(F.inline(results)).groupBy("task", "label")
    per_label = per_label.agg(F.count("*").alias("n"), F.count_if("right").alias("right"))
    return per_label.groupBy("task").agg(
        F.sum("n").alias("test_rows"),
        (F.sum("right") / F.sum("n")).alias("accuracy"),
        (F.max("n") / F.sum("n")).alias("majority"),
    )

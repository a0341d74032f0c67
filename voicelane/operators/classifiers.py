"""Review classifiers trained with Spark ML: one binary model per category, one for sentiment."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelane import fixed_values as V
from voicelane.functions import labels as L
from voicelane.operators.numbering import split_hash

FEATURES = 1 << 13
ITERATIONS = 10
REGULARISATION = 0.01
FITS_AT_ONCE = 3


@dataclass
class ReviewModels:
    """A fitted text pipeline with its classifiers."""

    features: PipelineModel
    categories: dict[str, LogisticRegressionModel]
    sentiment: LogisticRegressionModel

    def predict(self, featured: DataFrame) -> DataFrame:
        """Adds one ``p_<n>`` column per category (taxonomy order) and ``p_sentiment``."""
        out = featured
        for position, model in enumerate(self.categories.values()):
            out = _add(out, model, f"p_{position}")
        return _add(out, self.sentiment, "p_sentiment")

    def score(self, reviews: DataFrame) -> DataFrame:
        """``raw_categories`` and ``raw_sentiment`` of reviews, in the form scorers return."""
        out = self.predict(self.features.transform(reviews))
        names = F.array_compact(
            F.array(*[F.when(F.col(f"p_{i}") == 1.0, n) for i, n in enumerate(self.categories)])
        )
        sentiment = F.get(
            F.array(*[F.lit(s) for s in V.SENTIMENTS]), F.col("p_sentiment").cast("int")
        )
        return out.select(
            *reviews.columns,
            L.format_labels(names).alias("raw_categories"),
            sentiment.alias("raw_sentiment"),
        )


def _add(rows: DataFrame, model: LogisticRegressionModel, column: str) -> DataFrame:
    return model.setPredictionCol(column).setRawPredictionCol("").setProbabilityCol("").transform(rows)


def _sentiment_index(sentiment: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(s) for s in V.SENTIMENTS]), sentiment) - 1).cast(
        "double"
    )


def _logistic(family: str, label: str) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features",
        labelCol=label,
        family=family,
        maxIter=ITERATIONS,
        regParam=REGULARISATION,
    )


def _prepared(labelled: DataFrame) -> DataFrame:
    return labelled.filter(
        L.is_precomputed(F.col("sentiment"), F.col("categories"))
    ).select(
        "review",
        split_hash(F.col("review")).alias("split"),
        _sentiment_index(F.col("sentiment")).alias("y_sentiment"),
        *[
            F.array_contains("categories", c).cast("double").alias(f"y_{i}")
            for i, c in enumerate(V.CATEGORIES)
        ],
    )


def _text_pipeline() -> Pipeline:
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="review", outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="words", outputCol="tf", numFeatures=FEATURES),
            IDF(inputCol="tf", outputCol="features"),
        ]
    )


def _fit(featured: DataFrame, features: PipelineModel) -> ReviewModels:
    train = featured.filter(F.col("split") == "train")
    tasks = [("binomial", f"y_{i}") for i in range(len(V.CATEGORIES))]
    # The fits are independent and each leaves cores idle between its iterations.
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        fitted = list(
            pool.map(lambda t: _logistic(*t).fit(train), [*tasks, ("multinomial", "y_sentiment")])
        )
    return ReviewModels(features, dict(zip(V.CATEGORIES, fitted, strict=False)), fitted[-1])


def train(labelled: DataFrame) -> ReviewModels:
    """Fit on the training side of the hash split. ``labelled`` needs review, sentiment, categories."""
    return _train(_prepared(labelled))[0]


def _train(rows: DataFrame) -> tuple[ReviewModels, DataFrame]:
    features = _text_pipeline().fit(rows.filter(F.col("split") == "train"))
    # Nine fits iterate over the same vectors; kept on disk where memory runs out, rebuilt from
    # their lineage where an executor is lost.
    featured = features.transform(rows).drop("review", "words", "tf")
    featured.persist(StorageLevel.MEMORY_AND_DISK)
    return _fit(featured, features), featured


def train_eval(labelled: DataFrame) -> DataFrame:
    """Test-side accuracy of every classifier next to the majority class, in one pass."""
    models, featured = _train(_prepared(labelled))
    try:
        test = models.predict(featured.filter(F.col("split") == "test"))
        tasks = [*[(c, f"y_{i}", f"p_{i}") for i, c in enumerate(V.CATEGORIES)]]
        tasks.append(("sentiment", "y_sentiment", "p_sentiment"))
        results = F.array(
            *[
                F.struct(
                    F.lit(name).alias("task"),
                    F.col(y).cast("int").alias("label"),
                    (F.col(y) == F.col(p)).alias("right"),
                )
                for name, y, p in tasks
            ]
        )
        per_label = (
            test.select(F.inline(results))
            .groupBy("task", "label")
            .agg(F.count("*").alias("n"), F.count_if("right").alias("right"))
        )
        report = per_label.groupBy("task").agg(
            F.sum("n").alias("test_rows"),
            (F.sum("right") / F.sum("n")).alias("accuracy"),
            (F.max("n") / F.sum("n")).alias("majority"),
        )
        # Eighteen counters at most; taken now so that the vectors can be released.
        rows = report.orderBy("task").collect()
    finally:
        featured.unpersist()
    return labelled.sparkSession.createDataFrame(rows, report.schema)

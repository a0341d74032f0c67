"""Embedding whitening by a weighted multiplicity covariance.

Method: identical quantised vectors are grouped first (one row per distinct vector with its number of
copies), so a vector repeated a million times costs one row in every later pass. The fit weight of a
distinct vector is its number of copies, or one (``weighted=False``, each distinct vector counted once).
The covariance is a weighted, centred GEMM: the mean is found first, each task multiplies its slice of
centred vectors (``Y^T W Y``, dimension by dimension), and the per-task matrices are summed by Spark.
Only the ``d x d`` matrix reaches the driver, which takes its eigenvectors. Each distinct vector is then
whitened once and joined back to its rows.

Defined results:

* rows whose vector is null, empty, holds a null or a non-finite entry, or has another length than the
  most common one among the valid vectors are dropped;
* an empty input, or one whose fit list has no spread (one distinct vector), gives no rows: only
  components with a positive eigenvalue (above ``1e-12`` of the largest) are returned;
* null keys and repeated rows are kept, each row with its own output rows;
* only the key and the computed columns are returned, so other input columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelane.llm.common import discard, written

#: Scale and offset of the quantisation: ``x = floor(SCALE * c) + OFFSET``.
SCALE, OFFSET = 64, 1_000_000


def quantised(frame: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key`` and ``x`` (array of longs) for all rows with a whole, finite vector of the usual length."""
    finite = F.forall(
        F.col(f"`{vector}`"),
        lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != F.lit(float("inf"))),
    )
    valid = frame.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")).filter(
        F.col("v").isNotNull() & (F.size("v") > 0) & finite
    )
    common = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return valid.select("key", F.array().cast("array<bigint>").alias("x")).limit(0)
    x = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + OFFSET)
    return valid.filter(F.size("v") == common["d"]).select("key", x.alias("x"))


def _gram(columns: list[str], centre: np.ndarray | None, weighted: bool):
    """Per task: one row with the flattened weighted ``Y^T W Y`` of its vectors (centred on ``centre``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            y = values.reshape(batch.num_rows, -1)
            if centre is not None:
                y = y - centre
            w = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64) if weighted else None
            part = (y * w[:, None]).T @ y if weighted else y.T @ y
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["g"])

    return run


def _summed(fit: DataFrame, column: str, centre: np.ndarray | None, weighted: bool, d: int) -> np.ndarray:
    parts = fit.select(column, "copies").mapInArrow(_gram([column], centre, weighted), "g array<double>")
    cells = parts.select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    out = np.zeros(d * d)
    for row in cells:
        out[row["pos"]] = row["s"]
    return out.reshape(d, d)


def whitened(
    frame: DataFrame,
    vector: str = "embedding",
    key: str = "vec_id",
    components: int = 16,
    weighted: bool = False,
) -> DataFrame:
    """Rows ``key, component, n, deviation, whitened, explained, identity_error``.

    ``n`` is the total fit weight (distinct vectors when not ``weighted``), ``S`` the weighted sums of
    each dimension; the covariance ``V`` of ``x`` over the fit list has divisor ``n`` and is centred
    before multiplying. ``component`` counts from 1 by falling eigenvalue ``e``; the sign of each unit
    eigenvector makes its largest entry positive. ``whitened`` is ``(x - S/n) . u / sqrt(e)``,
    ``explained`` is ``e / trace(V)``, ``deviation`` is ``sum((n x - S)^2)`` computed in longs, and
    ``identity_error`` is the largest absolute entry of the whitened covariance minus the identity.
    """
    spark = frame.sparkSession
    rows = written(quantised(frame, vector, key).withColumn("h", F.xxhash64("x")), "whiten-rows")
    fit = rows.groupBy("h", "x").agg(F.count("*").alias("copies"))
    if not weighted:
        fit = fit.withColumn("copies", F.lit(1).cast("bigint"))
    fit = written(fit, "whiten-fit")
    weight = F.col("copies")
    sums = (
        fit.select(F.posexplode("x"), weight.alias("w"))
        .groupBy("pos")
        .agg(F.sum(F.col("col") * F.col("w")).alias("s"))
        .collect()
    )
    n = fit.agg(F.sum(weight)).first()[0] or 0
    empty = spark.createDataFrame(
        [],
        "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double",
    ).withColumnRenamed("vec_id", key)
    if n == 0 or not sums:
        return empty
    d = len(sums)
    total = np.zeros(d, dtype=object)
    for row in sums:
        total[row["pos"]] = int(row["s"])
    mean = np.array([float(s) / n for s in total])
    cov = _summed(fit, "x", mean, weighted, d) / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    top = values[0] if len(values) else 0.0
    k = int(min(components, np.sum(values > max(top, 0.0) * 1e-12))) if top > 0 else 0
    if k == 0:
        return empty
    values, vectors = values[:k], vectors[:, :k]
    biggest = np.argmax(np.abs(vectors), axis=0)
    vectors = vectors * np.sign(vectors[biggest, np.arange(k)])
    project = vectors / np.sqrt(values)
    explained = (values / np.trace(cov)).tolist()

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            w = (x.reshape(batch.num_rows, -1) - mean) @ project
            made = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), made], names=["h", "x", "copies", "w"]
            )

    white = fit.select("h", "x", "copies").mapInArrow(
        whiten, "h bigint, x array<bigint>, copies bigint, w array<double>"
    )
    sums_lit = F.array(*[F.lit(int(s)).cast("bigint") for s in total])
    deviation = F.aggregate(
        F.zip_with("x", sums_lit, lambda a, s: F.lit(int(n)) * a - s),
        F.lit(0).cast("bigint"),
        lambda acc, v: acc + v * v,
    )
    white = written(white.withColumn("deviation", deviation), "whiten-distinct")
    gram = _summed(white, "w", None, weighted, k) / n
    identity_error = float(np.max(np.abs(gram - np.eye(k))))
    discard(fit)
    out = rows.join(white.drop("copies"), ["h", "x"]).select(
        F.col("key").alias(key),
        F.posexplode("w").alias("pos", "whitened"),
        "deviation",
    )
    return out.select(
        key,
        (F.col("pos") + 1).cast("int").alias("component"),
        F.lit(int(n)).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*[F.lit(float(e)) for e in explained]), F.col("pos") + 1).alias("explained"),
        F.lit(identity_error).alias("identity_error"),
    )

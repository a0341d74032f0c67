"""What the operators share: tables in the shared folder, columns made by Arrow batch, components.

Functions for Python workers travel by value, so what is costly to load (a tokenizer, an automaton)
is held per worker process outside of them, see :func:`held`.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voicelane.session import shared_folder

#: Rows, and bytes of text, handled at once inside a task (at least one row).
SLICE, SLICE_BYTES = 1_000, 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the cluster's shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: computed once, no lineage, and a lost
    executor takes nothing of them along."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Removes the files of a table that :func:`written` made and no one reads any more."""
    spark = frame.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held(key: tuple, build: Callable):
    """``build()``, once per worker process."""
    name = "_voicelane_held"
    store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def fresh(columns: Sequence[str], base: str) -> str:
    """``base``, with underscores in front until it equals no name of ``columns`` (in any case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row: it is the lambda variable of a one-element
    ``transform``, so no optimizer rewrite copies it into lambdas inside ``body`` (where it would be
    computed again for every element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame less the columns that would clash with the given names (in any case)."""
    taken = {n.lower() for n in names}
    return frame.select(*[F.col(f"`{c}`") for c in frame.columns if c.lower() not in taken])


def extended(
    frame: DataFrame,
    inputs: dict[str, Column],
    outputs: str,
    rows: Callable[..., Sequence[Sequence]],
) -> DataFrame:
    """``frame`` with columns computed by Arrow batch.

    ``rows`` gets a list of values for each of ``inputs`` and returns a list of values for each field
    of the schema ``outputs``. Other columns pass through untouched; those that have the name of an
    output are replaced. Few rows are in Python at once, whatever the batch size.
    """
    added = T.StructType.fromDDL(outputs)
    kept = without(frame, added.names)
    names = [f"_in{i}" for i in range(len(inputs))]
    fed = frame.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        *[value.alias(n) for n, value in zip(names, inputs.values(), strict=True)],
    )
    schema = T.StructType(kept.schema.fields + added.fields)
    width = len(kept.columns)
    arrow = _arrow_types(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, range(width, batch.num_columns)):
                columns = part.columns
                made = rows(*[c.to_pylist() for c in columns[width:]])
                new = [pa.array(v, type=t) for v, t in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns[:width] + new, names=schema.names)

    return fed.mapInArrow(run, schema)


def parts(batch: pa.RecordBatch, texts: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that are small by rows and by the bytes of the given columns."""
    size = np.zeros(batch.num_rows, dtype=np.int64)
    for i in texts:
        column = batch.column(i)
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    until, start = np.cumsum(size), 0
    while start < batch.num_rows:
        full = int(np.searchsorted(until, until[start] - size[start] + SLICE_BYTES, side="right"))
        stop = min(max(full, start + 1), start + SLICE, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def ordered_edges(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).filter("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph ``(u, v)`` of longs: rows ``(node, root)`` for all
    nodes with an edge but the roots; the root is the smallest node.

    Stars of large and of small neighbours by turns: every round links each node's neighbours to its
    smallest one, until nothing changes, which takes a number of rounds that grows with the logarithm
    of the longest path. Each round is written to the shared folder. Minima combine before the
    shuffle; the join back is one that the adaptive planner splits where a node has very many edges.
    """
    now = written(ordered_edges(edges).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m"))
        smallest = smallest.select("u", F.least("u", "m").alias("m"))
        large = both.join(smallest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        then = written(small, "edges")
        discard(now)
        now, before, seen = then, seen, _digest(then)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)

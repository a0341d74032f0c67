"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition becomes a sorted run: one entry per distinct text, with the row that stays and
the number of copies. Runs are then merged in binomial rounds. In a round, partitions exchange with
the few partners whose number differs from theirs in one digit: each takes over one slice of the
partners' digests and gives the other slices away, so runs grow in copies but not in slices, the work
stays spread over all partitions and nothing gathers in one task. After the last round each partition
holds one slice of all digests.

Copies collapse in the first run already, so a text that makes up a third of all rows is one entry
per partition. Entries are equal only if a second digest by another algorithm agrees as well; rows
whose SHA-256 agrees but not the other stay apart.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelane.llm import common

BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Most partners that a partition exchanges with in a round.
PARTNERS = 16

ENTRY = "digest binary, other binary, chars bigint, doc_id bigint, copies bigint"


def normalised(text: str) -> bytes:
    """UTF-8 of a text less ASCII white space."""
    return text.encode().translate(None, BLANK)


def digested(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``digest`` (SHA-256 of the normalised text), ``other`` (XXH3-128 of it) and
    ``chars`` (code points of the original text). Null counts as empty."""

    def rows(texts):
        import xxhash

        plain = [normalised(t or "") for t in texts]
        return [
            [hashlib.sha256(p).digest() for p in plain],
            [xxhash.xxh3_128_digest(p) for p in plain],
            [len(t or "") for t in texts],
        ]

    outputs = "digest binary, other binary, chars bigint"
    return common.extended(docs, {text: F.col(f"`{text}`")}, outputs, rows)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal neighbours of sorted entries made one: the first stays, copies add up."""
    held, names = None, ENTRY.replace(",", "").split()[::2]
    plain = pa.schema([(n, pa.binary() if n in ("digest", "other") else pa.int64()) for n in names])
    for batch in batches:
        if not batch.num_rows:
            continue
        own = pa.RecordBatch.from_arrays(batch.columns, schema=plain)
        whole = pa.Table.from_batches([own] if held is None else [held, own]).combine_chunks()
        keys = [whole[name].chunk(0) for name in ("digest", "other")]
        new = np.zeros(len(whole), dtype=bool)
        new[0] = True
        for key, width in zip(keys, (32, 16), strict=True):
            offset = key.offset
            start = np.frombuffer(key.buffers()[1], dtype=np.int32)[offset]
            raw = np.frombuffer(key.buffers()[2], dtype=np.uint8)[start : start + width * len(key)]
            cells = raw.reshape(-1, width)
            new[1:] |= (cells[1:] != cells[:-1]).any(axis=1)
        heads = np.flatnonzero(new)
        copies = np.add.reduceat(whole["copies"].to_numpy(), heads)
        out = whole.take(pa.array(heads)).set_column(4, "copies", pa.array(copies, pa.int64()))
        out = out.combine_chunks().to_batches()[0]
        held = out.slice(len(out) - 1)
        if len(out) > 1:
            yield out.slice(0, len(out) - 1)
    if held is not None:
        yield held


def _run(entries: DataFrame) -> DataFrame:
    """A sorted run per partition, merged. Sorting is Spark's, which spills; merging streams."""
    order = ["digest", "other", F.desc("chars"), F.asc_nulls_last("doc_id")]
    return entries.sortWithinPartitions(*order).mapInArrow(_merged, ENTRY)


def radices(partitions: int, most: int = PARTNERS) -> list[int]:
    """Partners per round: as few rounds as possible, their product covers all partitions."""
    if partitions < 2:
        return []
    rounds = math.ceil(math.log(partitions) / math.log(most) - 1e-9)
    each = math.ceil(partitions ** (1 / rounds) - 1e-9)
    return [each] * rounds


def _digit(number: Column, low: int, radix: int) -> Column:
    return F.pmod(F.floor(number / low), F.lit(radix))


def tree_merge(entries: DataFrame, partitions: int, most: int = PARTNERS) -> DataFrame:
    """One entry per distinct digest, from entries in any order and any partition."""
    runs, cells, low = _run(entries), radices(partitions, most), 1
    total = math.prod(cells)
    first = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("bigint")
    slice_of = F.floor(first * total / float(1 << 32)).cast("bigint")
    for radix in cells:
        here = F.spark_partition_id().cast("bigint")
        there = here + (_digit(slice_of, low, radix) - _digit(here, low, radix)) * low
        sent = runs.withColumn("_cell", there.cast("int")).repartitionById(total, "_cell")
        runs, low = _run(sent.drop("_cell")), low * radix
    return runs


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, dropped ones too: ``doc_id``, ``keep_id``, ``group_size``, ``kept``,
    ``digest``.

    Texts are equal when identical less ASCII white space; of equal texts the row with the most code
    points stays, then the smallest id. Null texts count as empty; a null id stays only where no
    other does. Rows that repeat the id of the row that stays are kept like it.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = common.written(digested(narrow).drop("text"), "digests")
    entries = known.select("digest", "other", "chars", "doc_id", F.lit(1).cast("bigint").alias("copies"))
    merged = tree_merge(entries, entries.rdd.getNumPartitions()).select(
        "digest", "other", F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size")
    )
    return known.join(merged, ["digest", "other"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` less the rows whose id some equal text's row replaces. Rows without id all stay, as
    nothing names them; rows that repeat an id stand or fall together."""
    found = exact_dedup(docs, doc_id, text)
    gone = common.fresh(docs.columns, "_dropped")
    dropped = found.filter("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col(f"`{doc_id}`") == F.col(gone), "left_anti")

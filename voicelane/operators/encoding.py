"""Token ids for training examples, over a vocabulary counted from the corpus itself."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voicelane import fixed_values as V
from voicelane.functions.matching import bound
from voicelane.session import shared_folder

# Ids after the reserved ones stand for single bytes, which spell what is not in the vocabulary.
FIRST_BYTE_ID = V.UNKNOWN_ID + 1
FIRST_TOKEN_ID = FIRST_BYTE_ID + 256
# Most bytes of the vocabulary that travel with tasks: its first tokens; the others are joined.
MAX_CARRIED_BYTES = 64 << 20
# Steps of ids by which the part that travels is measured.
STEPS = 4_096


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(_pieces(text), lambda t: t != "")


def first_tokens(text: Column, n: int) -> Column:
    """The first ``n`` tokens. Splitting stops there: of ``n + 2`` pieces the last is the rest of the
    text, and only the very first can be empty."""
    return F.slice(F.filter(_pieces(text, n + 2), lambda t: t != ""), 1, n)


def _pieces(text: Column, limit: int = -1) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", limit)


def vocabulary(corpus: DataFrame, columns: Sequence[str], size: int | None = None) -> DataFrame:
    """Tokens by frequency, ties by token, with ids after the reserved ones: all tokens, or as a limit
    of the model the ``size`` most frequent ones.

    Ids come from counts per range of the order, so no task sees all tokens. The table is written to
    the shared folder.
    """
    texts = F.array(*[F.col(c) for c in columns])
    counted = (
        corpus.select(F.explode(texts).alias("text"))
        .select(F.explode(_pieces(F.col("text"))).alias("token"))
        .filter(F.col("token") != "")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    order = (F.desc("n"), F.asc("token"))
    if size is not None:
        counted = counted.orderBy(*order).limit(size)
    spark = corpus.sparkSession
    path = f"{shared_folder(spark)}/vocabulary-{uuid.uuid4().hex}"
    row = F.monotonically_increasing_id()
    ranges = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges.withColumn("_row", row).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_range", F.shiftright("_row", 33))
    # One row per range.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = starts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), "_range").select(
        "token", "n", (place + FIRST_TOKEN_ID).cast("bigint").alias("id")
    )


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def encode(
    examples: DataFrame,
    vocab: DataFrame,
    max_input: int = V.MAX_INPUT_TOKENS,
    max_label: int = V.MAX_LABEL_TOKENS,
    max_carried_bytes: int = MAX_CARRIED_BYTES,
) -> DataFrame:
    """``input_ids``, ``attention_mask`` and ``labels`` instead of the two text columns.

    Sequences end with the end id and are cut to their limits; padding ids in labels become the
    ignored id. A token outside the vocabulary is spelled by the ids of its bytes, so nothing is lost.
    A vocabulary that is small enough travels with the tasks and ids are looked up by Arrow batch,
    without a shuffle. Of a larger one its most frequent tokens (lowest ids) travel, as many as fit, and
    only the occurrences of all others are joined. All give the same ids.
    """
    limits = {"input": max_input - 1, "output": max_label - 1}
    kept = [c for c in examples.columns if c not in limits]
    frequent, rest = _divided(vocab, max_carried_bytes)
    ids_of = _carried(frequent, rest is None)
    lists = [ids_of(first_tokens(F.col(c), n)).alias(f"_{c}") for c, n in limits.items()]
    if rest is None:
        found = examples.select(*kept, *lists)
    else:
        # Ids depend on the two texts only: their digest tells rows apart, without a written row number.
        text = [F.sha2(F.coalesce(F.col(c).cast("string"), F.lit("")), 256) for c in limits]
        key = F.substring(F.unhex(F.sha2(F.concat(*text), 256)), 1, 16)
        found = _joined(examples.select(*kept, key.alias("_key"), *lists), rest, kept, limits)
    end = F.lit(V.END_ID)

    def sequence(name: str) -> Column:
        return F.array_append(F.slice(f"_{name}", 1, limits[name]), end)

    return found.select(
        *kept, sequence("input").alias("input_ids"), sequence("output").alias("_labels")
    ).select(
        *kept,
        "input_ids",
        F.transform("input_ids", lambda _: F.lit(1)).alias("attention_mask"),
        F.transform(
            "_labels", lambda t: F.when(t == V.PAD_ID, V.IGNORED_LABEL_ID).otherwise(t)
        ).alias("labels"),
    )


def _divided(vocab: DataFrame, most_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """The tokens of lowest ids that fit into ``most_bytes``, by steps of ids, and the others, if any."""
    size = F.sum(F.octet_length("token") + 12)
    total, low, high = vocab.agg(F.coalesce(size, F.lit(0)), F.min("id"), F.max("id")).first()
    if total <= most_bytes:
        return vocab, None
    if low is None:
        return vocab, vocab
    width = (high - low) // STEPS + 1
    step = F.floor((F.col("id") - low) / width).alias("step")
    cut = low
    for number, held in sorted(vocab.groupBy(step).agg(size).collect()):
        most_bytes -= held
        if most_bytes < 0:
            break
        cut = low + (number + 1) * width
    return vocab.filter(F.col("id") < cut), vocab.filter(F.col("id") >= cut)


def _carried(vocab: DataFrame, whole: bool):
    """Ids of token lists by Arrow batch. With the ``whole`` vocabulary unknown tokens are spelled;
    else the result is a struct of ``ids``, null for tokens not found, and ``missing`` tokens by position."""
    table = vocab.select("token", F.col("id").cast("int").alias("id")).toArrow().combine_chunks()
    words, numbers = (table[c].combine_chunks() for c in ("token", "id"))
    first_byte = FIRST_BYTE_ID

    def look_up(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        found = pc.take(numbers, pc.index_in(flat, value_set=words))
        offsets = pc.subtract(lists.offsets, lists.offsets[0])
        if not whole:
            starts = offsets.to_numpy(zero_copy_only=False)
            lost = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
            row = np.searchsorted(starts, lost, side="right") - 1
            missing = pa.StructArray.from_arrays(
                [pa.array((lost - starts[row]).astype(np.int32)), flat.take(pa.array(lost))], ["pos", "token"]
            )
            until = pa.array(np.searchsorted(lost, starts).astype(np.int32))
            return pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(offsets, found), pa.ListArray.from_arrays(until, missing)],
                ["ids", "missing"],
            )
        if not found.null_count:
            return pa.ListArray.from_arrays(offsets, found)
        # Few tokens are unknown: only their lists grow.
        ids, tokens, at = found.to_pylist(), flat.to_pylist(), offsets.to_pylist()
        spelled = [
            [i] if i is not None else [first_byte + b for b in token.encode()]
            for i, token in zip(ids, tokens, strict=True)
        ]
        rows = [[i for part in spelled[a:b] for i in part] for a, b in zip(at, at[1:], strict=False)]
        return pa.array(rows, pa.list_(pa.int32()))

    partly = "struct<ids: array<int>, missing: array<struct<pos: int, token: string>>>"
    return F.arrow_udf(look_up, "array<int>" if whole else partly)


def _asked(rows: DataFrame, sides: Sequence[str]) -> DataFrame:
    """The tokens that tasks did not find, one row per occurrence: ``_key, side, pos, token``."""

    def lost(c: str) -> Column:
        of_side = F.lit(c).alias("side")
        return F.transform(
            F.col(f"_{c}.missing"), lambda m: F.struct(of_side, m["pos"].alias("pos"), m["token"].alias("token"))
        )

    return rows.select("_key", F.inline(F.concat(*map(lost, sides))))


def _joined(rows: DataFrame, rest: DataFrame, kept: Sequence[str], limits: dict[str, int]) -> DataFrame:
    """Ids of the tokens that tasks did not find by a join on the token; they meet the others by key.
    Of texts that come repeatedly the missing ids are kept once."""
    digits = F.hex("token")
    spelled = F.transform(
        F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int")),
        lambda i: F.conv(F.substring(digits, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + FIRST_BYTE_ID,
    )
    ids = F.when(F.col("id").isNotNull(), F.array(F.col("id").cast("int"))).otherwise(spelled)
    known = rest.groupBy("token").agg(F.min("id").alias("id"))
    met = _asked(rows, list(limits)).join(known, "token", "left")
    met = met.groupBy("_key").agg(F.collect_set(F.struct("side", "pos", ids.alias("ids"))).alias("_met"))
    none = F.array().cast("array<struct<side:string,pos:int,ids:array<int>>>")

    def whole(c: str) -> Column:
        answers = F.filter(F.coalesce("_met", none), lambda a: a["side"] == c)
        by_place = F.map_from_entries(F.transform(answers, lambda a: F.struct(a["pos"], a["ids"])))
        placed = bound(
            by_place,
            lambda m: F.flatten(
                F.transform(F.col(f"_{c}.ids"), lambda i, at: F.when(i.isNull(), m[at]).otherwise(F.array(i)))
            ),
        )
        return F.when(F.size(F.col(f"_{c}.missing")) == 0, F.col(f"_{c}.ids")).otherwise(placed)

    return rows.join(met, "_key", "left").select(*kept, *[whole(c).alias(f"_{c}") for c in limits])

"""Exact row numbers and exact sample sizes without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voicelane import fixed_values as V


def number_rows(
    rows: DataFrame,
    order: str,
    within: Sequence[str] = (),
    name: str = "row_number",
    bits: int = 16,
) -> DataFrame:
    """Consecutive numbers (from 1) by a unique bigint ``order``, per ``within`` group.

    Rows are cut into ranges of ``2**bits`` order values, which hold at most that many rows as
    order values are unique; a range is numbered by itself and shifted by the count of all rows
    before it. Those counts are summed level by level (ranges of ranges), so no window ever sees
    more than ``2**bits`` rows, however large one group is.
    """
    levels = len(range(bits, 64, bits))
    tagged = rows.select(
        "*", _group_key(within).alias("_group"), F.shiftright(order, bits).alias("_range")
    )
    # Per level, from rows upwards: how many rows lie before a range inside the next wider range.
    counts = tagged.groupBy("_group", "_range").agg(F.count("*").alias("_rows"))
    before: list[DataFrame] = []
    for level in range(levels):
        top = level == levels - 1
        parent = F.lit(0).cast("bigint") if top else F.shiftright("_range", bits)
        counts = counts.withColumn("_parent", parent)
        earlier = (
            Window.partitionBy("_group", "_parent")
            .orderBy("_range")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        shift = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
        before.append(counts.select("_group", "_parent", "_range", shift.alias("_shift")))
        counts = counts.groupBy("_group", F.col("_parent").alias("_range")).agg(
            F.sum("_rows").alias("_rows")
        )
    # From the widest ranges downwards, each level adds the shift of the range around it. A range
    # meets at most ``2**bits`` narrower ones in these joins, too.
    shifts = before[-1].drop("_parent")
    for narrower in reversed(before[:-1]):
        outer = shifts.select(
            "_group", F.col("_range").alias("_parent"), F.col("_shift").alias("_outer")
        )
        # Every row finds its match; a left join only keeps the optimizer from deriving null filters
        # that differ from branch to branch and would stop the counts from being computed once.
        shifts = narrower.join(outer, ["_group", "_parent"], "left").select(
            "_group", "_range", (F.col("_shift") + F.col("_outer")).alias("_shift")
        )
    inside = F.row_number().over(Window.partitionBy("_group", "_range").orderBy(order))
    return (
        tagged.withColumn("_inside", inside)
        .join(shifts, ["_group", "_range"], "left")
        .withColumn(name, (F.col("_inside") + F.col("_shift")).cast("bigint"))
        .drop("_group", "_range", "_inside", "_shift")
    )


def _group_key(columns: Sequence[str]) -> Column:
    """One text per group, never null, so that groups with a null key take part in equal joins.

    Values carry their length, which keeps ('a,b', null) and ('a', 'b') apart.
    """
    texts = [F.col(c).cast("string") for c in columns]
    sized = [
        F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]
    return F.concat_ws(",", F.lit(""), *sized)


def chunk_ids(
    rows: DataFrame, order: str, within: Sequence[str] = (), size: int = V.CHUNK_SIZE
) -> DataFrame:
    """Chunk number (from 0) and place in the chunk, ``size`` consecutive rows per chunk."""
    place = F.col("_place") - 1
    return (
        number_rows(rows, order, within, "_place")
        .withColumn("chunk", F.floor(place / size).cast("bigint"))
        .withColumn("chunk_row", (place % size).cast("bigint"))
        .drop("_place")
    )


def quota_limit(
    candidates: DataFrame, existing: DataFrame, order: str, total: int | Column = V.DATASET_TOTAL
) -> DataFrame:
    """The first ``max(total - existing, 0)`` candidates by ``order``."""
    target = total if isinstance(total, Column) else F.lit(total)
    remaining = F.greatest(target - existing.agg(F.count("*")).scalar(), F.lit(0))
    return (
        number_rows(candidates, order, name="_place")
        .filter(F.col("_place") <= remaining)
        .drop("_place")
    )


def split_hash(key: Column, one_in: int = V.TEST_ONE_IN, seed: int = V.SPLIT_SEED) -> Column:
    """``test`` for one in ``one_in`` keys, else ``train``; row by row, no shuffle.

    All rows with one key land on one side, so copies of a review never leak across.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % one_in
    return F.when(bucket == 0, "test").otherwise("train")


def split_exact(
    rows: DataFrame,
    key: Sequence[str],
    one_in: int = V.TEST_ONE_IN,
    seed: int = V.SPLIT_SEED,
    grouped: bool = False,
    digits: int = 4,
) -> DataFrame:
    """Exactly ``ceil(n / one_in)`` of the ``n`` keys to ``test``, by hash order.

    With a key per row the test size is exact in rows. With ``grouped``, rows that share a key (the
    copies of a review) stay together and the size is exact in groups. The cut is found without sorting: keys are counted by the first
    ``digits`` hex digits of their hash (65,536 counters), and only the one counter that holds the
    cut is ranked, about ``n / 65536`` keys.
    """
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    hashed = rows.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(str(seed)), *texts)))
    keys = hashed.select("_hash")
    if grouped:
        keys = keys.distinct()
    lead = F.substring("_hash", 1, digits)

    counters = keys.groupBy(lead.alias("_lead")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_lead"))
    # Window over all counters: at most 16**digits rows.
    running = counters.select(
        "_lead", "_n", upto.alias("_upto"), F.sum("_n").over(Window.partitionBy()).alias("_all")
    )
    wanted = F.ceil(F.col("_all") / one_in)
    cut = running.filter((F.col("_upto") >= wanted) & (F.col("_upto") - F.col("_n") < wanted))
    cut_lead = cut.select("_lead").scalar()
    cut_rank = cut.select(wanted - (F.col("_upto") - F.col("_n"))).scalar()
    threshold = (
        keys.filter(lead == cut_lead)
        .withColumn("_rank", F.row_number().over(Window.orderBy("_hash")))
        .filter(F.col("_rank") == cut_rank)
        .select("_hash")
        .scalar()
    )
    side = F.when(F.col("_hash") <= threshold, "test").otherwise("train")
    return hashed.withColumn("split", side).drop("_hash")

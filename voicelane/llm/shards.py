"""Sharding by longest-processing-time scheduling.

Groups of rows that must stay together are sorted by size, and each goes to the shard with the least
load so far, taken from a heap. A group that is large against a shard is scheduled by itself. There
are too many small ones to pass through one heap, so whole small groups are first put into packs by
their hash; packs and large groups together are a bounded list, which is scheduled in one go. A pack
is small against a shard, so the loads end up as equal as the large groups allow.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voicelane.llm import common

#: Packs of small groups per shard. A group larger than an average pack is scheduled by itself, so
#: the heap sees at most twice this number of items per shard, whatever the number of rows.
PACKS_PER_SHARD = 512
#: Average rows that are numbered in one window.
ROWS_NUMBERED_AT_ONCE = 32_768


def longest_first(sizes: list[tuple[object, int]], shards: int) -> dict[object, int]:
    """Shard of each item: the largest first, always to the least-loaded shard."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for key, size in sorted(sizes, key=lambda item: (-item[1], str(item[0]))):
        load, shard = heap[0]
        placed[key] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return placed


def sharded(rows: DataFrame, shards: int, group: str, size: str) -> DataFrame:
    """``rows`` with ``shard`` and the gapless ``slot`` in it; equal ``group`` values (a long) stay
    together. Other columns are kept; earlier columns ``shard`` and ``slot`` are replaced.

    Null groups form one group, null sizes count as 0. Rows of a shard are numbered in the order of
    their hash. No rows give no rows.
    """
    spark = rows.sparkSession
    group_col, size_col = F.col(f"`{group}`"), F.coalesce(F.col(f"`{size}`"), F.lit(0))
    sums = rows.groupBy(group_col.alias("_group")).agg(F.sum(size_col).cast("bigint").alias("_sum"))
    sums = common.written(sums, "group-sizes")
    total = sums.agg(F.coalesce(F.sum("_sum"), F.lit(0))).first()[0]
    packs = PACKS_PER_SHARD * shards
    large = sums.filter(F.col("_sum") * packs > F.lit(total))
    pack = F.pmod(F.xxhash64("_group"), F.lit(packs)).cast("int")
    small = sums.filter(F.col("_sum") * packs <= F.lit(total)).groupBy(pack.alias("_pack"))
    # Fewer than `packs` groups can be larger than an average pack: two bounded lists.
    items = [(("group", r["_group"]), r["_sum"]) for r in large.collect()]
    items += [(("pack", r["_pack"]), r["_sum"]) for r in small.agg(F.sum("_sum").alias("_sum")).collect()]
    placed = longest_first(items, shards)
    of_groups = [(key, shard, True) for (kind, key), shard in placed.items() if kind == "group"]
    of_packs = [(key, shard) for (kind, key), shard in placed.items() if kind == "pack"]
    group_map = spark.createDataFrame(of_groups, "_group bigint, _own int, _is_large boolean")
    pack_map = spark.createDataFrame(of_packs, "_pack int, _shared int")
    parts = max(1, rows.count() // (ROWS_NUMBERED_AT_ONCE * shards))
    kept = common.without(rows, ["shard", "slot"])
    names = [F.col(f"`{c}`") for c in kept.columns]
    put = kept.withColumn("_group", group_col).withColumn("_pack", pack)
    own = F.broadcast(group_map.withColumnRenamed("_group", "_large"))
    put = put.join(own, F.col("_group").eqNullSafe(F.col("_large")), "left")
    put = put.join(F.broadcast(pack_map), "_pack", "left")
    shard = F.when(F.col("_is_large"), F.col("_own")).otherwise(F.col("_shared"))
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in kept.columns])
    put = put.withColumn("shard", shard.cast("int")).withColumn("_hash", row_hash)
    put = put.withColumn("_part", F.pmod("_hash", F.lit(parts)))
    return numbered(put, ["shard"], "_part", ["_hash"]).select(*names, "shard", "slot")


def numbered(rows: DataFrame, within: list[str], part: str, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``, counting from 0 within ``within``: parts in their order, rows in theirs
    inside a part. Windows see one part at a time, or one counter per part."""
    keys = [*within, part]
    before = Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    starts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = rows.withColumn("_at", inside)
    return ranked.join(starts, keys).withColumn("slot", (F.col("_start") + F.col("_at") - 1).cast("bigint"))

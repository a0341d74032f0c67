"""Mixing sources to target weights by entropy balancing.

Of all rates at which documents could be taken so that each source gives its target number of words,
and none is taken more often than allowed, the wanted ones stay closest (in entropy) to taking every
document once. Their dual is convex with one multiplier per source: a document's rate is the
exponential of the multiplier times its size, cut at the highest rate. Newton steps find all
multipliers together; every step is one aggregation over how many documents of which size a source
has, so it costs the same however many documents there are.

Rates are then rounded to whole copies. Documents of a source are dealt into blocks by hash, and in
each block, from the largest document to the smallest, the words still owed decide between the two
whole numbers next to the rate, so a block is off by about half of its smallest document.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voicelane.llm import common

WORD = r"[^\x20\x09-\x0D]+"
STEPS, EXACT = 80, 1e-10
#: Average documents of a block whose rates are rounded together.
BLOCK_DOCUMENTS = 512


def words(text: Column) -> Column:
    """Number of words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _key(source: Column) -> Column:
    """A join key of a source that null has too."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``sources`` (``source``, ``source_size``: one row per source) with ``target``.

    Weights are dealt out to the sources by code point, null last, again and again. All targets
    together are ``share`` of all sizes; none is above ``most`` times its source's size, and what is
    cut there goes to the others by weight. Ranking passes the list of sources through one window.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))) + 1)
    weighed = common.written(sources.withColumn("_weight", dealt), "source-weights")
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    top, level, cut = F.col("source_size") * float(most), 0.0, -1
    while True:  # at most one round per source, usually two or three
        full = top <= F.col("_weight") * level
        row = weighed.agg(
            F.count_if(full), F.sum(F.when(full, top).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_weight")))
        ).first()
        if row[0] == cut or not row[2]:
            break
        cut, level = row[0], (share * total - row[1]) / row[2]
    reached = F.least(top, F.col("_weight") * level)
    return weighed.select("source", "source_size", reached.alias("target"))


def tilts(sizes: DataFrame, wanted: DataFrame, most: float) -> DataFrame:
    """Multiplier of each source: ``key``, ``scale``, ``tilt``, and ``full`` where every document is
    taken at the highest rate.

    ``sizes``: ``key``, ``size`` (over 0), ``n``; ``wanted``: ``key``, ``target``. Newton's method on
    the logarithm of the words taken, inside a bracket that every step narrows.
    """
    scale = (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale")
    total = F.sum(F.col("n") * F.col("size")).alias("_total")
    start = wanted.join(sizes.groupBy("key").agg(scale, total), "key").select(
        "key",
        "target",
        "scale",
        (F.col("target") >= F.col("_total") * (most * (1 - 1e-12))).alias("full"),
        F.lit(0.0).alias("tilt"),
        F.lit(-math.inf).alias("low"),
        F.lit(math.inf).alias("high"),
        F.lit(math.inf).alias("off"),
    )
    now = common.written(start, "tilts")
    for _ in range(STEPS):
        rate = F.exp(F.col("tilt") * F.col("size") / F.col("scale"))
        mass = F.col("n") * F.col("size") * F.least(rate, F.lit(float(most)))
        slope = F.when(rate < most, mass * F.col("size") / F.col("scale")).otherwise(0.0)
        taken = sizes.join(now.select("key", "tilt", "scale"), "key").groupBy("key")
        taken = taken.agg(F.sum(mass).alias("_taken"), F.sum(slope).alias("_slope"))
        step = F.log(F.col("target") / F.col("_taken")) * F.col("_taken") / F.col("_slope")
        short = F.col("_taken") < F.col("target")
        low = F.when(short, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(short, F.col("high")).otherwise(F.col("tilt"))
        newton = F.when(F.col("_slope") > 0, F.col("tilt") + step)
        middle = (
            F.when(low == -math.inf, high - 1 - F.abs(high))
            .when(high == math.inf, low + 1 + F.abs(low))
            .otherwise((low + high) / 2)
        )
        inside = newton.isNotNull() & (newton > low) & (newton < high)
        off = F.when(F.col("full") | (F.col("target") <= 0), 0.0).otherwise(
            F.abs(F.col("_taken") / F.col("target") - 1)
        )
        moved = now.drop("off").join(taken, "key").select(
            "key", "target", "scale", "full",
            F.when(off <= EXACT, F.col("tilt")).when(inside, newton).otherwise(middle).alias("tilt"),
            low.alias("low"), high.alias("high"), off.alias("off"),
        )
        then = common.written(moved, "tilts")
        common.discard(now)
        now = then
        if (now.agg(F.max("off")).first()[0] or 0.0) <= EXACT:
            break
    return now.select("key", "scale", "tilt", "full", "target")


def _copies(sizes: list[int], rates: list[float], most: float) -> list[int]:
    """Whole copies of the documents of a block (largest first) with nearly the words of their rates."""
    owed, copies, between = 0.0, [], []
    for i, (size, rate) in enumerate(zip(sizes, rates, strict=True)):
        low = math.floor(rate)
        owed += (rate - low) * size
        more = rate > low and low < most and owed * 2 >= size
        owed -= size * more
        copies.append(low + more)
        if rate > low and low < most:
            between.append(i)
    # What is left over: turn the document round that brings it closest to nothing.
    for _ in range(4):
        turned = [(abs(owed - sizes[i] * (1 if copies[i] <= rates[i] else -1)), i) for i in between]
        left, i = min(turned, default=(math.inf, 0))
        if left >= abs(owed):
            break
        step = 1 if copies[i] <= rates[i] else -1
        copies[i] += step
        owed -= step * sizes[i]
    return copies


def _rounded(most: float):
    def rounded(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "hash"], ascending=[False, True], kind="stable")
        copies = _copies(block["size"].tolist(), block["rate"].tolist(), most)
        return block[["doc_id", "hash", "size", "key"]].assign(copies=copies)

    return rounded


def balanced(docs: DataFrame, wanted: DataFrame, most: float) -> DataFrame:
    """``docs`` (``doc_id``, ``source``, ``size``) with ``copies`` to take of each document.

    ``wanted``: ``source``, ``target``. Documents of size 0 are not taken. The same rows give the same
    copies: order comes from hashes of the rows. A null id is as good as any other.
    """
    narrow = docs.select("doc_id", "size", "source", _key(F.col("source")).alias("key"))
    narrow = common.written(narrow.withColumn("hash", F.xxhash64("doc_id", "size", "key")), "sized")
    some = narrow.filter("size > 0")
    sizes = common.written(some.groupBy("key", "size").agg(F.count("*").alias("n")), "size-counts")
    found = tilts(sizes, wanted.select(_key(F.col("source")).alias("key"), "target"), most)
    blocks = sizes.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_DOCUMENTS).alias("_blocks"))
    rate = F.when(F.col("full"), F.lit(float(most))).when(F.col("target") <= 0, 0.0)
    rate = rate.otherwise(F.least(F.exp(F.col("tilt") * F.col("size") / F.col("scale")), F.lit(float(most))))
    # One row per source; the planner broadcasts it below its size limit, else splits the hot source.
    rated = some.join(found.join(blocks, "key"), "key").select(
        "doc_id", "hash", "size", "key", rate.alias("rate"), F.pmod("hash", F.col("_blocks")).alias("_block")
    )
    # One value for source and block: rows that the join has dealt by source are dealt anew.
    rated = rated.withColumn("block", F.concat_ws(":", F.col("_block").cast("string"), "key")).drop("_block")
    schema = "doc_id bigint, hash bigint, size bigint, key string, copies bigint"
    taken = rated.groupBy("block").applyInPandas(_rounded(most), schema)
    none = narrow.filter("size = 0").select("doc_id", "hash", "size", "key", F.lit(0).cast("bigint").alias("copies"))
    return taken.unionByName(none)


def mix(
    docs: DataFrame,
    weights: list[float],
    share: float,
    most: float,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document: ``doc_id``, ``source``'s ``source_size`` and ``target``, ``size`` (words of
    its text, 0 for null) and ``copies``. An empty table gives no rows."""
    sized = docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
        words(F.col(f"`{text}`")).alias("size"),
        F.col(f"`{source}`").alias("source"),
    )
    sized = common.written(sized, "word-counts")
    wanted = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    wanted = common.written(wanted, "targets")
    taken = balanced(sized, wanted, most)
    of_source = wanted.select(_key(F.col("source")).alias("key"), "source_size", "target")
    return taken.join(of_source, "key").select("doc_id", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, weights: list[float], share: float, most: float, doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: ``docs`` with each row repeated as often as it is taken. Rows that repeat an id
    are taken as often as the one of them that is taken most."""
    key, times = common.fresh(docs.columns, "_id"), common.fresh(docs.columns, "_copies")
    copies = mix(docs, weights, share, most, doc_id).groupBy(F.col("doc_id").alias(key))
    copies = copies.agg(F.max("copies").cast("int").alias(times)).filter(F.col(times) > 0)
    joined = docs.join(copies, F.col(f"`{doc_id}`").eqNullSafe(F.col(key)))
    repeated = joined.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(key)
    )
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])

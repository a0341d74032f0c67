"""Exact counts of tokens for every context limit, from a histogram of lengths.

Documents are counted by encoded length. From the longest down, sums over the histogram give for each
length L how many documents are longer and how many tokens they have; what a limit of L keeps is then
the tokens of all others and L for each longer one. Sums run over blocks of lengths and inside the
blocks, so no window sees all lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lengths of a block.
BLOCK = 128


def histogram(lengths: DataFrame, by: list[str] | None = None, length: str = "n_tokens") -> DataFrame:
    """``documents`` per ``n_tokens`` (and per ``by``). Counted before the shuffle, so a length that
    very many documents have is one row per task. Null lengths count as 0."""
    size = F.coalesce(F.col(f"`{length}`"), F.lit(0)).cast("bigint").alias("n_tokens")
    return lengths.groupBy(*(by or []), size).agg(F.count("*").alias("documents"))


def limits(counted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per length that occurs, as a context limit: ``documents`` and ``tokens`` of that length,
    ``documents_upto`` and ``tokens_upto`` (that length or less), ``documents_over`` and
    ``tokens_over`` (longer), ``kept_tokens`` (what stays when all are cut to it), ``cut_tokens``, and
    ``share_upto``, by which quantiles are found. No documents give no rows.

    ``counted`` is read twice, so it should be a table, not the counting itself.
    """
    by = by or []
    rows = counted.withColumn("tokens", F.col("n_tokens") * F.col("documents"))
    rows = rows.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    totals = rows.groupBy(*by, "_block").agg(F.sum("documents").alias("_d"), F.sum("tokens").alias("_t"))
    above = Window.partitionBy(*by).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = totals.select(
        *by,
        "_block",
        *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("_d", "_t")],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("_d", "_t")],
    )
    longer = Window.partitionBy(*by, "_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)

    def over(column: str, above_: str) -> Column:
        return F.coalesce(F.sum(column).over(longer), F.lit(0)) + F.col(above_)

    joined = rows.join(totals, [*by, "_block"])
    joined = joined.withColumn("documents_over", over("documents", "_d_above"))
    joined = joined.withColumn("tokens_over", over("tokens", "_t_above"))
    kept = F.col("_t_all") - F.col("tokens_over") + F.col("documents_over") * F.col("n_tokens")
    return joined.select(
        *by,
        "n_tokens",
        "documents",
        "tokens",
        (F.col("_d_all") - F.col("documents_over")).alias("documents_upto"),
        (F.col("_t_all") - F.col("tokens_over")).alias("tokens_upto"),
        "documents_over",
        "tokens_over",
        kept.alias("kept_tokens"),
        (F.col("_t_all") - kept).alias("cut_tokens"),
        ((F.col("_d_all") - F.col("documents_over")) / F.col("_d_all")).alias("share_upto"),
    )


def kept_at(table: DataFrame, limit: int) -> DataFrame:
    """Tokens that stay at any limit, whether a document has that length or not: one row."""
    cut = F.least("n_tokens", F.lit(limit)) * F.col("documents")
    return table.agg(F.coalesce(F.sum(cut), F.lit(0)).alias("kept_tokens"))


def quantile(table: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least this share of the documents do not exceed: one row."""
    return table.filter(F.col("share_upto") >= share).agg(F.min("n_tokens").alias("n_tokens"))

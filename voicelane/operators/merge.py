"""Joins by key: merging enrichment into stored reviews, resuming a labelling run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelane import fixed_values as V
from voicelane.functions import labels as L
from voicelane.functions.text import prefix


# A key is hot if it holds more than one in this many rows, so there are always fewer hot keys.
HOT_ONE_IN = 2_000
_SPREAD = 10_007  # parts a hot key is spread over


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that hold more than one in ``HOT_ONE_IN`` rows: fewer than that many, whatever the data.

    Counting combines on the map side, so a hot key is one counter per task.
    """
    total = rows.agg(F.count("*")).scalar()
    return (
        rows.groupBy(key)
        .agg(F.count("*").alias("_n"))
        .filter((F.col("_n") * HOT_ONE_IN > total) & F.col(key).isNotNull())
        .select(key)
    )


def _spread_hot(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Adds ``_part``: 0 for ordinary keys, some other number for rows of a hot key.

    Joined on (key, _part) with a side that only has part 0, rows of hot keys match nothing and go
    to many tasks. They have to be answered before, from the few hot keys of the other side. The part
    comes from the row itself, so a repeated task sends it to the same place.
    """
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(_SPREAD)) + 1
    flagged = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    return flagged.withColumn("_part", F.when(F.col("_hot"), part).otherwise(0)).drop("_hot")


def _part_zero(rows: DataFrame, key: str) -> DataFrame:
    """Part 0 for all rows, computed from the key: a plain literal would be taken out of the join
    keys by the optimizer."""
    return rows.withColumn("_part", F.pmod(F.hash(key), F.lit(1)).cast("bigint"))


def latest_per_key(updates: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key (map-side combined, so a hot key costs one row per task)."""
    others = [c for c in updates.columns if c not in (key, version)]
    newest = F.max_by(F.struct(*others), version).alias("_newest")
    return (
        updates.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(newest)
        .select(key, *[F.col(f"_newest.{c}").alias(c) for c in others])
    )


def merge_enrichment(
    stored: DataFrame, updates: DataFrame, key: str = "database_id", version: str = "version"
) -> DataFrame:
    """Stored rows with newer enrichment values where there are any.

    Rows without a key match nothing; they bypass the join instead of meeting in one partition.
    """
    fresh = latest_per_key(updates, key, version)
    new = [c for c in fresh.columns if c != key]
    renamed = fresh.select(key, *[F.col(c).alias(f"_new_{c}") for c in new])
    keyed = stored.filter(F.col(key).isNotNull())
    # The few hot keys are merged by broadcast, all others by a shuffle that no key can overload.
    hot = hot_keys(keyed, key)
    few = renamed.join(F.broadcast(hot), key, "left_semi").select(
        key, *[F.col(f"_new_{c}").alias(f"_hot_{c}") for c in new]
    )
    keyed = (
        _spread_hot(keyed.join(F.broadcast(few), key, "left"), key, hot)
        .join(_part_zero(renamed, key), [key, "_part"], "left")
        .drop("_part")
    )
    types = dict(fresh.dtypes)

    def value(c: str):
        old = [c] if c in stored.columns else []
        return F.coalesce(f"_new_{c}", f"_hot_{c}", *old)

    kept = [c for c in stored.columns if c not in new]
    merged = keyed.select(*kept, *[value(c).alias(c) for c in new])
    unkeyed = stored.filter(F.col(key).isNull()).select(
        *kept,
        *[
            (F.col(c) if c in stored.columns else F.lit(None).cast(types[c])).alias(c)
            for c in new
        ],
    )
    return merged.unionByName(unkeyed)


def _resume_key(text: Column, key_chars: int | None) -> Column:
    """What tells one review from another: its first characters, or (None) the whole text."""
    return text if key_chars is None else prefix(text, key_chars)


def done_keys(
    labelled: DataFrame, text: str = "review_body", key_chars: int | None = V.RESUME_KEY_CHARS
) -> DataFrame:
    """Distinct keys that are labelled already; rows without text count as not done."""
    return (
        labelled.filter(F.col(text).isNotNull())
        .select(_resume_key(F.col(text), key_chars).alias("done_key"))
        .distinct()
    )


def resume(
    candidates: DataFrame,
    labelled: DataFrame,
    text: str = "review",
    key_chars: int | None = V.RESUME_KEY_CHARS,
) -> DataFrame:
    """Candidates that are no spam and whose key is not labelled yet: by default their first
    characters, so reviews that begin alike count as one; ``None`` compares whole texts.

    Copies inside the candidates all stay. The few keys that very many candidates share are
    looked up by broadcast, and their rows are spread over many tasks in the join of the others.
    """
    keyed = candidates.withColumn("done_key", _resume_key(F.col(text), key_chars))
    done = done_keys(labelled, key_chars=key_chars)
    hot = hot_keys(keyed.select("done_key"), "done_key")
    hot_done = done.join(F.broadcast(hot), "done_key", "left_semi")
    clean = keyed.filter(~L.is_spam(F.col(text))).join(
        F.broadcast(hot_done), "done_key", "left_anti"
    )
    return (
        _spread_hot(clean, "done_key", hot)
        .join(_part_zero(done, "done_key"), ["done_key", "_part"], "left_anti")
        .drop("done_key", "_part")
    )


def label_run_stats(
    candidates: DataFrame,
    labelled: DataFrame,
    text: str = "review",
    key_chars: int | None = V.RESUME_KEY_CHARS,
) -> DataFrame:
    """Totals of a labelling run: reviews, spam, keys done, reviews remaining.

    One pass over the candidates: they are counted per key before anything is joined, so copies of
    a review meet as one counter each.
    """
    done = done_keys(labelled, key_chars=key_chars)
    spam = F.coalesce(L.is_spam(F.col(text)), F.lit(False))
    per_key = candidates.groupBy(_resume_key(F.col(text), key_chars).alias("done_key")).agg(
        F.count("*").alias("n"), F.count_if(spam).alias("n_spam")
    )
    flagged = per_key.join(done.withColumn("_done", F.lit(True)), "done_key", "left")
    open_rows = F.when(F.col("_done").isNull(), F.col("n") - F.col("n_spam")).otherwise(0)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return flagged.agg(
        total(F.col("n")).alias("total"),
        total(F.col("n_spam")).alias("spam"),
        total(open_rows).alias("remaining"),
    ).select("total", "spam", done.agg(F.count("*")).scalar().alias("done"), "remaining")


def phrase_lookup(rows: DataFrame, phrases: DataFrame, category: str = "category") -> DataFrame:
    """Phrase of each category from a (category, phrase) table; an unknown one in lower case.

    A plain left join: the planner broadcasts the table only if its size allows.
    """
    dim = phrases.select(F.col("category").alias(category), F.col("phrase").alias("_phrase"))
    return rows.join(dim, category, "left").select(
        *rows.columns, F.coalesce("_phrase", F.lower(category)).alias("phrase")
    )

"""The written summary of a scope, over one row per scope.

Built in steps: each step is a column the next ones read, so that no expression is repeated inside
another (a single nested expression would be copied hundreds of times into the plan).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelane import fixed_values as V
from voicelane.functions.labels import natural_phrase
from voicelane.functions.text import (
    empty_to_null,
    join_with_and,
    percent,
    pick_template,
    render,
    tuple_text,
)


def scope_context(provider: Column, location: Column, renter: Column) -> Column:
    """Renter (else provider) at location; empty text counts as missing."""
    who = F.coalesce(empty_to_null(renter), empty_to_null(provider))
    return F.coalesce(
        empty_to_null(F.concat_ws(" at ", who, empty_to_null(location))), F.lit(V.NO_CONTEXT)
    )


def _choose(index: str, templates: Sequence[str], **values: Column) -> Column:
    return F.get(F.array(*[render(t, **values) for t in templates]), F.col(index))


def with_narrative(
    scopes: DataFrame,
    name: str,
    *,
    context: str,
    total: str,
    positive: str,
    negative: str,
    praised: str,
    complained: str,
    upselling: str,
    fees: str,
    damage: str,
) -> DataFrame:
    """Adds the text ``name``: praise (or a neutral opening), then up to two issues.

    The other arguments name columns: the context text, counters, and ranked category lists.
    """
    none = F.array().cast("array<string>")
    flags = F.array_compact(
        F.array(
            F.when(F.col(upselling) > 0, V.UPSELLING_PHRASE),
            F.when(F.col(fees) > 0, V.FEES_PHRASE),
            F.when(F.col(damage) > 0, V.DAMAGE_PHRASE),
        )
    )
    steps = scopes.select(
        "*",
        percent(F.col(positive), F.col(total)).alias("_pos_pct"),
        percent(F.col(negative), F.col(total)).alias("_neg_pct"),
        F.transform(F.slice(praised, 1, V.MAX_PRAISED), lambda c: natural_phrase(c)).alias(
            "_phrases"
        ),
        F.transform(F.slice(complained, 1, V.MAX_COMPLAINED), lambda c: natural_phrase(c)).alias(
            "_complaints"
        ),
        flags.alias("_flags"),
    )
    complaints = F.when(F.col("_neg_pct") > V.NARRATIVE_PCT_ABOVE, F.col("_complaints")).otherwise(
        none
    )
    steps = steps.withColumn(
        "_issues",
        F.slice(F.array_distinct(F.concat(complaints, F.col("_flags"))), 1, V.MAX_ISSUES),
    )
    where = F.col(context)
    steps = steps.select(
        "*",
        pick_template(
            len(V.POSITIVE_TEMPLATES), where, F.col("_pos_pct"), tuple_text(F.col("_phrases"))
        ).cast("int").alias("_praise_no"),
        pick_template(len(V.FALLBACK_TEMPLATES), where, F.col(total)).cast("int").alias("_plain_no"),
        pick_template(len(V.NEGATIVE_TEMPLATES), where, tuple_text(F.col("_issues")))
        .cast("int")
        .alias("_trouble_no"),
        join_with_and(F.col("_phrases")).alias("_phrase_list"),
        join_with_and(F.col("_issues")).alias("_issue_list"),
    )
    praise = _choose(
        "_praise_no",
        V.POSITIVE_TEMPLATES,
        phrases=F.col("_phrase_list"),
        context=where,
        pct=F.col("_pos_pct"),
    )
    plain = _choose("_plain_no", V.FALLBACK_TEMPLATES, context=where)
    trouble = _choose("_trouble_no", V.NEGATIVE_TEMPLATES, phrases=F.col("_issue_list"))
    praises = (F.size("_phrases") > 0) & (F.col("_pos_pct") > V.NARRATIVE_PCT_ABOVE)
    return steps.select(
        *scopes.columns,
        F.concat_ws(
            " ",
            F.when(praises, praise).otherwise(plain),
            F.when(F.size("_issues") > 0, trouble),
        ).alias(name),
    )

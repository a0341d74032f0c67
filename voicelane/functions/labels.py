"""Category, sentiment and flag expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voicelane import fixed_values as V
from voicelane.functions.matching import (
    Groups,
    bound,
    contains_any,
    groups_in,
    native_mask,
    word_mask,
)
from voicelane.functions.text import strip

_EMPTY = "array<string>"


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast(_EMPTY)


def keep_known(categories: Column, known: Sequence[str] = V.CATEGORIES) -> Column:
    """Known names only, in their order and with their duplicates."""
    return F.filter(categories, lambda c: c.isin(*known))


def parse_categories(raw: Column, known: Sequence[str] = V.CATEGORIES) -> Column:
    """``'A, bad, B'`` to ``[A, B]``; may be empty."""
    return keep_known(F.transform(F.split(raw, ","), strip), known)


def parse_sentiment(raw: Column) -> Column:
    """First of positive, negative that occurs in the reply; else mixed."""

    def choose(text: Column) -> Column:
        return (
            F.when(F.contains(text, F.lit("positive")), "positive")
            .when(F.contains(text, F.lit("negative")), "negative")
            .otherwise(V.DEFAULT_SENTIMENT)
        )

    return bound(F.lower(raw), choose)


def normalise_sentiment(raw: Column) -> Column:
    return F.lower(strip(F.coalesce(raw, F.lit(""))))


def category_flags(categories: Column) -> dict[str, Column]:
    return {
        flag: F.array_contains(categories, category)
        for flag, category in V.FLAG_CATEGORIES.items()
    }


def primary_category(categories: Column) -> Column:
    return F.coalesce(F.get(categories, F.lit(0)), F.lit(V.DEFAULT_CATEGORY))


def format_labels(labels: Column) -> Column:
    return F.array_join(labels, ", ")


def natural_phrase(category: Column, phrases: Mapping[str, str] = V.NATURAL_PHRASES) -> Column:
    """The wording of a category; an unknown one in lower case."""
    table = F.create_map(*[F.lit(text) for pair in phrases.items() for text in pair])
    return F.coalesce(F.try_element_at(table, category), F.lower(category))


def labels_or_default(labels: Column) -> Column:
    return F.when(F.size(labels) > 0, labels).otherwise(_strings([V.DEFAULT_CATEGORY]))


def keyword_labels(review: Column, lexicon: Groups = V.LEXICON) -> Column:
    """All categories with a keyword inside the lower-cased review, in lexicon order.

    Substring semantics on purpose: ``happy`` hits ``app``. No hit gives the default category.
    """
    return labels_or_default(groups_in(word_mask(review, lexicon), list(lexicon)))


def native_keyword_labels(
    review: Column, lexicon: Groups = V.LEXICON, prune: bool = True
) -> Column:
    """The same by native expressions only."""
    return labels_or_default(groups_in(native_mask(review, lexicon, prune), list(lexicon)))


def sentiment_of(good: Column, bad: Column) -> Column:
    """Only good words positive, only bad ones negative, else mixed."""
    return (
        F.when(good & ~bad, "positive").when(bad & ~good, "negative").otherwise(V.DEFAULT_SENTIMENT)
    )


def is_spam(review: Column) -> Column:
    """Raw text shorter than the minimum, or holding a spam phrase."""
    phrase = bound(F.lower(review), lambda t: contains_any(t, V.SPAM_PHRASES))
    return (F.length(review) < V.SPAM_MIN_CHARS) | phrase


def is_precomputed(sentiment: Column, categories: Column) -> Column:
    """Scored earlier: a known sentiment and categories present (an empty list counts)."""
    return F.coalesce(sentiment.isin(*V.SENTIMENTS) & categories.isNotNull(), F.lit(False))


def repair_sentiment(sentiment: Column) -> Column:
    return F.when(sentiment.isin(*V.SENTIMENTS), sentiment).otherwise(V.DEFAULT_LABEL_SENTIMENT)


def repair_categories(categories: Column) -> Column:
    known = keep_known(categories)
    return F.when(F.size(known) > 0, known).otherwise(_strings([V.DEFAULT_CATEGORY]))


def is_rare(categories: Column) -> Column:
    return F.coalesce(F.arrays_overlap(categories, _strings(V.RARE_CATEGORIES)), F.lit(False))

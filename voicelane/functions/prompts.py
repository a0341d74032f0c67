"""Prompt texts as column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voicelane import fixed_values as V
from voicelane.functions.text import render


def _names(categories: Sequence[str]) -> Column:
    return F.lit(", ".join(categories))


def category_prompt(review: Column, categories: Sequence[str] = V.CATEGORIES) -> Column:
    return render(V.CATEGORY_PROMPT, cats=_names(categories), review=review)


def open_category_prompt(review: Column, categories: Sequence[str] = V.CATEGORIES) -> Column:
    """The variant that asks for one or more categories."""
    return render(V.OPEN_CATEGORY_PROMPT, cats=_names(categories), review=review)


def sentiment_prompt(review: Column) -> Column:
    return render(V.SENTIMENT_PROMPT, review=review)


def label_system_prompt(categories: Sequence[str] = V.CATEGORIES) -> Column:
    return render(V.LABEL_SYSTEM_PROMPT, cats_json=F.lit(json.dumps(list(categories))))


def label_user_prompt(review: Column) -> Column:
    return render(V.LABEL_USER_PROMPT, review=review)


def generation_prompt(n: Column, categories: Sequence[str] = V.CATEGORIES) -> Column:
    return render(V.GENERATION_PROMPT, n=n, cats=_names(categories))

"""Which words of which groups occur in a text, found in one pass over it.

A chain of ``contains`` reads a text once per word; with some 200 words that dominates every job
that touches review text (about six times the cost measured for the pass used here). The words are
compiled into a string-matching automaton, run by Arrow batch; it returns one small number per row
and everything else stays in the JVM. Executors need the automaton library (``pyahocorasick``);
:func:`native_mask` gives the same result without it, for callers that choose it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Groups = Mapping[str, Sequence[str]]


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row.

    The optimizer copies a computed column into every place that mentions it; a lambda variable is
    the one form it leaves alone.
    """
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def deciding_words(words: Sequence[str]) -> list[str]:
    """Words that can decide: one that contains another of its list never does."""
    unique = list(dict.fromkeys(words))
    return [w for w in unique if not any(o != w and o in w for o in unique)]


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True if any word is a substring of ``text``; stops at the first hit."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def native_mask(text: Column, groups: Groups, prune: bool = True) -> Column:
    """Bit ``i`` is set if a word of group ``i`` occurs in the lower-cased text."""

    def bits(lowered: Column) -> Column:
        parts = [
            F.when(contains_any(lowered, deciding_words(words) if prune else words), 1 << i)
            .otherwise(0)
            .cast("bigint")
            for i, words in enumerate(groups.values())
        ]
        return reduce(lambda a, b: a + b, parts)

    return bound(F.lower(text), bits)


def _automaton(values: Mapping[str, int]):
    import ahocorasick  # on the executor

    automaton = ahocorasick.Automaton()
    for word, value in values.items():
        automaton.add_word(word, value)
    automaton.make_automaton()
    return automaton


def word_mask(text: Column, groups: Groups) -> Column:
    """Like :func:`native_mask`, in one pass per text. Null text gives 0."""
    values: dict[str, int] = {}
    for i, words in enumerate(groups.values()):
        for word in deciding_words(words):
            values[word] = values.get(word, 0) | 1 << i

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(values)
        for texts in batches:
            masks = []
            for row in texts.to_pylist():
                found = 0
                if row is not None:
                    for _, bits in automaton.iter(row):
                        found |= bits
                masks.append(found)
            yield pa.array(masks, pa.int64())

    return F.arrow_udf(scan, "bigint")(F.lower(text))


def words_found(text: Column, words: Sequence[str]) -> Column:
    """Positions (in ``words``) of all words that occur in the lower-cased text."""
    values = {w: i for i, w in enumerate(words)}

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(values)
        for texts in batches:
            yield pa.array(
                [
                    [] if row is None else sorted({i for _, i in automaton.iter(row)})
                    for row in texts.to_pylist()
                ],
                pa.list_(pa.int32()),
            )

    return F.arrow_udf(scan, "array<int>")(F.lower(text))


def groups_in(mask: Column, names: Sequence[str]) -> Column:
    """Names of the set bits, in group order."""
    return F.array_compact(
        F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, n) for i, n in enumerate(names)])
    )

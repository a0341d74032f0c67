"""Quality rules as a short-circuit cascade, in DataFrame expressions only (no Python per row).

Every document gets base counts over its words ``[^\\x20\\x09-\\x0D]+`` (a null text has none):
``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters of ``[#*$%&|<>]``),
``n_dup_lines`` (``\\n``-split lines holding a word that equal an earlier line) and ``n_repeat_words``
(words covered by an 8-word window that occurs twice or more in the text, the first time included).
The base fails when there are fewer than 20 words or more than 30 % repeated words.

Method: the rules below are columns. On a bounded sample (:data:`SAMPLE_ROWS`, documented; it only
orders the rules, never decides a row) each rule's cost (seconds to evaluate it) and selectivity (share of
the sample it rejects) are measured, and the rules are tested in order of rejections per second inside
one ``CASE WHEN``, which stops at the first rule that rejects. The verdict is the same in any order; only
the work differs.

Defined results: null and empty texts have zero counts, fail the base and are not kept; ties and
repeated rows are judged alike, each row on its own; an empty table gives no rows and the rules keep the
order in which they are listed; other columns pass through, ones named like an output are replaced.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelane.llm.common import discard, written

#: Expected rows of the sample that orders the rules (a Bernoulli sample of this expected size, so it
#: stays spread over tasks; smaller tables are used whole).
SAMPLE_ROWS = 2_000
#: Rows for which the 8-word windows are compared.
WINDOW = 8
BLANK = r"[\x20\x09-\x0D]"
OUTPUTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: bound as the lambda variable of a one-element
    ``transform``, so that no optimizer rewrite copies it into the body's own lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by a window of :data:`WINDOW` words that occurs at least twice. The windows are
    sorted once per row; equal neighbours in that order mark repeated ones, and the union of their spans
    is summed from the sorted starts. The word array is bound once (:func:`_let`), as a filter pushed
    below this column would otherwise copy the split of the text into the window lambda."""
    return _let(words, _repeat_of_bound)


def _repeat_of_bound(words: Column) -> Column:
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))),
        lambda j: F.struct(F.array_join(F.slice(words, j + 1, WINDOW), " ").alias("w"), j.alias("j")),
    )

    def repeated(ordered: Column) -> Column:
        m = F.size(ordered)
        flagged = F.transform(
            ordered,
            lambda s, k: F.when(
                ((k > 0) & (F.element_at(ordered, F.greatest(k, F.lit(1))).w == s.w))
                | ((k < m - 1) & (F.element_at(ordered, F.least(k + 2, m)).w == s.w)),
                s.j,
            ),
        )
        return _let(F.sort_array(F.filter(flagged, lambda j: j.isNotNull())), covered)

    def covered(firsts: Column) -> Column:
        r = F.size(firsts)
        gaps = F.aggregate(
            F.sequence(F.lit(1), F.greatest(r - 1, F.lit(1))),
            F.lit(0).cast("bigint"),
            lambda acc, t: acc
            + F.when(t < r, F.least(F.element_at(firsts, t + 1) - F.element_at(firsts, t), F.lit(WINDOW))).otherwise(0),
        )
        return F.when(r == 0, F.lit(0).cast("bigint")).otherwise(gaps + WINDOW)

    return F.when(n < WINDOW, F.lit(0).cast("bigint")).otherwise(_let(F.sort_array(windows), repeated))


def helper_prefix(columns: list[str]) -> str:
    """A prefix for helper columns that no column of ``columns`` starts with."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def base_counts(docs: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and helper columns named ``prefix*`` for the rules
    (choose the prefix with :func:`helper_prefix` so that no column of ``docs`` clashes)."""
    t = F.col(f"`{text}`")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {o.lower() for o in OUTPUTS}]
    lines = F.split(F.coalesce(t, F.lit("")), "\n")
    worded = F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    stage = docs.select(
        *kept, _words(t).alias(prefix + "words"), worded.alias(prefix + "lines"), t.alias(prefix + "text")
    )
    words, with_word, plain = F.col(prefix + "words"), F.col(prefix + "lines"), F.col(prefix + "text")
    counted = stage.select(
        "*",
        F.size(words).cast("bigint").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.coalesce(
            F.length(plain) - F.length(F.regexp_replace(plain, r"[#*$%&|<>]", "")), F.lit(0)
        )
        .cast("bigint")
        .alias("n_symbols"),
        (F.size(with_word) - F.size(F.array_distinct(with_word))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(words).cast("bigint").alias("n_repeat_words"),
        F.size(with_word).cast("bigint").alias(prefix + "n_lines"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def rules(prefix: str = "_q_") -> dict[str, Column]:
    """Rejection rules over the base columns (true: the document goes). Thresholds are those of common
    web-text filters: mean word length 3 to 10, at most 0.1 symbols a word, at most 30 % duplicate lines,
    at most 90 % bullet lines, at most 30 % lines ending in an ellipsis, at least 80 % words with a
    letter."""
    words, lines = F.col("n_words"), F.col(prefix + "n_lines")
    line_list = F.col(prefix + "lines")
    bullets = F.size(F.filter(line_list, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[•*-]")))
    ellipses = F.size(F.filter(line_list, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")))
    lettered = F.size(F.filter(F.col(prefix + "words"), lambda w: w.rlike(r"\p{L}")))
    return {
        "word_length": (F.col("word_chars") < 3 * words) | (F.col("word_chars") > 10 * words),
        "symbols": 10 * F.col("n_symbols") > words,
        "duplicate_lines": 10 * F.col("n_dup_lines") > 3 * lines,
        "bullets": 10 * bullets > 9 * lines,
        "ellipses": 10 * ellipses > 3 * lines,
        "letters": 10 * lettered < 8 * words,
    }


def cascade_order(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """``(rule, seconds, rejected share)`` in the order of rejections per second, measured on a sample of
    at most ``sample_rows`` documents that pass the base, written once to the shared folder."""
    total = docs.count()
    if total == 0:
        return [(name, 0.0, 0.0) for name in rules()]
    picked = docs.sample(fraction=sample_rows / total, seed=7) if total > sample_rows else docs
    prefix = helper_prefix(docs.columns)
    sample = written(base_counts(picked, text, prefix).filter(~F.col("base_failed")), "rule-sample")
    measured = []
    for name, rule in rules(prefix).items():
        began = time.perf_counter()
        row = sample.agg(F.count("*").alias("n"), F.count_if(rule).alias("r")).first()
        seconds = max(time.perf_counter() - began, 1e-6)
        measured.append((name, seconds, (row["r"] / row["n"]) if row["n"] else 0.0))
    discard(sample)
    return sorted(measured, key=lambda m: -m[2] / m[1])


def judged(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and ``kept`` (false if the base fails or any rule
    rejects), the rules tested in the measured order with short circuit."""
    order = cascade_order(docs, text, sample_rows)
    prefix = helper_prefix(docs.columns)
    based = base_counts(docs, text, prefix)
    named = rules(prefix)
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for name, _, _ in order:
        verdict = verdict.when(named[name], F.lit(False))
    out = based.withColumn("kept", verdict.otherwise(F.lit(True)))
    return out.drop(*[c for c in out.columns if c.startswith(prefix)])

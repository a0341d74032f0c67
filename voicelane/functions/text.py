"""Text and number helpers with exact semantics."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from voicelane.fixed_values import FENCE, WHITESPACE


def strip(col: Column) -> Column:
    """Trim all Unicode white space (plain ``trim`` removes blanks only)."""
    return F.trim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.length(strip(F.coalesce(col, F.lit("")))) == 0


def first_of(col: Column) -> Column:
    """First element of an array-wrapped value; null where the array is missing or empty."""
    return F.get(col, F.lit(0))


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def csv_double(col: Column) -> Column:
    """Trimmed text as a number, empty as null; text that is no number fails the job."""
    return empty_to_null(strip(col)).cast("double")


def csv_bigint(col: Column) -> Column:
    """Trimmed text as an integer, truncating a fraction (``489.9`` gives 489)."""
    return csv_double(col).cast("bigint")


def csv_is_junk(col: Column) -> Column:
    """True where a CSV number would fail the cast; used to route rows to a quarantine."""
    text = empty_to_null(strip(col))
    return text.isNotNull() & text.try_cast("double").isNull()


def half_even(col: Column) -> Column:
    """Round a ratio to a whole number, ties to even."""
    return F.bround(col, 0).cast("bigint")


def half_even_2(col: Column) -> Column:
    """Round to two decimals on the exact binary value, ties to even.

    ``bround`` works on the shortest decimal text of a double, so 2.675 (binary 2.67499...) would
    go up; ``format_number`` rounds the binary value itself.
    """
    return F.replace(F.format_number(col, 2), F.lit(","), F.lit("")).cast("double")


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to a whole number, ties to even; 0 for an empty whole."""
    ratio = F.lit(100) * part / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.coalesce(half_even(ratio), F.lit(0).cast("bigint"))


def join_with_and(phrases: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``."""
    head = F.array_join(F.slice(phrases, 1, F.greatest(F.size(phrases) - 1, F.lit(0))), ", ")
    last = F.try_element_at(phrases, F.lit(-1))
    return F.when(F.size(phrases) == 1, last).otherwise(F.concat(head, F.lit(" and "), last))


def quoted(text: Column) -> Column:
    """Text as a quoted literal: single quotes, or double ones where only single ones occur inside.

    Backslash, line feed, carriage return and tab are escaped; other control characters are not.
    """
    escaped = text
    for raw, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(code))
    has_single = F.contains(text, F.lit("'"))
    has_double = F.contains(text, F.lit('"'))
    return (
        F.when(has_single & ~has_double, F.concat(F.lit('"'), escaped, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def tuple_text(items: Column) -> Column:
    """Array of text in tuple notation: ``('a', 'b')``, one element ``('a',)``, none ``()``."""
    inner = F.array_join(F.transform(items, quoted), ", ")
    comma = F.when(F.size(items) == 1, ",").otherwise("")
    return F.concat(F.lit("("), inner, comma, F.lit(")"))


def md5_mod(seed: Column, n: int) -> Column:
    """MD5 of the text as a 128-bit number, modulo ``n``: four 32-bit digits folded in a bigint."""
    digest = F.md5(seed)
    remainder = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        digit = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        remainder = (remainder * F.lit(1 << 32) + digit) % F.lit(n)
    return remainder


def pick_template(n: int, *seed_parts: Column) -> Column:
    """Which of ``n`` wordings to use: stable for equal parts, spread over different ones."""
    return md5_mod(F.concat_ws("|", *[p.cast("string") for p in seed_parts]), n)


def render(template: str, **values: Column) -> Column:
    """A ``{name}`` template as one ``concat``; values that contain braces stay as they are."""
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(values[name].cast("string"))
    return F.concat(*pieces)


def strip_fence(text: Column) -> Column:
    """Remove a Markdown code fence and a ``json`` tag around a reply."""
    trimmed = strip(text)
    inside = F.get(F.split(trimmed, FENCE), F.lit(1))
    return F.when(
        F.startswith(trimmed, F.lit(FENCE)), strip(F.regexp_replace(inside, "^json", ""))
    ).otherwise(trimmed)


def prefix(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def one_line_preview(text: Column, chars: int) -> Column:
    return F.translate(prefix(text, chars), "\n", " ")

"""Documents that are hard to handle: nulls, empty and very long texts, ties, repeated rows, clashes."""

from __future__ import annotations

LONG = "lorem ipsum dolor sit amet consectetur " * 3_000 + "x" * 20_000

DOCS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 1),
    (2, "the quick brown fox  jumps over the lazy dog and runs away", "en", "a", 2),
    (3, "The Quick brown fox jumps over the lazy dog and runs away", "en", None, 3),
    (4, None, None, "b", None),
    (5, "", "en", "b", 0),
    (6, " \t\n\r\x0b\x0c", "en", "b", 6),
    (7, LONG, "la", "c", 7),
    (8, "12345 !!! ???", None, None, 8),
    (9, "日本語のテキスト と English ▁ <s> </s> <0x41> \x00 🙂", "ja", "é", 9),
    (10, "tie", "en", "z", 10),
    (11, "tie", "en", "z", 11),
    (11, "tie", "en", "z", 11),
    (12, "the quick brown fox jumps over the lazy dog and runs away", "en", "b", 12),
    (None, "a text without an id", "en", "a", 13),
    (13, "one", None, "a", 14),
    (14, "ONE", None, "a", 15),
    (15, "a b a b", None, "a", 15),
]

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows=DOCS, extra: dict[str, str] | None = None):
    """The rows, with further columns (name and SQL) whose names clash with what operators make."""
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name, sql in (extra or {}).items():
        frame = frame.selectExpr("*", f"{sql} AS `{name}`")
    return frame

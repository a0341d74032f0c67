import re

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from voicelane.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    words = re.findall(WORD, text or "")
    n = len(words)
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [" ".join(words[j : j + 8]) for j in range(n - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = set()
    for j, w in enumerate(windows):
        if seen[w] >= 2:
            covered.update(range(j, j + 8))
    base = {
        "n_words": n,
        "word_chars": sum(len(w) for w in words),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }
    failed = n < 20 or 100 * len(covered) > 30 * n
    bullets = sum(bool(re.match(r"^[\x20\x09-\x0D]*[•*-]", x)) for x in lines)
    ellipses = sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines)
    lettered = sum(any(c.isalpha() for c in w) for w in words)
    rejected = failed or (
        base["word_chars"] < 3 * n or base["word_chars"] > 10 * n or 10 * base["n_symbols"] > n
        or 10 * base["n_dup_lines"] > 3 * len(lines) or 10 * bullets > 9 * len(lines)
        or 10 * ellipses > 3 * len(lines) or 10 * lettered < 8 * n
    )
    return base | {"base_failed": failed, "kept": not rejected}


PROSE = "The river runs past the old mill and the children walk along its banks every morning before school. "
ROWS = cases.DOCS + [
    (20, PROSE * 3, "en", "a", 1),
    (21, PROSE + "\n" + PROSE + "\n" + PROSE, "en", "a", 1),
    (22, "one two three four five six seven eight " * 2 + " ".join(f"w{i}ord" for i in range(40)), "en", "a", 1),
    (23, " ".join(f"word{i}" for i in range(30)) + " ### $$$ %%% &&& <<< >>> |||", "en", "a", 1),
    (24, "\n".join(f"- item number {i} here" for i in range(30)), "en", "a", 1),
    (25, "\n".join(f"line {i} trails off ..." for i in range(30)), "en", "a", 1),
    (26, " ".join(["12345"] * 5 + [f"w{i}x" for i in range(25)]), "en", "a", 1),
    (27, PROSE.replace(" ", "\t") * 2, "en", "a", 1),
]


def test_against_brute_force(spark):
    docs = cases.documents(spark, ROWS, {"kept": "1", "n_words": "'x'", "_q_extra": "2"})
    got = quality.judged(docs, sample_rows=5).collect()
    assert len(got) == len(ROWS)
    for row in got:
        expect = brute(row["text"])
        assert {k: row[k] for k in expect} == expect, row["doc_id"]
        assert row["_q_extra"] == 2 or row["_q_extra"] is None


def test_order_does_not_change_the_verdict(spark):
    docs = cases.documents(spark, ROWS)
    based = quality.base_counts(docs)
    named = quality.rules()
    for order in (list(named), list(reversed(named))):
        verdict = F.when(F.col("base_failed"), False)
        for name in order:
            verdict = verdict.when(named[name], False)
        kept = sorted((r[0], r[1]) for r in based.select("doc_id", verdict.otherwise(True)).collect() if r[0] is not None)
        assert kept == sorted((d, brute(t)["kept"]) for d, t, *_ in ROWS if d is not None)


def test_empty_table(spark):
    assert quality.judged(cases.documents(spark, [])).collect() == []


def test_cascade_order_is_by_rejections_per_second(spark):
    order = quality.cascade_order(cases.documents(spark, ROWS))
    assert sorted(n for n, *_ in order) == sorted(quality.rules())
    rates = [r / s for _, s, r in order]
    assert rates == sorted(rates, reverse=True)

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm import cases
from voicelane.llm import catalog, periodic


def brute_runs(ids, least=12):
    """Every period, every maximal stretch: the definition itself."""
    n, out = len(ids), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and ids[j] == ids[j + q]:
                j += 1
            length = j - i + q
            part = list(ids[i : i + length])
            smallest = next(p for p in range(1, q + 1) if part[:-p] == part[p:])
            if length >= max(least, 2 * q) and smallest == q:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_ids(rng):
    n, k = rng.randrange(0, 300), rng.choice([2, 3, 7, 50, 10_000])
    ids = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n < 4:
            break
        a, p = rng.randrange(n), rng.randrange(1, max(2, n // 3))
        seg = [rng.randrange(k) for _ in range(p)]
        for i in range(a, min(n, a + p * rng.randrange(1, 5) + rng.randrange(p + 1))):
            ids[i] = seg[(i - a) % p]
    return ids


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(300):
        ids = random_ids(rng)
        assert periodic.runs_of(np.array(ids, dtype=np.int64)) == brute_runs(ids)


@pytest.mark.parametrize("q", [1, 2, 7, 13, 64, 101])
@pytest.mark.parametrize("times", [2.0, 2.5, 3.0, 7.3])
def test_one_rare_word_per_period(q, times):
    """Roots like ``a^(q-1) b``: contexts repeat inside a period, only few positions are unique."""
    root = [0] * (q - 1) + [1]
    ids = [5, 6] + [root[i % q] for i in range(int(q * times))] + [7]
    assert periodic.runs_of(np.array(ids, dtype=np.int64)) == brute_runs(ids)


def test_collapse_keeps_first_period():
    words = "x a b c a b c a b c a b c a b c y".split()
    runs = [(1, 15, 3)]
    assert periodic.collapsed_words(words, runs) == ["x", "a", "b", "c", "y"]


def test_edge_documents(spark):
    docs = cases.documents(spark, extra={"runs": "1", "collapsed": "'c'"})
    found = {r["doc_id"]: r for r in periodic.periodic_runs(docs).collect() if r["doc_id"] is not None}
    assert found[4]["runs"] == [] and found[4]["collapsed"] == ""
    assert found[5]["collapsed"] == "" and found[6]["collapsed"] == ""
    long_words = re.findall(r"[^\x20\x09-\x0D]+", cases.LONG)
    assert [tuple(r) for r in found[7]["runs"]] == [(0, len(long_words) - 1, 6)]
    assert found[7]["collapsed"] == " ".join(long_words[:6] + long_words[-1:])


def planted_words(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, " ".join(random.Random(i).choice("ab cd ef gh".split()) for _ in range(random.Random(i).randrange(0, 60))))
            for i in range(60)] + [(60, None), (61, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    frame = frame.selectExpr("doc_id", "text", "'x' AS lang", "'s' AS source", "0L AS n_chars")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in catalog.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len({r[0] for r in rows})
    for doc_id, text in rows:
        words = planted_words(doc_id, text)
        _, ids = np.unique(np.array(words, dtype=object), return_inverse=True) if words else (None, [])
        runs = brute_runs(list(ids))
        row = got[doc_id]
        assert row["n_runs"] == len(runs)
        listed = "".join(f"{s},{l},{q}\n" for s, l, q in runs)
        assert row["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        kept = periodic.collapsed_words(words, runs)
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        if runs:
            s, l, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]))
            assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == (s, l, q, 1000 * l // q)
        else:
            assert row["start"] is None and row["period"] is None


@pytest.mark.parametrize("copies", [2, 5, 9])
def test_periods_that_repeat_a_block_inside(copies):
    rng = random.Random(copies)
    block = [rng.randrange(1000) for _ in range(30)]
    period = block * copies + [rng.randrange(1000, 2000) for _ in range(20)]
    ids = [rng.randrange(3000, 4000) for _ in range(7)] + period * 3 + period[:50]
    assert periodic.runs_of(np.array(ids, dtype=np.int64)) == brute_runs(ids)


@pytest.mark.parametrize("d, times, extra", [(2, 101, 1), (3, 90, 2), (9, 100, 4)])
@pytest.mark.parametrize("exponent", [2.0, 2.3])
def test_periods_that_repeat_a_small_period(d, times, extra, exponent):
    """Periods ``V V ... V V'``: all contexts inside repeat more often than any fixed number of members."""
    rng = random.Random(d)
    small = [rng.randrange(100 * i, 100 * i + 100) for i in range(d)]
    period = small * times + small[:extra]
    ids = [9001, 9002] + [period[i % len(period)] for i in range(int(len(period) * exponent))] + [9003]
    found = periodic.runs_of(np.array(ids, dtype=np.int64))
    assert (2, int(len(period) * exponent), len(period)) in [(s, min(l, len(ids) - 3), q) for s, l, q in found]
    assert found == brute_runs(ids)


def test_nested_and_adjoining_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(30):
        k, ids = rng.choice([2, 3, 50]), []
        for _ in range(rng.randrange(1, 4)):
            ids = ids[:60] * rng.randrange(1, 7) + [rng.randrange(k) for _ in range(rng.randrange(4))]
            ids = ids * rng.randrange(1, 4) + ids[: rng.randrange(len(ids) + 1)]
        for least in (2, 12, 40):
            assert periodic.runs_of(np.array(ids, dtype=np.int64), least) == brute_runs(ids, least)

import math
import random

import numpy as np
import pytest

from voicelane.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=16):
    valid = [(v, e) for v, e, _ in rows if e is not None and len(e) > 0 and all(c is not None and math.isfinite(c) for c in e)]
    xs = {tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e) for _, e in valid}
    fit = np.array(sorted(xs), dtype=np.float64)
    n, s = len(fit), np.array(sorted(xs), dtype=object).sum(axis=0)
    mean = fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    return n, s, mean, cov, values[order], vectors[:, order], valid


@pytest.mark.parametrize("seed", [0, 1])
def test_against_numpy(spark, seed):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 0.3) for _ in range(20)] for _ in range(40)]
    rows = [(i, base[rng.randrange(40)] if rng.random() < 0.5 else [rng.gauss(0, 0.3) for _ in range(20)], 1) for i in range(300)]
    rows += [(900, None, 1), (901, [1.0, None] + [0.0] * 18, 1), (902, [float("nan")] * 20, 1), (903, [float("inf")] + [0.0] * 19, 1), (None, base[0], 1), (5, rows[5][1], 1)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = whitening.whitened(frame).collect()
    n, s, mean, cov, values, vectors, valid = brute(rows)
    assert {r["n"] for r in got} == {n}
    assert len(got) == 16 * len(valid)
    assert max(r["identity_error"] for r in got) <= 1e-4
    by_id = {}
    for r in got:
        by_id.setdefault((r["vec_id"], r["component"]), []).append(r)
    for vec_id, e in valid:
        x = np.array([math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e])
        deviation = sum(int(d) ** 2 for d in (n * x.astype(object) - s))
        for c in range(16):
            (r, *_) = by_id[(vec_id, c + 1)]
            u = vectors[:, c]
            expect = (x - mean) @ u / math.sqrt(values[c])
            assert abs(abs(r["whitened"]) - abs(expect)) < 1e-6
            assert abs(r["explained"] - values[c] / np.trace(cov)) <= 1e-4 * values[c] / np.trace(cov)
            assert r["deviation"] == deviation


def test_sign_is_the_same_for_all_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], 0) for i in range(50)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA), components=4).collect()
    n, s, mean, cov, values, vectors, valid = brute(rows, 4)
    signs = {}
    for r in got:
        e = dict((v, e) for v, e, _ in rows)[r["vec_id"]]
        x = np.array([math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e])
        expect = (x - mean) @ vectors[:, r["component"] - 1] / math.sqrt(values[r["component"] - 1])
        if abs(expect) > 1e-3:
            signs.setdefault(r["component"], set()).add(np.sign(expect) == np.sign(r["whitened"]))
    assert all(len(v) == 1 for v in signs.values())


@pytest.mark.parametrize(
    "rows",
    [[], [(1, None, 0)], [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], [(1, [0.0, 1.0], 0), (2, [1.0, 0.0, 3.0], 0)]],
)
def test_edges_give_no_rows(spark, rows):
    assert whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_clashing_columns(spark):
    rows = [(i, [float(i % 3), float(i % 5)], 0) for i in range(30)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS x", "2 AS h", "3 AS copies", "4 AS key")
    got = whitening.whitened(frame, components=2).collect()
    assert len(got) == 60 and {r["n"] for r in got} == {15}

import math
import re

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from voicelane.llm import catalog, mixing


def water(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in open_}
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 5, "c": 900, None: 40, "é": 10, "z": 0},
    {"a": 10}, {"a": 0, "b": 0}, {"a": 1_000_000, **{f"s{i:02}": i for i in range(30)}},
])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    found = {r["source"]: r["target"] for r in mixing.targets(frame, [3, 1, 2], 1.5, 2.0).collect()}
    assert found == pytest.approx(water(sizes, [3, 1, 2], 1.5, 2.0))


def test_copies_of_a_block():
    sizes = sorted(range(1, 400), reverse=True)
    rates = [min(2.0, math.exp(0.4 - s / 300)) for s in sizes]
    copies = mixing._copies(sizes, rates, 2.0)
    assert all(math.floor(r) <= c <= min(2, math.ceil(r)) for r, c in zip(rates, copies, strict=True))
    assert abs(sum(c * s for c, s in zip(copies, sizes, strict=True)) - sum(r * s for r, s in zip(rates, sizes, strict=True))) < 2


def test_tilts_solve_the_dual(spark):
    sizes = [("a", s, 1 + s % 3) for s in range(1, 200)] + [("b", 50, 7)] + [("c", s, 2) for s in (1, 3_000, 20_000)]
    totals = {k: sum(s * n for x, s, n in sizes if x == k) for k in "abc"}
    for factor in (0.05, 1.0, 1.7, 1.999):
        wanted = spark.createDataFrame([(k, factor * t) for k, t in totals.items()], "key string, target double")
        rows = mixing.tilts(spark.createDataFrame(sizes, "key string, size bigint, n bigint"), wanted, 2.0).collect()
        for r in rows:
            taken = sum(n * s * min(2.0, math.exp(min(50, r["tilt"] * s / r["scale"]))) for x, s, n in sizes if x == r["key"])
            assert taken == pytest.approx(factor * totals[r["key"]], rel=1e-8)


def check(rows):
    target, taken, biggest = {}, {}, {}
    for r in rows:
        key = (r["source_size"], r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"]
        target[key] = r["target"]
        taken[key] = taken.get(key, 0) + r["taken"]
        biggest[key] = max(biggest.get(key, 0), r["size"])
    return target, taken, biggest


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    first = catalog.QUERIES["op10_mixing"](spark, folder).collect()
    again = catalog.QUERIES["op10_mixing"](spark, folder).collect()
    assert sorted(first) == sorted(again)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    sizes, totals = {}, {}
    for doc, r in docs.items():
        sizes[doc] = len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))
        totals[r["source"]] = totals.get(r["source"], 0) + sizes[doc]
    expected, taken = water(totals, [3, 1, 2], 1.5, 2.0), dict.fromkeys(totals, 0)
    for r in first:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == totals[source] and r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(expected[source])
        taken[source] += r["taken"]
    assert len(first) == len(docs)
    assert all(abs(taken[s] - expected[s]) <= 0.01 * expected[s] for s in totals)


def test_edge_documents(spark):
    docs = cases.documents(spark, extra={"size": "1", "copies": "2", "key": "3", "hash": "4"})
    rows = mixing.mix(docs, [3, 1, 2], 1.5, 2.0)
    assert rows.count() == len(cases.DOCS)
    check(rows.withColumn("taken", F.col("copies") * F.col("size")).collect())
    assert {r["copies"] for r in rows.filter("size = 0").collect()} == {0}
    assert mixing.mix(cases.documents(spark, []), [3, 1, 2], 1.5, 2.0).collect() == []


def test_rows_are_repeated(spark):
    docs = cases.documents(spark)
    mixed = mixing.mixed(docs, [3, 1, 2], 1.5, 2.0)
    assert mixed.columns == docs.columns
    wanted = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, [3, 1, 2], 1.5, 2.0).orderBy("copies").collect()}
    found = {}
    for r in mixed.collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
    expected = {d: n * (2 if d == 11 else 1) for d, n in wanted.items() if n}
    assert found == expected

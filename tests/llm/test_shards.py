import random
from collections import Counter, defaultdict

from tests.llm import cases
from voicelane.llm import shards


def test_longest_first():
    placed = shards.longest_first([("a", 7), ("b", 6), ("c", 5), ("d", 4), ("e", 3)], 2)
    loads = Counter()
    for key, size in {"a": 7, "b": 6, "c": 5, "d": 4, "e": 3}.items():
        loads[placed[key]] += size
    assert sorted(loads.values()) == [11, 14]  # the known result of the rule
    assert shards.longest_first([], 3) == {}


def check(rows, found, count):
    assert len(found) == len(rows)
    groups, loads, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in found:
        groups[r["g"]].add(r["shard"])
        loads[r["shard"]] += r["size"] or 0
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(0 <= s < count for s in slots)
    return loads


def test_balanced_with_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(shards, "ROWS_NUMBERED_AT_ONCE", 20)  # several windows per shard
    rng = random.Random(4)
    rows = [(i, rng.randrange(1, 4_000), rng.randrange(1, 200)) for i in range(4_000)]
    rows += [(10_000 + i, 1, 15) for i in range(1_500)]  # about as large as one shard may be
    frame = spark.createDataFrame(rows, "id bigint, g bigint, size bigint").repartition(5)
    loads = check(rows, shards.sharded(frame, 8, "g", "size").collect(), 8)
    assert max(loads.values()) - min(loads.values()) < 0.01 * sum(loads.values())


def test_nulls_clashes_and_no_rows(spark):
    rows = [(1, None, 5), (2, None, 5), (3, 7, None), (3, 7, None), (4, 8, 0)]
    frame = spark.createDataFrame(rows, "id bigint, g bigint, size bigint")
    frame = frame.selectExpr("*", "'x' AS shard", "1 AS _pack", "2 AS SLOT")
    found = shards.sharded(frame, 3, "g", "size")
    assert {"id", "g", "size", "_pack", "shard", "slot"} == set(found.columns)
    check(rows, found.collect(), 3)
    assert shards.sharded(frame.limit(0), 3, "g", "size").collect() == []


def test_documents_query_law(spark):
    from voicelane.llm import catalog

    found = catalog.QUERIES["op3_sharding"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in cases_table(spark)}
    where = defaultdict(set)
    for r in found:
        assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 and r["grown_shard"] is None
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values()) and len(found) == len(texts)


def cases_table(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()


def test_edge_documents(spark):
    docs = cases.documents(spark).selectExpr("*", "xxhash64(text) AS g", "octet_length(text) AS size")
    found = shards.sharded(docs, 4, "g", "size").collect()
    assert len(found) == len(cases.DOCS)

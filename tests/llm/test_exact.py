import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from voicelane.llm import exact


def brute(rows):
    groups = {}
    for doc, text, *_ in rows:
        plain = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(plain, []).append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for doc, text, *_ in rows:
        plain = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        keep = min(groups[plain])[3]
        out.append((doc, keep, len(groups[plain]), doc == keep, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [cases.DOCS, [], [(None, None, None, None, None)] * 3])
def test_groups(spark, rows):
    docs = cases.documents(spark, rows, {"digest": "1", "keep_id": "2", "copies": "3"})
    found = exact.exact_dedup(docs).withColumn("digest", F.lower(F.hex("digest")))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize(("partitions", "most"), [(1, 16), (5, 2), (20, 3), (17, 16)])
def test_rounds_merge_all_runs(spark, partitions, most):
    """A key with a third of the rows, others with few, over several rounds."""
    rng = random.Random(partitions)
    keys = [0 if rng.random() < 0.33 else rng.randrange(1, 200) for _ in range(2_000)]
    rows = [
        (hashlib.sha256(b"%d" % k).digest(), hashlib.md5(b"%d" % k).digest(), rng.randrange(3), i, 1)
        for i, k in enumerate(keys)
    ]
    entries = spark.createDataFrame(rows, exact.ENTRY).repartition(partitions)
    merged = exact.tree_merge(entries, partitions, most).collect()
    best = {}
    for digest, _, chars, doc, _ in rows:
        best[digest] = min(best.get(digest, (0, math.inf)), (-chars, doc))
    counts = {hashlib.sha256(b"%d" % k).digest(): keys.count(k) for k in set(keys)}
    assert {bytes(r["digest"]): (-r["chars"], r["doc_id"]) for r in merged} == best
    assert {bytes(r["digest"]): r["copies"] for r in merged} == counts and len(merged) == len(best)


def test_partners_are_few():
    for partitions in (2, 16, 17, 211, 5_000, 100_000):
        cells = exact.radices(partitions)
        assert math.prod(cells) >= partitions and max(cells) <= exact.PARTNERS


def test_equal_digests_with_another_second_digest_stay_apart(spark):
    rows = [(b"d" * 32, b"a" * 16, 1, 1, 1), (b"d" * 32, b"b" * 16, 1, 2, 1), (b"d" * 32, b"a" * 16, 1, 3, 1)]
    merged = exact.tree_merge(spark.createDataFrame(rows, exact.ENTRY), 4).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in merged) == [(1, 2), (2, 1)]


def test_filter(spark):
    docs = cases.documents(spark)
    kept = exact.deduplicated(docs)
    assert kept.columns == docs.columns
    # 1, 2 and 12 are one text (2 has most code points), as are 4 to 6 (6) and 10 and 11 (10).
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [2, 3, 6, 7, 8, 9, 10, 13, 14, 15]

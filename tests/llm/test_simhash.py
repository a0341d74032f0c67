import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm import cases
from voicelane.llm import simhash

BLANK = "[\x20\x09-\x0d]+"


def words(text):
    lowered = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    return [w for w in re.split(BLANK, lowered) if w]


def shingles(text, width):
    own = words(text)
    return [" ".join(own[i : i + width]) for i in range(max(1, len(own) - width + 1))] if own else []


def fingerprint(text, width=3):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, width)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, linked):
    root = list(range(len(values)))
    for i, j in itertools.combinations(range(len(values)), 2):
        if linked(values[i], values[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprints_of_many_sizes():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 2, 254, 255, 256, 511, 1_000, 0, 3])
    flat = rng.integers(0, 1 << 64, sizes.sum(), dtype=np.uint64)
    found, at = simhash.majority(flat, sizes), 0
    for size, value in zip(sizes.tolist(), found.tolist(), strict=True):
        own = flat[at : at + size].tolist()
        at += size
        assert value == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > size)


def test_documents(spark):
    docs = cases.documents(spark, extra={"fp": "1", "node": "2", "more": "3"})
    found = simhash.near_duplicates(docs).collect()
    rows = [(d, fingerprint(t)) for d, t, *_ in cases.DOCS]
    root = roots(rows, lambda a, b: (a[1] ^ b[1]).bit_count() <= 3)
    expected = []
    for i, (doc, fp) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i]]
        expected.append((doc, fp, min([d for d in ids if d is not None], default=None)))
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_no_documents(spark):
    none = cases.documents(spark, [])
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.similar_kept(none).collect() == []


@pytest.mark.parametrize(("distance", "skewed"), [(0, False), (3, False), (3, True), (7, True), (12, False)])
def test_links_are_complete(spark, distance, skewed):
    """All pairs within the distance, each once, for any bits, also correlated and constant ones."""
    rng = random.Random(distance)
    fps = {0, (1 << 64) - 1, 1 << 63}
    while len(fps) < 400:
        base = rng.getrandbits(64)
        if skewed:
            base = (base & 0xFF00FF) | (0xAAAA << 40) | ((base & 1) * 0xFFFF << 24)
        fps.add(base)
        for _ in range(3):
            flips = sum(1 << rng.randrange(64) for _ in range(rng.randrange(distance + 3)))
            fps.add((base ^ flips) % (1 << 64))
    fps = sorted(fps)
    signed = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in enumerate(fps)]
    frame = spark.createDataFrame(signed, "node bigint, fp bigint").repartition(3)
    found = [tuple(sorted(r)) for r in simhash.links(frame, distance).collect()]
    expected = {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= distance}
    assert len(found) == len(set(found)) and set(found) == expected


@pytest.mark.parametrize("count", [10, 10**4, 10**7, 10**10])
def test_thresholds_keep_the_pigeonhole(count):
    shares = [simhash.distances(np.ones(256, dtype=np.int64)) for _ in range(8)]
    for distance, parts in itertools.product((0, 3, 8, 12), range(1, 9)):
        cost, taken = simhash.allocated([8] * parts, shares[:parts], distance, count)
        if taken:
            assert sum(taken) == distance - parts + 1 and min(taken) >= -1


def test_larger_tables_get_wider_parts():
    def best(count):
        options = []
        for parts in (1, 2, 4, 8):
            width = 8 // parts
            share = np.ones(1)
            for _ in range(width):
                share = np.convolve(share, simhash.distances(np.ones(256, dtype=np.int64)))
            options.append((simhash.allocated([8 * width] * parts, [share] * parts, 3, count)[0], parts))
        return min(options)[1]

    assert best(10**4) >= best(10**7) >= best(10**10) and best(10**4) > best(10**10)


def test_correlated_bits_come_together():
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (4_000, 64))
    for k in range(8):  # bits k, k + 8, ... follow each other
        bits[:, k::8] ^= (rng.random((4_000, 8)) < 0.95) & (bits[:, [k]] != bits[:, k::8])
    pairs = bits.T @ bits
    blocks = simhash.together(pairs, len(bits))
    assert sorted(b for block in blocks for b in block) == list(range(64))
    assert all(len({b % 8 for b in block}) == 1 for block in blocks)


def test_similar_documents_go(spark):
    """Groups of copies with few changed words lose all but one; others stay, whatever their size."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3_000)]
    rows, group = [], {}
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(150, 400))]
        for copy in range(rng.choice([1, 2, 2, 5])):
            own = list(base)
            for _ in range(copy * len(base) // 400):
                own[rng.randrange(len(own))] = "changed"
            rows.append((len(rows), " ".join(own), "en", "s", 0))
            group[len(rows) - 1] = g
    docs = cases.documents(spark, rows, {"fp": "7", "more": "8", "hashes": "9"})
    kept = simhash.similar_kept(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    sets = [set(shingles(t, 5)) for _, t, *_ in rows]
    similar = {
        (i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    }
    root = roots(list(range(len(rows))), lambda i, j: (i, j) in similar)
    assert ids >= set(root)  # nothing goes without a near-duplicate before it
    both = [(i, j) for i, j in similar if i in ids and j in ids]
    assert len(both) <= 0.02 * len(similar)


def test_similar_edge_documents(spark):
    kept = [r["doc_id"] for r in simhash.similar_kept(cases.documents(spark)).collect()]
    assert {4, 5, 6, None} <= set(kept)  # without words or without id
    assert {1, 2, 3, 12} & set(kept) == {1} and {13, 14} & set(kept) == {13}
    assert {10, 11} & set(kept) == {10}


def test_all_similar_pairs_are_found(spark):
    """Pairs just at the threshold, alone in their group: none stays, nothing else goes."""
    rng = random.Random(17)
    rows = []
    for _ in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 200))]
        own = list(base)
        sets = set(shingles(" ".join(base), 5))
        for at in rng.sample(range(len(own)), len(own)):
            changed = [*own[:at], f"x{at}", *own[at + 1 :]]
            now = set(shingles(" ".join(changed), 5))
            if len(sets & now) < 0.8 * len(sets | now):
                break
            own = changed
        rows += [(len(rows), " ".join(base), "en", "s", 0), (len(rows) + 1, " ".join(own), "en", "s", 0)]
        if len(own) == len(base) and rng.random() < 0.5:  # the first that is too different
            rows.append((len(rows), " ".join(changed), "en", "s", 0))
    rows += [(len(rows) + i, f"a very common line of all these {i % 40} x{i} y{i}", "en", "s", 0) for i in range(300)]
    kept = {r["doc_id"] for r in simhash.similar_kept(cases.documents(spark, rows)).collect()}
    sets = [set(shingles(t, 5)) for _, t, *_ in rows]
    where = {}
    for i, own in enumerate(sets):
        for s in own:
            where.setdefault(s, []).append(i)
    pairs = {p for ids in where.values() for p in itertools.combinations(ids, 2)}
    similar = {p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])}
    root = list(range(len(rows)))
    for i, j in similar:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    assert len(similar) >= 300 and kept == set(root)

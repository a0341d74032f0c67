import numpy as np
import pytest

from voicelane.llm import embeddings

NAN, INF = float("nan"), float("inf")


def brute(rows, least=0.98):
    good = {}
    for i, (_, vector, label) in enumerate(rows):
        if label is None or not vector or None in vector or not np.isfinite(vector).all() or not np.any(vector):
            continue
        wide = np.array(vector, dtype=np.float32).astype(np.float64)
        good[i] = wide / np.linalg.norm(wide)
    links, root = [0] * len(rows), list(range(len(rows)))
    for i in good:
        for j in good:
            if i < j and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= least:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    out = []
    for i, (vec, *_) in enumerate(rows):
        component = min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])
        out.append((vec, links[i], component, vec == component))
    return sorted(out)


def vectors(count, seed, groups, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        if groups and rng.random() < 0.5:
            base = np.random.default_rng(int(rng.integers(groups))).normal(size=dims)
            own = base + rng.normal(size=dims) * 0.08
        else:
            own = rng.normal(size=dims)
        rows.append((i, own.astype(np.float32).tolist(), int(rng.integers(2))))
    return rows


def run(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    frame = frame.selectExpr("*", "1 AS node", "'x' AS `group`", "2 AS root")
    return sorted(tuple(r) for r in embeddings.near_duplicates(frame).collect())


def test_hard_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 1), (2, one, 1), (3, [2.0, 4.0, 6.0], 1), (4, one, 2), (5, one, None), (6, None, 1),
        (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (9, [1.0, None, 3.0], 1), (10, [1.0, NAN, 3.0], 1),
        (11, [1.0, INF, 3.0], 1), (12, [1.0, 2.0], 1), (13, [-1.0, -2.0, -3.0], 1),
        (14, [3e38, 3e38, 3e38], 3), (15, [3e38, 3e38, 2.9e38], 3), (16, [1e-30, 2e-30, 3e-30], 1),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("slices", [False, True])
def test_recall_and_precision(spark, monkeypatch, slices):
    """Many clusters, or few that are cut into slices; an exact audit of all links."""
    monkeypatch.setattr(embeddings, "CLUSTER", 10_000 if slices else 60)
    monkeypatch.setattr(embeddings, "SLICE", 150)
    rows = vectors(700, 1, 25)
    found, true = run(spark, rows), brute(rows)
    links = sum(r[1] for r in true)
    assert links > 500
    assert all(a[1] <= b[1] for a, b in zip(found, true, strict=True))
    assert sum(r[1] for r in found) >= 0.97 * links
    assert sum(a[2] == b[2] for a, b in zip(found, true, strict=True)) >= 0.99 * len(rows)


def test_pruned_edges_differ_in_direction():
    rng = np.random.default_rng(2)
    points = embeddings.unit(rng.normal(size=(300, 8)))
    graph = embeddings.pruned_graph(points, 12, 1)
    assert graph.shape == (300, 12) and (graph != np.arange(300)[:, None]).all()
    for p, own in enumerate(graph[:50]):
        own = own[own >= 0]
        far = np.linalg.norm(points[own] - points[p], axis=1)
        for k in range(1, len(own)):
            between = np.linalg.norm(points[own[:k]] - points[own[k]], axis=1)
            assert (embeddings.ALPHA * between > far[k] - 1e-3).all()


def test_audit_sees_missing_links(spark):
    rows = [(i, "1:2", [1.0, 0.001 * i], 1) for i in range(20)]
    nodes = spark.createDataFrame(rows, "node bigint, group string, vector array<float>, copies bigint")
    counted = spark.createDataFrame([(i, 19 if i % 2 else 0) for i in range(20)], "node bigint, n_links bigint")
    assert embeddings.audit(nodes, counted, 0.98) == pytest.approx(0.5)
    assert embeddings.audit(nodes.limit(0), counted, 0.98) == 1.0

import sys

import numpy as np

from blotter.llm import topk


def test_against_brute_force(spark):
    chance = np.random.default_rng(1)
    vectors = chance.normal(size=(500, 6)).round(1).astype("float32")
    vectors[100:220] = vectors[7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1020, [1.0] * 5 + [float("nan")]), (1040, [None] + [1.0] * 5),
             (1060, [float("inf")] * 6), (None, [1.0] * 6), (20, vectors[20].tolist()),
             (1080, [1.0, 2.0]), (1081, [1.0, -2.0]), (1100, [])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(data).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ints = np.floor(64 * vectors.astype(float)).astype(int)
    for q in range(0, 500, 20):
        scores = ints @ ints[q]
        order = sorted((i for i in range(500) if i != q), key=lambda i: (-scores[i], i))[:20]
        assert got.pop(q) == {n + 1: (i, scores[i]) for n, i in enumerate(order)}
    assert got == {1080: {1: (1081, 64 * 64 - 128 * 128)}}


def test_pruning_is_exact_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 25)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    chance = np.random.default_rng(2)
    vectors = (chance.normal(size=(400, 3)) + 3 * chance.integers(-1, 2, (400, 1))).astype("float32")
    data = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>"
    )
    rows = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(data, k=5).collect()}
    ints = np.floor(64 * vectors.astype(float)).astype(int)
    for q in range(0, 400, 20):
        scores = ints @ ints[q]
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-scores[i], i))[:5]
        assert [rows[q, n + 1] for n in range(5)] == [(i, scores[i]) for i in order]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, cell int")
    assert topk.top_k(empty).count() == 0


def test_all_vectors_of_an_id_take_part(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_ROWS", 30)
    chance = np.random.default_rng(3)
    rows = [(int(i), v) for i, v in zip(chance.integers(0, 60, 200), chance.normal(size=(200, 3)).round(1).tolist())]
    data = spark.createDataFrame(rows + rows[:40], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(data, k=7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    ints = {(i, tuple(np.floor(64 * np.array(v)).astype(int).tolist())) for i, v in rows}
    for q in {i for i, _ in ints if i % 20 == 0}:
        found = [
            (int(np.dot(v, w)), j) for i, v in ints if i == q for j, w in ints if j != q
        ]
        best = sorted(found, key=lambda x: (-x[0], x[1]))[:7]
        assert [got[q][n + 1] for n in range(7)] == best


def test_queries_go_through_a_tree_together():
    """Calls grow with the leaves, not with the pairs of query and leaf, and results stay exact."""
    chance = np.random.default_rng(4)
    points = chance.integers(-40, 41, (3000, 24))
    points[500:540] = points[3]
    others, asked = np.arange(3000) // 2, np.arange(400) * 3
    queries, kth = chance.integers(-40, 41, (400, 24)), np.full(400, -np.inf)
    kth[::4] = np.sort(queries[::4] @ points.T, axis=1)[:, -5]
    kth[7] = 1e9
    with np.load(topk.io.BytesIO(topk.build_tree(others, points))) as file:
        tree = dict(file)
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = topk.search_tree(tree, asked, queries, kth, 9)
    finally:
        sys.setprofile(None)
    leaves = int((tree["nodes"][:, 0] < 0).sum())
    assert calls[0] < 200 * leaves
    scores = queries @ points.T
    for i, me in enumerate(asked.tolist()):
        fit = [(-s, o) for s, o in zip(scores[i].tolist(), others.tolist()) if o != me and s >= kth[i]]
        assert sorted((-s, o) for q, o, s in found if q == me) == sorted(fit)[:9]

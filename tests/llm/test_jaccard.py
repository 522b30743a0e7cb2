import tracemalloc

import numpy as np
import pytest

from blotter import storage
from blotter.llm import jaccard


def plain_components(docs, k, percent):
    sets = {d: set(jaccard.shingle_set(t, k).tolist()) for d, t in docs}
    root = {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(root)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_against_brute_force(spark, words, k, percent):
    import random

    chance = random.Random(percent)
    docs, passage = [], words(14)
    for d in range(140):
        if d % 7 == 0:
            base = words(chance.choice([3, 6, 7, 8, 20, 60, 120]))
        text = list(base)
        for _ in range(chance.randrange(0, max(1, len(base) // 12))):
            text[chance.randrange(len(text))] = words(1)[0]
        if d % 3 == 0:
            text += passage
        docs.append((d, " ".join(text)))
    rows = jaccard.jaccard_components(
        spark.createDataFrame(docs, "doc_id long, text string"), k=k, percent=percent, frequent=4
    ).collect()
    assert {r.doc_id: r.component_id for r in rows} == plain_components(docs, k, percent)
    assert {r.doc_id: r.n_shingles for r in rows} == {
        d: len(jaccard.shingle_set(t, k)) for d, t in docs
    }


def test_prefix_lemma(words):
    """Sets that link share as many prefix tokens as the smaller demand."""
    for _ in range(60):
        a = words(90, 5000)
        b = list(a)
        b[17] = b[51] = "other"
        x, y = (np.sort(jaccard.shingle_set(" ".join(t), 4)) for t in (a, b))
        heavy = np.sort(x[::3]), np.full(len(x[::3]), 50)
        for counts in ((heavy[0][:0], heavy[1][:0]), heavy):
            (l, p), (m, q) = (jaccard.adaptive_prefix(s, 85, *counts) for s in (x, y))
            if jaccard.links(x, y, 85):
                assert len(np.intersect1d(p, q)) >= min(l, m)
                overlap = -(-85 * (len(x) + len(y)) // 185)
                early, soon = (t[: len(z) - overlap + min(l, m)] for t, z in ((p, x), (q, y)))
                assert len(np.intersect1d(early, soon)) >= min(l, m)


def test_edge_rows(edge, spark):
    rows = jaccard.jaccard_components(edge("node")).collect()
    assert len(rows) == 7
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in rows if r.doc_id in (1, 2, 5))
    assert [r.component_id for r in rows if r.doc_id == 3] == [3, 3]
    kept = jaccard.one_per_component(edge("_kept"))
    assert kept.columns == edge("_kept").columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, i) for i in (1, 2, 3, 4, 5)
    ] + [(True, 0)]
    assert jaccard.jaccard_components(edge(rows=[])).count() == 0


def test_large_group_of_near_copies(spark, words):
    base = words(80, 5000)
    docs = []
    for d in range(300):
        text = list(base)
        text[d % 80] = f"x{d}"
        docs.append((d, " ".join(text)))
    docs += [(1000 + d, docs[0][1]) for d in range(200)] + [(2000, " ".join(words(80, 5000)))]
    rows = jaccard.jaccard_components(
        spark.createDataFrame(docs, "doc_id long, text string"), k=4, percent=80
    ).collect()
    assert {r.component_id for r in rows if r.doc_id < 2000} == {0}
    assert {r.component_id for r in rows if r.doc_id == 2000} == {2000}


def test_different_texts_that_share_an_id_or_have_none_stay(spark, words):
    texts = [" ".join(words(30, 9000)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(repr, jaccard.one_per_component(docs).collect())) == sorted(map(repr, docs.collect()))
    copies = docs.union(docs).union(spark.createDataFrame([(8, texts[1]), (5, texts[3] + " end")], docs.schema))
    kept = sorted((r.doc_id is None, r.doc_id or 0, texts.index(r.text) if r.text in texts else 9)
                  for r in jaccard.one_per_component(copies).collect())
    assert kept == [(False, 5, 9), (False, 7, 2), (False, 8, 1), (False, 9, 4), (True, 0, 0)]


def test_sketches_never_differ_more_than_sets(words):
    sizes, sets = [1, 3, 20, 31, 33, 90, 300, 5000, 9000], []
    for n in sizes:
        a = words(n, 100_000)
        b = [w if i % 11 else "other" for i, w in enumerate(a)]
        sets += [jaccard.shingle_set(" ".join(t), 1) for t in (a, b, a[: n // 2 + 1], a + b[:7])]
    sketches = jaccard.Sketches([jaccard.sketch(s) for s in sets])
    left, right = (i.ravel() for i in np.indices((len(sets), len(sets))))
    differ = sketches.differing(left, right)
    apart = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(left, right)])
    assert (differ <= apart).all() and (differ[left == right] == 0).all()
    # Near copies of up to a few thousand tokens are told apart.
    for i, size in enumerate(sizes[3:8], 3):
        assert differ[(left == 4 * i) & (right == 4 * i + 1)] > 0.4 * apart[(left == 4 * i) & (right == 4 * i + 1)]


def test_group_that_just_misses_gives_few_pairs(spark, words):
    """Near copies that differ in too much: nearly no pair is left to verify."""
    base, docs = words(120, 5000), []
    for d in range(150):
        text = list(base)
        for i in range(3):
            text[(7 * d + 40 * i) % 120] = f"x{d}"
        docs.append((d, " ".join(text)))
    table = spark.createDataFrame(docs, "_id long, text string")
    heavy = jaccard.frequent_tokens(table, "text", 4, frequent=4, most_frequent=1000)
    nodes = jaccard._nodes(jaccard._keyed(table.selectExpr("_id AS doc_id", "text", "_id"), "doc_id", "text", 4, 85, heavy))
    shared = jaccard._shared_tokens(nodes)
    marked = shared.withColumn("component", shared.node)
    across = {(r.a, r.b) for r in jaccard._across(marked, nodes, 85).collect()}
    of = {r.node: r._id for r in nodes.collect()}
    sets = {d: jaccard.shingle_set(t, 4) for d, t in docs}
    links = {(a, b) for a in of for b in of if a < b and jaccard.links(sets[of[a]], sets[of[b]], 85)}
    assert links <= across
    assert len(across) <= len(links) + 150 * 149 // 20


def test_pairs_across_meet_in_groups_of_bounded_bytes(spark, words, monkeypatch):
    """Sketches count for the size of a group; the pairs are the same in many groups."""
    base, docs = words(120, 5000), []
    for d in range(60):
        text = list(base)
        for i in range(2):
            text[(7 * d + 40 * i) % 120] = f"x{d}"
        docs.append((d, " ".join(text)))
    table = spark.createDataFrame(docs, "_id long, text string")
    heavy = jaccard.frequent_tokens(table, "text", 4, frequent=4, most_frequent=1000)
    nodes = jaccard._nodes(jaccard._keyed(table.selectExpr("_id AS doc_id", "text", "_id"), "doc_id", "text", 4, 85, heavy))
    shared = jaccard._shared_tokens(nodes)
    marked = shared.withColumn("component", shared.node)
    whole = sorted((r.a, r.b) for r in jaccard._across(marked, nodes, 85).collect())
    assert whole
    monkeypatch.setattr(jaccard, "GROUP_BYTES", 1 << 16)
    assert sorted((r.a, r.b) for r in jaccard._across(marked, nodes, 85).collect()) == whole


def test_few_groups_get_the_sketch_of_a_node(spark, monkeypatch):
    """Tokens of near copies lie in one group, and too many of them in several."""
    rows = [(100 * c + i, 10 * c + d, 0, 50, 1, 10 * c + d) for c in range(40) for i in range(9) for d in range(6)]
    marked = spark.createDataFrame(rows, jaccard._SHARED + ", component long")
    monkeypatch.setattr(jaccard, "GROUP_BYTES", 4 * 9 * 6 * (100 + jaccard._ITEM.itemsize))
    grouped = jaccard._grouped(marked)
    assert grouped.count() == len(rows) and grouped.select("g").distinct().count() > 4
    assert grouped.select("g", "token").distinct().count() == 40 * 9
    assert grouped.select("g", "node").distinct().count() == 40 * 6
    monkeypatch.setattr(jaccard, "GROUP_BYTES", 2 * 6 * (100 + jaccard._ITEM.itemsize))
    assert jaccard._grouped(marked).groupBy("g").count().selectExpr("max(count)").first()[0] < len(rows) // 10


def test_tables_that_are_read_no_more_go(spark, words, tmp_path, monkeypatch):
    """Texts, and the prefixes and sketches of all rows, don't stay until the end."""
    monkeypatch.setattr(storage, "shared_dir", lambda spark: str(tmp_path))
    base = words(60, 5000)
    docs = [(d, " ".join([*base[:d], f"x{d}", *base[d + 1 :]])) for d in range(30)]
    docs += [(100 + d, " ".join(words(60, 90_000))) for d in range(30)]
    rows = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), k=4, percent=80)
    assert {r.component_id for r in rows.collect()} == {0, *range(100, 130)}
    left = {}
    for path in tmp_path.iterdir():
        left.setdefault(path.name.rsplit("-", 1)[0], []).append(spark.read.parquet(str(path)))
    named = {name: tables for name, tables in left.items() if name.startswith("jaccard")}
    assert not {"jaccard-texts", "jaccard-mixed"} & set(named)
    (keys,), (nodes,) = named["jaccard-keys"], named["jaccard-nodes"]
    assert keys.count() == 60 and set(keys.columns) == {"doc_id", "_content", "n_shingles", "k1", "k2"}
    assert nodes.count() <= 30 and "prefix" not in nodes.columns


def _made(spark, monkeypatch, call):
    """The function of a task that `call` gives to `map_batches`."""
    made = []

    def stop(df, make, schema, last=None):
        made.extend([make, last])
        raise InterruptedError

    monkeypatch.setattr(jaccard, "map_batches", stop)
    with pytest.raises(InterruptedError):
        call()
    return made


def test_tasks_take_little_memory(spark, monkeypatch):
    nodes = spark.createDataFrame([(0, 8, 1, b"")], "node long, n int, ask int, prefix binary")
    make, last = _made(spark, monkeypatch, lambda: jaccard._shared_tokens(nodes))
    chance, dealer, dealt = np.random.default_rng(5), make(), 0
    prefixes = [chance.integers(0, 1 << 63, 20_000, np.uint64).tobytes() for _ in range(40)]
    tracemalloc.start()
    for at in range(0, 40, 4):
        for _, items in dealer(range(4), [20_000] * 4, [1] * 4, prefixes[at : at + 4]):
            dealt += len(items)
    dealt += sum(len(items) for _, items in last(dealer))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dealt == 800_000 * jaccard._ITEM.itemsize
    assert peak < 40e6


def test_counts_of_tokens(spark, words, monkeypatch):
    """The counts are those of all distinct sets, wherever they are folded."""
    docs = spark.createDataFrame([("",)], "text string")
    monkeypatch.setattr(jaccard, "COUNTED_AT_ONCE", 100)
    make, last = _made(
        spark, monkeypatch, lambda: jaccard.frequent_tokens(docs, "text", 1, frequent=2, most_frequent=9)
    )
    counter, texts = make(), [" ".join(words(30, 200)) for _ in range(40)]
    for at in range(0, 40, 7):
        assert not counter(texts[at : at + 7] + texts[:1])
    tokens, counts = np.unique(np.concatenate([jaccard.shingle_set(t, 1) for t in texts]), return_counts=True)
    twice = counts > 1
    assert dict(last(counter)) == dict(zip(tokens[twice].astype(np.int64).tolist(), counts[twice].tolist()))

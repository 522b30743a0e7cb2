import random

import numpy as np

from blotter.llm import lines


def test_every_window_holds_a_fingerprint():
    chance = np.random.default_rng(3)
    for n in range(40):
        grams = chance.integers(0, 6, n).astype(np.uint64)
        at = lines.winnowed(grams, 4).tolist()
        for start in range(max(0, n - 3)):
            inside = [i for i in at if start <= i < start + 4]
            assert inside and min(grams[start : start + 4]) in [grams[i] for i in inside]
        assert bool(at) == bool(n)


def plain_dedup(docs, gram, window, long_words):
    """Remove what equals an earlier run, found from all fingerprints, line by line."""
    parsed = {d: lines.text_lines(t) for d, t in docs}
    body = {d: [p[0][i] for i in p[1]] for d, p in parsed.items()}
    first, marks = {}, {}
    for d in sorted(body):
        hashes = lines.word_hashes([x.encode() for x in body[d]])
        marks[d] = lines.fingerprints(hashes, np.array(parsed[d][2]), long_words, gram, window)
        for mark, place in marks[d]:
            first[mark] = min(first.get(mark, (d, place)), (d, place))
    gone = {d: set() for d in body}
    for d, found in marks.items():
        for mark, place in found:
            e, there = first[mark]
            if (e, there) == (d, place):
                continue
            for step in (1, -1):
                i, j = place, there
                while 0 <= i < len(body[d]) and 0 <= j < len(body[e]) and body[d][i] == body[e][j]:
                    gone[d].add(i)
                    i, j = i + step, j + step
    return {
        d: "\n".join(
            x for i, x in enumerate(p[0]) if i not in {p[1][k] for k in gone[d]}
        )
        for d, p in parsed.items()
    }


def test_runs_against_brute_force(spark):
    chance = random.Random(5)
    pool = [f"line {i} of some words" for i in range(12)] + [f"long {i} " + "w " * 30 for i in range(3)]
    docs = []
    for d in range(60):
        out = []
        while len(out) < 12:
            at = chance.randrange(len(pool) - 4)
            out += pool[at : at + chance.randrange(1, 5)] if chance.random() < 0.6 else [f"own {d} {len(out)}"]
        docs.append((d, "\n".join(out)))
    rows = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == plain_dedup(docs, 3, 4, 25)
    left = "\n".join(r.text for r in rows).split("\n")
    assert set(left) == {x for _, t in docs for x in t.split("\n")}
    assert len(left) < sum(t.count("\n") + 1 for _, t in docs)


def test_a_run_goes_whole_where_its_long_line_came_alone_before(spark):
    """Document 3 k has only the long line, the next two share a run of five lines around it."""
    chance, docs = random.Random(8), []
    for k in range(60):
        long = f"long {k} " + "w " * 30
        run = [f"run {k} {i}" for i in range(4)]
        run.insert(chance.randrange(5), long)

        def around(rows, d):
            own = [f"own {k} {d} {i}" for i in range(6)]
            at = chance.randrange(7)
            return own[:at] + rows + own[at:]

        docs += [(3 * k + d, "\n".join(around(rows, d))) for d, rows in enumerate(([long], run, run))]
    rows = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    left = {r.doc_id: r.text for r in rows}
    for k in range(60):
        assert left[3 * k] == docs[3 * k][1]
        assert "long" not in left[3 * k + 1] and "run" in left[3 * k + 1]
        assert "run" not in left[3 * k + 2] and "long" not in left[3 * k + 2]
        assert left[3 * k + 2].count("own") == 6


def test_long_passage_and_clean_documents(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, f"start {i}\n{passage}\nend {i}") for i in range(40)] + [(99, "clean one\nclean two")]
    rows = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].text == docs[0][1] and by_id[99].text == docs[-1][1]
    assert all(by_id[i].text == f"start {i}\nend {i}" and by_id[i].removed_lines == [1] for i in range(1, 40))


def test_edge_rows(edge):
    for name in ("_id", "_content", "_runs", "_mark", "removed"):
        docs = edge(name)
        out = lines.dedup_lines(docs, removed=None)
        assert out.columns == docs.columns
        assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    assert lines.dedup_lines(edge(rows=[])).count() == 0

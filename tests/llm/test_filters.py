import random
from collections import Counter
from itertools import permutations

import numpy as np

from blotter.llm import filters


def plain_fails(rows):
    """The failing filters of (doc_id, text, lang) rows, written out."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if w]
        fails = "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text))
        fails += "D" * any(c in "#$%&*|" for c in text)
        before = [i for i, t, _ in rows if i is not None and (t or "") == text]
        fails += "E" * (doc_id is not None and min(before) < doc_id)
        out.append(fails)
    return out


def plain_audit(rows, good, toxic):
    fails = plain_fails(rows)
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(i, f) for (i, _, lang), f in zip(rows, fails) if (lang or "") == part]
        removed_of = Counter()
        for order in map("".join, permutations("ABCDE")):
            gone = set()
            for step, letter in enumerate(order, 1):
                here = {k for k, (_, f) in enumerate(mine) if letter in f and k not in gone}
                redundant = sum(letter in f for k, (_, f) in enumerate(mine) if k in gone)
                gone |= here
                removed_of[letter] += len(here)
                out[part, order, step] = (
                    len(mine) - len(gone), len(here), redundant, sum(f == letter for _, f in mine),
                    sum(mine[k][0] in good for k in here), sum(mine[k][0] in toxic for k in here), letter,
                )
        for key in [k for k in out if k[0] == part]:
            out[key] = (*out[key][:6], removed_of[out[key][6]])
    return out


def corpus():
    chance = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"w{chance.randrange(chance.choice([20, 900]))}" for _ in range(chance.choice([3, 199, 200, 260]))]
        text = chance.choice([" ", "\n", " \x0b"]).join(words)
        text = chance.choice(["", "", "", "ABCDEF " * 9, "# "]) + text
        rows.append((i, text, chance.choice(["en", "de", None])))
    rows += [(100 + i, rows[i][1], chance.choice(["en", "fr"])) for i in range(0, 30, 2)]
    rows += [(None, rows[0][1], "en"), (None, None, "en"), (7, "", None), (7, "", None), (200, None, "it")]
    return rows


def test_against_the_plain_audit(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(
        [(i, i % 2, int(i % 3 == 0)) for i in range(0, 140)] + [(7, 0, 0), (None, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    failing = filters.failing_filters(docs, labels)
    got = Counter((r.id, r.part, r.fails) for r in failing.collect())
    assert got == Counter((i, lang or "", f) for (i, _, lang), f in zip(rows, plain_fails(rows)))
    good = {i for i in range(140) if i % 2}
    audit = {
        (r.part, r.filter_order, r.step): (
            r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley
        )
        for r in filters.audit_orders(failing).collect()
    }
    assert audit == plain_audit(rows, good, {i for i in range(140) if i % 3 == 0})


def test_the_matrix_gives_the_words_back(spark):
    rows = [(i, t) for i, t, _ in corpus()]
    matrix, words = filters.document_term_matrix(
        spark.createDataFrame(rows, "doc_id long, text string"), most_words=300, bucket_words=200
    )
    names = {r.id: r.word for r in words.collect()}
    assert len(set(names.values())) == len(names) >= 900
    assert matrix.count() > 1
    found = []
    for shard in matrix.collect():
        ends = np.frombuffer(shard.offsets, "<i8")
        columns = np.frombuffer(shard.columns, "<i8")
        counts = np.frombuffer(shard.counts, f"<u{len(shard.counts) // len(columns)}")
        for row, a, b in zip(shard.rows, ends, ends[1:]):
            found.append((row.doc_id, {names[c]: n for c, n in zip(columns[a:b].tolist(), counts[a:b].tolist())}))
    expected = [(i, dict(Counter((t or "").split()))) for i, t in rows]
    assert sorted(map(repr, ((i, sorted(d.items())) for i, d in found))) == sorted(
        map(repr, ((i, sorted(d.items())) for i, d in expected))
    )


def test_edge_rows(spark, edge):
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    for name in ("n", "fails", "_digest", "shard", "part", "quality"):
        failing = filters.failing_filters(edge(name), labels)
        rows = Counter((r.id, r.part, r.fails, r.good) for r in failing.collect())
        # The text of document 2 equals the null text of document 1.
        assert rows[1, "en", "A", False] == 1 and rows[2, "de", "AE", False] == 1
        assert rows[3, "", "A", True] == 2 and rows[4, "fr", "B", False] == 1
        assert filters.audit_orders(failing).count() == 600 * 5
    assert filters.audit_orders(filters.failing_filters(edge(rows=[]), labels)).count() == 0
    nobody = spark.createDataFrame([], labels.schema)
    assert not any(r.good or r.toxic for r in filters.failing_filters(edge(), nobody).collect())

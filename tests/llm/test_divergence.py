import random
from collections import Counter, defaultdict

import numpy as np

from blotter.llm import divergence


def plain_terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalpha() or ord(c) >= 128 else " " for c in lowered).split(" ")


def plain_divergence(rows, least):
    """All rows of the result from (text, lang, source) rows, written out."""
    group, docs_of = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [t for t in plain_terms(text) if t]
        group[lang or "", source or ""].update(terms)
        docs_of[lang or ""].update(set(terms))
    out = set()
    for lang in docs_of:
        kept = sorted((t for t, n in docs_of[lang].items() if n >= least), key=str.encode)
        mine = {s: c for (x, s), c in group.items() if x == lang}
        mine_all = sum(mine.values(), Counter())

        def p(counts, term):
            total = sum(counts[t] for t in kept)
            return 1 + 1_000_000_000 * (counts[term] + 5) // (total + 5 * len(kept))

        for s, counts in mine.items():
            pairs = [
                (-sum(abs(p(counts, t) - p(other, t)) for t in kept), o)
                for o, other in mine.items() if o != s
            ]
            terms = [(p(mine_all, t) - p(counts, t), t) for t in kept if counts[t]]
            terms = [x for x in terms if x[0] < 0]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (x[0], x[1].encode()))
                ranked = ranked[: 50 if part == "term" else None]
                out |= {(lang, s, part, item, -v, i) for i, (v, item) in enumerate(ranked, 1)}
    return out


def corpus(n=150):
    chance = random.Random(11)
    words = [f"{a}{b}" for a in "abcdefghé你\U0001f600" for b in ("", "X", "y", "Zz", "É", "q9")]
    rows = []
    for _ in range(n):
        source = chance.choice(["s1", "s2", "s3", "é", "z", None])
        own = words[hash(source) % 7 :][:20] if source else words
        text = chance.choice([" ", "-", "  "]).join(chance.choices(chance.choice([words, own]), k=30))
        rows.append((text, chance.choice(["en", "en", "de", None]), source))
    return rows + [(None, "en", "empty"), ("", "xx", "a"), ("once", "xx", "b"), ("1 2", "yy", "only")]


def rows_of(df):
    return {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect()}


def test_against_the_plain_sums(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    out = divergence.source_divergence(docs, least=4, width=16, block=2)
    assert out.count() == len(rows_of(out))
    assert rows_of(out) == plain_divergence(rows, 4)
    assert {r[2] for r in rows_of(out)} == {"pair", "term"}


def test_equal_subtrees_are_one_node():
    counts = np.zeros((6, 64), np.int64)
    counts[1:3, 5] = 3
    counts[3] = np.arange(64)
    counts[4] = counts[3]
    trees = divergence.ConsedTrees(counts)
    assert trees.roots[1] == trees.roots[2] and trees.roots[3] == trees.roots[4]
    # A tree of zeros has one node per level, and one changed count adds one node per level.
    assert all(len(left) <= 2 + 64 // 2 ** (k + 1) for k, (left, _) in enumerate(trees.levels))
    for a in range(6):
        assert trees.leaves(a, 0).tolist() != [] or not counts[a].any()
        assert sorted(trees.leaves(a, 0).tolist()) == np.flatnonzero(counts[a]).tolist()
        for b in range(6):
            x, y, times = trees.count_pairs(a, b)
            assert Counter({(p, q): n for p, q, n in zip(x.tolist(), y.tolist(), times.tolist())}) == Counter(
                zip(counts[a].tolist(), counts[b].tolist())
            )
    x, _, _ = trees.count_pairs(1, 2)
    assert len(x) == 2


def test_shares_stay_exact():
    big = 10**13
    found = divergence.shares(np.array([0, big, divergence.BEYOND]), 3 * big, 7)
    under = 3 * big + 35
    assert found.tolist() == [1 + 5 * 10**9 // under, 1 + 10**9 * (big + 5) // under, 0]


def test_edge_rows(spark, edge):
    for name in ("term", "g", "item", "value"):
        found = rows_of(divergence.source_divergence(edge(name), least=1))
        rows = [(r.text, r.lang, r.source) for r in edge(name).collect()]
        assert found == plain_divergence(rows, 1)
    assert divergence.source_divergence(edge(rows=[])).count() == 0

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from blotter.llm import quality
from blotter.llm.common import word_hashes


def plain_counts(text):
    """The four base counts, written out."""
    words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {
        i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)
    }
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return (sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é#*<\n\t ", max_size=60))
def test_base_counts(text):
    raw = text.encode()
    words = raw.split()
    assert quality.base_counts(raw, words, word_hashes(words)) == plain_counts(text)


def test_ratio_is_the_log_of_the_shares(spark, words):
    texts = [(i, " ".join(words(80))) for i in range(30)] + [(99, "junk!! " * 60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    out = {r.doc_id: r for r in quality.quality_rules(docs, trusted, buckets=512).collect()}
    grams = {
        i: quality.gram_buckets(word_hashes(t.encode().split()), 512) for i, t in texts
    }
    raw = sum(np.bincount(g, minlength=512) for g in grams.values())
    target = sum(np.bincount(grams[i], minlength=512) for i in range(10))
    ratio = np.log((target + 20) / (raw * target.sum() / raw.sum() + 20))
    for i, _ in texts:
        assert abs(out[i].score - ratio[grams[i]].mean()) < 1e-9
        assert out[i].kept == (not out[i].base_failed and out[i].score >= quality.THRESHOLD)
    assert out[99].base_failed and not out[99].kept


def test_edge_rows(spark, edge):
    trusted = spark.createDataFrame([(3,)], "doc_id long")
    for name in ("score", "kept", "_id", "_trusted", "bucket"):
        rows = quality.quality_rules(edge(name), trusted).collect()
        assert len(rows) == 7
        assert all(r.n_words == 0 and r.base_failed for r in rows if r.doc_id in (1, 2, 5))
        assert len({tuple(r) for r in rows if r.doc_id == 3}) == 1
    empty = edge(rows=[])
    assert quality.quality_rules(empty, trusted).count() == 0
    nobody = spark.createDataFrame([], "doc_id long")
    assert {r.score for r in quality.quality_rules(edge(), nobody).collect()} == {0.0}

import random
import zlib

import numpy as np

from blotter.llm import toxicity


def test_label_model_tells_good_voters_from_copies():
    chance = np.random.default_rng(4)
    truth = chance.random(3000) < 0.2
    good = [(chance.random(3000) < np.where(truth, 0.5, 0.01)) for _ in range(6)]
    votes = np.array([*good, good[0], good[0]]).T
    votes = np.column_stack([votes, ~votes.any(1)]).astype(np.int8)
    p = toxicity.label_model(votes, 0.2)
    assert ((p > 0.5) == truth).mean() > 0.95


def labelled(spark, n=900):
    chance = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{chance.randrange(3000)}" for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            words[chance.randrange(60)] = chance.choice(["vile", "scum", f"hate{chance.randrange(50)}"])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string, _toxic string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_accuracy_and_labels_that_are_not_read(spark):
    docs, labels = labelled(spark)
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in out.items() if r.held_out} == set(held)
    assert sum(out[i].predicted == (i % 4 == 0) for i in held) > 0.95 * len(held)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in out.values())
    # Labels of held-out rows change nothing.
    turned = labels.selectExpr(
        "doc_id", "quality", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - toxic, toxic) AS toxic"
    )
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, turned).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in out.items())


def test_edge_rows(spark, edge):
    _, labels = labelled(spark, 40)
    rows = toxicity.score_toxicity(edge("at"), labels).collect()
    assert len(rows) == 7 and len({tuple(r) for r in rows if r.doc_id == 3}) == 1
    assert next(r.held_out for r in rows if r.doc_id is None) is False
    nothing = labels.limit(0)
    assert {r.score for r in toxicity.score_toxicity(edge(), nothing).collect()} == {0.0}
    assert toxicity.score_toxicity(edge(rows=[]), labels).count() == 0


def test_an_id_that_repeats_gives_one_sample_row(spark):
    docs = spark.range(5000).selectExpr("IF(id < 4900, 1, id) AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    rows = toxicity.labelled_sample(
        docs, labels, id_col="doc_id", text="text", label="toxic", folds=5, sample=4000
    )
    ids = {0} | {1} | set(range(4900, 5000))
    assert rows.count() <= len(ids)

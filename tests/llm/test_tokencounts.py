import random
import uuid

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blotter.llm import tokencounts
from blotter.storage import shared_dir

ODD = [
    "A <|endoftext|> b", "a<|ENDOFTEXT|>b", " \n\t x\u000b\u000cy z  ", "İstanbul ΣΣ é",
    "don't DON'T 1234 ١٢", "", "   ", "<|startoftext|><|endoftext|>", "x" * 5000, "a\u0085b\u001cc",
    "café ́ x", "\U0001f600\U0001f600 你好", "A\r\nB", "﻿", "K K",
]


@pytest.fixture
def cache(spark):
    return f"{shared_dir(spark)}/token-test-{uuid.uuid4().hex}"


def library_counts(vocabulary, texts):
    path = public_tokenizers.path(vocabulary)
    if vocabulary.endswith(".model"):
        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
        return [len(encode(t)) for t in texts]
    tokenizer = Tokenizer.from_file(path)
    return [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("few", [0, 20_000])
@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_against_the_library(spark, cache, vocabulary, few):
    chance = random.Random(3)
    letters = "aB c\n'é́.<|>1s "
    texts = ODD + ["".join(chance.choices(letters, k=chance.randrange(40))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = tokencounts.count_tokens(docs, cache, vocabulary=vocabulary, few_misses=few, limit=20)
    rows = {r.doc_id: r for r in out.collect()}
    expected = library_counts(vocabulary, texts)
    assert [rows[i].n_tokens for i in range(len(texts))] == expected
    assert [rows[i].n_bytes for i in range(len(texts))] == [len(t.encode()) for t in texts]
    assert [rows[i].over_limit for i in range(len(texts))] == [n > 20 for n in expected]


def test_only_distinct_misses_are_encoded(spark, cache, monkeypatch):
    made = []
    encoded = tokencounts._encoded

    def spy(distinct, vocabulary):
        made.append(distinct.count())
        return encoded(distinct, vocabulary)

    monkeypatch.setattr(tokencounts, "_encoded", spy)
    docs = spark.createDataFrame(
        [(1, "one two"), (2, "ONE  two\n"), (3, "three"), (4, "three"), (5, None)], "doc_id long, text string"
    )
    first = tokencounts.count_tokens(docs, cache).collect()
    more = docs.union(spark.createDataFrame([(6, "six"), (7, "one two")], docs.schema))
    second = {r.doc_id: r.n_tokens for r in tokencounts.count_tokens(more, cache).collect()}
    tokencounts.count_tokens(more, cache).collect()
    assert made == [3, 1]
    assert second == {r.doc_id: r.n_tokens for r in first} | {6: 1, 7: 2}
    # Another vocabulary shares no count.
    tokencounts.count_tokens(docs, cache, vocabulary="byte_bpe_50k.json").collect()
    assert made == [3, 1, 4]


def test_repeated_appends_do_no_harm(spark, cache):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    before = sorted(tokencounts.count_tokens(docs, cache).collect())
    spark.read.parquet(cache).write.mode("append").parquet(cache)
    assert sorted(tokencounts.count_tokens(docs, cache).collect()) == before


def test_hot_content_and_edge_rows(spark, edge, cache):
    same = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a b c").otherwise(F.concat(F.lit("t"), "id")).alias("text")
    )
    out = tokencounts.count_tokens(same, cache)
    assert out.where("doc_id % 3 = 0").select("n_tokens").distinct().collect() == [(3,)]
    assert out.count() == 3000
    for name in ("digest", "n_tokens", "_id", "version"):
        rows = tokencounts.count_tokens(edge(name), cache).collect()
        assert len(rows) == 7
        assert {(r.n_bytes, r.n_tokens, r.over_limit) for r in rows if r.doc_id in (1, 2)} == {(0, 0, False)}
        assert [(r.n_tokens, r.over_limit) for r in rows if r.doc_id == 4] == [(30_000, True)]
        assert [r.n_tokens for r in rows if r.doc_id is None] == library_counts("word_bpe_49k.json", ["alpha beta gamma"])
    assert tokencounts.count_tokens(edge(rows=[]), f"{cache}-none").count() == 0

import itertools
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blotter.llm import packing

ODD = ["It's we're İstanbul x² a_b <|endoftext|>c foo<|startoftext|> don't'S ǅ éa. Ａb,  x\ty",
       "'' '... word.'s <|ENDOFTEXT|> ΣΑΣ. ΟΔΟΣ, café CAFÉ.", "", "\n\n", " .,# ",
       "The the THE the. THE,the", "日本語 ☃☃ \U0001f600x"]


def test_chunks_are_tokenised_as_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path).encode_batch(ODD, add_special_tokens=False)
    encode = packing.ChunkTokenizer(path)
    for _ in range(2):
        for mine, theirs in zip(encode(ODD), whole):
            assert np.frombuffer(mine, "<u2").tolist() == theirs.ids


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = packing.hilbert_key(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1).max() == 1


def check_pieces(rows, length):
    """Sequences without gaps, all full but the last; documents in gapless pieces."""
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and r.length > 0
        ends[r.sequence_id] = r.offset + r.length
    assert sorted(ends) == list(range(len(ends)))
    assert all(ends[s] == length for s in sorted(ends)[:-1])
    assert all(e <= length for e in ends.values())


def test_edge_rows(edge):
    rows = packing.pack(edge("_key"), length=64).collect()
    check_pieces(rows, 64)
    assert sum(r.length for r in rows if r.doc_id == 3) == 12
    assert [(r.start, r.length, bytes(r.ids)) for r in rows if r.doc_id == 1] == [(0, 1, b"\2\0")]
    assert sum(r.length for r in rows if r.doc_id == 4) == 30_001
    assert packing.with_crc(packing.pack(edge(rows=[]))).count() == 0


def test_query_holds_every_id_once(spark):
    from blotter.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op8_packing"](spark, folder).collect()
    check_pieces(rows, 4096)
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d in spark.read.parquet(f"{folder}/documents.parquet").where(F.col("doc_id") < 80).collect():
        ids = np.array([*encode(d.text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)

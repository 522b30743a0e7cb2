"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Spaces become the mark U+2581 and one mark is put in front, as the model asks. No piece
has a mark after another character, so a text falls into marked words that are encoded
by themselves. Each batch sorts its distinct new words; read in that order they are a
trie in depth-first order, and the forward scores of the prefix that a word shares with
the one before are kept. A character without a piece is spelt in byte pieces at the cost
of the lowest score minus 10.

The path with the highest sum of the model's scores is taken; of equal paths the one
whose last piece is longest, and so on backwards. Decoding gives back every text exactly,
also with runs of spaces, marks or unknown characters in it. Null texts have null ids,
empty ones none. Rows are independent; further columns are only carried where asked for.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.registry import query, table

MARK = "▁"
#: Stands for a mark that occurs in the text itself; no valid text has this code point.
_LITERAL = "\ud800"
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")
#: Words of one generation of what a worker remembers.
CACHE_WORDS = 200_000


class Model:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[float, int]] = {}
        self.out: list[bytes] = []
        self.bytes: list[int] = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.out.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.out.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} has a mark inside")
                self.pieces[piece] = (sp.get_score(i), i)
                self.out.append(piece.replace(MARK, " ").encode())
        # All endings of pieces: None where the ending itself is no piece.
        self.endings: dict[str, tuple[float, int] | None] = dict(self.pieces)
        for piece in self.pieces:
            for i in range(1, len(piece)):
                self.endings.setdefault(piece[i:])
        self.unknown = min(s for s, _ in self.pieces.values()) - 10.0

    def spelt(self, char: str) -> list[int]:
        return [self.bytes[b] for b in (MARK if char == _LITERAL else char).encode()]


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def marked_words(text: str) -> list[str]:
    if not text:
        return []
    text = text.replace(MARK, _LITERAL)
    if "  " in text or text[0] == " ":
        return _RUNS.findall(MARK + text.replace(" ", MARK))
    return (MARK + text.replace(" ", " " + MARK)).split(" ")


def viterbi(words: Sequence[str], model: Model) -> Iterator[tuple[str, list[int]]]:
    """(word, ids) of distinct sorted words, each prefix scored once per run of words."""
    endings, unknown = model.endings, model.unknown
    score, back, ids = [0.0], [0], [-1]
    before = ""
    for word in words:
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del score[shared + 1 :], back[shared + 1 :], ids[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            best, start, piece = score[end - 1] + unknown, end - 1, -1
            for i in range(end - 1, -1, -1):
                hit = endings.get(word[i:end], 0)
                if hit:
                    if (total := score[i] + hit[0]) >= best:
                        best, start, piece = total, i, hit[1]
                elif hit == 0:
                    break
            score.append(best)
            back.append(start)
            ids.append(piece)
        path, end = [], len(word)
        while end:
            if ids[end] >= 0:
                path.append(ids[end])
            else:
                path.extend(reversed(model.spelt(word[end - 1])))
            end = back[end]
        yield word, path[::-1]
        before = word


def _add_column(df: DataFrame, make, source: str, name: str, kind: str, arrow: pa.DataType):
    """`df` with a column that `make()`'s function computes from the values of `source`."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    schema = df.withColumn(name, F.lit(None).cast(kind)).schema
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            new = pa.array(each(batch.column(at)), arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def encode(df: DataFrame, *, text: str = "text", ids: str = "ids", model: str | None = None):
    """`df` with the ids of each text."""

    def make():
        m = load(model or default_model())
        young: dict[str, bytes] = {}
        old: dict[str, bytes] = {}

        def each(column):
            nonlocal young, old
            split = [None if t is None else marked_words(t) for t in column.to_pylist()]
            if len(young) > CACHE_WORDS:
                young, old = {}, young
            new = set().union(*filter(None, split)).difference(young)
            again = [word for word in new if word in old]
            for word in again:
                young[word] = old[word]
            for word, path in viterbi(sorted(new.difference(again)), m):
                young[word] = array("i", path).tobytes()
            take = young.__getitem__
            return [
                None if words is None else np.frombuffer(b"".join(map(take, words)), np.int32)
                for words in split
            ]

        return each

    return _add_column(df, make, text, ids, "array<int>", pa.list_(pa.int32()))


def decode(df: DataFrame, *, ids: str = "ids", text: str = "decoded", model: str | None = None):
    """`df` with the text of each list of ids; control pieces give nothing."""

    def make():
        out = load(model or default_model()).out

        def each(column):
            ends, values = column.offsets.to_numpy(), column.values.to_numpy()
            gone = column.is_null().to_numpy(zero_copy_only=False)
            found = []
            for i, null in enumerate(gone):
                joined = b"".join(map(out.__getitem__, values[ends[i] : ends[i + 1]].tolist()))
                found.append(
                    None if null else joined.removeprefix(b" ").decode("utf-8", "replace")
                )
            return found

        return each

    return _add_column(df, make, ids, text, "string", pa.string())


@query()
def op3_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        "ids",
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )

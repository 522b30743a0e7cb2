"""Packing along a space-filling curve.

A document is its token ids and an end id. Its vector counts hashed ids, is projected to
few dimensions by fixed random signs, and gets the key of its cell on a Hilbert curve.
Documents are sorted by that key over range partitions, laid end to end along the curve
and cut every `length` ids, so neighbours on the curve share sequences and only the last
sequence of all is not full.

Null texts count as empty: one piece with the end id alone. Every row is packed, repeated
rows each by themselves; equal keys are ordered by id and row. Texts are cut as often as
their length asks. Columns other than id and text are not looked at. An empty table
gives no piece.
"""

from __future__ import annotations

import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blotter.llm.common import map_batches, mix, written
from blotter.llm.registry import query, table

LENGTH = 4096
END_ID = 2
#: Buckets of the hashed vector, dimensions it is projected to, bits of each on the curve.
BUCKETS, DIMS, BITS = 1024, 6, 8
#: Chunks of one generation of what a worker remembers.
CACHE_CHUNKS = 200_000
#: Chunks that are tokenised in one string.
JOINED = 100


#: Marks that the tokenizer always takes apart from letters before them.
_MARKS = ".,;:!?*#$%&"


class ChunkTokenizer:
    """Ids of texts as little-endian unsigned 16-bit bytes.

    The tokenizer drops white space and never joins across it, so the ids of a text are
    those of its chunks between spaces and line ends; each chunk is tokenised once.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError(f"{size} ids do not fit in 16 bits")
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        # Two generations: what a worker still meets moves on when the younger one is full.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u2") for e in found]

    def _find(self, chunks: set[str]) -> set[str]:
        """Those of `chunks` that neither generation knows."""
        new, old = chunks.difference(self.young), self.old
        known = [chunk for chunk in new if chunk in old]
        for chunk in known:
            self.young[chunk] = old[chunk]
        return new.difference(known)

    def _learn(self, chunks: set[str]) -> None:
        words, tails, rest = [], {}, []
        for chunk in chunks:
            stem = chunk.rstrip(_MARKS)
            if not stem or not _is_word(stem):
                rest.append(chunk)
            elif len(stem) < len(chunk):
                tails[chunk] = stem, chunk[len(stem) :]
            else:
                words.append(chunk)
        stems = self._find({part for pair in tails.values() for part in pair}.difference(words))
        for stem in stems:
            (words if _is_word(stem) else rest).append(stem)
        words.sort()
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            ids = self._ids([" ".join(part)])[0]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                rest += part
                continue
            whole, start = ids.tobytes(), 0
            for word, end in zip(part, (2 * cuts).tolist()):
                self.young[word] = whole[start:end]
                start = end
        if rest:
            for chunk, ids in zip(rest, self._ids(rest)):
                self.young[chunk] = ids.tobytes()
        for chunk, (stem, tail) in tails.items():
            self.young[chunk] = self.young[stem] + self.young[tail]

    def __call__(self, texts: list[str]) -> list[bytes]:
        lines = pa.array([_lowered(t).replace("\n", " ") for t in texts], pa.large_string())
        split = pc.split_pattern(lines, " ")
        chunks = split.values.dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.young) > CACHE_CHUNKS:
            self.old, self.young = self.young, {}
        if new := self._find(set(distinct)):
            self._learn(new)
        known = [self.young[chunk] for chunk in distinct]
        # The ids of every chunk in turn, taken from those of the distinct chunks.
        each = np.fromiter(map(len, known), np.int64, len(known)) // 2
        which = chunks.indices.to_numpy()
        ids, first, count = np.frombuffer(b"".join(known), "<u2"), np.cumsum(each) - each, each[which]
        ends = np.append(0, np.cumsum(count))
        taken = ids[np.arange(ends[-1]) + np.repeat(first[which] - ends[:-1], count)]
        bounds = ends[split.offsets.to_numpy()].tolist()
        return [taken[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


def _lowered(text: str) -> str:
    """Lower case where that surely is what the tokenizer does first anyway."""
    if text.isascii():
        return text if "<|" in text else text.lower()
    special = "<|" in text or "\u03a3" in text or "\u0130" in text
    return text if special or not unicodedata.is_normalized("NFC", text) else text.lower()


def _is_word(chunk: str) -> bool:
    """Letters alone, also after the tokenizer's normalisation: one word for it."""
    return chunk.isalpha() and (
        chunk.isascii()
        or chunk.lower().isalpha() and unicodedata.is_normalized("NFC", chunk)
    )


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


@lru_cache(maxsize=2)
def projection(buckets: int, dims: int) -> np.ndarray:
    """Signs of a fixed random projection, from the hash of each cell."""
    cells = mix(np.arange(1, buckets * dims + 1, dtype=np.uint64))
    return np.where(cells & np.uint64(1), 1.0, -1.0).reshape(buckets, dims)


def document_points(vectors: np.ndarray, dims: int, bits: int) -> np.ndarray:
    """Grid cells of count vectors: unit length, projected, spread over 0 .. 2**bits - 1."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    flat = vectors / np.where(norm > 0, norm, 1) @ projection(vectors.shape[1], dims)
    scaled = (np.tanh(flat / 2) + 1) / 2
    return np.minimum((scaled * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Position of each grid cell on the Hilbert curve (one row per point).

    Undoes the rotations from the highest bit down, then takes the Gray code's place
    and interleaves the bits.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            inverted = (x[i] & q) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def tokens_and_keys(
    docs: DataFrame, *, id_col: str, text: str, vocabulary: str | None, end_id: int
) -> DataFrame:
    """Per row: id, curve key, number of ids, ids as unsigned 16-bit little-endian bytes."""
    end = np.array([end_id], "<u2").tobytes()

    def make():
        encode = tokenizer(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
        place = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)

        def each(ids, texts):
            found = encode([t or "" for t in texts])
            vectors = np.stack(
                [np.bincount(place[np.frombuffer(f, "<u2")], minlength=BUCKETS) for f in found]
            )
            keys = hilbert_key(document_points(vectors, DIMS, BITS), BITS)
            for key, curve, f in zip(ids, keys.tolist(), found):
                yield key, curve, len(f) // 2 + 1, f + end

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.select(id_col, text), make, f"{id_col} {kind}, _key long, _n long, _ids binary"
    )


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", length: int = LENGTH,
    vocabulary: str | None = None, end_id: int = END_ID,
) -> DataFrame:
    """Pieces with their ids: (id, start, size, doc_tokens, sequence_id, offset, ids)."""
    spark = docs.sparkSession
    encoded = tokens_and_keys(docs, id_col=id_col, text=text, vocabulary=vocabulary, end_id=end_id)
    # The row number is only stable once written.
    rows = written(encoded.withColumn("_row", F.monotonically_increasing_id()), "packing-ids")
    ordered = rows.select(id_col, "_key", "_n", "_row").repartitionByRange("_key", id_col, "_row")
    # The bounds of the ranges are drawn anew in each run, so the ranges are written too.
    ranges = written(ordered.withColumn("_range", F.spark_partition_id()), "packing-order")
    # One row per range: as many as shuffle partitions.
    sums = ranges.groupBy("_range").agg(F.sum("_n").alias("_sum")).orderBy("_range").collect()
    starts, total = [], 0
    for at, size in sums:
        starts.append((at, total))
        total += size
    bases = F.broadcast(spark.createDataFrame(starts, "_range int, _base long"))
    along = (
        Window.partitionBy("_range")
        .orderBy("_key", F.col(id_col).asc_nulls_first(), "_row")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = ranges.join(bases, "_range").select(
        "_row", (F.col("_base") + F.sum("_n").over(along) - F.col("_n")).alias("_at")
    )

    def make():
        def each(ids, counts, blobs, begins):
            for key, n, blob, begin in zip(ids, counts, blobs, begins):
                done = 0
                while done < n:
                    sequence, offset = divmod(begin + done, length)
                    size = min(n - done, length - offset)
                    yield key, done, size, n, sequence, offset, blob[2 * done : 2 * (done + size)]
                    done += size

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        rows.join(placed, "_row").select(id_col, "_n", "_ids", "_at"),
        make,
        f"{id_col} {kind}, start long, length long, doc_tokens long, sequence_id long, "
        "offset long, ids binary",
    )


def with_crc(pieces: DataFrame) -> DataFrame:
    """`pieces` with `ids_crc32` over the ids as unsigned 32-bit integers, without the ids."""

    def make():
        def each(*columns):
            crcs = [zlib.crc32(np.frombuffer(b, "<u2").astype("<u4").tobytes()) for b in columns[-1]]
            return zip(*columns[:-1], crcs)

        return each

    rest = pieces.drop("ids")
    schema = rest.withColumn("ids_crc32", F.lit(0).cast("long")).schema
    return map_batches(pieces.select(*rest.columns, "ids"), make, schema)


@query()
def op8_packing(spark, sf_dir):
    return with_crc(pack(table(spark, sf_dir, "documents")))

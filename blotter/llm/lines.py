"""Line dedup: winnowed fingerprints of line hashes, joined and extended to runs.

Lines are what stands between line ends; blank ones (no word) are never matched or
removed. Two kinds of fingerprints are taken from the sequence of the other lines:
every line of at least `long_words` words by itself, and of the hashes of `gram`
neighbouring lines the minimum of every window of `window` (the last of equal minima).
So every repeated run with a long line in it, or of `gram + window - 1` lines or more,
holds a fingerprint. Each occurrence of a fingerprint is joined with the first one in
the order of (id, position), with the first that has the same line before it, and with the
first that has the same line after it; each match is extended both ways while lines are
equal, and the later run is removed. So a run is found whole even if its fingerprint
occurs earlier among other lines.

The first occurrence of a line always stays: a removed line has an equal one before it.
Rows that repeat both id and text are one document here and get equal results. Null
texts stay null. A null id comes before all others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from blotter.llm.common import extras_renamed, map_batches, mix, window_hashes, word_hashes, written
from blotter.llm.registry import query, table

LONG_WORDS = 25
GRAM = 3
WINDOW = 4

_NULL_ID = -(1 << 63)
#: Odd factors that tell a fingerprint with the line before it from one with the line after.
_BEFORE, _AFTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def text_lines(text: str) -> tuple[list[str], list[int], list[int]]:
    """All lines, the places of those with words, and how many words those have."""
    lines = text.split("\n")
    counts = [len(line.split()) for line in lines]
    at = [i for i, n in enumerate(counts) if n]
    return lines, at, [counts[i] for i in at]


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the minima of all windows; of equal minima the last."""
    n = len(grams)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(grams[::-1]))]) if n else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    last = window - 1 - np.argmin(views[:, ::-1], axis=1)
    return np.unique(np.arange(len(views)) + last)


def fingerprints(
    hashes: np.ndarray, counts: np.ndarray, long_words: int, gram: int, window: int
) -> list[tuple[int, int]]:
    """(key, position) of the long lines and of the winnowed grams, and of each of them
    together with the line before it and with the line after it."""
    long_at = np.flatnonzero(counts >= long_words)
    grams = window_hashes(hashes, gram)
    gram_at = winnowed(grams, window)
    keys = np.concatenate([mix(hashes[long_at]), grams[gram_at]])
    start = np.concatenate([long_at, gram_at])
    end = np.concatenate([long_at + 1, gram_at + gram])
    before, after = start > 0, end < len(hashes)
    keys = np.concatenate([
        keys,
        mix(keys[before] * _BEFORE + hashes[start[before] - 1]),
        mix(keys[after] * _AFTER + hashes[end[after]]),
    ])
    places = np.concatenate([start, start[before], start[after]])
    return list(zip(keys.astype(np.int64).tolist(), places.tolist()))


def extended(
    later: np.ndarray, first: np.ndarray, shift: int, places: list[int]
) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of `later` equal to `first` moved by `shift`, around places."""
    low, high = max(0, shift), min(len(later), len(first) + shift)
    same = later[low:high] == first[low - shift : high - shift]
    breaks = np.flatnonzero(~same) + low
    runs = set()
    for place in places:
        i = int(np.searchsorted(breaks, place))
        start = int(breaks[i - 1]) + 1 if i else low
        end = int(breaks[i]) if i < len(breaks) else high
        runs.add((start, end))
    return sorted(runs)


def repeated_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text",
    long_words: int = LONG_WORDS, gram: int = GRAM, window: int = WINDOW,
) -> DataFrame:
    """(_id, _content, runs): per document the later repeated runs, as places among its
    lines with words. `_content` is the hash of the text, `_id` the id, least if null."""

    def sequences():
        def each(ids, contents, texts):
            for key, content, body in zip(ids, contents, texts):
                lines, at, counts = text_lines(body)
                hashes = word_hashes([lines[i].encode() for i in at])
                yield key, content, hashes.tobytes(), np.array(counts, "<i4").tobytes()

        return each

    seen = identified(docs, id_col, text).where(F.col(text).isNotNull())
    rows = map_batches(
        seen.select("_id", "_content", text),
        sequences,
        "_id long, _content long, _hashes binary, _counts binary",
    )
    rows = written(rows, "line-hashes")

    def marks():
        def each(ids, contents, hashes, counts):
            for key, content, h, n in zip(ids, contents, hashes, counts):
                found = fingerprints(
                    np.frombuffer(h, "<u8"), np.frombuffer(n, "<i4"), long_words, gram, window
                )
                for mark, place in found:
                    yield mark, key, content, place

        return each

    prints = map_batches(rows, marks, "_mark long, _id long, _content long, _place int")
    here = F.struct("_id", "_content", "_place")
    firsts = (
        prints.groupBy("_mark")
        .agg(F.min(here).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    pairs = (
        prints.join(firsts, "_mark")
        .where(here != F.col("_first"))
        .select(
            "_id",
            "_content",
            F.col("_first._id").alias("_first_id"),
            F.col("_first._content").alias("_first_content"),
            (F.col("_place") - F.col("_first._place")).alias("_shift"),
            "_place",
        )
        # One row per pair of documents and shift, however many fingerprints they share.
        .groupBy("_id", "_content", "_first_id", "_first_content", "_shift")
        .agg(F.sort_array(F.collect_set("_place")).alias("_places"))
    )
    known = rows.select("_id", "_content", "_hashes").dropDuplicates(["_id", "_content"])
    first = known.toDF("_first_id", "_first_content", "_first_hashes")

    def extend():
        def each(ids, contents, later, earlier, shifts, places):
            for key, content, a, b, shift, at in zip(
                ids, contents, later, earlier, shifts, places
            ):
                runs = extended(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), shift, at)
                yield key, content, [dict(start=s, end=e) for s, e in runs]

        return each

    runs = map_batches(
        pairs.join(first, ["_first_id", "_first_content"])
        .join(known, ["_id", "_content"])
        .select("_id", "_content", "_hashes", "_first_hashes", "_shift", "_places"),
        extend,
        "_id long, _content long, _runs array<struct<start:int,end:int>>",
    )
    return runs.groupBy("_id", "_content").agg(
        F.array_distinct(F.flatten(F.collect_list("_runs"))).alias("_runs")
    )


def identified(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """`docs` with the two columns that name a document here."""
    return docs.withColumns(
        {
            "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)),
            "_content": F.xxhash64(text),
        }
    )


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars",
    removed: str | None = "removed_lines", long_words: int = LONG_WORDS, gram: int = GRAM,
    window: int = WINDOW,
) -> DataFrame:
    """All rows and columns with later repeated runs removed from `text`.

    `removed`, if given, is a further column with the numbers of the removed lines, from
    0, null for a null text. `n_chars`, if the rows have it, follows the text.
    """
    outside = docs.columns
    docs = extras_renamed(docs, id_col, text, n_chars)
    runs = repeated_runs(
        docs, id_col=id_col, text=text, long_words=long_words, gram=gram, window=window
    )
    names = docs.columns
    at = names.index(text)
    fields = [StructField(f.name, StringType() if f.name == text else f.dataType) for f in docs.schema]
    mark = "_removed"
    fields.append(StructField(mark, ArrayType(IntegerType())))

    def make():
        def each(*columns):
            texts, gone = [], []
            for body, found in zip(columns[at], columns[-1]):
                if body is None or not found:
                    texts.append(body)
                    gone.append(None if body is None else [])
                    continue
                lines, places, _ = text_lines(body)
                out = sorted({places[i] for r in found for i in range(r["start"], r["end"])})
                drop = set(out)
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop))
                gone.append(out)
            return zip(*columns[:at], texts, *columns[at + 1 : -1], gone)

        return each

    marked = identified(docs, id_col, text).join(runs, ["_id", "_content"], "left")
    out = map_batches(marked.select(*names, "_runs"), make, StructType(fields))
    if n_chars in names:
        length = F.when(F.size(mark) > 0, F.length(text)).otherwise(F.col(n_chars))
        out = out.withColumn(n_chars, length.cast(docs.schema[n_chars].dataType))
    return out.toDF(*outside, removed) if removed else out.drop(mark).toDF(*outside)


@query()
def op9_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        "text",
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join("removed_lines", ",").alias("removed_lines"),
    )

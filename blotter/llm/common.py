"""Helpers of this subpackage: word hashes, Arrow mapping, written tables."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from blotter.storage import new_path

#: Rows of one Arrow batch: keeps a batch of texts at a few MB.
BATCH_ROWS = 500
#: Bytes of one Arrow batch, however long its texts are.
BATCH_BYTES = "16m"

_U = np.uint64


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of hashes spread over all bits."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for every window of `k` neighbouring hashes (none if fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    out = np.zeros(n, _U)
    for i in range(k):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[..., Iterator[tuple] | list[tuple]]],
    schema: str | StructType,
    *,
    last: Callable | None = None,
) -> DataFrame:
    """`mapInArrow` with plain columns: `make()` runs once a task and gives a function
    from the batch's columns (lists) to rows; `last`, if given, gets that function
    after the last batch and gives the rows that sum up the task."""
    spark = df.sparkSession
    kind = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            rows = list(each(*(c.to_pylist() for c in batch.columns)))
            if rows:
                yield table(rows)
        if last is not None and (rows := list(last(each))):
            for at in range(0, len(rows), 20_000):
                yield table(rows[at : at + 20_000])

    return df.mapInArrow(run, kind)


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Send the package's code to the executors, once, and bound an Arrow batch of texts."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="blotter-code-")) / "blotter.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read from there."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extras_renamed(docs: DataFrame, *own: str | None) -> DataFrame:
    """`docs` with all but its `own` columns under names that clash with nothing; the order
    stays, so `toDF(*names)` gives the names back."""
    return docs.toDF(*(n if n in own else f"extra_{i}" for i, n in enumerate(docs.columns)))


#: A key is hot if it holds more than one of this many rows, so fewer keys than that are hot.
HOT_SHARE = 10_000


def join_counted(rows: DataFrame, values: DataFrame, key: str, copies: DataFrame) -> DataFrame:
    """`rows` with the columns of `values`, which has one row per `key`; null where none is.

    `copies` (key, n) counts the rows of every key. The values of hot keys are broadcast,
    which their share of the rows bounds by `HOT_SHARE` rows; all others meet in a shuffle in
    which no key is large. Rows without a key go past both joins.
    """
    total = copies.agg(F.sum("n")).first()[0] or 0
    hot = copies.where(F.col("n") * HOT_SHARE > total).select(key)
    named = [c for c in values.columns if c != key]
    few = values.join(F.broadcast(hot), key, "left_semi").select(key, F.struct(*named).alias("_hot"))
    few = few.union(hot.join(few, key, "left_anti").withColumn("_hot", F.lit(None)))
    marked = rows.join(F.broadcast(few.withColumn("_is_hot", F.lit(True))), key, "left")
    past = marked.where(F.col("_is_hot") | F.col(key).isNull())
    past = past.select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in named])
    rest = marked.where(F.col("_is_hot").isNull() & F.col(key).isNotNull()).select(*rows.columns)
    return past.unionByName(rest.join(values, key, "left"))

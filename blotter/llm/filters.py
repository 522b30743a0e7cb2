"""Filter interaction audit over a sparse document-term matrix.

Documents are dealt into shards. A shard is a CSR block: row offsets, columns and counts of its
documents, with the shard's own words, in the order of a hash, beside it. One global dictionary
encodes the words: a range of hashes is a bucket, every shard sends each bucket its words once,
the bucket numbers its distinct words and sends the numbers back, and the shard's columns are
renumbered by them. Row sums and numbers of stored entries of the matrix decide the filters A
(few words) and B (few distinct words); the other filters' flags travel with the rows, and a
table of cells (part, failing filters, labels, n) is all that the audit of the orders reads.

Null texts count as empty and equal each other; a null language is the part ''. A document
without id has no labels and is no copy of another, but its text stands for no other row
either. Repeated rows each count; rows that share an id are no copies of each other. Labels
that repeat for an id count as 1 if any of them does. Columns other than id, text and language
are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from blotter.llm.common import join_counted, map_batches, word_hashes, written
from blotter.llm.registry import query, table

FILTERS = "ABCDE"
#: A document fails A below this number of words, and B below this percentage of distinct ones.
LEAST_WORDS, LEAST_DISTINCT = 200, 50
#: It fails C above this percentage of capitals and D with any of these characters.
MOST_CAPITALS, MARKS = 3, b"#$%&*|"
#: Bytes of text and words of one shard; one document may exceed both.
SHARD_BYTES, SHARD_WORDS = 8 << 20, 50_000
#: Words (of all shards) that one bucket of the dictionary gets on average.
BUCKET_WORDS = 400_000

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def _marks(text: str, body: bytes) -> dict:
    """Whether a text fails C and D."""
    capitals = len(body) - len(body.translate(None, _CAPITALS))
    return {
        "_c": capitals * 100 > len(text) * MOST_CAPITALS,
        "_d": len(body.translate(None, MARKS)) < len(body),
    }


class Shard:
    """One CSR block in the making; columns are places in its own list of words."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.rows: list[dict] = []
        self.sizes: list[int] = []
        self.columns: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, row: dict, text: bytes) -> None:
        entries = Counter(text.split())
        place = self.words
        for word in entries:
            if word not in place:
                place[word] = len(place)
        n = len(entries)
        self.columns.append(np.fromiter(map(place.__getitem__, entries), "<u4", n))
        self.counts.append(np.fromiter(entries.values(), "<u4", n))
        self.rows.append(row)
        self.sizes.append(n)
        self.bytes += len(text)

    def full(self, most_words: int) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.words) >= most_words

    def record(self, name: int) -> tuple:
        """Words by hash, one a line; integers as narrow as they fit."""
        words = list(self.words)
        order = np.argsort(word_hashes(words), kind="stable")
        rank = np.empty(len(words), "<u4")
        rank[order] = np.arange(len(words), dtype="<u4")
        blank = [np.empty(0, "<u4")]
        return (
            name,
            self.rows,
            np.cumsum([0, *self.sizes]).astype("<i8").tobytes(),
            _packed(rank[np.concatenate(blank + self.columns)]),
            _packed(np.concatenate(blank + self.counts)),
            len(words),
            b"\n".join([words[i] for i in order.tolist()]),
        )


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned little-endian integers of 1, 2 or 4 bytes, whichever holds them all."""
    most = int(numbers.max()) if len(numbers) else 0
    return numbers.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // n if n else 1}")


def csr_shards(
    docs: DataFrame, text: str, most_words: int = SHARD_WORDS,
    note: Callable[[str, bytes], dict] | None = None, noted: str = "",
) -> DataFrame:
    """Written shards of `docs`: its other columns as `rows`, CSR parts and local words.

    `note` gives further fields of a row, of the kinds in `noted`, from its text and the
    text's bytes. The words are `[^\\x20\\x09-\\x0D]+` of the whole texts; a document lies in one shard.
    """
    fields = docs.drop(text).columns
    row = StructType(list(docs.drop(text).schema) + list(_struct(docs.sparkSession, noted)))
    kind = StructType().add("shard", "long").add("rows", ArrayType(row))
    kind = kind.add("offsets", "binary").add("columns", "binary").add("counts", "binary")
    kind = kind.add("n_words", "long").add("words", "binary")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, shard = TaskContext.get().partitionId() << 32, Shard()

        def finished() -> pa.RecordBatch:
            columns = zip(shard.record(made))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
            )

        for batch in batches:
            *attributes, texts = (c.to_pylist() for c in batch.columns)
            for *values, content in zip(*attributes, texts):
                body = (content or "").encode()
                attributes_of = dict(zip(fields, values))
                if note is not None:
                    attributes_of |= note(content or "", body)
                shard.add(attributes_of, body)
                if shard.full(most_words):
                    yield finished()
                    made, shard = made + 1, Shard()
        if shard.rows:
            yield finished()

    return written(docs.select(*fields, text).mapInArrow(run, kind), "csr-shards")


def _struct(spark: SparkSession, kinds: str) -> StructType:
    return spark.createDataFrame([], kinds).schema if kinds else StructType()


def _bucketed(shards: DataFrame, bucket_words: int) -> tuple[DataFrame, int]:
    """((bucket, shard, words), number of buckets): a bucket is a range of word hashes."""
    total = shards.agg(F.sum("n_words")).first()[0] or 0
    buckets = 1 + total // bucket_words
    bounds = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)

    def make():
        def each(names, blobs):
            for name, blob in zip(names, blobs):
                words = blob.split(b"\n") if blob else []
                cuts = np.searchsorted(word_hashes(words), bounds).tolist()
                for bucket, (start, end) in enumerate(zip([0, *cuts], [*cuts, len(words)])):
                    if start < end:
                        yield bucket, name, b"\n".join(words[start:end])

        return each

    kind = "bucket int, shard long, words binary"
    return map_batches(shards.select("shard", "words"), make, kind), buckets


def _numbers(table: pa.Table) -> tuple[list[list[bytes]], dict[bytes, int]]:
    """The lists of words of one bucket and the place of each word in byte order."""
    lists = [blob.split(b"\n") for blob in table["words"].to_pylist()]
    return lists, {word: i for i, word in enumerate(sorted(set().union(*lists)))}


def dictionary(parts: DataFrame, buckets: int) -> DataFrame:
    """(word, id): the words of all shards with their ids.

    The words of bucket b of n are numbered in byte order: b, b + n, b + 2n and so on, so ids
    are unique, and without gaps but for the unevenness of the buckets.
    """

    def named(part: pa.Table) -> pa.Table:
        _, places = _numbers(part)
        bucket = part["bucket"][0].as_py()
        ids = [bucket + buckets * i for i in places.values()]
        return pa.table({"word": [w.decode() for w in places], "id": pa.array(ids, pa.int64())})

    return parts.groupBy("bucket").applyInArrow(named, "word string, id long")


def document_term_matrix(
    docs: DataFrame, text: str = "text", *, most_words: int = SHARD_WORDS,
    bucket_words: int = BUCKET_WORDS,
    note: Callable[[str, bytes], dict] | None = None, noted: str = "",
) -> tuple[DataFrame, DataFrame]:
    """(shards, dictionary): CSR shards whose columns are the dictionary's ids.

    A shard has `rows` (the other columns of `docs` and what is noted), `offsets` (64-bit, one more than rows),
    `columns` (64-bit) and `counts` (unsigned, 1, 2 or 4 bytes), all little-endian.
    """
    shards = csr_shards(docs, text, most_words, note, noted)
    parts, buckets = _bucketed(shards, bucket_words)

    def numbered(part: pa.Table) -> pa.Table:
        lists, places = _numbers(part)
        found = [np.fromiter(map(places.__getitem__, words), "<u4", len(words)) for words in lists]
        blobs = pa.array([f.tobytes() for f in found], pa.binary())
        return pa.table({"shard": part["shard"], "bucket": part["bucket"], "places": blobs})

    coded = parts.groupBy("bucket").applyInArrow(numbered, "shard long, bucket int, places binary")
    # A shard has one row per bucket, and its words are in the order of the buckets.
    told = coded.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "places"))).alias("known"))

    def make():
        def each(names, rows, offsets, columns, counts, known):
            for name, row, ends, places, n, parts in zip(names, rows, offsets, columns, counts, known):
                lookup = np.concatenate([
                    np.empty(0, "<i8"),
                    *(p["bucket"] + buckets * np.frombuffer(p["places"], "<u4").astype("<i8") for p in parts or []),
                ])
                entries = int(np.frombuffer(ends, "<i8")[-1])
                yield name, row, ends, lookup[_unpacked(places, entries)].tobytes(), n

        return each

    slim = shards.drop("words", "n_words")
    return map_batches(slim.join(told, "shard", "left"), make, slim.schema), dictionary(parts, buckets)


def row_statistics(matrix: DataFrame) -> DataFrame:
    """The rows of the matrix with their sums (`n_words`) and stored entries (`n_distinct`)."""
    inner: StructType = matrix.schema["rows"].dataType.elementType
    kind = StructType(list(inner)).add("n_words", "long").add("n_distinct", "long")

    def make():
        def each(rows, offsets, counts):
            for block, ends, n in zip(rows, offsets, counts):
                ends = np.frombuffer(ends, "<i8")
                counts_of = _unpacked(n, int(ends[-1]))
                upto = np.concatenate([[0], np.cumsum(counts_of, dtype=np.int64)])
                sums = upto[ends[1:]] - upto[ends[:-1]]
                for row, total, entries in zip(block, sums.tolist(), np.diff(ends).tolist()):
                    yield *row.values(), total, entries

        return each

    return map_batches(matrix.select("rows", "offsets", "counts"), make, kind)


def failing_filters(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """(id, part, fails, good, toxic) per document; `fails` has the letters of its filters."""
    body = F.coalesce(F.col("_text"), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(lang), F.lit("")).alias("_part"),
        F.col(text).alias("_text"),
    ).withColumn("_digest", F.unhex(F.sha2(body.cast("binary"), 256)))
    matrix, _ = document_term_matrix(slim, "_text", note=_marks, noted="_c boolean, _d boolean")
    rows = written(row_statistics(matrix), "audit-rows")

    texts = rows.groupBy("_digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("_id").alias("_first")
    )
    texts = written(texts, "audit-texts")
    ids = rows.where("_id IS NOT NULL").groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"),
    )
    whole = join_counted(rows, texts.drop("n"), "_digest", texts.select("_digest", "n"))
    whole = join_counted(whole, marks, "_id", written(ids, "audit-ids"))
    fails = {
        "A": F.col("n_words") < LEAST_WORDS,
        "B": F.col("n_distinct") * 100 < F.col("n_words") * LEAST_DISTINCT,
        "C": F.col("_c"),
        "D": F.col("_d"),
        "E": F.coalesce(F.col("_first") < F.col("_id"), F.lit(False)),
    }
    return whole.select(
        F.col("_id").alias("id"),
        F.col("_part").alias("part"),
        F.concat(*[F.when(hit, letter).otherwise("") for letter, hit in fails.items()]).alias("fails"),
        F.coalesce(F.col("_good") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.col("_toxic") == 1, F.lit(False)).alias("toxic"),
    )


def audit_orders(failing: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley) for all orders of the filters, from rows of `failing_filters`."""
    cells = failing.groupBy("part", "fails", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    orders = ["".join(order) for order in permutations(filters)]
    steps = F.sequence(F.lit(1), F.lit(len(filters)))
    at = (
        cells.select("*", F.explode(F.lit(orders)).alias("filter_order"))
        .select("*", F.explode(steps).alias("step"))
        .withColumn("filter", F.expr("substring(filter_order, step, 1)"))
        .withColumn("_before", F.expr("translate(fails, substring(filter_order, 1, step - 1), '')"))
    )
    fails_it = F.contains("fails", "filter")
    reaches = F.col("_before") == F.col("fails")

    def count(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    removed = fails_it & reaches
    steps_of = at.groupBy("part", "filter_order", "step", "filter").agg(
        count(reaches & ~fails_it).alias("kept"),
        count(removed).alias("removed"),
        count(fails_it & ~reaches).alias("redundant"),
        count(F.col("fails") == F.col("filter")).alias("unique_fails"),
        count(removed & F.col("good")).alias("good_lost"),
        count(removed & F.col("toxic")).alias("toxic_lost"),
    )
    # A filter comes first of the failing ones in an equal share of all orders.
    shares = at.groupBy("part", "filter").agg(count(removed).alias("shapley"))
    return steps_of.join(shares, ["part", "filter"]).drop("filter")


def _sql() -> str:
    words = r"list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    return (
        "WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents), "
        "l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), "
        f"s AS (SELECT *, {words} AS w, min(doc_id) OVER (PARTITION BY x) AS least FROM d), "
        "f AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS bad, "
        "CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || "
        "CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || "
        "CASE WHEN 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 3 * length(x) "
        "THEN 'C' ELSE '' END || "
        "CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END || "
        "CASE WHEN least < s.doc_id THEN 'E' ELSE '' END AS fails FROM s LEFT JOIN l USING (doc_id)), "
        "c AS (SELECT part, fails, good, bad, count(*) AS n FROM f GROUP BY ALL), "
        f"o AS (SELECT ord, step, substr(ord, step, 1) AS flt FROM (VALUES {orders}) v(ord), "
        "(SELECT CAST(range AS INTEGER) AS step FROM range(1, 6)) t), "
        "a AS (SELECT *, contains(fails, flt) AS hit, "
        "translate(fails, substr(ord, 1, step - 1), '') = fails AS reaches FROM c, o), "
        "r AS (SELECT part, ord AS filter_order, step, flt, "
        "CAST(coalesce(sum(n) FILTER (WHERE reaches AND NOT hit), 0) AS BIGINT) AS kept, "
        "CAST(coalesce(sum(n) FILTER (WHERE reaches AND hit), 0) AS BIGINT) AS removed, "
        "CAST(coalesce(sum(n) FILTER (WHERE hit AND NOT reaches), 0) AS BIGINT) AS redundant, "
        "CAST(coalesce(sum(n) FILTER (WHERE fails = flt), 0) AS BIGINT) AS unique_fails, "
        "CAST(coalesce(sum(n) FILTER (WHERE reaches AND hit AND good), 0) AS BIGINT) AS good_lost, "
        "CAST(coalesce(sum(n) FILTER (WHERE reaches AND hit AND bad), 0) AS BIGINT) AS toxic_lost "
        "FROM a GROUP BY ALL) "
        "SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, "
        "CAST(sum(removed) OVER (PARTITION BY part, flt) AS BIGINT) AS shapley FROM r"
    )


@query(_sql())
def op12_filter_audit(spark, sf_dir):
    failing = failing_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit_orders(failing)

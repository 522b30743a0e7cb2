"""Token counts with a cache of digests.

A text's content is normalised as far as that surely leaves its number of tokens alone, and
the SHA-256 digest of that content, with the digest of the tokenizer's version, is the key of
a stored count. Counts are looked up by key; of the contents that are not stored yet each
distinct one is encoded once, and its count is appended to the cache. The version covers the
vocabulary file, the library's release and the normalisation, so a change of any of them
misses the whole cache and never reads a stale count.

The cache is a folder of Parquet files (version, digest, n_tokens). Every row of it is true by
itself: an append that broke off, or two at once, leave rows that are right or equal to others,
and readers take one row per digest. So lost executors and reruns are harmless.

Null texts count as empty: 0 bytes, 0 tokens. Every row is counted, repeated rows and copies
alike; the texts are never cut. Columns other than id and text are not looked at. An empty
table gives no row and leaves the cache alone.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm.common import join_counted, map_batches, written
from blotter.llm.registry import query, table
from blotter.storage import new_path

VOCABULARY = "word_bpe_49k.json"
#: Tokens above which a document is over the limit.
LIMIT = 2048
#: Missing digests that are broadcast to the texts (a few MB); more of them meet in a shuffle.
FEW_MISSES = 20_000
#: Bytes of one generation of the chunks that a worker remembers.
CACHE_BYTES = 32 << 20

#: Fixed value: the vocabularies that drop white space and never join tokens across it, and
#: lower their input but for special tokens, which start with "<|".
WORDWISE = {"word_bpe_49k.json"}


def version_digest(vocabulary: str) -> str:
    """SHA-256 of all that the count of a content depends on."""
    library = "sentencepiece" if vocabulary.endswith(".model") else "tokenizers"
    seal = hashlib.sha256(Path(public_tokenizers.path(vocabulary)).read_bytes())
    seal.update(f"{library} {importlib.metadata.version(library)} {_wordwise(vocabulary)}".encode())
    return seal.hexdigest()


def _wordwise(vocabulary: str) -> bool:
    return vocabulary in WORDWISE


def normalised(text: Column, vocabulary: str) -> Column:
    """The content whose number of tokens is that of `text`; null is empty.

    For word-wise vocabularies runs of white space become one space and, in ASCII texts
    without special tokens, capitals become small. Others see every character as it is.
    """
    text = F.coalesce(text, F.lit(""))
    if not _wordwise(vocabulary):
        return text
    spaced = F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))
    plain = (F.octet_length(spaced) == F.char_length(spaced)) & ~F.contains(spaced, F.lit("<|"))
    return F.when(plain, F.lower(spaced)).otherwise(spaced)


class ChunkCounter:
    """Tokens of texts for word-wise vocabularies: the sum over the chunks between spaces.

    What a worker has met is kept in two generations of bounded bytes.
    """

    def __init__(self, lengths: Callable[[list[str]], list[int]]) -> None:
        self.lengths = lengths
        self.young: dict[str, int] = {"": 0}
        self.old: dict[str, int] = {}
        self.held = 0

    def __call__(self, texts: list[str]) -> list[int]:
        split = [t.split(" ") for t in texts]
        if self.held > CACHE_BYTES:
            self.old, self.young, self.held = self.young, {"": 0}, 0
        new = set().union(*split).difference(self.young)
        known = [chunk for chunk in new if chunk in self.old]
        self.young.update((chunk, self.old[chunk]) for chunk in known)
        missing = list(new.difference(known))
        self.young.update(zip(missing, self.lengths(missing)))
        self.held += sum(map(len, new)) + 100 * len(new)
        get = self.young.__getitem__
        return [sum(map(get, chunks)) for chunks in split]


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> Callable[[list[str]], list[int]]:
    """A function from contents to their numbers of tokens, by the vocabulary's own library."""
    path = public_tokenizers.path(vocabulary)
    if vocabulary.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
        return lambda texts: [len(ids) for ids in encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def lengths(texts: list[str]) -> list[int]:
        return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return ChunkCounter(lengths) if _wordwise(vocabulary) else lengths


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of the cache for one version, one row per digest."""
    kind = "version string, digest binary, n_tokens long"
    try:
        held = spark.read.schema(kind).parquet(cache)
        held.limit(0).collect()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        held = spark.createDataFrame([], kind)
    held = held.where(F.col("version") == version)
    return held.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, cache: str, *, id_col: str = "doc_id", text: str = "text",
    vocabulary: str = VOCABULARY, limit: int = LIMIT, few_misses: int = FEW_MISSES,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; `cache` is a folder of stored counts."""
    spark = docs.sparkSession
    version = version_digest(vocabulary)
    content = normalised(F.col("_text"), vocabulary)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    keyed = source.withColumn("digest", F.unhex(F.sha2(content.cast("binary"), 256)))
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    rows = written(keyed.select("_id", size.alias("n_bytes"), "digest"), "token-rows")
    copies = written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "token-copies")

    stored = stored_counts(spark, cache, version)
    misses = written(copies.select("digest").join(stored, "digest", "left_anti"), "token-misses")
    n_misses = misses.count()
    if n_misses:
        texts = keyed.select("digest", content.alias("_content"))
        if n_misses <= few_misses:
            texts = texts.join(F.broadcast(misses), "digest", "left_semi")
        # Copies fall together within each task before any text is sent.
        distinct = texts.groupBy("digest").agg(F.first("_content").alias("_content"))
        if n_misses > few_misses:
            distinct = distinct.join(misses, "digest", "left_semi")
        _encoded(distinct, vocabulary).withColumn("version", F.lit(version)).write.mode(
            "append"
        ).parquet(cache)
        stored = stored_counts(spark, cache, version)

    wanted = stored.join(copies.select("digest"), "digest", "left_semi")
    counted = join_counted(rows, wanted, "digest", copies)
    return counted.select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )


def _encoded(distinct: DataFrame, vocabulary: str) -> DataFrame:
    def make():
        lengths = counter(vocabulary)
        return lambda digests, contents: zip(digests, lengths(contents))

    return map_batches(distinct, make, "digest binary, n_tokens long")


@query()
def op13_token_counts(spark, sf_dir):
    # Every run fills a cache of its own, so that it does all its work.
    cache = new_path(spark, "token-count-cache")
    return count_tokens(table(spark, sf_dir, "documents"), cache)

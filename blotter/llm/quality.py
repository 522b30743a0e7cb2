"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are estimated, one from trusted
target documents and one from the whole raw corpus. A document's score is the mean of
log(p_target / p_raw) over its n-grams; every document is compared with one fixed
threshold. The raw counts cover all documents. The target may be a bounded sample of
labelled rows (`trusted_ids`); its bound is the parameter `max_trusted`.

Null and empty texts have no words: all counts 0, `base_failed`, score 0. Repeated rows
get equal results; columns other than id and text are not looked at. Without any target
document both multinomials are taken as equal, so only the base rules decide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import map_batches, mix, window_hashes, word_hashes
from blotter.llm.registry import query, table

BUCKETS = 1 << 16
#: Target n-grams added to every bucket, seen and expected: rare buckets count as neutral.
SMOOTHING = 20.0
#: Mean log ratio below which a document is dropped.
THRESHOLD = -0.1
#: Bound of the labelled target sample.
MAX_TRUSTED = 20_000

_SPACE = b" \t\n\x0b\x0c\r"


def base_counts(text: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int]:
    """(word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    body = text.translate(None, _SPACE)
    word_chars = len(body) if body.isascii() else len(body.decode("utf-8", "replace"))
    symbols = sum(map(body.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    seen: set[bytes] = set()
    dup_lines = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                dup_lines += 1
            elif line and line.translate(None, _SPACE):
                seen.add(line)
    n = len(words)
    repeat = 0
    if n > 3:
        windows = window_hashes(hashes, 3)
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            hit = np.zeros(n - 2, bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for i in range(3):
                covered[i : i + n - 2] |= hit
            repeat = int(covered.sum())
    return word_chars, symbols, dup_lines, repeat


def gram_buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of all unigrams and bigrams."""
    grams = np.concatenate([mix(hashes), window_hashes(hashes, 2)])
    return (grams % np.uint64(buckets)).astype(np.int64)


def ngram_counts(docs: DataFrame, *, text: str, trusted: str, buckets: int) -> DataFrame:
    """Raw and target counts per bucket over all rows of `docs`; `trusted` is boolean."""

    class Counter:
        def __init__(self) -> None:
            self.raw = np.zeros(buckets, np.int64)
            self.target = np.zeros(buckets, np.int64)

        def __call__(self, texts, flags):
            for content, flag in zip(texts, flags):
                if words := (content or b"").split():
                    found = gram_buckets(word_hashes(words), buckets)
                    np.add.at(self.raw, found, 1)
                    if flag:
                        np.add.at(self.target, found, 1)
            return []

        def totals(self):
            at = np.flatnonzero(self.raw)
            return list(zip(at.tolist(), self.raw[at].tolist(), self.target[at].tolist()))

    counts = map_batches(
        docs.select(F.col(text).cast("binary"), F.coalesce(F.col(trusted), F.lit(False))),
        Counter,
        "bucket int, raw long, target long",
        last=Counter.totals,
    )
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratio_table(counts: DataFrame, *, buckets: int, smoothing: float) -> np.ndarray:
    """log(p_target / p_raw) per bucket; at most `buckets` rows reach the driver."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, t in counts.collect():
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(buckets)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + smoothing) / (expected + smoothing))


def score_documents(
    docs: DataFrame, ratios: np.ndarray, *, id_col: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Base counts, score and verdict of every row."""
    buckets = len(ratios)

    def make():
        def each(ids, texts):
            for key, content in zip(ids, texts):
                content = content or b""
                words = content.split()
                hashes = word_hashes(words)
                counts = base_counts(content, words, hashes)
                n = len(words)
                failed = n < 50 or 100 * counts[3] > 50 * n
                score = float(ratios[gram_buckets(hashes, buckets)].mean()) if n else 0.0
                yield (key, n, *counts, failed, not failed and score >= threshold, score)

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.select(F.col(id_col), F.col(text).cast("binary")),
        make,
        f"{id_col} {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean, score double",
    )


def trusted_ids(labels: DataFrame, *, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """Ids of at most `max_trusted` rows labelled good and harmless, by smallest hash."""
    good = labels.where("quality = 1 and toxic = 0").select("doc_id").where("doc_id is not null")
    return good.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def quality_rules(
    docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text: str = "text",
    buckets: int = BUCKETS, smoothing: float = SMOOTHING, threshold: float = THRESHOLD,
    max_trusted: int = MAX_TRUSTED,
) -> DataFrame:
    """Score every row of `docs` against the target given by the ids in `trusted`.

    `trusted` is cut to the `max_trusted` ids with the smallest hashes, the same in every run, and
    so is small enough to broadcast.
    """
    ids = trusted.select(F.col(trusted.columns[0]).alias("_trusted_id")).distinct()
    some = ids.orderBy(F.xxhash64("_trusted_id"), "_trusted_id").limit(max_trusted)
    ids = F.broadcast(some.withColumn("_trusted", F.lit(True)))
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    flagged = slim.join(ids, F.col("_id") == F.col("_trusted_id"), "left")
    counts = ngram_counts(flagged, text="_text", trusted="_trusted", buckets=buckets)
    ratios = ratio_table(counts, buckets=buckets, smoothing=smoothing)
    return score_documents(docs, ratios, id_col=id_col, text=text, threshold=threshold)


@query()
def op1_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules(docs, trusted_ids(labels))

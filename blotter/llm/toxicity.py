"""Toxicity by weak supervision: many voters, a label model, a linear classifier.

Voters are mined from a bounded sample of labelled training rows: single words, words
that share a beginning, and groups of rarer words, each voting toxic where it occurs;
one further voter votes harmless where none of them does. A generative label model is
fitted to the votes by expectation maximisation: each voter's chance to vote in each
class, while silence says nothing. Correlations of voters within the classes are estimated from
what the model leaves over; a voter's evidence is divided by one plus its correlations
with the others, so that copies of one signal count once. The model's posteriors are the
soft labels on which a logistic regression over votes and hashed word beginnings is
trained. Every row of the input is then scored, whole text by whole text.

Labels come from training rows only (`held_out` rows are those whose crc32 of the id as
text is divisible by `folds`); the id, label, language and source are no inputs of a
score. Without labelled rows of both classes all scores are the share of toxic labels
(0 without any). Null texts count as empty and are scored like them. A null id is never
held out. Repeated rows get equal scores.
"""

from __future__ import annotations

import re
import xxhash

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import map_batches, written
from blotter.llm.registry import query, table

FOLDS = 5
#: Labelled training rows of each class that the models are fitted on, at most.
SAMPLE = 6_000
#: Single words, word beginnings and groups of rarer words that vote.
WORDS, STARTS, GROUPS = 64, 48, 16
#: Rarer words that are dealt to the groups, at most.
GROUPED = 2_000
#: Groups of like documents that a voting word or beginning needs, also as a share of all
#: toxic ones, and how many of the groups it is in must be toxic.
LEAST_GROUPS, LEAST_REACH, LEAST_SHARE = 5, 0.004, 0.9
#: Correlation within the classes from which voters share their weight.
LINKED = 0.5
#: Hashed word beginnings beside the votes.
BUCKETS, START_LENGTH = 1 << 12, 4
#: Lengths of word beginnings that may vote.
STARTS_OF = (4, 5, 6, 7, 8)

_WORD = re.compile(r"\w+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def is_held_out(id_col: str, folds: int = FOLDS):
    held = F.crc32(F.col(id_col).cast("string")) % folds == 0
    return F.coalesce(held, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, *, id_col: str, text: str, label: str, folds: int,
    sample: int,
) -> DataFrame:
    """(text, toxic) of at most `sample` training rows of each class, by smallest hash.

    Of rows that repeat an id, the one whose text has the smallest hash counts.
    """
    known = labels.where(
        F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(id_col, folds)
    ).groupBy(F.col(id_col).alias("_label_id")).agg(F.max(label).cast("int").alias("_toxic"))
    parts = [
        known.where(F.col("_toxic") == value)
        .orderBy(F.xxhash64("_label_id"), "_label_id")
        .limit(sample)
        for value in (0, 1)
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    found = slim.join(chosen, F.col("_id") == F.col("_label_id"))
    order = Window.partitionBy("_label_id").orderBy(F.xxhash64("_text"))
    one = found.where(F.col("_text").isNotNull()).withColumn("_n", F.row_number().over(order))
    return one.where("_n = 1").select(
        "_text", "_toxic", F.xxhash64("_label_id", "_text").alias("_order")
    )


class Voters:
    """Which voters a set of words makes vote; the last voter is the harmless one."""

    def __init__(self, words: list[str], starts: list[str], grouped: list[str], groups: int):
        self.by_word: dict[str, int] = {w: i for i, w in enumerate(words)}
        for w in grouped:
            number = xxhash.xxh3_64_intdigest(w.encode()) % groups
            self.by_word.setdefault(w, len(words) + number)
        first = len(words) + groups
        self.by_start = {s: first + i for i, s in enumerate(starts)}
        self.lengths = sorted({len(s) for s in starts})
        self.count = first + len(starts) + 1

    def of_word(self, word: str) -> list[int]:
        found = [self.by_word[word]] if word in self.by_word else []
        for n in self.lengths:
            if len(word) >= n and (at := self.by_start.get(word[:n])) is not None:
                found.append(at)
        return found


class Features:
    """Positions of votes and hashed word beginnings in a text; remembers words."""

    def __init__(self, voters: Voters, buckets: int) -> None:
        self.voters, self.buckets = voters, buckets
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, text: str) -> list[int]:
        """Sorted positions: voters first, then buckets."""
        known, found = self.known, set()
        for word in words_of(text):
            at = known.get(word)
            if at is None:
                start = xxhash.xxh3_64_intdigest(word[:START_LENGTH].encode()) % self.buckets
                at = (*self.voters.of_word(word), self.voters.count + start)
                if len(known) >= 400_000:
                    known.clear()
                known[word] = at
            found.update(at)
        if not any(i < self.voters.count for i in found):
            found.add(self.voters.count - 1)
        return sorted(found)


def group_of(words: set[str]) -> int:
    """One minimum hash of the words: near copies mostly share it, and count once."""
    return min((xxhash.xxh32_intdigest(w.encode()) for w in words), default=0)


def mine_voters(rows: DataFrame) -> Voters:
    """Voters from word and beginning counts over the labelled sample."""

    def make():
        def each(texts, toxic):
            for text, label in zip(texts, toxic):
                words = words_of(text)
                group = group_of(words)
                starts = {(n, w[:n]) for w in words for n in STARTS_OF if len(w) > n}
                yield from ((0, w, group, label) for w in words)
                yield from ((n, s, group, label) for n, s in starts)

        return each

    parts = map_batches(
        rows.select("_text", "_toxic"), make, "n int, part string, g long, toxic int"
    )
    grouped = parts.groupBy("n", "part", "g").agg(F.max("toxic").alias("toxic"))
    counts = grouped.groupBy("n", "part").agg(
        F.sum("toxic").alias("toxic"), F.count("*").alias("docs")
    )
    least = max(LEAST_GROUPS, LEAST_REACH * rows.where("_toxic = 1").count())
    counts = counts.where(
        (F.col("toxic") >= least) & (F.col("toxic") >= LEAST_SHARE * F.col("docs"))
    )

    def top(condition, most: int) -> list[str]:
        best = counts.where(condition).orderBy(F.desc("toxic"), "n", "part").limit(most)
        return [r["part"] for r in best.collect()]

    words = top("n = 0", WORDS + GROUPED)
    starts: list[str] = []
    for start in top("n > 0", 8 * STARTS):
        if len(starts) < STARTS and not any(start.startswith(s) for s in starts):
            starts.append(start)
    return Voters(words[:WORDS], starts, words[WORDS:], GROUPS)


def label_model(votes: np.ndarray, share: float, rounds: int = 30) -> np.ndarray:
    """Posterior of the toxic class per row of a 0/1 vote matrix; the last column is the
    harmless voter. `share` is the share of the toxic class."""
    n, m = votes.shape
    x = votes.astype(np.float64)
    p = np.where(x[:, -1] > 0, 0.02, 0.98)
    weight = np.ones(m)
    # What the outcomes are smoothed with: a voter's mean, as two rows.
    mean = (x.sum(0) + 0.5) / (n + 1)

    def fitted(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = (p @ x + 2 * mean) / (p.sum() + 2)
        miss = ((1 - p) @ x + 2 * mean * 0.1) / ((1 - p).sum() + 2)
        return np.clip(hit, 1e-6, 1 - 1e-6), np.clip(miss, 1e-6, 1 - 1e-6)

    def posterior(hit: np.ndarray, miss: np.ndarray) -> np.ndarray:
        # A voter that does not vote abstains: that says nothing.
        odds = np.log(share / (1 - share)) + x @ (np.log(hit / miss) * weight)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    for step in range(rounds):
        hit, miss = fitted(p)
        if step in (5, 15):
            # Correlations within the classes, of what the voters do beyond their chances.
            left = x - p[:, None] * hit - (1 - p)[:, None] * miss
            spread = np.sqrt((left**2).mean(0)) + 1e-9
            both = left.T @ left / n / spread[:, None] / spread
            np.fill_diagonal(both, 0)
            both[-1], both[:, -1] = 0, 0
            weight = 1 / (1 + np.where(both > LINKED, both, 0).sum(0))
            # All others silent: the harmless voter alone speaks for them.
            weight[-1] = 1
        p = posterior(hit, miss)
    return p


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text",
    label: str = "toxic", folds: int = FOLDS, sample: int = SAMPLE,
) -> DataFrame:
    """(id, held_out, score, predicted) of every row of `docs`."""
    spark = docs.sparkSession
    rows = written(
        labelled_sample(
            docs, labels, id_col=id_col, text=text, label=label, folds=folds, sample=sample
        ),
        "toxicity-sample",
    )
    counts = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    total = sum(counts.values())
    if not (counts.get(0) and counts.get(1)):
        constant = counts.get(1, 0) / total if total else 0.0
        score = F.lit(float(constant))
        return docs.select(id_col, is_held_out(id_col, folds).alias("held_out"), score.alias(
            "score"), (score >= 0.5).cast("int").alias("predicted"))

    voters = mine_voters(rows)

    def featured():
        features = Features(voters, BUCKETS)

        def each(orders, texts, toxic):
            return [(o, features.of(t), y) for o, t, y in zip(orders, texts, toxic)]

        return each

    marked = written(
        map_batches(
            rows.select("_order", "_text", "_toxic"), featured,
            "_order long, at array<int>, toxic int",
        ),
        "toxicity-votes",
    )
    # At most 2 * sample rows of at most `voters.count` votes.
    voted = marked.select(
        "_order", F.filter("at", lambda i: i < voters.count).alias("votes")
    ).orderBy("_order").collect()
    votes = np.zeros((len(voted), voters.count), np.int8)
    for i, r in enumerate(voted):
        votes[i, r["votes"]] = 1
    soft = label_model(votes, counts[1] / total)
    size = voters.count + BUCKETS
    posteriors = F.broadcast(
        spark.createDataFrame(
            [(r["_order"], float(p)) for r, p in zip(voted, soft)], "_order long, p double"
        ).dropDuplicates(["_order"])
    )
    to_vector = F.udf(lambda at: Vectors.sparse(size, at, [1.0] * len(at)), VectorUDT())
    joined = marked.join(posteriors, "_order").withColumn("features", to_vector("at"))
    # A soft label is one row of each class, weighted.
    training = joined.select("features", F.lit(1.0).alias("label"), F.col("p").alias("weight"))
    training = training.unionByName(
        joined.select("features", F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight"))
    ).where("weight > 0")
    training = written(training, "toxicity-train")
    fit = LogisticRegression(
        weightCol="weight", regParam=1e-4, maxIter=40, standardization=False, tol=1e-6
    ).fit(training)
    weights, constant = np.array(fit.coefficients.toArray()), float(fit.intercept)

    def scored():
        features = Features(voters, BUCKETS)

        def each(ids, held, texts):
            for key, out, content in zip(ids, held, texts):
                odds = constant + float(weights[features.of(content or "")].sum())
                score = float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))
                yield key, out, score, int(score >= 0.5)

        return each

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return map_batches(
        docs.select(id_col, is_held_out(id_col, folds).alias("_held"), text),
        scored,
        f"{id_col} {kinds[id_col]}, held_out boolean, score double, predicted int",
    )


@query()
def op6_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Source divergence audit by hash-consed segment trees.

Every language keeps the terms that enough of its documents have and numbers them in byte
order. A group (language, source) is the vector of its counts over these numbers, held as a
segment tree: a node over 2^k numbers is the pair of its halves, and equal halves of whatever
groups are one node. Two groups are priced by walking both trees at once from the roots; pairs
of nodes that were met before are not walked again but add to the times they count, so every
pair of nodes, and at the bottom every pair of counts, is priced once. Spark holds the upper
levels: a task has the trees over one range of numbers for two blocks of groups, and the
prices of the ranges are summed.

The smoothed share of a count c is p = 1 + floor(SCALE * (c + 5) / (N + 5 V)), in exact integers, with N the
group's count of kept terms and V their number.

Null text, language and source are read as ''. Repeated rows each count. A group without kept
terms has N = 0, a language without kept terms gives every pair of its sources 0. Other
columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import map_batches, written
from blotter.llm.registry import query, table

#: A kept term occurs in this many documents of the language.
LEAST_DOCUMENTS = 30
#: Shares are multiples of 1 / SCALE, after PRIOR more occurrences of every kept term.
SCALE, PRIOR = 1_000_000_000, 5
#: Ranks reported of the terms of a group.
TOP_TERMS = 50
#: Terms of one range (a power of two) and groups of one block: bound what a task holds.
RANGE, BLOCK = 4096, 128
#: Entries of the counts that a task holds before it sends them on.
HELD = 400_000

#: Bytes of a term are letters and all that is not ASCII; capitals become small.
_TERM = bytes(
    b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)
)


def term_counts(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source",
    held: int = HELD,
) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed within each task."""

    def make():
        tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flushed():
            for (language, origin), (n, docs_of) in tables.items():
                for term, count in n.items():
                    yield language, origin, term.decode(), count, docs_of[term]
            tables.clear()

        def each(texts, languages, origins):
            for content, *key in zip(texts, languages, origins):
                terms = (content or "").encode().translate(_TERM).split()
                n, docs_of = tables.setdefault(tuple(key), (Counter(), Counter()))
                n.update(terms)
                docs_of.update(set(terms))
            return flushed() if sum(len(n) for n, _ in tables.values()) > held else []

        each.rest = flushed
        return each

    slim = docs.select(
        F.col(text), *[F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in (lang, source)]
    )
    return map_batches(
        slim, make, "lang string, source string, term string, n long, docs long",
        last=lambda each: each.rest(),
    )


def kept_counts(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source",
    least: int = LEAST_DOCUMENTS,
) -> tuple[DataFrame, DataFrame]:
    """(counts, terms): (lang, source, term, n) of the kept terms, and (lang, term, n, id).

    All counts of a term meet in one shuffle. `id` numbers the kept terms of a language in byte
    order from 0.
    """
    met = term_counts(docs, text=text, lang=lang, source=source).repartition("lang", "term")
    cells = met.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # A term has one row per source by now, in the partition it was sent to.
    term = Window.partitionBy("lang", "term")
    known = cells.withColumns({"docs": F.sum("docs").over(term), "total": F.sum("n").over(term)})
    counts = written(known.where(F.col("docs") >= least).drop("docs"), "divergence-counts")
    terms = counts.select("lang", "term", F.col("total").alias("n")).distinct()
    return counts.drop("total"), _numbered(terms)


def _numbered(terms: DataFrame) -> DataFrame:
    """Add `id`, the place among the language's terms, without one task for a language."""
    ordered = terms.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    # The bounds of the ranges are drawn anew in each run, so the places are written.
    places = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "divergence-terms")
    part = F.shiftright("_at", 33).alias("_part")
    # One row per range and language.
    spans = places.groupBy("lang", part).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_least"))
    before = Window.partitionBy("lang").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = spans.select(
        "lang", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_base")
    )
    return places.withColumn("_part", part).join(bases, ["lang", "_part"]).select(
        "lang", "term", "n", (F.col("_at") + F.col("_base")).alias("id")
    )


class ConsedTrees:
    """Segment trees over the rows of a matrix of counts, equal nodes held once.

    `levels[0]` are the distinct counts, the nodes of `levels[k]` pairs of nodes of level k - 1;
    `roots` has the node at the top for each row. The width is a power of two.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.counts, at = np.unique(counts, return_inverse=True)
        at = at.reshape(counts.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        size = len(self.counts)
        while at.shape[1] > 1:
            pairs, at = np.unique(at[:, ::2] * size + at[:, 1::2], return_inverse=True)
            at = at.reshape(len(counts), -1)
            self.levels.append((pairs // size, pairs % size))
            size = len(pairs)
        self.roots = at[:, 0]

    def count_pairs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts of row a, counts of row b, times) of all distinct pairs of leaves.

        The walk goes down both trees level by level; pairs of nodes that come up more than once
        become one that counts as often.
        """
        x, y = self.roots[a : a + 1], self.roots[b : b + 1]
        times = np.ones(1, np.int64)
        for left, right in reversed(self.levels):
            width = len(left)
            x, y = np.concatenate([left[x], right[x]]), np.concatenate([left[y], right[y]])
            width = max(int(x.max()), int(y.max())) + 1
            pairs, at = np.unique(x * width + y, return_inverse=True)
            times = np.bincount(at, np.concatenate([times, times]), len(pairs)).astype(np.int64)
            x, y = pairs // width, pairs % width
        return self.counts[x], self.counts[y], times

    def leaves(self, row: int, blank: int) -> list[int]:
        """Places of a row whose count is above 0; subtrees of `blank` nodes are passed over."""
        at, node = np.zeros(1, np.int64), self.roots[row : row + 1]
        empty = self._empty(blank)
        for depth in range(len(self.levels) - 1, -1, -1):
            left, right = self.levels[depth]
            seen = ~empty[depth + 1][node]
            at, node = at[seen], node[seen]
            at = np.concatenate([2 * at, 2 * at + 1])
            node = np.concatenate([left[node], right[node]])
        return at[~empty[0][node]]

    def _empty(self, blank: int) -> list[np.ndarray]:
        """Per level: the nodes without a count above `blank`."""
        found = [self.counts <= blank]
        for left, right in self.levels:
            found.append(found[-1][left] & found[-1][right])
        return found


#: The count of a place beyond the last term: equal in all trees and without a price.
BEYOND = -1


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """p of each count, as exact integers; 0 beyond the last term."""
    under = total + PRIOR * kept
    exact = [0 if c == BEYOND else 1 + SCALE * (c + PRIOR) // under for c in counts.tolist()]
    return np.array(exact, np.int64)


def _vectors(counts: DataFrame, terms: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """One row per language, range and group: (lang, range, g, total, kept, ids, counts).

    Groups have numbers from 0 within the language; -1 is the language itself. Ranges in which
    a group has no term have empty lists, and a language without terms has one range.
    """
    named = counts.join(terms.select("lang", "term", "id"), ["lang", "term"])
    named = named.join(groups.select("lang", "source", "g"), ["lang", "source"]).select(
        "lang", "g", "id", "n"
    )
    entries = named.unionByName(terms.select("lang", F.lit(-1).cast("long").alias("g"), "id", "n"))
    filled = entries.groupBy("lang", F.floor(F.col("id") / width).cast("int").alias("range"), "g").agg(
        F.collect_list(F.struct((F.col("id") % width).cast("int").alias("at"), "n")).alias("cells")
    )
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    totals = entries.groupBy("lang", "g").agg(F.sum("n").alias("total"))
    everyone = groups.select("lang", "g").unionByName(
        groups.select("lang", F.lit(-1).cast("long").alias("g")).distinct()
    )
    size = F.coalesce("kept", F.lit(0))
    ranges = F.sequence(F.lit(0), F.greatest(F.ceil(size / width) - 1, F.lit(0)).cast("int"))
    whole = everyone.join(kept, "lang", "left").join(totals, ["lang", "g"], "left").select(
        "lang", "g", F.coalesce("total", F.lit(0)).alias("total"), size.alias("kept"),
        F.explode(ranges).alias("range"),
    )
    return whole.join(filled, ["lang", "range", "g"], "left")


def _matrix(part: pa.Table, width: int) -> tuple[list[int], list[int], int, np.ndarray]:
    """(groups, totals, kept terms, counts) of one task, a row per group in their order."""
    rows = sorted(part.select(["g", "total", "cells"]).to_pylist(), key=lambda r: r["g"])
    kept, start = part["kept"][0].as_py(), part["range"][0].as_py() * width
    matrix = np.zeros((len(rows), width), np.int64)
    for row, line in zip(rows, matrix):
        for cell in row["cells"] or []:
            line[cell["at"]] = cell["n"]
    matrix[:, max(kept - start, 0) :] = BEYOND
    return [r["g"] for r in rows], [r["total"] for r in rows], kept, matrix


def _prices(part: pa.Table, width: int, block: int) -> pa.Table:
    """Prices of all pairs of groups of two blocks in one range, and the best terms.

    A task of one block with itself also prices its groups against the language.
    """
    names, totals, kept, matrix = _matrix(part, width)
    trees = ConsedTrees(matrix)
    low, high = part["low"][0].as_py(), part["high"][0].as_py()
    start = part["range"][0].as_py() * width
    held = trees.counts

    def share_of(row: int) -> np.ndarray:
        return shares(held, totals[row], kept) if kept else np.zeros(len(held), np.int64)

    lookup = [share_of(row) for row in range(len(names))]
    found: list[tuple] = []
    for a, g in enumerate(names):
        if g < 0:
            continue
        if low == high:
            if g // block == low and kept:
                found += _terms(trees, lookup, matrix, a, names.index(-1), g, start)
        for b in range(a + 1, len(names)):
            h = names[b]
            if (g // block, h // block) == (low, high):
                x, y, times = trees.count_pairs(a, b)
                p = lookup[a][np.searchsorted(held, x)]
                q = lookup[b][np.searchsorted(held, y)]
                found.append((g, h, None, int((np.abs(p - q) * times).sum())))
    g, h, ids, value = zip(*found) if found else ([], [], [], [])
    return pa.table({
        "lang": pa.array([part["lang"][0].as_py()] * len(g), pa.string()),
        "g": pa.array(g, pa.int64()), "h": pa.array(h, pa.int64()),
        "id": pa.array(ids, pa.int64()), "value": pa.array(value, pa.int64()),
    })


def _terms(trees, lookup, matrix, row: int, lang_row: int, g: int, start: int) -> list[tuple]:
    """The range's TOP_TERMS terms of a group by p - q, ties to the smaller id."""
    at = np.sort(trees.leaves(row, 0))
    held = trees.counts
    p = lookup[row][np.searchsorted(held, matrix[row, at])]
    q = lookup[lang_row][np.searchsorted(held, matrix[lang_row, at])]
    gain = p - q
    order = np.argsort(-gain, kind="stable")[:TOP_TERMS]
    return [(g, None, start + int(at[i]), int(gain[i])) for i in order if gain[i] > 0]


def source_divergence(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source",
    least: int = LEAST_DOCUMENTS, width: int = RANGE, block: int = BLOCK,
) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of the sources of each language.

    Part `pair`: every other source of the language with the sum of |p - q| over all kept terms.
    Part `term`: the TOP_TERMS terms whose p exceeds the language's most.
    """
    counts, terms = kept_counts(docs, text=text, lang=lang, source=source, least=least)
    pairs = docs.select(
        F.coalesce(F.col(lang), F.lit("")).alias("lang"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
    ).distinct()
    numbered = Window.partitionBy("lang").orderBy("source")
    groups = pairs.withColumn("g", (F.row_number().over(numbered) - 1).cast("long"))
    groups = written(groups, "divergence-groups")

    vectors = _vectors(counts, terms, groups, width)
    # Blocks of groups meet in pairs of blocks; the language itself goes where a block meets itself.
    blocks = groups.groupBy("lang").agg((F.floor(F.max("g") / block)).cast("int").alias("_last"))
    own = F.floor(F.col("g") / block).cast("int")
    every = F.sequence(F.lit(0), F.col("_last"))
    met = F.when(
        F.col("g") < 0, F.transform(every, lambda b: F.struct(b.alias("low"), b.alias("high")))
    ).otherwise(
        F.transform(every, lambda b: F.struct(F.least(b, own).alias("low"), F.greatest(b, own).alias("high")))
    )
    dealt = vectors.join(blocks, "lang").select(
        "lang", "range", "g", "total", "kept", "cells", F.inline(met)
    )
    priced = dealt.groupBy("lang", "range", "low", "high").applyInArrow(
        lambda part: _prices(part, width, block), "lang string, g long, h long, id long, value long"
    )
    priced = written(priced, "divergence-prices")

    # Sums of long values stay exact; every price has both directions.
    summed = priced.where("id IS NULL").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    both = summed.unionByName(summed.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    name = groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    pair_rows = both.join(name, ["lang", "h"]).select("lang", "g", F.lit("pair").alias("part"), "item", "value")
    best = priced.where("id IS NOT NULL").join(
        terms.select("lang", "id", F.col("term").alias("item")), ["lang", "id"]
    )
    term_rows = best.select("lang", "g", F.lit("term").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "g", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    ranked = pair_rows.withColumn("rank", rank).unionByName(
        term_rows.withColumn("rank", rank).where(F.col("rank") <= TOP_TERMS)
    )
    return ranked.join(groups, ["lang", "g"]).select("lang", "source", "part", "item", "value", "rank")


_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t,
  row_number() OVER () AS row FROM documents),
o AS (SELECT lang, source, row, unnest(t) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM g LEFT JOIN c
  USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, kept.term, coalesce(c.n, 0) AS n,
  1 + CAST((1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (s.total + 5 * v.v) AS BIGINT) AS p,
  1 + CAST((1000000000 * (kept.n + 5)::HUGEINT) // (v.total + 5 * v.v) AS BIGINT) AS q
  FROM s JOIN kept USING (lang) JOIN v USING (lang)
  LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part
  ORDER BY value DESC, item) AS INTEGER) AS rank FROM x) y WHERE part = 'pair' OR rank <= 50
"""


@query(_SQL)
def op11_source_divergence(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))

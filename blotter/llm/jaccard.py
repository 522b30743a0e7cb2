"""N-gram Jaccard join with adaptive prefixes that need several matches.

A document's set are its distinct word shingles, hashed to 64 bits. Two sets link when
their Jaccard similarity reaches `percent`. Sets are ordered by one global order: tokens
that are frequent come last, by their count, others by hash. Of a set of n tokens, with
need = ceil(percent * n / 100), the prefix for l matches is its first n - need + l tokens,
and two sets that link share at least min(l, l') tokens of their prefixes. Each set
chooses its l by estimated cost: a longer prefix has more tokens to index, but every
candidate must then share more of them before it is verified.

1. Equal sets are one node. Frequent tokens are found by counts that tasks share; the
   list only sorts and estimates, so its bound (`most_frequent`) loses nothing.
2. Prefix tokens meet in groups of bounded size. In each token's list every node is first
   matched with one centre only, and verified with the best few of its centres, so that
   large groups of near copies link in stars. Then rounds with other centres in lists that
   still hold different components. This only spares pairs; step 3 decides.
3. Lists that still hold different components give all pairs across components, which
   need enough shared tokens and are then verified: no link between components is lost,
   and no pair inside a component is made. Sets of a and b tokens that link share at
   least o = ceil(percent * (a + b) / (100 + percent)), so the first l that they share
   are among the first a - o + l and b - o + l: a pair counts only tokens found there.

Each set has a sketch: for every bit, whether an odd number of its tokens fall there. Bits in
which two sketches differ hold a token of one set only, so sets whose sketches differ in more
than a + b - 2 * o bits cannot link. Such pairs go before anything is made of them, which
keeps large groups of near copies that just miss the similarity from giving all their pairs.

Null and empty texts, and those without words, have the empty set and link with nothing;
fewer words than a shingle has are one shingle. Rows that repeat have equal sets and so
are one node. Further columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import extras_renamed, map_batches, window_hashes, word_hashes, written
from blotter.llm.components import connected_components
from blotter.llm.registry import query, table
from blotter.storage import Stages

#: Documents from which a token counts as frequent, and the longest list of such tokens.
FREQUENT, MOST_FREQUENT = 24, 1 << 18
#: Matches that a set may ask for, and the cost of verifying against that of indexing.
MATCHES = (1, 2, 3, 4, 6, 8)
VERIFY_COST, OTHER_PARTNERS = 10.0, 0.05
#: Prefix tokens that meet in one group, and those that a task deals out at once.
GROUP_TOKENS, DEALT_AT_ONCE = 400_000, 200_000
#: Bytes of the tokens across components that meet in one group, each with a sketch.
GROUP_BYTES = 1 << 26
#: Tokens that a task takes up before it counts them.
COUNTED_AT_ONCE = 500_000
#: Rounds of stars, kinds of centres, and the centres that a node is verified with in a round.
ROUNDS, CENTRES, TRIES = 2, 32, 16
#: Pairs that a task looks at together, and the bytes of their sketches.
PAIRS_AT_ONCE, SKETCH_BYTES_AT_ONCE = 200_000, 1 << 23
#: Bits of the shortest and the longest sketch; between them, at least 8 for each token.
SKETCH_BITS = 64, 1 << 15

_NULL_ID = -(1 << 63)
_ITEM = np.dtype([("token", "<u8"), ("node", "<i8"), ("at", "<i4"), ("n", "<i4"), ("ask", "<i4")])
_SHARED = "token long, node long, at int, n int, ask int"


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of `k` words, A-Z in lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(k, len(words))))


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set, as two signed 64-bit integers."""
    high, low = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), ">i8").tolist()
    return high, low


def sketch(tokens: np.ndarray) -> bytes:
    """For each bit, whether an odd number of tokens has its place as remainder."""
    bits = min(max(SKETCH_BITS[0], 1 << (8 * len(tokens) - 1).bit_length()), SKETCH_BITS[1])
    at = (tokens & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


class Sketches:
    """Sketches of different lengths that are compared by their places in `blobs`."""

    def __init__(self, blobs: list[bytes]) -> None:
        self.words = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8
        self.slot = np.empty(len(blobs), np.int64)
        self.tables: dict[tuple[int, int], np.ndarray] = {}
        for length in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == length)
            self.slot[own] = np.arange(len(own))
            joined = b"".join(blobs[i] for i in own.tolist())
            self.tables[length, length] = np.frombuffer(joined, np.uint64).reshape(-1, length)

    def folded(self, length: int, to: int) -> np.ndarray:
        """The sketches of `length` words as those of `to` words: parities of halves add up."""
        if (length, to) not in self.tables:
            longer = self.folded(length, 2 * to)
            self.tables[length, to] = longer[:, :to] ^ longer[:, to:]
        return self.tables[length, to]

    def differing(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Bits in which each pair differs: never more than tokens that one of them lacks."""
        out = np.zeros(len(left), np.int64)
        x, y = self.words[left], self.words[right]
        for one, other in {*zip(*(v.tolist() for v in np.unique(np.stack([x, y]), axis=1)))}:
            to = min(one, other)
            first, second = self.folded(one, to), self.folded(other, to)
            rows = np.flatnonzero((x == one) & (y == other))
            step = max(1, SKETCH_BYTES_AT_ONCE // (8 * to))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                bits = first[self.slot[left[part]]] ^ second[self.slot[right[part]]]
                out[part] = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        return out


def least_overlap(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that two linking sets share at least, by the sum of their sizes."""
    return -(-percent * sizes // (100 + percent))


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def frequent_tokens(
    docs: DataFrame, text: str, k: int, *, frequent: int, most_frequent: int
) -> tuple[np.ndarray, np.ndarray]:
    """(tokens sorted, counts) of the most frequent tokens.

    Every task counts all tokens of its distinct sets and tells those it saw twice.
    """

    class Counter:
        def __init__(self) -> None:
            self.seen: set[bytes] = set()
            self.parts: list[np.ndarray] = []
            self.size = 0
            self.tokens, self.counts = np.empty(0, np.uint64), np.empty(0, np.int32)

        def fold(self) -> None:
            fresh, n = np.unique(np.concatenate(self.parts), return_counts=True)
            self.parts, self.size = [], 0
            at = np.searchsorted(self.tokens, fresh)
            known = at < len(self.tokens)
            known[known] = self.tokens[at[known]] == fresh[known]
            self.counts[at[known]] += n[known].astype(np.int32)
            self.tokens = np.insert(self.tokens, at[~known], fresh[~known])
            self.counts = np.insert(self.counts, at[~known], n[~known].astype(np.int32))

        def __call__(self, texts):
            for content in texts:
                tokens = shingle_set(content, k)
                key = xxhash.xxh3_128_digest(tokens.tobytes())
                if len(tokens) and key not in self.seen:
                    self.seen.add(key)
                    self.parts.append(tokens)
                    self.size += len(tokens)
            if self.size > COUNTED_AT_ONCE:
                self.fold()
            return self.told() if len(self.tokens) > 8_000_000 else []

        def told(self):
            """What was seen twice; then the count starts anew, so that memory is bounded."""
            if self.parts:
                self.fold()
            twice = self.counts > 1
            found = zip(self.tokens[twice].astype(np.int64).tolist(), self.counts[twice].tolist())
            self.tokens, self.counts = np.empty(0, np.uint64), np.empty(0, np.int32)
            return list(found)

    told = map_batches(docs.select(text), Counter, "token long, n long", last=Counter.told)
    best = (
        told.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent)
        .orderBy(F.desc("n"), "token").limit(most_frequent)
    )
    rows = best.toPandas()
    tokens = rows["token"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows["n"].to_numpy(np.int64)[order]


def adaptive_prefix(
    tokens: np.ndarray, percent: int, frequent: np.ndarray, counts: np.ndarray
) -> tuple[int, np.ndarray]:
    """(matches to ask for, prefix) of a sorted set; empty if only equal sets could link."""
    n = len(tokens)
    if n * (100 - percent) < percent:
        return 0, tokens[:0]
    need = -(-percent * n // 100)
    weight = np.zeros(n)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        weight = np.where(frequent[at] == tokens, counts[at], 0).astype(float)
        if weight.any():
            order = np.argsort(weight, kind="stable")
            tokens, weight = tokens[order], weight[order]
    partners = np.cumsum(np.where(weight > 0, weight - 1, OTHER_PARTNERS))
    best, least = 1, math.inf
    for l in MATCHES:
        if l > need:
            break
        size = n - need + l
        cost = size + VERIFY_COST * partners[size - 1] / l
        if cost < least:
            best, least = l, cost
    return best, tokens[: n - need + best]


def _keyed(
    slim: DataFrame, id_col: str, text: str, k: int, percent: int, heavy, stages: Stages | None = None
) -> DataFrame:
    """One row per row of `slim`: its id, the hash of its text, size and key of its set, and
    matches, prefix and sketch of sets that can link with other ones. It is written by `stages`."""
    frequent, counts = heavy

    def make():
        def each(ids, numbers, contents, texts):
            for key, number, content_hash, content in zip(ids, numbers, contents, texts):
                tokens = shingle_set(content, k)
                n = len(tokens)
                own = set_key(tokens) if n else (None, None)
                ask, prefix = adaptive_prefix(tokens, percent, frequent, counts) if n else (0, None)
                more = (ask, prefix.tobytes(), sketch(tokens)) if ask else (0, None, None)
                yield key, number, content_hash, n, *own, *more

        return each

    kind = slim.schema[id_col].dataType.simpleString()
    made = map_batches(
        slim.select(id_col, "_id", F.xxhash64(text), text), make,
        f"{id_col} {kind}, _id long, _content long, n_shingles long, k1 long, k2 long, "
        "ask int, prefix binary, sketch binary",
    )
    return (stages or Stages(slim.sparkSession, "jaccard-keys")).write(made)


def _nodes(keyed: DataFrame, stages: Stages | None = None) -> DataFrame:
    """One row per distinct set that can link: node, one of its documents, key, size, matches,
    prefix, sketch. It is written by `stages`."""
    # Documents of one key have the same set, so all but the document is equal.
    one = keyed.where("ask > 0").groupBy("k1", "k2").agg(
        F.min(F.struct("_id", "_content")).alias("_doc"),
        F.first(F.col("n_shingles").cast("int")).alias("n"),
        *(F.first(c).alias(c) for c in ("ask", "prefix", "sketch")),
    )
    numbered = one.select("*", "_doc.*").drop("_doc").withColumn("node", F.monotonically_increasing_id())
    return (stages or Stages(keyed.sparkSession, "jaccard-nodes")).write(numbered)


def _shared_tokens(nodes: DataFrame) -> DataFrame:
    """(token, node, its place `at` in the prefix, the node's size and matches) of every
    token that prefixes of several nodes have."""
    total = nodes.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0
    groups = max(1, math.ceil(total / GROUP_TOKENS))

    class Dealer:
        def __init__(self) -> None:
            self.parts: list[np.ndarray] = []
            self.size = 0

        def __call__(self, ids, sizes, asks, prefixes):
            for node, n, ask, prefix in zip(ids, sizes, asks, prefixes):
                items = np.empty(len(prefix) // 8, _ITEM)
                items["token"], items["node"] = np.frombuffer(prefix, "<u8"), node
                items["n"], items["ask"] = n, ask
                items["at"] = np.arange(len(items))
                self.parts.append(items)
                self.size += len(items)
                if self.size > DEALT_AT_ONCE:
                    yield from self.dealt()

        def dealt(self):
            if not self.parts:
                return
            items = np.concatenate(self.parts)
            self.parts, self.size = [], 0
            group = (items["token"] % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            items, group = items[order], group[order]
            for part in np.split(items, np.flatnonzero(np.diff(group)) + 1):
                yield int(part["token"][0] % np.uint64(groups)), part.tobytes()

    def shared(part: pd.DataFrame) -> pd.DataFrame:
        items = np.frombuffer(b"".join(part["items"]), _ITEM)
        items = items[np.argsort(items["token"], kind="stable")]
        token = items["token"]
        same = token[1:] == token[:-1]
        keep = np.zeros(len(items), bool)
        keep[1:] |= same
        keep[:-1] |= same
        kept = items[keep]
        columns = {c: kept[c] for c in ("node", "at", "n", "ask")}
        return pd.DataFrame({"token": kept["token"].astype(np.int64), **columns})

    dealt = map_batches(
        nodes.select("node", "n", "ask", "prefix"), Dealer, "g long, items binary", last=Dealer.dealt
    )
    return written(dealt.groupBy("g").applyInPandas(shared, _SHARED), "jaccard-shared")


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) whose sketches allow that they link."""
    for side in ("a", "b"):
        own = nodes.select(
            F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")
        )
        pairs = pairs.join(own, side)

    def make():
        def each(a, b, n_a, n_b, s_a, s_b):
            sizes = np.array(n_a, np.int64) + np.array(n_b, np.int64)
            at = np.arange(len(a))
            differ = Sketches(s_a + s_b).differing(at, at + len(a))
            fits = differ <= sizes - 2 * least_overlap(sizes, percent)
            return [(a[i], b[i]) for i in np.flatnonzero(fits).tolist()]

        return each

    columns = ("a", "b", "n_a", "n_b", "s_a", "s_b")
    return map_batches(pairs.select(*columns), make, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) whose sets link; `texts` has (node, text)."""
    left = texts.select(F.col("node").alias("a"), F.col(text).alias("_a"))
    right = texts.select(F.col("node").alias("b"), F.col(text).alias("_b"))
    both = pairs.join(left, "a").join(right, "b")

    def make():
        last: dict[str, tuple] = {}

        def set_of(side: str, node: int, content: str) -> np.ndarray:
            # Rows come by node, so a hot node's set is made once.
            if last.get(side, (None,))[0] != node:
                last[side] = (node, shingle_set(content, k))
            return last[side][1]

        def each(a, b, first, second):
            for x, y, s, t in zip(a, b, first, second):
                if links(set_of("a", x, s), set_of("b", y, t), percent):
                    yield x, y

        return each

    checked = map_batches(both.select("a", "b", "_a", "_b"), make, "a long, b long")
    return written(checked, "jaccard-links")


def _labelled(shared: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(component of nodes that have links, shared tokens whose nodes differ in component)."""
    parts = connected_components(found)
    own = F.coalesce("component", "node").alias("component")
    marked = shared.join(parts, "node", "left").select(*shared.columns, own)
    mixed = marked.groupBy("token").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high")
    ).where("_low <> _high")
    return parts, marked.join(mixed.select("token"), "token")


def _star(marked: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): each node with those few centres of its tokens that it shares most with."""
    chance = F.xxhash64("node", F.pmod("token", F.lit(CENTRES)), F.lit(turn))
    own = [c for c in ("node", "at", "n", "ask", "component") if c in marked.columns]
    centre = marked.groupBy("token").agg(F.min_by(F.struct(*own), chance).alias("c"))
    name = own[-1] if "component" in own else "node"
    size = F.col("n") + F.col("c.n")
    spare = F.least("ask", "c.ask") - F.ceil(percent * size / F.lit(100 + percent))
    pairs = marked.join(centre, "token").where(
        (F.col(name) != F.col(f"c.{name}"))
        & (100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n"))
        & (F.col("at") < F.col("n") + spare) & (F.col("c.at") < F.col("c.n") + spare)
    )
    counts = pairs.groupBy("node", F.col("c.node").alias("b")).agg(F.count("*").alias("n"))
    # At most one entry for each token of the node's own prefix.
    best = F.sort_array(F.collect_list(F.struct("n", "b")), asc=False)
    few = counts.groupBy("node").agg(F.slice(best, 1, TRIES).alias("_best"))
    return few.select(F.col("node").alias("a"), F.explode("_best.b").alias("b"))


def _grouped(marked: DataFrame) -> DataFrame:
    """`marked` with the group `g` of each token, of `GROUP_BYTES` with the sketches of its nodes.

    Lists with the same least component mostly have the same nodes, so they lie in one group,
    unless they are too many, and few groups get the sketch of a node.
    """
    # A sketch has at most twice as many bytes as its set has tokens.
    sketch_bytes = F.least(F.greatest(2 * F.col("n"), F.lit(SKETCH_BITS[0] // 8)), F.lit(SKETCH_BITS[1] // 8))
    lists = marked.groupBy("token").agg(
        F.min("component").alias("_low"), F.sum(sketch_bytes + _ITEM.itemsize).alias("_bytes")
    )
    lows = lists.groupBy("_low").agg(F.sum("_bytes").alias("_bytes"))
    total = lows.agg(F.sum("_bytes")).first()[0] or 0
    groups = max(1, math.ceil(total / GROUP_BYTES))
    part = F.pmod(F.xxhash64("token"), F.ceil(F.col("_bytes") / GROUP_BYTES))
    group = F.pmod(F.xxhash64("_low", part), F.lit(groups))
    dealt = lists.drop("_bytes").join(lows, "_low").select("token", group.alias("g"))
    return marked.join(dealt, "token")


def _across(marked: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that share enough tokens early in their prefixes and
    whose sketches allow that they link."""
    rows = _grouped(marked)
    # A node's sketch goes once to each group that has tokens of it.
    near = rows.select(F.col("g").alias("_g"), F.col("node").alias("known")).distinct().join(
        nodes.select(F.col("node").alias("known"), "sketch"), "known"
    )

    def pairs(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["token", "component"], kind="stable")
        token, component = part["token"].to_numpy(), part["component"].to_numpy()
        node, n, ask, place = (part[c].to_numpy(np.int64) for c in ("node", "n", "ask", "at"))
        known = own["known"].to_numpy(np.int64)
        order = np.argsort(known)
        slot = order[np.searchsorted(known[order], node)]
        sketches = Sketches(own["sketch"].tolist())
        count = len(part)
        changes = np.flatnonzero(np.diff(token)) + 1
        ends = np.append(changes, count)[np.searchsorted(changes, np.arange(count), "right")]
        same = (np.diff(token) == 0) & (np.diff(component) == 0)
        others = np.flatnonzero(np.append(~same, True)) + 1
        # From where in its list the other components come, for each row.
        begins = others[np.searchsorted(others, np.arange(count), "right")]
        found = []
        many = np.maximum(ends - begins, 0)
        before = np.append(0, np.cumsum(many))
        at = 0
        while at < count:
            # At least one row, which has at most as many partners as the group has rows.
            to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS_AT_ONCE, "right")) - 1)
            left = np.repeat(np.arange(at, to), many[at:to])
            right = begins[left] + np.arange(len(left)) - (before[left] - before[at])
            low, high = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
            overlap = least_overlap(low + high, percent)
            spare = np.minimum(ask[left], ask[right]) - overlap
            fits = (100 * low >= percent * high) & (place[left] < n[left] + spare)
            fits &= place[right] < n[right] + spare
            left, right, most = left[fits], right[fits], (low + high - 2 * overlap)[fits]
            fits = sketches.differing(slot[left], slot[right]) <= most
            left, right = left[fits], right[fits]
            found.append(
                pd.DataFrame(
                    {
                        "a": np.minimum(node[left], node[right]),
                        "b": np.maximum(node[left], node[right]),
                        "ask": np.minimum(ask[left], ask[right]),
                    }
                ).groupby(["a", "b"], as_index=False).agg(ask=("ask", "min"), n=("ask", "size"))
            )
            at = to
        if not found:
            return pd.DataFrame({c: [] for c in ("a", "b", "ask", "n")})
        return pd.concat(found).groupby(["a", "b"], as_index=False).agg({"ask": "min", "n": "sum"})

    made = (
        rows.groupBy("g").cogroup(near.groupBy("_g"))
        .applyInPandas(pairs, "a long, b long, ask int, n long")
    )
    return (
        made.groupBy("a", "b").agg(F.min("ask").alias("ask"), F.sum("n").alias("n"))
        .where(F.col("n") >= F.col("ask")).select("a", "b")
    )


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", **settings) -> DataFrame:
    """(id, n_shingles, component_id) of every row; a component is named by its least id."""
    return _components(docs, id_col=id_col, **settings).select(id_col, "n_shingles", "component_id")


def _components(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80,
    frequent: int = FREQUENT, most_frequent: int = MOST_FREQUENT,
) -> DataFrame:
    """The rows of `jaccard_components` with the hash of their text, `_content`, and the least
    set key of their component, `_group` (null without words): ids may repeat, keys do not."""
    slim = docs.select(
        F.col(id_col),
        F.col(text),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("_id"),
    )
    heavy = frequent_tokens(slim, text, k, frequent=frequent, most_frequent=most_frequent)
    # Prefixes and sketches are the bulk of both tables: what is read no more goes.
    spark = slim.sparkSession
    key_stages, node_stages = Stages(spark, "jaccard-keys"), Stages(spark, "jaccard-nodes")
    text_stages, mixed_stages = Stages(spark, "jaccard-texts"), Stages(spark, "jaccard-mixed")
    keyed = _keyed(slim, id_col, text, k, percent, heavy, key_stages)
    nodes = _nodes(keyed, node_stages)
    keyed = key_stages.write(keyed.select(id_col, "_content", "n_shingles", "k1", "k2"))
    shared = _shared_tokens(nodes)
    # A node that shares no token is in no pair.
    nodes = node_stages.write(
        nodes.drop("ask", "prefix").join(shared.select("node").distinct(), "node", "left_semi")
    )

    # By id and content, as ids may repeat or be missing.
    texts = slim.select("_id", F.xxhash64(text).alias("_content"), text).join(
        nodes.select("node", "_id", "_content"), ["_id", "_content"]
    )
    texts = text_stages.write(texts.select("node", text))
    # Rows that repeat id and text would come twice.
    texts = texts.dropDuplicates(["node"]) if docs_repeat(texts) else texts

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, texts, text, k, percent)

    found = verified(_plausible(_star(shared, 0, percent), nodes, percent))
    for turn in range(1, ROUNDS + 1):
        _, mixed = _labelled(shared, found)
        mixed = mixed_stages.write(mixed)
        if turn < ROUNDS:
            star = _star(mixed, turn, percent)
            found = found.unionByName(verified(_plausible(star, nodes, percent)))
    found = found.unionByName(verified(_across(mixed, nodes, percent)))
    text_stages.clear()
    mixed_stages.clear()
    parts = connected_components(found)

    # Nodes in components of several; all other documents group by their own key.
    named = parts.join(nodes.select("node", "k1", "k2"), "node").select("k1", "k2", "component")
    least = (
        keyed.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min(id_col).alias("_least"))
        .join(named, ["k1", "k2"], "left")
    )
    whole = least.where("component IS NOT NULL").groupBy("component").agg(
        F.min("_least").alias("_whole"), F.min(F.struct("k1", "k2")).alias("_key")
    )
    least = least.join(whole, "component", "left").select(
        "k1", "k2", F.coalesce("_whole", "_least").alias("_component_id"),
        F.coalesce("_key", F.struct("k1", "k2")).alias("_group"),
    )
    # Documents without words have no key and meet nothing here.
    return keyed.join(least, ["k1", "k2"], "left").select(
        id_col, "n_shingles", F.coalesce("_component_id", id_col).alias("component_id"),
        "_content", "_group",
    )


def docs_repeat(texts: DataFrame) -> bool:
    """Whether a node's text is there more than once."""
    return not texts.groupBy("node").count().where("count > 1").isEmpty()


def one_per_component(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **settings):
    """One row of each component: the one with the least id, rows without id last.

    Rows without words stay, once for each id and text. Components are told apart by their
    sets, so different texts that share an id, or have none, do not replace each other.
    """
    outside = docs.columns
    docs = extras_renamed(docs, id_col, text)
    parts = _components(docs, id_col=id_col, text=text, **settings)
    row = F.struct(F.col(id_col).isNull().alias("_last"), F.col(id_col).alias("_kept"), F.col("_content"))
    chosen = parts.where("_group IS NOT NULL").groupBy("_group").agg(F.min(row).alias("_row"))
    wordless = parts.where("_group IS NULL").select(row.alias("_row")).distinct()
    keep = chosen.select("_row").unionByName(wordless).select("_row._kept", "_row._content")
    marked = docs.withColumn("_text_hash", F.xxhash64(text))
    same = F.col(id_col).eqNullSafe(F.col("_kept")) & (F.col("_text_hash") == F.col("_content"))
    kept = marked.join(keep, same, "left_semi")
    # Rows that repeat id and text come down to one.
    order = Window.partitionBy(id_col, "_text_hash").orderBy(F.lit(0))
    first = kept.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return first.select(*docs.columns).toDF(*outside)


@query(
    r"""
    WITH d AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
            WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')]
            ELSE list_transform(range(1, len(w) - 2), lambda i:
                w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g
        FROM d
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
        FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
    ), e AS (
        SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
        WHERE 100 * shared >= 85 * (x.n + y.n - shared)
    ), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (
        WITH RECURSIVE c(doc_id, root) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT u.b, c.root FROM c JOIN u ON u.a = c.doc_id
        )
        SELECT doc_id, min(root) AS component_id FROM c GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)
    """
)
def op4_ngram_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)

"""Exact top-k search by integer inner product with KD-trees per shard.

Vectors are turned into integers and routed to cells by median splits that are fitted on
a bounded sample; every vector is indexed. A cell falls into blocks of bounded size, and
each block is a shard with a KD-tree: median splits down to small leaves, tight boxes.
A query is searched in its own cell first. Its k-th best score then goes along to all
cells whose box could hold more; there queries go down each tree in batches, first to the
leaf of the best bounds of box and query, then wherever a bound reaches the k-th score.
Bounds are never below a score in the box, ties at the k-th score are followed, so results
are exact.

Of equal vectors only the k + 1 smallest ids are indexed, which is all that a result can
name, so a vector that a large share of the rows has makes no large shard. Rows with a
null id, and vectors that are null or hold a null or non-finite component, take no part;
rows that repeat id and vector count once. Different vectors of one id are all candidates,
and as queries share one ranking; rows of the query's own id are never its results. Vectors
are compared with
those of their own dimension. Scores are exact below 2**53. An empty table gives no rows.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import map_batches, written
from blotter.llm.registry import query, table

K = 20
SCALE = 64
#: Rows the cells' splits are fitted on, at most.
SAMPLE = 4096
#: Rows a cell should have, rows of a block at most (on average), rows of a leaf.
CELL_ROWS, BLOCK_ROWS, LEAF_ROWS = 4096, 8192, 32
#: Cells of one dimension, at most; blocks take up what is beyond.
MAX_LEVELS = 8
#: Queries that go through a tree together, and hits beyond their best that they keep.
QUERY_ROWS, HITS_AT_ONCE = 1024, 1 << 16


def quantised(rows: DataFrame, *, id_col: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): one row per id and vector, components floor(scale * x) as long."""
    whole = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    some = rows.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).where(whole)
    return some.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).distinct()


def median_splits(points: np.ndarray, levels: int) -> list[tuple[int, int, float]]:
    """(node, dimension, median) of a tree in heap order; rows above the median go right."""
    splits, todo = [], [(1, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if node >= 1 << levels or len(rows) < 2:
            continue
        part = points[rows]
        dim = int(np.argmax(part.max(0) - part.min(0)))
        cut = float(np.median(part[:, dim]))
        right = part[:, dim] > cut
        if right.any():
            splits.append((node, dim, cut))
            todo += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]
    return splits


def cell_of(points: np.ndarray, splits: list[tuple[int, int, float]]) -> np.ndarray:
    """The node of the split tree at which each point ends."""
    at = np.ones(len(points), np.int64)
    for node, dim, cut in sorted(splits):
        here = at == node
        at[here] = 2 * node + (points[here, dim] > cut)
    return at


def build_tree(ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> bytes:
    """A KD-tree in one binary: rows in leaf order, nodes with children, rows and boxes."""
    order = np.arange(len(ids))
    nodes: list[tuple[int, int, int, int]] = []
    lows, highs = [], []

    def add(start: int, end: int) -> int:
        me = len(nodes)
        part = points[order[start:end]]
        low, high = part.min(0), part.max(0)
        nodes.append((-1, -1, start, end))
        lows.append(low)
        highs.append(high)
        if end - start > leaf_rows and (high > low).any():
            dim = int(np.argmax(high - low))
            middle = (end - start) // 2
            inner = np.argpartition(part[:, dim], middle)
            order[start:end] = order[start:end][inner]
            nodes[me] = (add(start, start + middle), add(start + middle, end), start, end)
        return me

    if points.shape[1]:
        add(0, len(ids))
    else:
        nodes, lows, highs = [(-1, -1, 0, len(ids))], [points[0]], [points[0]]
    out = io.BytesIO()
    np.savez(
        out, ids=ids[order], points=points[order], nodes=np.array(nodes),
        low=np.array(lows), high=np.array(highs),
    )
    return out.getvalue()


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Highest inner product that each query can have with a point of each box."""
    q = queries.astype(np.float64)
    return np.maximum(q, 0) @ high.astype(np.float64).T + np.minimum(q, 0) @ low.astype(np.float64).T


class _Best:
    """Hits of a batch of queries, of which the k best of each query are kept."""

    def __init__(self, kth: np.ndarray, k: int) -> None:
        self.least, self.k = np.array(kth, np.float64), k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, 4 * k * len(kth) + HITS_AT_ONCE

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((at, ids, scores))
        self.size += len(at)
        if self.size > self.most:
            self.tighten()

    def tighten(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Drop what k other hits of its query beat; each query's k-th score is its least one."""
        at, ids, scores = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else [
            np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        ]
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        last = rank == self.k - 1
        self.least[at[last]] = np.maximum(self.least[at[last]], scores[last])
        kept = rank < self.k
        self.parts = [(at[kept], ids[kept], scores[kept])]
        self.size = int(kept.sum())
        return self.parts[0]


def search_tree(
    tree: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int
) -> list[tuple[int, int, int]]:
    """(query, id, score) of up to k rows per query that can be among its best.

    `kth` is a score that k other rows reach already, or -inf. The queries go down the tree
    together: each first to the leaf of the best bounds, then to all nodes whose bound reaches
    its k-th score, and the queries that meet in a leaf are scored by one matrix product.
    """
    limit = bounds(queries, tree["low"], tree["high"])
    points, q = tree["points"].astype(np.float64), queries.astype(np.float64)
    left, right, start, end = tree["nodes"].T
    best = _Best(kth, k)

    def score(node: int, at: np.ndarray) -> None:
        rows = slice(int(start[node]), int(end[node]))
        scores, others = q[at] @ points[rows].T, tree["ids"][rows]
        hits = (scores >= best.least[at][:, None]) & (others[None, :] != ids[at][:, None])
        i, j = np.nonzero(hits)
        best.add(at[i], others[j], scores[i, j])

    everyone = np.flatnonzero(limit[:, 0] >= best.least)
    first = np.full(len(ids), -1)
    first[everyone] = 0
    while len(inner := everyone[left[first[everyone]] >= 0]):
        one, other = left[first[inner]], right[first[inner]]
        first[inner] = np.where(limit[inner, other] > limit[inner, one], other, one)
    order = everyone[np.argsort(first[everyone], kind="stable")]
    for at in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
        if len(at):
            score(int(first[at[0]]), at)
    best.tighten()
    todo = [(0, everyone)]
    while todo:
        node, at = todo.pop()
        at = at[limit[at, node] >= best.least[at]]
        if left[node] >= 0:
            if len(at):
                todo += [(int(right[node]), at), (int(left[node]), at)]
        elif len(at := at[first[at] != node]):
            score(node, at)
    at, others, scores = best.tighten()
    return list(zip(ids[at].tolist(), others.tolist(), scores.astype(np.int64).tolist()))


def _array(blobs, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), dims)


def _searched(trees: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Search every query of `asked` (cell, query_id, v, kth) in all trees of its cell."""
    sizes = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("_parts"))
    dealt = asked.join(sizes, "cell").withColumn(
        "_part", F.pmod(F.xxhash64("query_id"), F.col("_parts"))
    )

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "cell": [part["cell"].iloc[0]],
                "query_ids": [part["query_id"].to_numpy("<i8").tobytes()],
                "vectors": [b"".join(part["v"])],
                "kths": [part["kth"].to_numpy("<f8").tobytes()],
            }
        )

    blocks = dealt.select("cell", "_part", "query_id", "v", "kth").groupBy("cell", "_part")
    blocks = blocks.applyInPandas(packed, "cell long, query_ids binary, vectors binary, kths binary")

    def make():
        def each(blobs, ids, vectors, kths):
            for blob, i, v, kth in zip(blobs, ids, vectors, kths):
                with np.load(io.BytesIO(blob)) as file:
                    tree = dict(file)
                who = np.frombuffer(i, "<i8")
                asked_for = np.frombuffer(v, "<i8").reshape(len(who), tree["points"].shape[1])
                yield from search_tree(tree, who, asked_for, np.frombuffer(kth, "<f8"), k)

        return each

    pairs = trees.join(blocks, "cell").select("tree", "query_ids", "vectors", "kths")
    return map_batches(pairs, make, "query_id long, vec_id long, score long")


def top_k(
    rows: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", k: int = K,
    scale: int = SCALE, is_query=None,
) -> DataFrame:
    """(query_id, rank, vec_id, score); `is_query` is a condition on `vec_id`."""
    condition = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    ints = written(quantised(rows, id_col=id_col, vector=vector, scale=scale), "search-vectors")
    total = ints.count()
    sample = ints.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    levels = min(MAX_LEVELS, max(0, math.ceil(math.log2(max(1, total) / CELL_ROWS))))
    splits = {}
    for dims in {len(r.v) for r in sample}:
        points = np.array([r.v for r in sample if len(r.v) == dims], np.int64)
        splits[dims] = median_splits(points, levels) if dims else []

    def make():
        def each(ids, vectors):
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(i)
            for dims, at in by_size.items():
                points = np.array([vectors[i] for i in at], "<i8").reshape(len(at), dims)
                cells = cell_of(points, splits.get(dims, [])) + (dims << MAX_LEVELS + 1)
                for i, cell, point in zip(at, cells.tolist(), points):
                    yield cell, dims, ids[i], point.tobytes()

        return each

    routed = written(
        map_batches(ints, make, "cell long, dims int, vec_id long, v binary"), "search-cells"
    )
    same = Window.partitionBy("cell", "v").orderBy("vec_id")
    kept = routed.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1)
    kept = written(kept.drop("_n"), "search-distinct")
    # At most 2 ** MAX_LEVELS cells of each dimension.
    sizes = F.broadcast(
        kept.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_blocks"))
    )
    dealt = kept.join(sizes, "cell").withColumn(
        "_block", F.pmod(F.xxhash64("vec_id"), F.col("_blocks"))
    )

    def planted(part: pd.DataFrame) -> pd.DataFrame:
        points = _array(list(part["v"]), int(part["dims"].iloc[0]))
        return pd.DataFrame(
            {
                "cell": [part["cell"].iloc[0]],
                "tree": [build_tree(part["vec_id"].to_numpy("<i8"), points)],
                "low": [points.min(0).tolist()],
                "high": [points.max(0).tolist()],
            }
        )

    trees = written(
        dealt.groupBy("cell", "_block").applyInPandas(
            planted, "cell long, tree binary, low array<long>, high array<long>"
        ),
        "search-trees",
    )
    queries = routed.where(condition).select(
        "cell", F.col("vec_id").alias("query_id"), "v", F.lit(float("-inf")).alias("kth")
    )
    home = written(_searched(trees.select("cell", "tree"), queries, k), "search-home")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kths = (
        home.withColumn("_n", F.row_number().over(best))
        .where(F.col("_n") == k)
        .select("query_id", F.col("score").cast("double").alias("_kth"))
    )
    # One box per cell, over all its blocks: at most 2 ** MAX_LEVELS of each dimension.
    sides = trees.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("_at", "_side"))
    sides = sides.groupBy("cell", "_at").agg(
        F.min("_side.low").alias("low"), F.max("_side.high").alias("high")
    )
    side = F.sort_array(F.collect_list(F.struct("_at", "low", "high")))
    boxes: dict[int, list[tuple[int, list, list]]] = {}
    for cell, box in sides.groupBy("cell").agg(side).collect():
        boxes.setdefault(len(box), []).append((cell, [b[1] for b in box], [b[2] for b in box]))

    def spread():
        sides = {
            dims: tuple(np.array(x) for x in zip(*others)) for dims, others in boxes.items()
        }

        def each(cells, ids, vectors, least):
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v) // 8, []).append(i)
            for dims, at in by_size.items():
                if dims not in sides:
                    continue
                names, low, high = sides[dims]
                limit = bounds(_array([vectors[i] for i in at], dims), low, high)
                reached = limit >= np.array([least[i] for i in at])[:, None]
                reached &= names != np.array([cells[i] for i in at])[:, None]
                for i, j in zip(*(x.tolist() for x in np.nonzero(reached))):
                    yield int(names[j]), ids[at[i]], vectors[at[i]], least[at[i]]

        return each

    far = queries.drop("kth").join(kths, "query_id", "left").select(
        "cell", "query_id", "v", F.coalesce("_kth", F.lit(float("-inf"))).alias("kth")
    )
    far = map_batches(far, spread, "cell long, query_id long, v binary, kth double")
    found = home.unionByName(_searched(trees.select("cell", "tree"), far, k))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


@query(
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding,
            lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 20 = 0
    ), r AS (
        SELECT query_id, vec_id, score, row_number() OVER (
            PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
        FROM s
    )
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
    """
)
def op5_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))

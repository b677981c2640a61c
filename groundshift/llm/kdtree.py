"""Exact top-k by inner product with one KD-tree per shard (operator 6)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundshift.llm.tables import stored

# Rows of a shard and queries that go through it in one task, at least and at most: small tables spread, large ones copy less.
SHARD_ROWS = (4096, 65_536)
QUERY_BLOCK = (512, 16_384)
SPREAD = 64
LEAF_ROWS = 256
EXACT = float(1 << 53)


class Tree:
    """A KD-tree over integer vectors: median splits on the widest side, tight boxes on every node."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.rows, self.ids, self.keys = rows, ids, keys
        lows, highs, self.children, self.leaves = [], [], [], []
        todo = [(np.arange(len(rows)), -1, 0)]
        while todo:
            members, parent, side = todo.pop()
            node, part = len(lows), rows[members]
            low, high = part.min(axis=0), part.max(axis=0)
            lows.append(low)
            highs.append(high)
            self.children.append([-1, -1])
            self.leaves.append(None)
            if parent >= 0:
                self.children[parent][side] = node
            if len(members) <= leaf_rows:
                self.leaves[node] = members
                continue
            axis = int(np.argmax(high - low)) if rows.shape[1] else 0
            order = np.argpartition(part[:, axis], len(members) // 2) if rows.shape[1] else np.arange(len(members))
            half = len(members) // 2
            todo += [(members[order[:half]], node, 0), (members[order[half:]], node, 1)]
        self.low, self.high = np.array(lows), np.array(highs)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each query can have with a point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bound: np.ndarray, key: int, k: int, least: float):
        """The best k of this tree with a score of at least `least`, best-first; `key` is the query's own row."""
        ids, scores = np.empty(0, np.int64), np.empty(0, self.rows.dtype)
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < least:
                break
            members = self.leaves[node]
            if members is None:
                for child in self.children[node]:
                    if bound[child] >= least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            found = self.rows[members] @ query
            take = (found >= least) & (self.keys[members] != key)
            if take.any():
                ids, scores = np.concatenate([ids, self.ids[members[take]]]), np.concatenate([scores, found[take]])
                if len(ids) > k:
                    order = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[order], scores[order]
                if len(ids) == k:
                    least = max(least, scores.min())
        return ids, scores


def _matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Floats while every sum is exact in them, Python integers beyond."""
    rows = np.array(vectors, dtype=np.float64).reshape(len(vectors), -1)
    peak = np.abs(rows).max(initial=0.0)
    if rows.shape[1] * peak * peak < EXACT / 4:
        return rows
    return np.array([[int(x) for x in row] for row in rows], dtype=object)


def _searcher(k: int, leaf_rows: int):
    out_schema = pa.schema([("query_key", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, trees, vectors, ids, keys = None, None, [], [], []
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            values = cols["vector"]
            flat = np.asarray(values.flatten(), dtype=np.float64)
            sizes = np.asarray(pa.compute.list_value_length(values))
            ends = np.cumsum(sizes)
            deals, is_query = cols["deal"].to_numpy(), np.asarray(cols["is_query"].to_pylist(), dtype=bool)
            id_, key, least = cols["id"].to_numpy(), cols["key"].to_numpy(), cols["least"].to_pylist()
            result: tuple[list, list, list, list] = ([], [], [], [])
            asked: dict[int, list[int]] = {}

            def answer() -> None:
                for dim, rows in asked.items():
                    tree = trees.get(dim)
                    if tree is None:
                        continue
                    queries = _matrix([flat[ends[i] - sizes[i]: ends[i]] for i in rows])
                    wide = queries.dtype == object or tree.rows.dtype == object
                    if wide or dim * np.abs(queries).max(initial=0.0) * np.abs(tree.rows).max(initial=0.0) >= EXACT / 4:
                        queries, tree = _as_integers(queries), _integer_tree(trees, dim)
                    bounds = tree.bounds(queries)
                    for n, i in enumerate(rows):
                        found, scores = tree.search(
                            queries[n], bounds[n], key[i], k, -math.inf if least[i] is None else least[i]
                        )
                        result[0].extend([key[i]] * len(found))
                        result[1].extend([id_[i]] * len(found))
                        result[2].extend(found.tolist())
                        result[3].extend(_as_long(s) for s in scores)
                asked.clear()

            for i in range(len(batch)):
                if deals[i] != deal:
                    if trees is not None:
                        answer()
                    deal, trees, vectors, ids, keys = deals[i], None, [], [], []
                if not is_query[i]:
                    vectors.append(flat[ends[i] - sizes[i]: ends[i]].copy())
                    ids.append(id_[i])
                    keys.append(key[i])
                    continue
                if trees is None:
                    trees = _trees(vectors, ids, keys, leaf_rows)
                    vectors, ids, keys = [], [], []
                asked.setdefault(int(sizes[i]), []).append(i)
            if trees is not None:
                answer()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in result], schema=out_schema)

    return run


def _as_integers(rows: np.ndarray) -> np.ndarray:
    return rows if rows.dtype == object else np.array([[int(x) for x in row] for row in rows], dtype=object).reshape(rows.shape)


def _integer_tree(trees: dict, dim: int) -> Tree:
    """The tree over Python integers, for components so large that float sums are inexact."""
    tree = trees[dim]
    if tree.rows.dtype != object:
        tree.rows, tree.low, tree.high = (_as_integers(x) for x in (tree.rows, tree.low, tree.high))
    return tree


def _as_long(score) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


def _trees(vectors: list, ids: list, keys: list, leaf_rows: int) -> dict[int, Tree]:
    """One tree per dimension, so only vectors of equal length meet."""
    by_dim: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by_dim.setdefault(len(v), []).append(i)
    return {
        dim: Tree(_matrix([vectors[i] for i in rows]), np.array([ids[i] for i in rows]), np.array([keys[i] for i in rows]), leaf_rows)
        for dim, rows in by_dim.items()
    }


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """`key, id, vector`, stored: floor(scale * x) of every component; rows without an id, vector or finite components go.

    Keys number the rows; they are written with them, as numbers computed again in a later job may differ.
    """
    as_double = F.transform("embedding", lambda x: x.cast("double"))
    usable = embeddings.select(
        F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("id"), as_double.alias("x")
    ).filter(
        F.col("id").isNotNull() & F.col("x").isNotNull()
        & F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    )
    # floor() of a double is a long and stops at its range; components beyond 2**53 lose nothing that a double holds.
    return stored(usable.select("key", "id", F.transform("x", lambda v: F.floor(v * scale).cast("double")).alias("vector")), "quantised")


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int | None = None, leaf_rows: int = LEAF_ROWS,
    query_block: int | None = None,
) -> DataFrame:
    """Each query's k highest inner products: `query_id, rank, vec_id, score`, ties to the smaller id.

    `vectors` and `queries` have key (unique per row and the same whenever the table is read), id and vector; a query never meets the row with its own key.
    Rows are dealt at random, but by a fixed hash, into shards of about `shard_rows`, queries into blocks of about `query_block` (by
    default a 64th of the rows, within bounds). A task reads a shard's vectors, builds its tree and then streams one block of queries
    through it. Queries are first answered in one shard; its k-th score goes with them to all other shards as the bound
    below which boxes are not opened. What a shard emits per query is at
    most k rows. An exact search compares queries with candidates by definition, so work grows with their product.

    Scores beyond the range of long stop at its ends. Vectors of another length than the query's take no part. Fewer than k candidates give fewer rows, empty tables none.
    """
    def parts(rows: int, size: int | None, bounds: tuple[int, int]) -> int:
        return max(1, math.ceil(rows / (size or min(max(rows // SPREAD, bounds[0]), bounds[1]))))

    n_shards = parts(vectors.count(), shard_rows, SHARD_ROWS)
    n_blocks = parts(queries.count(), query_block, QUERY_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    search = _searcher(k, leaf_rows)
    schema = "query_key long, query_id long, vec_id long, score long"
    columns = [(F.col("block").cast("long") * n_shards + F.col("shard")).alias("deal"), "is_query", "id", "key", "least", "vector"]
    dealt = vectors.withColumns({
        "shard": F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int"), "is_query": F.lit(False), "least": F.lit(None).cast("long"),
    }).withColumn("block", every(n_blocks)).select(*columns)

    def ask(asked: DataFrame) -> DataFrame:
        both = dealt.unionByName(asked.withColumn("is_query", F.lit(True)).select(*columns))
        return both.repartition("deal").sortWithinPartitions("deal", "is_query").mapInArrow(search, schema)

    placed = queries.withColumns({
        "block": F.pmod(F.xxhash64("key", F.lit(2)), F.lit(n_blocks)).cast("int"),
        "home": F.pmod(F.xxhash64("key", F.lit(1)), F.lit(n_shards)).cast("int"),
    })
    first = stored(ask(placed.withColumns({"shard": F.col("home"), "least": F.lit(None).cast("long")})), "topk")
    found = first
    if n_shards > 1:
        kth = first.groupBy(F.col("query_key").alias("key")).agg(
            F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least")
        )
        rest = placed.join(kth, "key", "left").withColumn("shard", every(n_shards)).filter("shard <> home")
        found = first.unionByName(ask(rest))
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Hard negatives by best-first search in STR-packed R-trees (operator 11)."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from operator import neg

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundshift.llm.tables import release_worker_state, stored

# Rows of a shard and queries that go through it in one task, at least and at most: small tables spread, large ones copy less.
SHARD_ROWS = (4096, 65_536)
QUERY_BLOCK = (1024, 16_384)
SPREAD = 64
LEAF_ROWS = 128
FANOUT = 8
EXACT = float(1 << 53)


def packed_order(rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> np.ndarray:
    """Sort-tile-recursive order: slabs along the widest side, each tiled along its own next side, down to leaves."""

    def tile(members: np.ndarray, sides_left: int) -> Iterator[np.ndarray]:
        leaves = math.ceil(len(members) / leaf_rows)
        part = rows[members]
        spread = part.max(axis=0) - part.min(axis=0) if len(members) else np.zeros(1)
        ordered = members[np.argsort(part[:, int(np.argmax(spread))], kind="stable")] if rows.shape[1] else members
        if leaves <= 1 or sides_left <= 1:
            yield ordered
            return
        # As many slabs as leave the same number of cuts for every remaining side.
        slabs = max(2, math.ceil(leaves ** (1 / sides_left)))
        width = math.ceil(leaves / slabs) * leaf_rows
        for lo in range(0, len(ordered), width):
            yield from tile(ordered[lo:lo + width], sides_left - 1)

    sides = max(1, min(rows.shape[1], math.ceil(math.log2(max(2, len(rows) / leaf_rows)))))
    return np.concatenate(list(tile(np.arange(len(rows)), sides))) if len(rows) else np.empty(0, np.int64)


class RTree:
    """Rows in packed order, leaves of `leaf_rows`, and levels of `FANOUT` boxes up to one root; every box is tight."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = packed_order(rows, leaf_rows)
        self.rows, self.ids, self.keys = rows[order], ids[order], keys[order]
        starts = np.arange(0, len(rows), leaf_rows)
        self.spans = [(int(s), int(min(s + leaf_rows, len(rows)))) for s in starts]
        low, high = np.minimum.reduceat(self.rows, starts, axis=0), np.maximum.reduceat(self.rows, starts, axis=0)
        lows, highs, self.children = [low], [high], [None] * len(starts)
        first, count = 0, len(starts)
        while count > 1:
            cuts = np.arange(0, count, FANOUT)
            self.children += [range(first + c, first + min(c + FANOUT, count)) for c in cuts.tolist()]
            low, high = np.minimum.reduceat(low, cuts, axis=0), np.maximum.reduceat(high, cuts, axis=0)
            lows.append(low)
            highs.append(high)
            first, count = first + count, len(cuts)
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)
        self.root = len(self.children) - 1

    def intervals(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of the query with any point of each box, added up coordinate by coordinate."""
        return _intervals(self.low, self.high, query)


def _intervals(low: np.ndarray, high: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.maximum(query, 0), np.minimum(query, 0)
    return low @ up + high @ down, high @ up + low @ down


class Wanted:
    """The best `k` rows with scores in [least, most], where scores below `floor` are of no use."""

    def __init__(self, k: int, least, most, floor=-math.inf):
        self.k, self.least, self.most = k, max(least, floor), most
        self.best: list[tuple] = []

    @property
    def ids(self) -> np.ndarray:
        return np.array([i for _, i in self.best], np.int64)

    @property
    def scores(self) -> np.ndarray:
        return np.array([-s for s, _ in self.best])

    def offer(self, ids: list[int], scores: list) -> None:
        """Take what is wanted of rows given by descending score, ties by id; a tie with the k-th counts by its id."""
        first = bisect_left(scores, -self.most, key=neg)
        better = [(-s, i) for s, i in zip(scores[first:first + self.k], ids[first:first + self.k], strict=True) if s >= self.least]
        if better:
            self.best = sorted(self.best + better)[: self.k]
            if len(self.best) == self.k:
                self.least = max(self.least, -self.best[-1][0])


def search(trees: list[RTree], query: np.ndarray, key: int, wanted: list[Wanted], bounds: list | None = None) -> None:
    """Best-first over the boxes of several trees for one query; `key` is the query's own row, which is no answer.

    The best leaf is scored first, then the best two, four and so on together, so that few calls score them and the bounds that
    the first ones give hold for the many; at most twice the leaves of a search one by one are scored. `bounds` are the trees' intervals.
    """
    bounds = bounds or [tuple(b.tolist() for b in tree.intervals(query)) for tree in trees]
    queue = [(-high[tree.root], t, tree.root) for t, (tree, (_, high)) in enumerate(zip(trees, bounds, strict=True))]
    heapq.heapify(queue)
    width = 1
    while queue:
        # A box that no window reaches holds no wanted row; a tie with the k-th may be one.
        least, most = min(w.least for w in wanted), max(w.most for w in wanted)
        leaves: list[tuple[RTree, slice]] = []
        while queue and len(leaves) < width:
            top, t, node = heapq.heappop(queue)
            low, high = bounds[t]
            if -top < least:
                queue.clear()
            elif low[node] <= most:
                children = trees[t].children[node]
                if children is None:
                    leaves.append((trees[t], slice(*trees[t].spans[node])))
                else:
                    for child in children:
                        if high[child] >= least and low[child] <= most:
                            heapq.heappush(queue, (-high[child], t, child))
        width *= 2
        if not leaves:
            continue
        scores = np.concatenate([tree.rows[span] @ query for tree, span in leaves])
        keys = np.concatenate([tree.keys[span] for tree, span in leaves])
        use = np.flatnonzero((scores >= least) & (scores <= most) & (keys != key))
        if len(use):
            ids, scores = np.concatenate([tree.ids[span] for tree, span in leaves])[use], scores[use]
            order = np.lexsort((ids, -scores))
            ids, scores = ids[order].tolist(), scores[order].tolist()
            for w in wanted:
                w.offer(ids, scores)


RESULT = pa.schema([
    ("query", pa.int64()), ("query_id", pa.int64()), ("slot", pa.int32()), ("found", pa.int64()), ("score", pa.int64()),
    ("positive", pa.int64()), ("positive_score", pa.int64()),
])


def _searcher(same_label: bool, k: int, leaf_rows: int) -> Callable:
    """mapInArrow over rows sorted by deal, vectors first: searches each query in the trees of the vectors of its deal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        deal, trees, held = None, None, []
        for batch in batches:
            names = batch.schema.names
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(names) if n != "vector"}
            values = batch.column(names.index("vector"))
            flat = np.asarray(values.flatten(), dtype=np.float64)
            ends = np.cumsum(np.asarray(pa.compute.list_value_length(values), dtype=np.int64))
            starts = np.concatenate([[0], ends[:-1]])
            out: list[tuple] = []
            for i in range(len(batch)):
                if cols["deal"][i] != deal:
                    deal, trees, held = cols["deal"][i], None, []
                vector, label = flat[starts[i]:ends[i]], cols["label"][i]
                if cols["windows"][i] is None:
                    held.append((len(vector), label, cols["id"][i], cols["key"][i], vector.copy()))
                    continue
                if trees is None:
                    trees, held = _forest(held, leaf_rows), []
                grove = trees.get(len(vector))
                chosen = grove.chosen(label, same_label) if grove else []
                query = vector
                if chosen and len(vector) * np.abs(vector).max(initial=0.0) * max(grove.trees[n].peak for n in chosen) >= EXACT / 4:
                    query = np.array([int(x) for x in vector], dtype=object)
                wanted = [
                    Wanted(k, -math.inf if w["least"] is None else w["least"], math.inf if w["most"] is None else w["most"],
                           -math.inf if w["floor"] is None else w["floor"])
                    for w in cols["windows"][i]
                ]
                if wanted and chosen:
                    bounds = grove.bounds(query, chosen)
                    search([grove.trees[n].over(query) for n in chosen], query, cols["key"][i], wanted, bounds)
                for w, window in zip(wanted, cols["windows"][i], strict=True):
                    out.extend(
                        (cols["key"][i], cols["id"][i], window["slot"], f, _long(-s), window["positive"], window["score"])
                        for s, f in w.best
                    )
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(RESULT)], schema=RESULT)

    return run


class _Tree(RTree):
    """A tree whose numbers become Python integers for queries that need them."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, leaf_rows: int):
        super().__init__(rows, ids, keys, leaf_rows)
        self.peak = float(np.abs(rows).max(initial=0.0))

    def over(self, query: np.ndarray) -> _Tree:
        if query.dtype == object and self.rows.dtype != object:
            self.rows, self.low, self.high = (np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object) for x in (
                self.rows, self.low, self.high))
        return self


class _Grove:
    """The trees of the vectors of one length, one a label, with all their boxes in one table."""

    def __init__(self, trees: dict[int, _Tree]):
        self.labels, self.trees = list(trees), list(trees.values())
        self.low, self.high = (np.concatenate([getattr(t, side) for t in self.trees]) for side in ("low", "high"))
        self.ends = np.cumsum([len(t.children) for t in self.trees]).tolist()

    def chosen(self, label: int, same_label: bool) -> list[int]:
        return [n for n, other in enumerate(self.labels) if (other == label) == same_label]

    def bounds(self, query: np.ndarray, chosen: list[int]) -> list[tuple[list, list]] | None:
        """The intervals of the chosen trees from one pass over all boxes; None for queries of Python integers."""
        if query.dtype == object:
            return None
        low, high = (b.tolist() for b in _intervals(self.low, self.high, query))
        spans = [slice(self.ends[n] - len(self.trees[n].children), self.ends[n]) for n in chosen]
        return [(low[span], high[span]) for span in spans]


def _forest(held: list[tuple], leaf_rows: int) -> dict[int, _Grove]:
    """One tree for every (vector length, label) of a shard, by length."""
    members: dict[int, dict[int, list]] = {}
    for size, label, *row in held:
        members.setdefault(size, {}).setdefault(label, []).append(row)
    return {
        size: _Grove({
            label: _Tree(
                np.array([v for *_, v in rows], np.float64).reshape(len(rows), size), np.array([r[0] for r in rows], np.int64),
                np.array([r[1] for r in rows], np.int64), leaf_rows,
            )
            for label, rows in by_label.items()
        })
        for size, by_label in members.items()
    }


def _long(score) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


WINDOWS = "array<struct<slot: int, positive: long, score: long, least: long, most: long, floor: long>>"


def search_shards(
    vectors: DataFrame, queries: DataFrame, same_label: bool, k: int, shard_rows: int | None = None, leaf_rows: int = LEAF_ROWS,
    query_block: int | None = None,
) -> DataFrame:
    """The best k rows for every window of every query: `query, query_id, slot, found, score, positive, positive_score, rank`.

    `vectors` has key, id, label, vector; `queries` the same and `windows`, each with its bounds on the score. Rows of the query's
    label, or of other labels, are searched. Vectors are dealt by a hash of their key into shards of about `shard_rows`, queries into
    blocks of about `query_block` (by default a 64th of the rows, within bounds), and a task searches one block in one shard. Each query first visits one shard; the k-th score that
    it finds there goes with it to all others as the floor of the window.
    """
    def parts(rows: int, size: int | None, bounds: tuple[int, int]) -> int:
        return max(1, math.ceil(rows / (size or min(max(rows // SPREAD, bounds[0]), bounds[1]))))

    n_shards = parts(vectors.count(), shard_rows, SHARD_ROWS)
    n_blocks = parts(queries.count(), query_block, QUERY_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = F.xxhash64("shard", "block").alias("deal")
    columns = [deal, "key", "id", "label", "vector"]
    own_shard = F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int")
    dealt = vectors.select("*", own_shard.alias("shard"), every(n_blocks).alias("block")).select(
        *columns, F.lit(None).cast(WINDOWS).alias("windows")
    )
    run = _searcher(same_label, k, leaf_rows)
    schema = "query long, query_id long, slot int, found long, score long, positive long, positive_score long"

    def ask(asked: DataFrame) -> DataFrame:
        both = dealt.unionByName(asked.select(*columns, "windows"))
        return both.repartition("deal").sortWithinPartitions("deal", F.col("windows").isNotNull()).mapInArrow(run, schema)

    block = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(n_blocks)).cast("int")
    home = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(n_shards)).cast("int")
    placed = queries.select("*", block.alias("block"), home.alias("home"))
    found = stored(ask(placed.withColumn("shard", F.col("home"))), "home-shard")
    if n_shards > 1:
        kth = found.groupBy("query", "slot").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        floors = kth.groupBy(F.col("query").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "floor"))).alias("floors"))
        raised = F.transform("windows", lambda w: w.withField("floor", F.try_element_at("floors", w["slot"])))
        others = placed.join(floors, "key", "left").withColumn("windows", raised).withColumn("shard", every(n_shards)).filter("shard <> home")
        found = found.unionByName(ask(others))
    best = Window.partitionBy("query", "slot").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def labelled_vectors(embeddings: DataFrame, scale: int = 256, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """`key, id, label, vector`, stored: floor(scale * x) of every component; every `shift_every`-th id takes the next label.

    Rows with a null id, label or vector, or with a null or non-finite component, go. Keys number the rows of the stored table.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.alias("x")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull()
        & F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    )
    label = F.when(F.col("id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return stored(
        usable.select(
            F.monotonically_increasing_id().alias("key"), "id", label.alias("label"),
            F.transform("x", lambda v: F.floor(v * scale).cast("double")).alias("vector"),
        ),
        "vectors",
    )


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, lowest: int = 50, highest: int = 95,
    shard_rows: int | None = None, leaf_rows: int = LEAF_ROWS, query_block: int | None = None,
) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score` for every anchor and positive.

    `vectors` and `anchors` have key (unique, and the same whenever the table is read), id, label and vector. An anchor's positives are
    the `positives` best other rows of its label by inner product, ties to the smaller id; for each the `negatives` best rows of
    other labels whose score lies between `lowest` and `highest` per cent of the positive's. Every shard packs one R-tree a
    label by sort-tile-recursive; a best-first queue opens boxes whose interval of inner products meets a window and reaches the
    k-th score so far. In many dimensions boxes overlap and little is pruned; the result is exact either way.

    Fewer candidates give fewer rows; a positive with a negative score has an empty window. Rows with the id of the anchor but another key
    are other rows. Vectors of another length than the anchor's take no part. Scores beyond long stop at its ends. Empty tables give no rows.
    """
    none = F.lit(None).cast("long")
    everything = F.array(F.struct(
        F.lit(0).alias("slot"), none.alias("positive"), none.alias("score"), none.alias("least"), none.alias("most"), none.alias("floor")
    )).cast(WINDOWS)
    sizes = (shard_rows, leaf_rows, query_block)
    chosen = search_shards(vectors, anchors.withColumn("windows", everything), True, positives, *sizes)
    # 100 negative >= lowest * positive and 100 negative <= highest * positive, in whole numbers.
    percent = lambda to, share: F.expr(f"cast({to}(cast({share} as decimal(5, 0)) * cast(score as decimal(19, 0)) / 100BD) as long)")
    window = F.struct(
        F.col("rank").alias("slot"), F.col("found").alias("positive"), F.col("score").alias("score"),
        percent("ceil", lowest).alias("least"), percent("floor", highest).alias("most"), none.alias("floor"),
    )
    windows = chosen.groupBy(F.col("query").alias("key")).agg(F.collect_list(window).cast(WINDOWS).alias("windows"))
    asked = stored(anchors.join(windows, "key"), "windows")
    mined = search_shards(vectors, asked, False, negatives, *sizes)
    return mined.select(
        F.col("query_id").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )

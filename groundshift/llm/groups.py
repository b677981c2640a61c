"""Links inside groups of any size, without listing pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundshift.llm.tables import small_side, stored

EDGE = "a string, b string"
# Rows that one task compares at once; larger groups are cut into blocks.
BLOCK_ROWS = 1024
HUBS = 16


class Forest:
    """Union-find over the rows of one task."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def spanning(nodes: list[str], rows: list, prepare: Callable, linked: Callable, left: list[bool] | None = None):
    """Edges that join the linked rows of one group: at most one less than its rows.

    `linked(features, i, js)` says which of the rows js are linked to row i. Pairs already joined are not compared; with
    `left`, only pairs with at least one left row are.
    """
    features, forest = prepare(rows), Forest(len(rows))
    index = np.arange(len(rows))
    side = np.ones(len(rows), bool) if left is None else np.array(left)
    for i in np.flatnonzero(side).tolist():
        roots = forest.roots()
        others = index[(roots != roots[i]) & ((index > i) | ~side)]
        if not len(others):
            continue
        for j in others[linked(features, i, others)].tolist():
            if forest.join(i, j):
                yield nodes[i], nodes[j]


def _per_group(prepare: Callable, linked: Callable):
    """mapInArrow over rows sorted by `group`: node, payload, left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, rows, left = None, [], [], []

        def close(out: list) -> None:
            if len(nodes) > 1:
                out.extend(spanning(nodes, rows, prepare, linked, left))

        for batch in batches:
            out: list[tuple[str, str]] = []
            for g, node, payload, is_left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    close(out)
                    group, nodes, rows, left = g, [], [], []
                nodes.append(node)
                rows.append(payload)
                left.append(is_left)
            yield _edges(out)
        out = []
        close(out)
        yield _edges(out)

    return run


def _edges(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["a", "b"])


def _to_hubs(prepare: Callable, linked: Callable, rows_at_once: int):
    """mapInArrow over rows sorted by `deal`, hubs first: group, deal, node, payload, is_hub.

    Gives (group, node, hub, pair): once a row the first hub that it is linked to, null if there is none; and with `pair`
    set the hubs that are linked to one row or to each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, hubs, hub_rows = None, [], []
        waiting: list[tuple] = []
        pairs: set[tuple] = set()

        def judge(out: list) -> None:
            if waiting:
                features = prepare([*hub_rows, *(payload for _, _, payload in waiting)])
                index = np.arange(len(hubs))
                for n, (group, node, _) in enumerate(waiting):
                    met = [hubs[h] for h in index[linked(features, len(hubs) + n, index)].tolist()] if len(hubs) else []
                    out.append((group, node, met[0] if met else None, False))
                    pairs.update((group, h, met[0], True) for h in met[1:])
                    if met and node in hubs and node != met[0]:
                        pairs.add((group, node, met[0], True))
                waiting.clear()

        for batch in batches:
            out: list[tuple] = []
            for group, d, node, payload, is_hub in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if d != deal:
                    judge(out)
                    out += sorted(pairs)
                    pairs.clear()
                    deal, hubs, hub_rows = d, [], []
                if is_hub:
                    hubs.append(node)
                    hub_rows.append(payload)
                else:
                    waiting.append((group, node, payload))
                    if len(waiting) >= rows_at_once:
                        judge(out)
            judge(out)
            yield _rows(out, batch.schema.field("group").type)
        if deal is not None:
            yield _rows(sorted(pairs), batch.schema.field("group").type)

    return run


def _rows(rows: list[tuple], group_type: pa.DataType) -> pa.RecordBatch:
    types = (group_type, pa.string(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["group", "node", "hub", "pair"])


def _hub_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over group, met (its pairs of hubs): group, hub, label. The label is one hub of each component of hubs."""
    for batch in batches:
        groups, names, labels = [], [], []
        for i, met in enumerate(batch.column(1).to_pylist()):
            hubs = sorted({h for pair in met for h in pair.values()})
            number, forest = {h: n for n, h in enumerate(hubs)}, Forest(len(hubs))
            for pair in met:
                forest.join(number[pair["node"]], number[pair["hub"]])
            groups += [i] * len(hubs)
            names += hubs
            labels += [hubs[forest.root(n)] for n in range(len(hubs))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(groups, pa.int64())), pa.array(names, pa.string()), pa.array(labels, pa.string())],
            names=["group", "hub", "label"],
        )


def links(members: DataFrame, prepare: Callable, linked: Callable, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges `a, b` that connect, in every group, exactly what its linked pairs connect.

    `members` has group (any type), node (string), payload, and blocks (how many blocks of at most about `block_rows` rows the
    group fills). Groups of one block are compared inside one task each. In larger ones every row is compared with
    `HUBS` hubs, rows of the group chosen by hash. Hubs that share a row or are linked form components; the rows on the hubs of one
    component, the one with most rows, are joined by that already. All other rows, which a tight group has few of, are
    compared with all rows, block against block. So no link is lost: of two linked rows, either both hang on that
    component or one is compared with all. No task holds more than two blocks and the hubs, and tight groups of any size
    take linear work.
    """
    small = members.filter("blocks <= 1").select("group", "node", "payload", F.lit(True).alias("left"))
    run = _per_group(prepare, linked)
    found = small.repartition("group").sortWithinPartitions("group").mapInArrow(run, EDGE)
    large = members.filter("blocks > 1")
    if large.select("group").isEmpty():
        return found
    slot = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(HUBS))
    hubs = large.groupBy("group", slot.alias("slot")).agg(F.min(F.struct("node", "payload")).alias("hub"), F.max("blocks").alias("blocks"))
    deal = lambda part: F.xxhash64("group", part)
    asked = hubs.select(
        "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "hub.node", "hub.payload", F.lit(True).alias("is_hub")
    ).unionByName(
        large.select("group", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("part"), "node", "payload", F.lit(False).alias("is_hub"))
    ).select("group", deal(F.col("part")).alias("deal"), "node", "payload", "is_hub")
    group_type = members.schema["group"].dataType.simpleString()
    judged = stored(
        asked.repartition("deal").sortWithinPartitions("deal", F.desc("is_hub")).mapInArrow(
            _to_hubs(prepare, linked, block_rows), f"group {group_type}, node string, hub string, pair boolean"
        ),
        "judged",
    )
    stars = judged.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    pairs = judged.filter("pair").groupBy("group").agg(F.collect_set(F.struct("node", "hub")).alias("met"))
    labels = small_side(pairs.mapInArrow(_hub_labels, f"group {group_type}, hub string, label string"))
    hung = judged.filter("NOT pair").join(labels, ["group", "hub"], "left").select("group", "node", F.coalesce("label", "hub").alias("label"))
    sizes = hung.filter("label IS NOT NULL").groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = small_side(sizes.groupBy("group").agg(F.max(F.struct("n", "label"))["label"].alias("joined")))
    apart = hung.join(largest, "group", "left").filter("label IS NULL OR label <> joined").select("group", "node")
    counts = apart.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    # Half blocks on either side, so that a task holds about one block.
    rest = large.join(counts, "group").withColumn("left_blocks", F.ceil(F.col("n") * 2 / block_rows).cast("int")).withColumn(
        "right_blocks", F.col("blocks") * 2
    )
    as_left = rest.join(apart, ["group", "node"], "left_semi").select(
        "group", F.pmod(F.xxhash64("node"), "left_blocks").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("right_blocks") - 1)).alias("j"), "node", "payload", F.lit(True).alias("left"),
    )
    # All rows stand on the right, those apart too, so that they meet each other.
    as_right = rest.select(
        "group", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("i"),
        F.pmod(F.xxhash64("node"), "right_blocks").alias("j"), "node", "payload", F.lit(False).alias("left"),
    )
    blocks = as_left.unionByName(as_right).select(deal(F.struct("i", "j")).alias("group"), "node", "payload", "left")
    crossed = blocks.repartition("group").sortWithinPartitions("group").mapInArrow(run, EDGE)
    return found.unionByName(stars).unionByName(crossed.filter("a <> b"))

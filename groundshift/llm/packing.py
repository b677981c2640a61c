"""Mixture-controlled packing by deficit round-robin over source queues (operator 2)."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundshift.llm.tables import slices, small_side, stored
from groundshift.llm.tokens import END_ID, encoder
from groundshift.session import ensure_checkpoint_dir

WINDOW = 2048
QUANTUM = 128
# Queues whose schedule is worked out in closed form on the tasks; that of more queues is sorted as a table.
CLOSED_QUEUES = 64
WEIGHT_UNITS = 1 << 20


def encode_queues(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", max_queues: int | None = None,
) -> DataFrame:
    """Token table in shared storage: `doc_id, queue, part, row, queue_start, n, ids`.

    `ids` are little-endian unsigned 32-bit integers with the end id; `queue_start` counts the queue's tokens before the
    document within its part. One queue a source, however many; only if `max_queues` is given and there are
    more sources, these are hashed to that many queues, which sources then share.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    if max_queues and docs.select(source.alias("s")).distinct().limit(max_queues + 1).count() > max_queues:
        source = F.format_string("queue-%d", F.crc32(source.cast("binary")) % max_queues)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), source.alias("queue"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, row = encoder(tokenizer), TaskContext.get().partitionId(), 0
        upto: dict[str, int] = {}
        for batch in batches:
            for piece in slices(batch, "text"):
                ids = words.documents(piece.column(2).to_pylist(), end)
                n, sizes = len(ids), pa.compute.binary_length(ids).to_numpy().astype(np.int64) // 4
                starts = []
                for queue, size in zip(piece.column(1).to_pylist(), sizes.tolist(), strict=True):
                    starts.append(upto.get(queue, 0))
                    upto[queue] = starts[-1] + size
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0), piece.column(1), pa.array(np.full(n, part, np.int32)),
                        pa.array(np.arange(row, row + n)), pa.array(starts, pa.int64()),
                        pa.array(sizes), ids,
                    ],
                    names=["doc_id", "queue", "part", "row", "queue_start", "n", "ids"],
                )
                row += n

    schema = "doc_id long, queue string, part int, row long, queue_start long, n long, ids binary"
    return stored(rows.mapInArrow(run, schema), "tokens")


class Schedule:
    """The order in which queues send blocks of `quantum` tokens, in closed form.

    Deficit round-robin gives every queue credit in proportion to its weight and lets it send a block when its credit
    covers one; what is left is carried on. Block b of queue i is therefore due when the queue's credit reaches its
    middle, at virtual time (2b + 1) / weight_i. Blocks go out by that time, ties by queue. The number of tokens
    sent before a block is a sum over queues, so any partition finds the place of its blocks, and with it the deficits at
    that point, without those before it. A queue that runs empty leaves its share to the others.
    """

    def __init__(self, totals: list[int], weights: list[int], quantum: int = QUANTUM):
        self.totals, self.weights, self.quantum = totals, weights, quantum

    def before(self, queue: int, block: np.ndarray) -> np.ndarray:
        """Tokens sent before each block of a queue."""
        sent = np.zeros(len(block), np.int64)
        own = self.weights[queue]
        for i, (total, weight) in enumerate(zip(self.totals, self.weights, strict=True)):
            if i == queue:
                count = block
            else:  # blocks c with (2c + 1) / weight before (2b + 1) / own, or at the same time for queues that go first
                due = (2 * block + 1) * weight
                count = ((due if i < queue else due - 1) // own + 1) // 2
            sent += np.minimum(total, count * self.quantum)
        return sent


def units_of(queues: int) -> int:
    """Units in which weights are given, so many that a queue of average share has 2**14 at least."""
    return WEIGHT_UNITS * max(1, -(-queues // CLOSED_QUEUES))


def weights_of(totals: dict[str, int], targets: dict[str, float] | None) -> dict[str, int]:
    """Whole-number weights in units of 2**-20 (or finer): the given proportions, else the queues' shares of all tokens.

    Targets that name none of the queues are an error, such as names of sources that share queues.
    """
    share = {q: float((targets or totals).get(q, 0.0)) for q in totals}
    whole = sum(share.values())
    if targets and totals and not whole:
        raise ValueError("the targets name none of the queues")
    return {q: max(1, round(s / (whole or 1.0) * units_of(len(totals)))) for q, s in share.items()}


def _weight_table(totals: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """`weights_of` as a table: queue, total, weight."""
    share = F.col("total").cast("double")
    if targets:
        given = totals.sparkSession.createDataFrame([(q, float(v)) for q, v in targets.items()], "queue string, target double")
        totals, share = totals.join(given, "queue", "left"), F.coalesce("target", F.lit(0.0))
    shares = totals.select("queue", "total", share.alias("share"))
    queues, whole = shares.agg(F.count(F.lit(1)), F.sum("share")).first()
    if targets and queues and not whole:
        raise ValueError("the targets name none of the queues")
    units = F.rint(F.col("share") / F.lit(whole or 1.0) * F.lit(units_of(queues))).cast("long")
    return shares.select("queue", "total", F.greatest(F.lit(1), units).cast("long").alias("weight"))


def _sent_before(placed: DataFrame, weights: DataFrame, quantum: int) -> DataFrame:
    """`queue, block, sent`: tokens sent before every block, by a range sort over the blocks of all queues.

    Every block is listed by the document that holds its first token, so no row lists the blocks of a whole queue. The
    virtual time (2b + 1) / weight is sorted as a whole number and a fraction, ties by queue, as in `Schedule`.
    """
    ensure_checkpoint_dir(placed.sparkSession)
    first, last = F.ceil(F.col("at") / quantum).cast("long"), F.floor((F.col("at") + F.col("n") - 1) / quantum).cast("long")
    begun = placed.select("queue", first.alias("first"), last.alias("last")).filter("first <= last")
    blocks = begun.select("queue", F.explode(F.sequence("first", "last")).alias("block")).join(small_side(weights), "queue")
    turn = 2 * F.col("block") + 1
    timed = blocks.select(
        F.floor((turn - turn % F.col("weight")) / F.col("weight")).cast("long").alias("whole"),
        ((turn % F.col("weight")) / F.col("weight")).alias("fraction"), "queue", "block",
        F.least(F.lit(quantum), F.col("total") - F.col("block") * quantum).alias("size"),
    )
    order = ["whole", "fraction", "queue", "block"]
    sorted_blocks = timed.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint().withColumn("range", F.spark_partition_id())
    sums = sorted_blocks.groupBy("range").agg(F.sum("size").alias("tokens"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("range", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy(*order)
    return sorted_blocks.withColumn("upto", F.sum("size").over(inside)).join(small_side(bases), "range").select(
        "queue", "block", (F.col("base") + F.col("upto") - F.col("size")).alias("sent")
    )


def _pack_many(placed: DataFrame, weights: DataFrame, window: int, quantum: int, with_ids: bool) -> DataFrame:
    """`pack` for any number of queues: the parts of documents are joined with the place of their blocks.

    Ids are shuffled once here. A block has at most `quantum` parts, so no key is hot.
    """
    first, last = F.floor(F.col("at") / quantum).cast("long"), F.floor((F.col("at") + F.col("n") - 1) / quantum).cast("long")
    low = F.greatest("at", F.col("block") * quantum)
    high = F.least(F.col("at") + F.col("n"), (F.col("block") + 1) * quantum)
    cut = lambda ids, start, length: F.substring(ids, (4 * start + 1).cast("int"), (4 * length).cast("int"))
    parts = placed.withColumn("block", F.explode(F.sequence(first, last))).withColumn("low", low).withColumn("size", high - low).select(
        "doc_id", "queue", "block", (F.col("low") - F.col("at")).alias("begin"), "size", F.col("n").alias("doc_tokens"),
        (F.col("low") - F.col("block") * quantum).alias("inside"), cut(F.col("ids"), F.col("low") - F.col("at"), F.col("size")).alias("ids"),
    )
    timed = parts.join(_sent_before(placed, weights, quantum).hint("merge"), ["queue", "block"]).withColumn("where", F.col("sent") + F.col("inside"))
    room = F.least("size", F.lit(window) - F.col("where") % window)
    piece = lambda skip, length: F.struct(skip.cast("long").alias("skip"), length.cast("long").alias("length"))
    pieces = timed.withColumn("room", room).withColumn(
        "piece", F.explode(F.filter(F.array(piece(F.lit(0), F.col("room")), piece(F.col("room"), F.col("size") - F.col("room"))), lambda p: p["length"] > 0))
    )
    skip, length = F.col("piece.skip"), F.col("piece.length")
    at, ids = F.col("where") + skip, cut(F.col("ids"), skip, length)
    return pieces.select(
        "doc_id", (F.col("begin") + skip).alias("start"), length.alias("length"), F.crc32(ids).alias("ids_crc32"), "doc_tokens",
        F.floor(at / window).cast("long").alias("sequence_id"), (at % window).alias("offset"), "queue",
        *([ids.alias("ids")] if with_ids else []),
    )


def pack(
    tokens: DataFrame, targets: dict[str, float] | None = None, window: int = WINDOW, quantum: int = QUANTUM,
    with_ids: bool = False, closed_queues: int = CLOSED_QUEUES,
) -> DataFrame:
    """Cut a token table into sequences of `window` tokens: one row a piece.

    Returns `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue` (and `ids`, if asked). Queues
    are served by deficit round-robin with `quantum` tokens a turn to proportions `targets` (default: their shares of
    all tokens), see `Schedule`; every window is full but the last one, so at most one sequence needs padding.

    One aggregation sums tokens by part and queue; at most `closed_queues` queue totals reach the driver. Up to that many
    queues positions follow by arithmetic, so no text or id is shuffled and a queue with a third of all tokens is no hot
    key. With more queues totals stay a table, blocks are sorted by their time, and ids are shuffled once; the pieces
    are the same either way.
    Parts and their rows are fixed in the stored token table, so retried tasks cut alike.
    Empty tables give no rows; every document has at least its end id, so each yields a piece.
    """
    sums = tokens.groupBy("part", "queue").agg(F.sum("n").alias("sent"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(sums.select("part", "queue", "sent", F.coalesce(F.sum("sent").over(before), F.lit(0)).alias("base")), "bases")
    if quantum > window:
        raise ValueError("a quantum may not exceed the window")
    by_queue = bases.groupBy("queue").agg(F.sum("sent").alias("total"))
    totals = {r["queue"]: r["total"] for r in by_queue.limit(closed_queues + 1).collect()}
    if len(totals) > closed_queues:
        known = stored(_weight_table(by_queue, targets), "weights")
        many = tokens.join(small_side(bases.select("part", "queue", "base")), ["part", "queue"])
        return _pack_many(many.withColumn("at", F.col("base") + F.col("queue_start")), known, window, quantum, with_ids)
    weights = weights_of(totals, targets)
    plan = json.dumps([(q, totals[q], weights[q]) for q in sorted(totals)])
    placed = tokens.join(small_side(bases.select("part", "queue", "base")), ["part", "queue"]).select(
        "doc_id", "queue", (F.col("base") + F.col("queue_start")).alias("at"), "n", "ids"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queues = json.loads(plan)
        number = {q: i for i, (q, _, _) in enumerate(queues)}
        schedule = Schedule([t for _, t, _ in queues], [w for _, _, w in queues], quantum)
        for batch in batches:
            at, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            names = batch.column(1).to_pylist()
            queue = np.array([number[q] for q in names], dtype=np.int64)
            # Segments: the parts of each document that lie in one block of its queue.
            first, last = at // quantum, (at + n - 1) // quantum
            counts = last - first + 1
            doc = np.repeat(np.arange(len(at)), counts)
            block = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[doc]
            low = np.maximum(at[doc], block * quantum)
            high = np.minimum(at[doc] + n[doc], (block + 1) * quantum)
            where = np.empty(len(doc), np.int64)
            for q in np.unique(queue):
                mine = queue[doc] == q
                where[mine] = schedule.before(int(q), block[mine])
            where += low - block * quantum
            size = high - low
            # A segment that crosses the end of a window is cut there; a quantum is at most a window long.
            room = window - where % window
            over = np.flatnonzero(size > room)
            doc = np.concatenate([doc, doc[over]])
            start = np.concatenate([low - at[doc[: len(low)]], (low + room)[over] - at[doc[len(low):]]])
            length = np.concatenate([np.minimum(size, room), (size - room)[over]])
            where = np.concatenate([where, (where + room)[over]])
            order = np.lexsort((start, doc))
            doc, start, length, where = doc[order], start[order], length[order], where[order]
            ids = [memoryview(raw) for raw in batch.column(4).to_pylist()]
            cut = [ids[d][4 * s: 4 * (s + m)] for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            for lo in range(0, len(doc), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                columns = [
                    batch.column(0).take(pa.array(doc[part])), pa.array(start[part]), pa.array(length[part]),
                    pa.array([zlib.crc32(c) for c in cut[part]], pa.int64()), pa.array(n[doc[part]]),
                    pa.array(where[part] // window), pa.array(where[part] % window),
                    batch.column(1).take(pa.array(doc[part])),
                ]
                if with_ids:
                    columns.append(pa.array([bytes(c) for c in cut[part]], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names_out)

    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
    ) + (", ids binary" if with_ids else "")
    names_out = [f.split()[0] for f in schema.split(", ")]
    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """`sequence_id, n_tokens, ids binary`: whole sequences from pieces with ids, padded to the window with `pad_id`.

    A sequence gathers at most `window` tokens in one row. Ids stay little-endian unsigned 32-bit integers.
    """
    gathered = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("cut")
    )
    # Binary columns have no array_join, so ids are joined as hexadecimal text.
    joined = F.array_join(F.transform("cut", lambda c: F.hex(c["ids"])), "")
    pad = pad_id.to_bytes(4, "little").hex()
    full = F.concat(joined, F.repeat(F.lit(pad), (F.lit(window) - F.col("n_tokens")).cast("int")))
    return gathered.select("sequence_id", "n_tokens", F.unhex(full).alias("ids"))

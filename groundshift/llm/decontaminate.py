"""Benchmark passages in documents by CGK embedding and bit-sampling LSH (operator 8)."""

from __future__ import annotations

import math
import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from groundshift.llm.tables import slices, stored, worker_state
from groundshift.llm.words import hash_words, word_hashes

# An item counts as found within this share of its words in edits (insert, delete, replace a word).
EDITS = 0.2
WALKS = 12
TABLES = 6
SAMPLED = 3
# Items, and bytes of their texts, looked for in one pass over the documents; more items take more passes.
ITEMS_A_PASS = 20_000
BYTES_A_PASS = 16 << 20
MIN_WORDS = 4
# Cells of edit tables that advance together, and stretches of text that wait for it.
CELLS = 1 << 18
STRETCHES = 4096
# One edit in a cell, above the place where its match starts.
EDIT = 1 << 32


def allowed(words: int, edits: float = EDITS) -> int:
    """Word edits allowed for an item of so many words."""
    return int(words * edits)


def size_class(words: int) -> int:
    """Window length for items of so many words: classes grow by a quarter, and windows never exceed their items."""
    size = MIN_WORDS
    while math.ceil(size * 1.25) <= words:
        size = math.ceil(size * 1.25)
    return size


def steps_of(window: int) -> int:
    """Walk steps that are sampled: with half a symbol a step a walk stays inside the window."""
    return max(4, math.ceil(1.5 * window))


def walk(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, steps: int, wanted: np.ndarray) -> np.ndarray:
    """CGK walks from many starts at once: the symbols that stand at the `wanted` steps, one row a start.

    At step j the walk writes the symbol under it and moves on if a random bit of (seed, j, symbol) says so. Two
    strings at small edit distance fall into step again after each edit, so their walks agree at most steps. Beyond `ends`
    stands symbol 0.
    """
    rng = np.random.default_rng(seed)
    multipliers = rng.integers(1 << 62, size=steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    place = starts.copy()
    out = np.empty((len(starts), len(wanted)), np.uint64)
    column = {int(j): c for c, j in enumerate(wanted)}
    last = int(wanted.max()) if len(wanted) else -1
    for j in range(last + 1):
        inside = place < ends
        symbol = np.where(inside, symbols[np.minimum(place, len(symbols) - 1)], np.uint64(0))
        if j in column:
            out[:, column[j]] = symbol
        place = place + ((symbol * multipliers[j]) >> np.uint64(63)).astype(np.int64)
    return out


class Plan:
    """The sampled steps of every walk and table for one size class."""

    def __init__(self, window: int, walks: int, tables: int, sampled: int):
        self.window, self.steps = window, steps_of(window)
        rng = np.random.default_rng(window)
        self.samples = [[np.sort(rng.choice(self.steps, sampled, replace=False)) for _ in range(tables)] for _ in range(walks)]

    def keys(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(table number, key of each start) for all walks and tables."""
        for w, tables in enumerate(self.samples):
            wanted = np.unique(np.concatenate(tables))
            seen = walk(symbols, starts, ends, 1000 * self.window + w, self.steps, wanted)
            for t, steps in enumerate(tables):
                key = np.zeros(len(starts), np.uint64)
                for s in steps:
                    key = (key ^ seen[:, np.searchsorted(wanted, s)]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                yield w * len(tables) + t, key


def best_matches(items: list[np.ndarray], texts: list[np.ndarray], most: list[int]) -> list[tuple[int, int, int] | None]:
    """(distance, start, end) of the best match of each whole item inside its text, None beyond its `most` edits.

    An item must be used up; text before and after the match is free. Ties go to the earliest end, then the earliest start.
    All pairs advance together, one item word a step, over whole rows of the edit table: a cell holds the edits and, below
    them, where its match starts, and a running minimum carries words left out of the text along the row.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(items)
    order = sorted((i for i in range(len(items)) if len(items[i])), key=lambda i: (len(texts[i]) + len(items[i]), i))
    first = 0
    while first < len(order):
        # Rows of similar width advance together; a wide text takes a batch of its own.
        last = first + 1
        while last < len(order) and (last + 1 - first) * (len(texts[order[last]]) + 1) <= CELLS:
            last += 1
        _advance([(i, items[i], texts[i], most[i]) for i in order[first:last]], out)
        first = last
    return out


def _advance(batch: list[tuple[int, np.ndarray, np.ndarray, int]], out: list) -> None:
    width = max(len(text) for _, _, text, _ in batch)
    number = np.array([i for i, _, _, _ in batch])
    sizes = np.array([len(item) for _, item, _, _ in batch])
    widths = np.array([len(text) for _, _, text, _ in batch])
    most = np.array([m for _, _, _, m in batch])
    words, there = np.zeros((len(batch), width), np.uint64), np.arange(width) < widths[:, None]
    symbols = np.zeros((len(batch), int(sizes.max())), np.uint64)
    for n, (_, item, text, _) in enumerate(batch):
        words[n, :len(text)] = text
        symbols[n, :len(item)] = item
    along = np.arange(width + 1, dtype=np.int64) * EDIT
    cells = np.tile(np.arange(width + 1, dtype=np.int64), (len(batch), 1))
    for step in range(int(sizes.max())):
        # Replace or keep a word, or leave the item's word out.
        moved = cells + EDIT
        np.minimum(moved[:, 1:], cells[:, :-1] + ((words != symbols[:, step, None]) | ~there) * EDIT, out=moved[:, 1:])
        moved[:, 0] = (step + 1) * EDIT
        # Leave words of the text out.
        cells = np.minimum.accumulate(moved - along, axis=1) + along
        done = sizes == step + 1
        # A row never falls below its smallest cell, so pairs beyond their edits stop here.
        hopeless = (cells.min(axis=1) // EDIT > most) if step % 8 == 7 else np.zeros(len(sizes), bool)
        if not (done.any() or hopeless.any()):
            continue
        for n in np.flatnonzero(done).tolist():
            row = cells[n, :widths[n] + 1]
            end = int(np.argmin(row // EDIT))
            distance, start = divmod(int(row[end]), EDIT)
            if distance <= most[n]:
                out[number[n]] = (distance, start, end)
        open_ = ~(done | hopeless)
        if not open_.any():
            return
        number, sizes, widths, most, words, there, symbols, cells = (
            a[open_] for a in (number, sizes, widths, most, words, there, symbols, cells)
        )


def edit_distance_within(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """`best_matches` of one item in one text."""
    return best_matches([item], [text], [most])[0]


class Index:
    """LSH tables of benchmark items, by size class: per table the sorted keys and the item behind each."""

    def __init__(self, items: list[tuple[int, np.ndarray]], edits: float, walks: int, tables: int, sampled: int):
        self.items: list[tuple[int, np.ndarray, int]] = []
        by_class: dict[int, list[int]] = defaultdict(list)
        for item_id, symbols in items:
            if len(symbols):
                by_class[min(size_class(len(symbols)), len(symbols))].append(len(self.items))
                self.items.append((item_id, symbols, allowed(len(symbols), edits)))
        self.classes = []
        for window, members in sorted(by_class.items()):
            plan = Plan(window, walks, tables, sampled)
            symbols = np.concatenate([self.items[m][1] for m in members])
            sizes = np.array([len(self.items[m][1]) for m in members])
            starts = np.cumsum(sizes) - sizes
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for _, keys in plan.keys(symbols, starts, starts + window):
                order = np.argsort(keys, kind="stable")
                found.append((keys[order], np.array(members, np.int32)[order]))
            # A window with at most d edits against an item keeps all but d of the item's words.
            slack = max(self.items[m][2] + (window if len(self.items[m][1]) < window else 0) for m in members)
            self.classes.append((plan, found, np.unique(symbols), min(slack, window - 1)))

    def hits(self, words: np.ndarray, doc_starts: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
        """Distinct (item, window start) pairs that share a key, ordered by item and place."""
        doc_of = np.repeat(np.arange(len(doc_starts)), doc_ends - doc_starts)
        met = np.empty(0, np.int64)
        for plan, found, vocabulary, slack in self.classes:
            at = np.searchsorted(vocabulary, words)
            shared = vocabulary[np.minimum(at, len(vocabulary) - 1)] == words
            upto = np.concatenate([[0], np.cumsum(shared)])
            window = plan.window
            ends = np.minimum(np.arange(len(words)) + window, doc_ends[doc_of])
            # Exact pruning: too few words of any item in the window, so no item is within its edits here.
            starts = np.flatnonzero(upto[ends] - upto[:-1] >= window - slack)
            if not len(starts):
                continue
            stops, fresh, waiting = ends[starts], [], 0
            for number, keys in plan.keys(words, starts, stops):
                known, members = found[number]
                low = np.searchsorted(known, keys)
                hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == keys)
                if not len(hit):
                    continue
                # Items with one opening share a key: every hit stands for all of them.
                low = low[hit]
                count = np.searchsorted(known, keys[hit], side="right") - low
                place = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                fresh.append(members[place].astype(np.int64) << 32 | np.repeat(starts[hit], count))
                waiting += len(place)
                if waiting > CELLS:
                    met, fresh, waiting = np.unique(np.concatenate([met, *fresh])), [], 0
            met = np.unique(np.concatenate([met, *fresh])) if fresh else met
        return np.stack([met >> 32, met & 0xFFFFFFFF], axis=1)

    def matches(self, words: np.ndarray, doc_starts: np.ndarray, doc_ends: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item id, first word, word after, distance) of every item found in the documents' words."""
        if not len(words):
            return
        stretches: list[tuple[int, int, int, int]] = []
        seen: set[tuple[int, int, bytes]] = set()
        covered, last = -1, (-1, -1)
        hits = self.hits(words, doc_starts, doc_ends)
        docs = np.searchsorted(doc_ends, hits[:, 1], side="right")
        for doc, (m, p) in zip(docs.tolist(), hits.tolist(), strict=True):
            _, symbols, most = self.items[m]
            if (doc, m) != last:
                covered, last = -1, (doc, m)
            if p <= covered:
                continue
            low = max(int(doc_starts[doc]), p - most - 2)
            covered = p + most  # nearby starts lie in the same verified stretch
            high = min(int(doc_ends[doc]), p + most + len(symbols) + most + 2)
            # The same words again give the same match further on, which loses the tie.
            content = (doc, m, words[low:high].tobytes())
            if content not in seen:
                seen.add(content)
                stretches.append((doc, m, low, high))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for part in range(0, len(stretches), STRETCHES):
            mine = stretches[part:part + STRETCHES]
            checked = best_matches(
                [self.items[m][1] for _, m, _, _ in mine], [words[low:high] for _, _, low, high in mine], [self.items[m][2] for _, m, _, _ in mine]
            )
            for (doc, m, low, _), found_at in zip(mine, checked, strict=True):
                if found_at is not None:
                    spot = (found_at[0], found_at[1] + low, found_at[2] + low)
                    best[doc, m] = min(best.get((doc, m), spot), spot)
        for (doc, m), spot in sorted(best.items()):
            base = int(doc_starts[doc])
            yield doc, self.items[m][0], spot[1] - base, spot[2] - base, spot[0]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", walks: int = WALKS, tables: int = TABLES,
    sampled: int = SAMPLED, items_a_pass: int = ITEMS_A_PASS, bytes_a_pass: int = BYTES_A_PASS,
) -> DataFrame:
    """Benchmark items that stand in documents: `doc_id, item_id, start_word, end_word, distance`, the best per pair.

    Texts are sequences of lower-cased words. Windows of an item's size class start at every word of every document;
    those that hold too few words of the benchmark are out by an exact bound. The others are embedded by CGK walks,
    which turn edits into differing steps, and looked up in tables keyed by a few sampled steps; several walks with several
    tables bring recall at the allowed edits above 0.99 (measured in the tests). Every hit is verified by exact word
    edit distance (at most `edits` of the item's words), so nothing else is reported.

    Documents stay in their partitions: no shuffle, no skew. The word hashes of about `items_a_pass` items, or `bytes_a_pass`
    bytes of their texts, go through the driver to the tasks, which build the tables; larger benchmarks take one pass over the
    documents for each such block, and the rows of a pass are stored before the next begins. Items with a common opening share
    keys, and all stretches of a batch of documents are verified together.

    Null or wordless texts and items match nothing; items shorter than five words must occur unchanged; repeated
    rows and items are reported each once; items without an id are not searched; empty tables give no rows. A column of
    structs, such as `file_rows` gives, may stand for the document's id.
    """
    is_row = isinstance(docs.schema[id_col].dataType, StructType)
    ids = F.col(id_col) if is_row else F.col(id_col).cast("long")
    source = docs.select(ids.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter(
        F.col("item_id").isNotNull() & F.col("text").isNotNull()
    ).distinct()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, math.ceil(size["n"] / items_a_pass), math.ceil(size["bytes"] / bytes_a_pass))
    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id long, start_word int, end_word int, distance int"
    found = None
    for block in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted((r["item_id"], r["words"]) for r in mine.mapInArrow(_item_words, "item_id long, words binary").collect())
        part = source.mapInArrow(_finder(pickle.dumps(rows), (edits, walks, tables, sampled)), schema)
        # The driver holds one block of items at a time.
        part = part if blocks == 1 else stored(part, "passages")
        found = part if found is None else found.unionByName(part)
    return found


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as the bytes of their word hashes."""
    for batch in batches:
        words = [hash_words(text).tobytes() for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], names=["item_id", "words"])


def _finder(shipped: bytes, settings: tuple):
    def index_of() -> Index:
        return Index([(i, np.frombuffer(w, np.uint64)) for i, w in pickle.loads(shipped)], *settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = worker_state(f"items_{zlib.crc32(shipped)}_{settings}", index_of)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                words, starts, ends = word_hashes(part.column(1).to_pylist())
                rows = list(index.matches(words, starts, ends))
                found = [pa.array([r[c] for r in rows], pa.int64() if c == 1 else pa.int32()) for c in range(1, 5)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([int(r[0]) for r in rows], pa.int64())), *found],
                    names=["doc_id", "item_id", "start_word", "end_word", "distance"],
                )

    return run

"""Token ids in whole-word pieces, and token files in ORC (operator 4)."""

from __future__ import annotations

import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundshift.llm.tables import slices, small_side, worker_state

END_ID = 1
CACHED_WORDS = 320_000
CACHED_CHARS = 48
# Bytes that mark by hash which pieces were seen before; a power of two.
SEEN_MARKS = 1 << 22


class WordEncoder(dict):
    """Ids of space-free pieces of text as little-endian bytes, remembered for the first `CACHED_WORDS` pieces that come back.

    For tokenizers that drop white space and never merge across it, a text's ids are those of its pieces in order. Shortcuts
    are taken only where probes show that the tokenizer allows them: Latin-1 texts are lower-cased first, plain
    words go to the merges directly, without the surrounding steps, and signs after a letter are encoded apart from what they follow.
    Most pieces of a corpus come once, so a piece is remembered when it comes again; a mark that two pieces share only
    remembers one of them sooner.
    """

    LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
    PROBES = ("a", "the", "zebra", "caf\u00e9", "stra\u00dfe", "se\u00f1or", "\u00e9\u00e8\u00e7", "qxzjkv", "m\u00fc\u00b5\u00aa\u00ba", "word" * 9)

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        self.table = {}
        for c in self.LETTERS:
            shown = tokenizer.pre_tokenizer.pre_tokenize_str(c) if tokenizer.pre_tokenizer else []
            self.table[ord(c)] = shown[0][0] if len(shown) == 1 else c
        slow = lambda w: self.encode(w, add_special_tokens=False).ids
        self.folds = all(slow(c.upper()) == slow(c) for c in "az\u00e9\u00fc") and all(
            slow(c) == slow(c.lower()) for c in map(chr, range(32, 256))
        )
        self.plain = self.folds and all([t.id for t in self.merge(w.translate(self.table))] == slow(w) for w in self.PROBES)
        # Signs that end a word and that no added token holds; a run of them is one piece, whatever word it follows.
        added = "".join(t.content for t in tokenizer.get_added_tokens_decoder().values())
        signs = "".join(c for c in string.punctuation if c not in added)
        splits = lambda tail: slow("ab" + tail) == slow("ab") + slow(tail) and slow("z\u00e9" + tail) == slow("z\u00e9") + slow(tail)
        self.signs = signs if self.plain and all(splits(c + d) for c in signs for d in ["", *signs]) else ""
        self.pack = {n: struct.Struct(f"<{n}I").pack for n in range(64)}
        self.seen = bytearray(SEEN_MARKS)
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(self.signs)
        n = len(stem)
        if 0 < n < len(word) and stem[-1].isalpha() and (word.isascii() or max(word) < "\u0100"):
            # A word before signs. Beyond Latin-1 folding may add a mark that joins them.
            ids = self[stem] + self[word[n:]]
        else:
            if self.plain and word.isalpha() and word.islower() and (word.isascii() or max(word) < "\u0100"):
                found = [t.id for t in self.merge(word.translate(self.table))]
            else:
                found = self.encode(word, add_special_tokens=False).ids
            ids = self.pack[len(found)](*found) if len(found) < 64 else np.array(found, dtype="<u4").tobytes()
        if len(self) < CACHED_WORDS and len(word) <= CACHED_CHARS:
            mark = hash(word) & (SEEN_MARKS - 1)
            if self.seen[mark]:
                self[word] = ids
            else:
                self.seen[mark] = 1
        return ids

    def folded(self, text: str) -> str:
        if self.folds:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass  # folding such texts before composing them could change them
        return text.replace("\n", " ")

    def document(self, text: str, end: bytes) -> bytes:
        return b"".join(map(self.__getitem__, self.folded(text).split(" "))) + end

    def documents(self, texts: list[str], end: bytes) -> pa.BinaryArray:
        """As `document` for each text; every different piece of all of them is looked up once."""
        # A line feed, which no piece holds, stands for the end id.
        pieces = pa.compute.split_pattern(pa.array([self.folded(t) + " \n" for t in texts], pa.string()), " ")
        coded = pieces.flatten().dictionary_encode()
        ids = pa.array([end if w == "\n" else self[w] for w in coded.dictionary.to_pylist()], pa.binary()).take(coded.indices)
        _, ends, data = ids.buffers()
        offsets = np.frombuffer(ends, np.int32)[pieces.offsets.to_numpy()]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), data])


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker for a tokenizer file."""
    return worker_state(f"encoder_{zlib.crc32(path.encode())}", lambda: WordEncoder(path))


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
    stripe_bytes: int = 64 << 20, index_rows: int = 1000,
) -> None:
    """Encode every whole text, append the end id, and write ORC files in ascending order of id.

    `path/docs` has one row a document (doc_id, part, local_start, n_tokens, ids); ORC writes integer columns with
    run-length encoding in stripes of about `stripe_bytes`, with a row index every `index_rows` rows and a Bloom
    filter on doc_id. `path/parts` has the ids before each part. Documents are range partitioned by id and input
    position, so files and rows within files ascend, a repeated id may be parted, and stripes can be read in parallel.

    Null texts count as empty and hold the end id alone; null ids come first; an empty table writes no documents.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("pos"),
    )
    ordered = rows.repartitionByRange("doc_id", "pos").sortWithinPartitions("doc_id", "pos")
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text"):
                _, ends, data = words.documents(piece.column(1).to_pylist(), end).buffers()
                offsets = np.frombuffer(ends, np.int32) // 4
                ids = np.frombuffer(data, dtype="<i4", count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0), pa.array(np.full(len(piece), part, np.int32)), pa.array(start + offsets[:-1].astype(np.int64)),
                        pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)),
                    ],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    written = ordered.mapInArrow(encode, "doc_id long, part int, local_start long, n_tokens long, ids array<int>")
    (
        written.write.option("orc.compress", "ZSTD").option("orc.stripe.size", stripe_bytes)
        .option("orc.rows.between.memory.checks", 500).option("orc.row.index.stride", index_rows).option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(f"{path}/docs")
    )
    spark = docs.sparkSession
    sizes = spark.read.schema("part int, n_tokens long").orc(f"{path}/docs").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.orc(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents of a token folder: `doc_id, start, n_tokens, ids`, optionally those with low <= doc_id <= high.

    The range is pushed to the ORC scan, which skips stripes and row groups by their statistics and, for one id, by its
    Bloom filter. Files are split by stripe.
    """
    docs = spark.read.schema("doc_id long, part int, local_start long, n_tokens long, ids array<int>").orc(f"{path}/docs")
    if low is not None:
        docs = docs.filter(F.col("doc_id") >= low) if low != high else docs.filter(F.col("doc_id") == low)
    if high is not None and low != high:
        docs = docs.filter(F.col("doc_id") <= high)
    parts = spark.read.schema("part int, base long").orc(f"{path}/parts")
    return docs.join(small_side(parts), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def with_checksums(documents: DataFrame) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32`: the crc32 of each document's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = np.ascontiguousarray(np.asarray(lists.flatten()), dtype="<i4").tobytes()
            ends = np.cumsum(np.asarray(pa.compute.list_value_length(lists), dtype=np.int64)) * 4
            starts = np.concatenate([[0], ends[:-1]])
            view = memoryview(flat)
            sums = [zlib.crc32(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    columns = documents.select("doc_id", "start", "n_tokens", "ids")
    return columns.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

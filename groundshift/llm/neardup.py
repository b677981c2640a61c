"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundshift.llm.graph import components
from groundshift.llm.groups import BLOCK_ROWS, links
from groundshift.llm.tables import file_rows, free_name, numbered, release_worker_state, slices, stored, worker_state
from groundshift.llm.words import mixed, shingle_hashes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 12
ROWS = 4
# Pairs in a common band go on to the exact comparison if their samples agree this often: 3.5 standard errors of 48
# samples below the similarity asked for.
AGREEMENT = 0.58
DF_BUCKETS = 1 << 17
# Texts, and their bytes, that one task compares exactly at once.
TEXT_ROWS = 512
TEXT_BYTES = 8 << 20
# Inverse document frequency is ln(1 + N / (df + N)): it falls from 0.69 for rare shingles to 0.41 for those of every
# document. A steeper one would part large groups of near copies, whose common shingles are frequent for no other
# reason than the copies, from each other.
DF_DAMPING = 1.0


class Weights:
    """TF-IDF weights of shingles; document frequencies are counted per hash bucket."""

    def __init__(self, frequency: np.ndarray, documents: int):
        df = frequency / max(1, documents)
        self.idf = np.log1p(1 / (df + DF_DAMPING))
        self.log_idf = np.log(self.idf)

    def features(self, texts: list[str | None]):
        """Distinct shingles of each text in order: text number, hash, term frequency, and shingles per text."""
        words, starts, ends = word_hashes(texts)
        hashes, numbers = shingle_hashes(words, starts, ends, SHINGLE)
        text = np.repeat(np.arange(len(texts)), numbers)
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(first)
        tf = np.diff(np.append(at, len(hashes)))
        return text[at], hashes[at], tf, np.bincount(text[at], minlength=len(texts))

    def weigh(self, hashes: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf * self.idf[bucket(hashes)]

    def log_weight(self, hashes: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return np.log(tf) + self.log_idf[bucket(hashes)]


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 17)).astype(np.int64)


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010) with random variates looked up by hash.

    For sample k a shingle draws r, c ~ Gamma(2, 1) and beta ~ U(0, 1) from bits of a hash of (shingle, k). With
    weight w, t = floor(ln w / r + beta) and ln a = ln c - r (t - beta + 1); the shingle with the smallest a is
    the sample. Two texts draw the same (shingle, t) with a probability equal to their weighted Jaccard similarity. The
    value of a identifies (shingle, t), so its bits are the sample.
    """

    def __init__(self, samples: int):
        rng = np.random.default_rng(20240601)
        self.r = rng.gamma(2.0, 1.0, 1 << 12)
        self.inverse = 1 / self.r
        self.log_c = np.log(rng.gamma(2.0, 1.0, 1 << 16))
        self.odd = rng.integers(1 << 62, size=samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sample(self, hashes: np.ndarray, log_weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples (rows: texts with at least one shingle, whose first shingles are at `starts`)."""
        out = np.empty((len(starts), len(self.odd)), np.uint64)
        for k, odd in enumerate(self.odd):
            bits = hashes * odd
            bits ^= bits >> np.uint64(32)
            low = (bits & np.uint64(4095)).astype(np.intp)
            r = self.r[low]
            beta = (bits >> np.uint64(28)).astype(np.float64)
            beta *= 2.0**-36
            t = np.floor(log_weight * self.inverse[low] + beta)
            t -= beta
            t += 1.0
            t *= r
            a = self.log_c[((bits >> np.uint64(12)) & np.uint64(65535)).astype(np.intp)] - t
            out[:, k] = np.minimum.reduceat(a, starts).view(np.uint64)
        return mixed(out)


def _pieces(texts: list, starts: np.ndarray, limit: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Runs of texts with about `limit` shingles, so that temporary arrays stay in cache."""
    at = 0
    for i in range(1, len(starts)):
        if starts[i] - starts[at] >= limit:
            yield at, i
            at = i
    if len(starts):
        yield at, len(starts)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents per shingle bucket over all documents, and the number of documents with words.

    A task adds up its documents in an array of fixed size; the sums per bucket, `DF_BUCKETS` numbers whatever the size
    of the corpus, reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        counts, documents = np.zeros(DF_BUCKETS, np.int64), 0
        plain = Weights(np.zeros(DF_BUCKETS), 1)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                _, hashes, _, numbers = plain.features(part.column(0).to_pylist())
                counts += np.bincount(bucket(hashes), minlength=DF_BUCKETS)
                documents += int((numbers > 0).sum())
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(counts[used], documents), pa.int64())],
            names=["bucket", "n"],
        )

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    rows = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    buckets, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    out, documents = np.zeros(DF_BUCKETS), 0
    for b, c in zip(buckets.tolist(), n.tolist(), strict=True):
        if b < 0:
            documents = c
        else:
            out[b] = c
    return out, documents


def text_key(text: Column) -> Column:
    """128 bits of a text's hash as 32 hexadecimal digits; null for null."""
    return F.when(
        text.isNotNull(),
        F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), text, F.lit(2))), 16, "0")),
    )


def signatures(docs: DataFrame, weights: Weights, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """`doc_id, node, pos, bytes` rows with `bands array<long>` and `samples binary`; both null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = worker_state(f"sampler_{bands * rows}", lambda: Sampler(bands * rows))
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                text, hashes, tf, numbers = weights.features(part.column(4).to_pylist())
                full = np.flatnonzero(numbers)
                starts = (np.cumsum(numbers) - numbers)[full]
                logs = weights.log_weight(hashes, tf)
                drawn = np.empty((len(full), bands * rows), np.uint64)
                for lo, hi in _pieces(full, starts):
                    a, b = starts[lo], starts[hi] if hi < len(starts) else len(hashes)
                    drawn[lo:hi] = sampler.sample(hashes[a:b], logs[a:b], starts[lo:hi] - a)
                keys = np.zeros((len(full), bands), np.uint64)
                for b in range(bands):
                    for k in range(b * rows, (b + 1) * rows):
                        keys[:, b] = mixed(keys[:, b] * np.uint64(31) + drawn[:, k])
                band_rows: list = [None] * len(numbers)
                sample_rows: list = [None] * len(numbers)
                short = drawn.astype(np.uint16)
                for n, i in enumerate(full.tolist()):
                    band_rows[i] = keys[n].view(np.int64)
                    sample_rows[i] = short[n].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(band_rows, pa.list_(pa.int64())), pa.array(sample_rows, pa.binary())],
                    names=["doc_id", "node", "pos", "bytes", "bands", "samples"],
                )

    pos = docs.schema["pos"].dataType.simpleString()
    return docs.select("doc_id", "node", "pos", "bytes", "text").mapInArrow(
        run, f"doc_id long, node string, pos {pos}, bytes int, bands array<long>, samples binary"
    )


def _sample_matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.uint16).reshape(len(rows), -1)


def _agree(least: float):
    return lambda samples, i, js: (samples[js] == samples[i]).mean(axis=1) >= least


class WeightedSets:
    """Weighted shingle sets of a block of texts with postings from shingles to texts."""

    def __init__(self, weights: Weights, texts: list[str]):
        self.text, hashes, tf, self.numbers = weights.features(texts)
        self.weight = weights.weigh(hashes, tf)
        self.starts = np.cumsum(self.numbers) - self.numbers
        self.totals = np.bincount(self.text, self.weight, minlength=len(texts))
        _, self.shingle, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        self.order = np.argsort(self.shingle, kind="stable")
        self.lists = np.concatenate([[0], np.cumsum(counts)])

    def similarity(self, i: int) -> np.ndarray:
        """Weighted Jaccard similarity of text i with every text."""
        mine = slice(self.starts[i], self.starts[i] + self.numbers[i])
        first, last = self.lists[self.shingle[mine]], self.lists[self.shingle[mine] + 1]
        sizes = last - first
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
        entry = self.order[at]
        least = np.minimum(self.weight[entry], np.repeat(self.weight[mine], sizes))
        shared = np.bincount(self.text[entry], least, minlength=len(self.totals))
        return shared / np.maximum(self.totals + self.totals[i] - shared, 1e-12)


def _jaccard_at_least(least: float):
    return lambda sets, i, js: sets.similarity(i)[js] >= least - 1e-9


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS,
    rows: int = ROWS, row_col: str | None = None,
) -> DataFrame:
    """The near-duplicate class of every document: `doc_id, class_id, copies, pos, stays`.

    Two texts are linked if the weighted Jaccard similarity of their five-word shingles, weighted by TF-IDF, is at least
    `similarity`; classes are the connected components of links, equal texts included. `class_id` is the smallest doc_id
    of the class, `copies` its rows; `stays` marks one row of each class, the one with the smallest doc_id, then the
    first in input order. `pos` tells the input's rows apart: the column `row_col`, which must be unique, orderable and the same whenever
    the table is read (see `file_rows`); without it the table is written once with numbers.

    Two row-wise passes over the texts count document frequencies and draw 48 consistent weighted samples a text.
    Then only distinct texts go on: those that share a band are compared by samples inside their bands, what agrees well
    enough forms coarse components, and inside these whole texts are compared exactly. Groups are cut into blocks, see
    `links`, so a band or component of any size is worked in parallel and no pairs are listed. Texts with similarity 0.8 share
    a band with probability 0.998, more similar ones with more. Runs jobs when called.

    Null texts are classes of their own; texts without words are alike only if equal; texts of fewer than five words
    have one shingle. Rows without an id count as larger than all ids. An empty table gives no rows.
    """
    if row_col is None:
        row_col = free_name(docs, "row_number")
        docs = numbered(docs, row_col)
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col).cast("string")).alias("node"),
        F.col(row_col).alias("pos"), F.octet_length(F.col(text_col).cast("string")).alias("bytes"),
        F.col(text_col).cast("string").alias("text"),
    )
    weights = Weights(*document_frequencies(docs, text_col))
    signed = stored(signatures(source, weights, bands, rows), "signatures")
    # Tables that grow with the corpus are joined by shuffles at every size, never by broadcast.
    nodes = signed.filter(F.col("bands").isNotNull())
    member = nodes.select("node", F.posexplode("bands")).select("node", F.xxhash64("pos", "col").alias("group")).repartition("group")
    short = F.xxhash64("node")
    crowded = member.groupBy("group").agg(F.min(short).alias("low"), F.max(short).alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high")
    in_bands = stored(
        member.join(crowded.hint("merge"), "group").select("node", "group", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "bands"
    ).dropDuplicates(["group", "node"])
    samples = nodes.select("node", F.col("samples").alias("payload")).join(in_bands.select("node").distinct().hint("merge"), "node", "left_semi")
    met = stored(in_bands.join(samples.dropDuplicates(["node"]).hint("merge"), "node"), "met")
    coarse = components(links(met, _sample_matrix, _agree(AGREEMENT)))
    # One row of each candidate text: the one whose position is smallest.
    chosen = stored(
        signed.select("node", "pos", "bytes").join(coarse.hint("merge"), "node").groupBy("node").agg(
            F.min("pos").alias("pos"), F.first("root").alias("group"), F.max("bytes").alias("bytes")
        ),
        "candidates",
    )
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / TEXT_ROWS), F.ceil(F.sum("bytes") / TEXT_BYTES)).cast("int")
    sizes = chosen.groupBy("group").agg(blocks.alias("blocks"))
    placed = stored(chosen.join(sizes.hint("merge"), "group").select("group", "node", "pos", "blocks"), "placed")
    # Written once, as links() reads it several times: texts of the whole corpus are shuffled a single time.
    texts = stored(
        source.select("pos", F.col("text").alias("payload")).join(placed.hint("merge"), "pos").select("group", "node", "payload", "blocks"),
        "texts",
    )
    edges = links(
        texts, lambda rows: WeightedSets(weights, rows), _jaccard_at_least(similarity), block_rows=TEXT_ROWS
    )
    roots = components(edges)
    classes = signed.select("doc_id", "pos", F.coalesce("node", F.concat(F.lit("null-"), F.col("pos").cast("string"))).alias("node")).join(
        roots.hint("merge"), "node", "left"
    ).select("doc_id", "pos", F.coalesce("root", "node").alias("class"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "pos")
    heads = classes.groupBy("class").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("copies"))
    return classes.join(heads.hint("merge"), "class").select(
        "doc_id", F.col("head.doc_id").alias("class_id"), "copies", "pos", (F.col("pos") == F.col("head.pos")).alias("stays")
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of a table without all but one of each near-duplicate class; columns stay. Pass a table as read from files."""
    row = free_name(docs, "row_number")
    located = file_rows(docs, row)
    kept = near_duplicates(located, row_col=row, **options).filter("stays").select(F.col("pos").alias(row))
    return located.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)

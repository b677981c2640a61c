"""How sources of a language differ: single-pass in-memory indexing, merged runs, pair corrections (operator 12)."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter, ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundshift.llm.tables import release_worker_state, slices, small_side, stored

MIN_DOCUMENTS = 10
TOP_TERMS = 10
ONE = 1_000_000_000
# Distinct (group, term) entries that a block of the index holds before it is spilled as a run.
BLOCK_ENTRIES = 400_000
# Postings that one task corrects pairs with, and sources that it compares at once.
SLICE_POSTINGS = 50_000
SOURCE_BLOCK = 256
PAIRS_AT_ONCE = 1 << 20
# Letters of ASCII in lower case and all bytes beyond ASCII make terms; everything else parts them.
TERM_BYTES = bytes(x | 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x > 127 else 32 for x in range(256))


RUN = pa.schema([
    ("shard", pa.int32()), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())),
    ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("documents", pa.list_(pa.int64())),
])


def index_runs(docs: DataFrame, shards: int, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Runs of the index, one row a run and hash shard: `shard, langs, sources, sizes, terms, counts, documents`.

    A task reads its documents once and adds their terms to postings in memory, a count and a number of documents for every term
    of every (lang, source). A full block leaves as one run, dealt to shards by a hash of the term; a row lists its groups in order,
    how many terms each has, and the terms of each in ascending order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        counts: dict[tuple, Counter] = {}
        documents: dict[tuple, Counter] = {}
        held = 0

        def spill() -> Iterator[pa.RecordBatch]:
            sections: dict[int, list[list]] = {}
            for group in sorted(counts):
                dealt: dict[int, list[bytes]] = {}
                for term in counts[group]:
                    dealt.setdefault(zlib.crc32(term) % shards, []).append(term)
                for shard, terms in dealt.items():
                    terms.sort()
                    section = sections.setdefault(shard, [[], [], [], [], [], []])
                    for column, values in zip(
                        section,
                        ([group[0]], [group[1]], [len(terms)], terms, map(counts[group].__getitem__, terms), map(documents[group].__getitem__, terms)),
                        strict=True,
                    ):
                        column.extend(values)
            counts.clear()
            documents.clear()
            shards_here = list(sections)
            for lo in range(0, len(shards_here), 64):
                yield _run_rows([[shard, *sections.pop(shard)] for shard in shards_here[lo:lo + 64]])

        for batch in batches:
            for part in slices(batch, "text"):
                groups = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                for group, text in zip(groups, part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    terms = text.translate(TERM_BYTES).split()
                    if group not in counts:
                        counts[group], documents[group] = Counter(), Counter()
                    before = len(counts[group])
                    counts[group].update(terms)
                    documents[group].update(set(terms))
                    held += len(counts[group]) - before
                    if held >= block_entries:
                        yield from spill()
                        held = 0
        yield from spill()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return _groups_of(docs).select("lang", "source", text).mapInArrow(
        run,
        "shard int, langs array<string>, sources array<string>, sizes array<long>, terms array<string>, counts array<long>, documents array<long>",
    )


def _run_rows(rows: list[list]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], pa.list_(pa.binary()) if f.name == "terms" else f.type) for i, f in enumerate(RUN)]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, RUN, strict=True)], schema=RUN)


def _groups_of(docs: DataFrame) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.withColumns({"lang": name("lang"), "source": name("source")})


def merge_runs(runs: DataFrame) -> DataFrame:
    """Frequencies `lang, source, term, n, docs` from runs, merged per hash shard.

    A heap takes the groups of all runs of a shard in order; the ascending terms of one group are merged by a sort that starts from
    them as runs. Every group is spread over all shards by its
    terms, so no group, however large, is one task's. A task holds its shard's runs as Arrow arrays and unpacks a group at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, sections = None, []
        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for i, here in enumerate(columns[0].to_pylist()):
                if here != shard:
                    yield from _merged(sections)
                    shard, sections = here, []
                # Copied, so that a section does not keep its whole batch.
                sections.append(tuple(pa.concat_arrays([columns[c].slice(i, 1)]).flatten() for c in range(1, 7)))
        yield from _merged(sections)

    return runs.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        run, "lang string, source string, term string, n long, docs long"
    )


def _parts(section: tuple) -> Iterator[tuple]:
    """(group, terms, counts, documents) of one section, unpacked when asked for."""
    langs, sources, sizes, terms, counts, documents = section
    at = 0
    for lang, source, n in zip(langs.to_pylist(), sources.to_pylist(), sizes.to_pylist(), strict=True):
        yield (lang, source), *(c.slice(at, n) for c in (terms, counts, documents))
        at += n


def _merged(sections: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Entries of a shard, equal ones added up, in batches of about 50,000."""
    out: list[pa.RecordBatch] = []
    waiting = 0
    for group, parts in groupby(heapq.merge(*map(_parts, sections), key=itemgetter(0)), itemgetter(0)):
        runs = [p[1:] for p in parts]
        terms, counts, documents = (pa.concat_arrays([r[c] for r in runs]) for c in range(3))
        terms = terms.cast(pa.binary()).to_pylist()
        if len(runs) > 1:
            # The sort finds the runs, which ascend already, and merges them.
            order = sorted(range(len(terms)), key=terms.__getitem__)
            terms = [terms[i] for i in order]
            first = np.flatnonzero([True, *map(ne, terms[1:], terms)])
            counts, documents = (np.add.reduceat(c.to_numpy()[order], first) for c in (counts, documents))
            terms = [terms[i] for i in first.tolist()]
        names = [pa.array([group[i]] * len(terms), pa.string()) for i in (0, 1)]
        out.append(pa.RecordBatch.from_arrays(
            [*names, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts), pa.array(documents)],
            names=["lang", "source", "term", "n", "docs"],
        ))
        waiting += len(terms)
        if waiting >= 50_000:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out, waiting = [], 0
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def shares(counts: np.ndarray, total) -> np.ndarray:
    """1 + floor(10**9 (count + 2) / total), exact: in 64 bits where that suffices, in Python integers beyond."""
    if not len(counts) or counts.max() < (1 << 63) // ONE - 2:
        return 1 + (counts + 2) * ONE // total
    exact = np.asarray(total).astype(object) if isinstance(total, np.ndarray) else total
    return (1 + (counts.astype(object) + 2) * ONE // exact).astype(np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)); shares are at most 10**9 + 1, so squares fit 64 bits."""
    return (p - q) * (p - q) // (p + q)


class PairSums:
    """Divergences of all pairs of two blocks of sources, summed over a slice of the kept terms.

    A term that neither source holds adds the pair's base value. So all V terms are taken at that value, and postings are
    streamed as corrections to it: one for each source that holds a term, and one for each pair that shares it.
    """

    def __init__(self, left: list[tuple[str, int]], right: list[tuple[str, int]] | None, kept: int):
        self.same = right is None
        right = left if right is None else right
        self.names = [s for s, _ in left], [s for s, _ in right]
        self.index = [{s: i for i, s in enumerate(names)} for names in self.names]
        self.total = [np.array([n for _, n in side], np.int64) + 2 * kept for side in (left, right)]
        self.kept = kept
        zero = [shares(np.zeros(len(t), np.int64), t) if kept else np.ones(len(t), np.int64) for t in self.total]
        self.zero = zero
        self.base = distance(zero[0][:, None], zero[1][None, :])
        self.sums = np.zeros((len(left), len(right)), np.int64)

    def add(self, term: np.ndarray, source: list[str], count: np.ndarray) -> None:
        """Postings of whole terms, ordered by the term's number."""
        sides = []
        for side in (0, 1):
            at = np.array([self.index[side].get(s, -1) for s in source])
            here = at >= 0
            sides.append((term[here], at[here], count[here], shares(count[here], self.total[side][at[here]])))
        self._alone(sides[0], self.zero[1], self.base, self.sums)
        self._alone(sides[1], self.zero[0], self.base.T, self.sums.T)
        (lt, li, _, lp), (rt, ri, _, rp) = sides
        first, last = np.searchsorted(rt, lt), np.searchsorted(rt, lt, side="right")
        ends = np.cumsum(last - first)
        if not len(ends) or not ends[-1]:
            return
        cuts = np.searchsorted(ends, np.arange(0, ends[-1], PAIRS_AT_ONCE), side="left")
        for lo, hi in zip(cuts, [*cuts[1:], len(lt)], strict=True):
            width = (last - first)[lo:hi]
            left = np.repeat(np.arange(lo, hi), width)
            right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[lo:hi], width)
            if self.same:
                once = li[left] < ri[right]
                left, right = left[once], right[once]
            i, j, p, q = li[left], ri[right], lp[left], rp[right]
            change = distance(p, q) - distance(p, self.zero[1][j]) - distance(self.zero[0][i], q) + self.base[i, j]
            np.add.at(self.sums, (i, j), change)

    @staticmethod
    def _alone(side: tuple, zero: np.ndarray, base: np.ndarray, sums: np.ndarray) -> None:
        """Corrections as if no source of the other side held the terms; equal counts of a source are taken at once."""
        _, at, count, share = side
        if not len(at):
            return
        order = np.lexsort((count, at))
        at, share = at[order], share[order]
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (share[1:] != share[:-1])))
        times = np.diff(np.append(new, len(at)))
        at, share = at[new], share[new]
        step = max(1, PAIRS_AT_ONCE // max(1, len(zero)))
        for lo in range(0, len(at), step):
            i, m = at[lo:lo + step], times[lo:lo + step, None]
            np.add.at(sums, i, m * (distance(share[lo:lo + step, None], zero[None, :]) - base[i]))

    def rows(self, first_slice: bool) -> Iterator[tuple[str, str, int]]:
        sums = self.sums + (self.base * self.kept if first_slice else 0)
        wanted = np.triu(np.ones(sums.shape, bool), 1) if self.same else np.ones(sums.shape, bool)
        for i, j in zip(*np.nonzero(wanted if first_slice else wanted & (sums != 0)), strict=True):
            yield self.names[0][i], self.names[1][j], int(sums[i, j])


def _correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows sorted by lang, a, b, slice, term, source; the slice's sources stand first, with a null term."""
    key, left, right, sums = None, [], [], None
    terms, sources, counts, number = [], [], [], 0

    def flush() -> None:
        if terms:
            sums.add(np.array(terms), sources, np.array(counts, np.int64))
            terms.clear()
            sources.clear()
            counts.clear()

    def close(out: list) -> None:
        if key is None:
            return
        made = sums or PairSums(left, right if key[1] != key[2] else None, kept)
        out.extend((key[0], *r) for r in made.rows(key[3] == 0))

    kept, last = 0, None
    for batch in batches:
        out: list[tuple] = []
        for lang, a, b, part, own, term, source, n, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (lang, a, b, part) != key:
                flush()
                close(out)
                key, left, right, sums, kept, last, number = (lang, a, b, part), [], [], None, v, None, 0
            if term is None:
                (left if own == a else right).append((source, n))
                continue
            if sums is None:
                sums = PairSums(left, right if a != b else None, kept)
            if term != last:
                if len(terms) >= SLICE_POSTINGS:
                    flush()
                last, number = term, number + 1
            terms.append(number)
            sources.append(source)
            counts.append(n)
        yield _pair_rows(out)
    out = []
    flush()
    close(out)
    yield _pair_rows(out)


def _pair_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["lang", "a", "b", "value"])


def pair_values(postings: DataFrame, groups: DataFrame, postings_per_task: int = SLICE_POSTINGS, block: int = SOURCE_BLOCK) -> DataFrame:
    """`lang, a, b, value` of every pair of sources of a language, each pair once.

    Work is dealt by (lang, block of sources, block of sources, slice of terms): a task holds two blocks of sources and streams the
    postings of its slice. Its sums per pair, not terms, are shuffled and added up.
    """
    slices_of_terms = max(1, -(-postings.count() // postings_per_task))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = groups.join(small_side(blocks), "lang")
    own = F.pmod(F.xxhash64("source"), "blocks").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pair = [F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")]
    sides = placed.select("lang", "source", "n", "v", own.alias("own"), other).select(
        "lang", *pair, F.explode(F.sequence(F.lit(0), F.lit(slices_of_terms - 1))).alias("slice"), "own",
        F.lit(None).cast("string").alias("term"), "source", "n", "v",
    )
    stream = postings.join(small_side(blocks), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.lit(slices_of_terms)).cast("int").alias("slice"), own.alias("own"), "term", "source", "n",
        "v", other,
    ).select("lang", *pair, "slice", "own", "term", "source", "n", "v")
    key = ["lang", "a", "b", "slice"]
    return sides.unionByName(stream).repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("term"), "source").mapInArrow(
        _correct, "lang string, a string, b string, value long"
    ).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS, block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """How the sources of each language differ: `lang, source, part, item, value, rank`.

    Terms are runs of ASCII letters, lower-cased, and characters beyond ASCII; a language keeps those in at least `min_documents`
    of its documents. A group's share of a term is p = 1 + floor(10**9 (count + 2) / (N + 2 V)), N its occurrences of the V
    kept terms, and two shares differ by floor((p - q)**2 / (p + q)). Part `pair` lists every other source of the language
    with the sum over all kept terms; part `term` the `top_terms` terms whose share is above the language's, by how much it is.

    Documents are read once. Runs of at most `block_entries` entries are merged to frequencies per hash shard; languages'
    document counts are sums of their sources', as a document has one source. Frequencies are shuffled once by (lang, term).

    Null text, lang and source count as empty. Groups without terms take part in pairs; a language without kept terms has pairs of
    value 0 and no terms. Repeated documents count each. Ties go to the item smaller in UTF-8. An empty table gives no rows.
    """
    shards = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frequencies = stored(merge_runs(index_runs(docs, shards, block_entries)), "frequencies").repartition("lang", "term")
    kept = frequencies.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).filter(
        F.col("docs") >= min_documents
    ).drop("docs")
    postings = stored(frequencies.drop("docs").join(kept.hint("merge"), ["lang", "term"]), "postings")
    terms = postings.select("lang", "term", "total").groupBy("lang", "term").agg(F.first("total").alias("total"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    used = postings.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = stored(
        _groups_of(docs).select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left").select(
            "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"),
            F.coalesce("lang_n", F.lit(0)).alias("lang_n"),
        ),
        "groups",
    )
    order = lambda item: Window.partitionBy("lang", "source").orderBy(F.desc("value"), item)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    of_group = small_side(groups.select("lang", "source", F.col("n").alias("group_n"), "v", "lang_n"))
    weighed = postings.join(of_group, ["lang", "source"])
    pairs = pair_values(weighed.select("lang", "source", "term", "n", "v"), groups.select("lang", "source", "n", "v"))
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    pair_part = both.select("*", F.lit("pair").alias("part"), F.row_number().over(order("item")).cast("int").alias("rank"))
    share = "1 + (cast({} + 2 as decimal(20, 0)) * 1000000000BD) div cast({} + 2 * v as decimal(20, 0))"
    above = weighed.select(
        "lang", "source", F.col("term").alias("item"), F.expr(share.format("n", "group_n")).alias("p"),
        F.expr(share.format("total", "lang_n")).alias("q"),
    ).filter("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    term_part = above.withColumn("rank", F.row_number().over(order("item")).cast("int")).filter(F.col("rank") <= top_terms).withColumn(
        "part", F.lit("term")
    )
    return pair_part.select(*columns).unionByName(term_part.select(*columns))

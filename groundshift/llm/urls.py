"""URL verdicts: rules, Viterbi segmentation of names into words, multinomial naive Bayes (operator 13)."""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundshift.llm.tables import release_worker_state, slices, stored, worker_state

# Rules (verdict, host, path); fixed values of the query.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# A word of the dictionary makes up at least this share of all words, so there are at most 1 / MIN_SHARE of them.
MIN_SHARE = 2e-6
LONGEST_WORD = 24
# Naive Bayes counts tokens by hash in this many buckets, whatever the size of the corpus.
BUCKETS = 1 << 18
HELD_ENTRIES = 200_000
CACHED_NAMES = 50_000
URL = r"://([^/?#]*)([^?#]*)"
MARKUP = re.compile(rb"<[^>]*>|&[#a-zA-Z0-9]+;")
PARTS = re.compile(r"[0-9]+|[^\W\d_]+")
LETTERS = bytes(x | 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x > 127 else 32 for x in range(256))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both empty for null and for text without `://`."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return F.translate(part(1), upper, lower), part(2)


def by_rules(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    pick = lambda value: F.coalesce(*[F.when(fits(r), F.lit(value(r))) for r in ordered], F.lit(None).cast("string"))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def word_counts(texts: DataFrame) -> DataFrame:
    """`word, n` over all rows of a one-column table of marked-up text; tags and character references are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in slices(batch, batch.schema.names[0]):
                for page in part.column(0).cast(pa.binary()).to_pylist():
                    held.update(w for w in MARKUP.sub(b" ", page or b"").translate(LETTERS).split() if len(w) <= 4 * LONGEST_WORD)
                    if len(held) >= HELD_ENTRIES:
                        yield out()
                        held.clear()
        yield out()

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_dictionary(texts: DataFrame, min_share: float = MIN_SHARE) -> dict[str, float]:
    """Log probabilities of the words that make up at least `min_share` of all words, at most 1 / min_share of them.

    All rows are counted. The threshold is a share, so it means the same at every size, and it bounds what reaches the driver.
    """
    counts = stored(word_counts(texts).filter(F.char_length("word") <= LONGEST_WORD), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") >= min_share * total).toArrow()
    words, n = rows.column("word").to_pylist(), rows.column("n").to_pylist()
    return {w: math.log(c / total) for w, c in zip(words, n, strict=True)}


class Segmenter(dict):
    """Names to their most probable words under a unigram model, found by Viterbi and remembered."""

    def __init__(self, words: dict[str, float]):
        super().__init__()
        self.words = words
        # An unknown run is less probable than any known word, and ten times less with every further letter.
        self.unknown = min(words.values(), default=0.0)
        self.longest = max(map(len, words), default=1)

    def __missing__(self, name: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            top, at = -math.inf, end - 1
            for start in range(max(0, end - max(self.longest, LONGEST_WORD)), end):
                known = self.words.get(name[start:end])
                score = best[start] + (self.unknown - math.log(10) * (end - start) if known is None else known)
                if score > top:
                    top, at = score, start
            best.append(top)
            back.append(at)
        found, end = [], len(name)
        while end:
            found.append(name[back[end]:end])
            end = back[end]
        words = tuple(reversed(found))
        if len(self) < CACHED_NAMES:
            self[name] = words
        return words

    def tokens(self, host: str, path: str, skipped: frozenset[str]) -> Iterator[str]:
        """Words of host and path, told apart by a mark; a number counts by its length; labels and segments in rules are left out."""
        for mark, text, cut in (("h:", host, "."), ("p:", path.lower(), "/")):
            for part in text.split(cut):
                if part in skipped:
                    continue
                for name in PARTS.findall(part):
                    if name[0].isdigit():
                        yield f"{mark}#{min(len(name), 9)}"
                    else:
                        for word in self[name]:
                            yield mark + word


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode(errors="surrogatepass")) % BUCKETS


def rule_words(rules) -> frozenset[str]:
    """Host labels and path segments that rules test: they give labelled rows away and say nothing about others."""
    return frozenset(w for _, host, path in rules for w in [*host.split("."), *path.split("/")] if w)


def fit_bayes(labelled: DataFrame, words: dict[str, float], skipped: frozenset[str]) -> np.ndarray:
    """Log odds of `block` against `allow` per token bucket, the prior last, from all rows of `host, path, block`.

    Multinomial naive Bayes with one added count per bucket in use. Tasks add up arrays of `BUCKETS` counts, and at most that many
    sums reach the driver. Without rows of both classes every odds is 0.
    """
    shipped, state = labelled.sparkSession.sparkContext.broadcast(words), f"segmenter_{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = worker_state(state, lambda: Segmenter(shipped.value))
        counts = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for host, path, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[int(block), BUCKETS] += 1
                for token in segmenter.tokens(host, path, skipped):
                    counts[int(block), _bucket(token)] += 1
        used = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(counts[0, used]), pa.array(counts[1, used])], names=["bucket", "allow", "block"]
        )

    sums = labelled.mapInArrow(run, "bucket int, allow long, block long").groupBy("bucket").agg(
        F.sum("allow").alias("allow"), F.sum("block").alias("block")
    ).toArrow()
    odds = np.zeros(BUCKETS + 1)
    at = sums.column("bucket").to_numpy()
    allow, block = (sums.column(n).to_numpy().astype(np.float64) for n in ("allow", "block"))
    prior = at == BUCKETS
    if not prior.any() or not allow[prior][0] or not block[prior][0]:
        return odds
    odds[BUCKETS] = math.log(block[prior][0] / allow[prior][0])
    tokens, seen = ~prior, int((~prior).sum())
    share = lambda n: np.log((n[tokens] + 1) / (n[tokens].sum() + seen + 1))
    odds[at[tokens]] = share(block) - share(allow)
    return odds


def judge_urls(
    pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", words_from: DataFrame | None = None,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """A verdict on every URL: `page_id, host, path, rule, verdict, score, words`.

    A rule (verdict, host, path) fits its host and all subdomains where the URL's path starts with the rule's; the longest
    decides. Other URLs are scored by naive Bayes, fitted on all URLs that a rule decides, over the words into which Viterbi splits
    host and path; what the rules themselves test is no feature. `words_from` is a one-column table of text whose words make the
    dictionary, by default the URLs. `score` is the probability of `block`, `words` what was scored, joined by blanks.

    Reads the text once to count words and the URLs twice, all row-wise; only word counts are shuffled. Rules are a short list and
    part of the plan.

    Null URLs and those without `://` have empty host and path, fit no rule and take the class that prevails among labelled rows.
    A tie is allowed, and so is everything no rule fits if rules decide for one class only. Null ids stay; repeated rows are
    judged each; an empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("*", rule.alias("rule"), verdict.alias("verdict"))
    skipped = rule_words(rules)
    words = fit_dictionary(pages.select(F.col(url_col).cast("string")) if words_from is None else words_from, min_share)
    labelled = ruled.filter(F.col("verdict").isNotNull()).select("host", "path", (F.col("verdict") == "block").alias("block"))
    odds = fit_bayes(labelled, words, skipped)
    shipped, state = pages.sparkSession.sparkContext.broadcast((words, odds)), f"segmenter_{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = worker_state(state, lambda: Segmenter(shipped.value[0]))
        weights = shipped.value[1]
        for batch in batches:
            scores, found = [], []
            for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens = list(segmenter.tokens(h, p, skipped))
                z = weights[BUCKETS] + math.fsum(weights[_bucket(t)] for t in tokens)
                scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
                found.append(" ".join(t[2:] for t in tokens))
            method = ["block" if s > 0.5 else "allow" for s in scores]
            given = batch.column(4)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4], pa.compute.coalesce(given, pa.array(method, given.type)), pa.array(scores, pa.float64()),
                    pa.array(found, pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict", "score", "words"],
            )

    id_type = ruled.schema["page_id"].dataType.simpleString()
    return ruled.mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, verdict string, score double, words string")

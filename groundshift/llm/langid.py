"""Language identification with averaged hashed subword embeddings (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundshift.llm.tables import release_worker_state, slices

BUCKETS = 1 << 14
ORDERS = (2, 3, 4)
DIM = 16
UNKNOWN = "und"
REJECT_SHARE = 0.1
# A text may hold so many times the share of unlearned n-grams of any calibration row, and this share at least. Shares are
# taken over so many n-grams more than a text has, so a few unlearned ones do not reject a short text.
UNKNOWN_TIMES = 4.0
UNKNOWN_LEAST = 0.02
UNKNOWN_EXTRA = 50
# Multiplier of the bucket hash, an odd number near 2**32 divided by the golden ratio.
MIX = np.uint32(2654435769)
GAP = b"     "


def _byte_classes() -> np.ndarray:
    """ASCII letters lower-cased, other ASCII as space, bytes of longer characters as they are."""
    table = np.full(256, 32, dtype=np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n-gram order: the bucket of the n-gram at every byte of the joined texts (0: none), and the text starts.

    N-grams run over lower-cased UTF-8 bytes with one space around words. Those that hold two adjacent spaces are none,
    so n-grams never span two texts.
    """
    raw = [t.lower().encode() for t in texts]
    joined = np.frombuffer(GAP + GAP.join(raw) + GAP, dtype=np.uint8)
    lengths = np.array([len(r) + len(GAP) for r in raw], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths + len(GAP) - 1  # the space before each text belongs to it
    chars = _byte_classes()[joined].astype(np.uint32)
    gap = (chars[:-1] == 32) & (chars[1:] == 32)
    for n in ORDERS:
        size = len(chars) - n + 1
        code, bad = np.zeros(size, np.uint32), np.zeros(size, bool)
        for i in range(n):
            code = (code << np.uint32(8)) | chars[i:i + size]
            if i:
                bad |= gap[i - 1:i - 1 + size]
        bucket = (code * MIX + np.uint32(n) * np.uint32(40503)) >> np.uint32(18)
        bucket[bucket == 0] = 1
        bucket[bad] = 0
        yield bucket, starts


@dataclass
class Model:
    """Embedding and softmax weights, temperature and rejection thresholds.

    `learned` marks the buckets of n-grams met in training; texts with a larger share of others than `unknown_most` are
    rejected.
    """

    languages: list[str]
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    learned: np.ndarray | None = None
    unknown_most: float = 1.0
    table: np.ndarray = field(init=False)

    def __post_init__(self):
        # Averaging and the linear layer commute, so the cheaper of the two tables is gathered per n-gram.
        folded = len(self.languages) <= self.embedding.shape[1]
        self.table = np.ascontiguousarray((self.embedding @ self.weights if folded else self.embedding).T)
        self.table[:, 0] = 0.0
        self.folded = folded

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and the share of n-grams that were not met in training."""
        sums, counts, unknown = np.zeros((len(texts), len(self.table))), np.zeros(len(texts)), np.zeros(len(texts))
        if self.learned is not None:
            strange = ~self.learned
            strange[0] = False
        for bucket, starts in subwords(texts):
            counts += np.add.reduceat((bucket > 0).astype(np.int32), starts)
            if self.learned is not None:
                unknown += np.add.reduceat(strange[bucket].astype(np.int32), starts)
            for j, row in enumerate(self.table):
                sums[:, j] += np.add.reduceat(row[bucket], starts, dtype=np.float64)
        mean = sums / np.maximum(counts, 1)[:, None]
        return (mean if self.folded else mean @ self.weights) + self.bias, unknown / (counts + UNKNOWN_EXTRA)

    def logits(self, texts: list[str]) -> np.ndarray:
        return self.measure(texts)[0]

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index and calibrated probability of the best language, and whether the text is rejected."""
        z, unknown = self.measure(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        score = p[np.arange(len(p)), best]
        return best, score, (score < self.reject_below) | (unknown > self.unknown_most)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index and calibrated probability of the best language."""
        return self.judge(texts)[:2]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Bags:
    """Bucket shares of many texts, kept as the buckets that occur; `bags[rows]` gives some rows in full."""

    def __init__(self, buckets: list[np.ndarray], counts: list[np.ndarray], width: int = BUCKETS):
        self.buckets, self.width = buckets, width
        self.sizes = np.array([c.sum() for c in counts], np.float32)
        self.shares = [c.astype(np.float32) / max(np.float32(1), n) for c, n in zip(counts, self.sizes, strict=True)]

    def __len__(self) -> int:
        return len(self.buckets)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.width), np.float32)
        for n, i in enumerate(rows):
            out[n, self.buckets[i]] = self.shares[i]
        return out

    def times(self, rows: np.ndarray, matrix: np.ndarray, at_once: int = 512) -> np.ndarray:
        """The product of some rows with a matrix, a few rows at once."""
        parts = [self[rows[lo:lo + at_once]] @ matrix for lo in range(0, len(rows), at_once)]
        return np.concatenate(parts) if parts else np.zeros((0, *matrix.shape[1:]), np.float32)


def train(x: Bags, y: np.ndarray, languages: list[str], epochs: int = 30, rate: float = 8.0, batch: int = 32) -> Model:
    """Stochastic gradient descent over rows of bucket shares; one row in five is kept for calibration.

    Rows are cut in two at a fixed shuffle. The temperature minimises the calibration rows' loss; the threshold lies a tenth
    of the way from a blind guess to the lowest probability of a calibration row that is predicted rightly. So texts
    are rejected by it only if they hardly look like one language more than like any other; texts that mix two learned
    languages stay. Unlearned scripts and languages show in n-grams that no training row holds: the calibration rows say
    what share of those learned languages have, and texts with several times as many are rejected.
    """
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    held = order[: len(x) // 5]
    fit = order[len(x) // 5:]
    n = len(languages)
    embedding = rng.normal(0, 1 / DIM, (x.width, DIM)).astype(np.float32)
    weights, bias = rng.normal(0, 0.5, (DIM, n)).astype(np.float32), np.zeros(n, np.float32)
    # Centre the classes: rare languages weigh as much as frequent ones.
    share = np.bincount(y[fit], minlength=n) / max(1, len(fit))
    balance = (1 / np.maximum(share, 1e-9) / n).clip(0, 20).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(fit), batch):
            rows = rng.choice(fit, min(batch, len(fit)), replace=False)
            xb = x[rows]
            hidden = xb @ embedding
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error *= balance[y[rows]][:, None] / len(rows)
            back = error @ weights.T
            weights -= step * (hidden.T @ error)
            bias -= 0.1 * step * error.sum(axis=0)
            used = np.flatnonzero(xb.any(axis=0))
            embedding[used] -= step * 20 * (xb[:, used].T @ back)
    learned = np.zeros(x.width, bool)
    for row in fit:
        learned[x.buckets[row]] = True
    model = Model(languages, embedding, weights, bias, learned=learned)
    if len(held):
        unknown = x.times(held, (~learned).astype(np.float32))
        unknown = unknown * (x.sizes[held] / (x.sizes[held] + UNKNOWN_EXTRA))
        model.unknown_most = max(UNKNOWN_LEAST, UNKNOWN_TIMES * float(unknown.max()))
        z = x.times(held, embedding) @ weights + bias
        scales = np.geomspace(0.02, 20, 200)
        losses = [-np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in scales]
        model.temperature = float(scales[int(np.argmin(losses))])
        p = softmax(z / model.temperature)
        right = p.argmax(axis=1) == y[held]
        lowest = float(p.max(axis=1)[right].min()) if right.any() else 1 / n
        model.reject_below = 1 / n + REJECT_SHARE * max(0.0, lowest - 1 / n) if n > 1 else 0.0
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse bucket counts of each text."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column(1).to_pylist()
            sums = [np.zeros(0, np.int64)] * len(texts)
            per_order = [(b, np.append(s, len(b))) for b, s in subwords(texts)]
            for i in range(len(texts)):
                sums[i] = np.bincount(np.concatenate([b[s[i]:s[i + 1]] for b, s in per_order]), minlength=BUCKETS)
                sums[i][0] = 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([np.flatnonzero(s) for s in sums], pa.list_(pa.int32())),
                    pa.array([s[np.flatnonzero(s)] for s in sums], pa.list_(pa.int32())),
                ],
                names=["lang", "bucket", "n"],
            )


def fit_languages(labelled: DataFrame, train_rows: int = 2000, least_rows: int = 5) -> Model | None:
    """Train on `lang, text, key` rows; about `train_rows` of them, alike for each language, are used.

    The sample is chosen by a hash of the key, the same at every run; it is the one bound here, a parameter. With so many
    languages that less than `least_rows` rows of each would do, about that many are used of each, and one at least. Bucket
    counts of sampled texts (whole texts, a few thousand numbers each) reach the driver. Every language of a labelled row is
    learned, however rare; the model has 64 numbers for each. None if there is no labelled row.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("first")).toArrow()
    if not sizes.num_rows:
        return None
    each = max(least_rows, train_rows // sizes.num_rows)
    shares = F.broadcast(usable.sparkSession.createDataFrame(sizes)).select(
        "lang", F.greatest(F.lit(each) / F.col("n"), F.col("first") + F.lit(0.5 / (1 << 30))).alias("share")
    )
    sample = usable.join(shares, "lang").filter(draw < F.col("share")).select("lang", "text")
    # Arrow keeps the counts as packed numbers on the driver.
    bags = sample.mapInArrow(_bags, "lang string, bucket array<int>, n array<int>").toArrow()
    if not bags.num_rows:
        return None
    langs = bags.column("lang").to_pylist()
    lists = [bags.column(c).combine_chunks() for c in ("bucket", "n")]
    (at, where), (_, count) = [
        (np.asarray(c.value_lengths(), dtype=np.int64), np.asarray(c.flatten(), dtype=np.int32)) for c in lists
    ]
    ends = np.cumsum(at)
    spans = [slice(e - m, e) for e, m in zip(ends.tolist(), at.tolist(), strict=True)]
    # The order of rows that tasks deliver may differ, their contents do not.
    # Big-endian bytes compare like the numbers.
    packed = lambda a, i: a[spans[i]].astype(">i4").tobytes()
    order = sorted(range(len(langs)), key=lambda i: (langs[i], at[i], packed(where, i), packed(count, i)))
    languages = sorted(set(langs))
    number = {lang: i for i, lang in enumerate(languages)}
    x = Bags([where[spans[i]] for i in order], [count[spans[i]] for i in order])
    return train(x, np.array([number[langs[i]] for i in order]), languages)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `lang_pred, score, rejected` for every whole text.

    `score` is the calibrated probability of the best language. Rejected are texts below the model's threshold, texts with
    too many n-grams that no training row holds (other scripts and languages, noise; a language whose n-grams nearly all
    occur in learned ones passes), and texts that are null or have no letter, which get `und` and score 0 (as do all texts if nothing was learned).
    Row-wise, no shuffle; repeated rows are judged each, an empty table gives no rows.
    """
    source = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(n).to_pylist()
                known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
                lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if known:
                    for i, b, s, r in zip(known, *model.judge([texts[i] for i in known]), strict=True):
                        lang[i], score[i], rejected[i] = model.languages[b], float(s), bool(r)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[*part.schema.names[:n], "lang_pred", "score", "rejected"],
                )

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:n])
    found = source.mapInArrow(run, f"{kept}, lang_pred string, score double, rejected boolean")
    return found.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "rejected")


def fold(doc_id: Column) -> Column:
    """The fold of a document, 0 to 4; fold 0 is held out. Null ids are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5

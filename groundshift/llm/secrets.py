"""Secret scanning through a trigram index (operator 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundshift.llm.tables import slices, worker_state

try:  # the parser of `re` moved in Python 3.11
    from re import _parser as sre
except ImportError:  # pragma: no cover
    import sre_parse as sre


def any_case(words: str) -> str:
    """ASCII letters of a pattern in either case, without the Unicode folds of IGNORECASE."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern`, kept if `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base kinds, in the order of their listing; their patterns and lengths are fixed values.
BASE_RULES = (
    Rule("assign", "(" + any_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
# Formats of well-known credentials, added to the base kinds.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hub_token", r"(?:ghp|gho|ghs|ghu|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", any_case("authorization") + r":\x20*" + any_case("bearer") + r"\x20+[A-Za-z0-9._~+/=-]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (every text), a set of strings all of which must occur (AND), or ("or", queries).
MAX_STRINGS = 64


def _fold(char: str) -> str:
    return char.lower() if char.isascii() else char


def _strings(tree) -> tuple[set[str] | None, list]:
    """For a parsed pattern: the strings it can match exactly, if few, and the conditions found on the way.

    Works bottom up: adjacent exact sets are multiplied; when a part is not exact or the product grows beyond
    MAX_STRINGS, what was gathered so far becomes a condition "one of these strings occurs".
    """
    needs: list[frozenset[str]] = []
    run: set[str] | None = {""}
    whole = True

    def flush() -> None:
        nonlocal run
        if run and min(map(len, run)) >= 3:
            needs.append(frozenset(run))
        run = {""}

    for op, arg in tree:
        name = str(op)
        exact: set[str] | None = None
        if name == "LITERAL":
            exact = {_fold(chr(arg))}
        elif name == "IN":
            chars = [chr(a) for o, a in arg if str(o) == "LITERAL"]
            exact = {_fold(c) for c in chars} if len(chars) == len(arg) else None
        elif name == "SUBPATTERN":
            exact, inner = _strings(arg[-1])
            needs += inner
        elif name == "BRANCH":
            options = [_strings(branch) for branch in arg[1]]
            if all(e is not None for e, _ in options):
                exact = reduce(set.union, (e for e, _ in options))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, item = arg
            inner_exact, inner = _strings(item)
            needs += inner if low else []
            if (low, high) == (0, 1) and inner_exact is not None:
                exact = inner_exact | {""}
            elif low == high and inner_exact is not None and low <= 4:
                exact = {""}
                for _ in range(low):
                    exact = {a + b for a in exact for b in inner_exact}
        elif name == "AT":
            continue
        if exact is None:
            whole = False
            flush()
            continue
        if len(run) * len(exact) > MAX_STRINGS:
            whole = False
            flush()
        run = {a + b for a in run for b in exact}
    if whole:
        return run, needs
    flush()
    return None, needs


def trigram_query(pattern: str) -> tuple[tuple[frozenset[str], ...], ...]:
    """The Boolean trigram query of a pattern: an AND of ORs of ANDs of lower-cased trigrams; () is "every text".

    Each outer entry is one condition; it holds if all trigrams of one of its alternatives occur. A text that fails a
    condition cannot match. Trigrams are over UTF-8 bytes, written here as Latin-1 text.
    """
    exact, needs = _strings(sre.parse(pattern))
    if exact is not None and exact and min(map(len, exact)) >= 3:
        needs = [*needs, frozenset(exact)]
    query = []
    for strings in needs:
        options = set()
        for s in strings:
            raw = s.encode().decode("latin-1")
            options.add(frozenset(raw[i:i + 3] for i in range(len(raw) - 2)))
        query.append(tuple(sorted(options, key=sorted)))
    return tuple(query)


class Scanner:
    """Compiled rules, their trigram queries and the table from trigram codes to posting lists."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.compiled = [re.compile(r.pattern) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.trigrams = sorted({t for q in self.queries for cond in q for alt in cond for t in alt})
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.slot = np.zeros(1 << 24, dtype=np.uint16)
        for n, t in enumerate(self.trigrams, start=1):
            a, b, c = t.encode("latin-1")
            self.slot[a << 16 | b << 8 | c] = n
        # Texts without any of the pair codes that start a trigram of a query are most of a corpus.
        self.number = {t: n for n, t in enumerate(self.trigrams, start=1)}

    def candidates(self, data: np.ndarray, starts: np.ndarray) -> list[np.ndarray | None]:
        """Per rule the rows of a segment that its query admits; None for every row."""
        low = self.fold[data].astype(np.uint32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.empty(0, np.uint32)
        slot = self.slot[code]
        hits = np.flatnonzero(slot)
        row = np.searchsorted(starts, hits, side="right") - 1
        inside = hits + 2 < np.append(starts[1:], len(data))[row]
        n_rows = len(starts)
        pairs = np.unique(slot[hits[inside]].astype(np.int64) * n_rows + row[inside])
        lists, rows = pairs // n_rows, pairs % n_rows
        edges = np.searchsorted(lists, np.arange(len(self.trigrams) + 2))
        posting = lambda t: rows[edges[self.number[t]]: edges[self.number[t] + 1]]
        meet = lambda a, b: np.intersect1d(a, b, assume_unique=True)
        admitted = []
        for query in self.queries:
            conditions = [
                np.unique(np.concatenate([reduce(meet, [posting(t) for t in sorted(alt)]) for alt in cond])) for cond in query
            ]
            admitted.append(reduce(meet, conditions) if conditions else None)
        return admitted

    def spans(self, n: int, text: str) -> Iterator[tuple[int, int]]:
        """Matches of rule n that pass its length, leftmost and not overlapping within the rule."""
        rule = self.rules[n]
        for m in self.compiled[n].finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                yield m.start(), m.end()


def _scan(docs: DataFrame, rules: tuple[Rule, ...], text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns as keep_0, keep_1, ... and the spans of every row."""
    source = docs.select(
        *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)],
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    kept = [f"keep_{i}" for i in range(len(keep))]
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    key = f"scanner_{abs(hash(rules))}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = worker_state(key, lambda: Scanner(rules))
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                raw = [t.encode() for t in texts]
                lengths = np.array([len(r) for r in raw])
                data = np.frombuffer(b"".join(raw), dtype=np.uint8)
                # Empty texts share their start with the next one; they hold no trigram and no match.
                full = np.flatnonzero(lengths)
                starts = (np.cumsum(lengths) - lengths)[full]
                found: list[list] = [[] for _ in texts]
                admitted = scanner.candidates(data, starts) if len(full) else []
                for n, rows in enumerate(admitted):
                    for i in full if rows is None else full[rows]:
                        found[i] += [(s, n, e) for s, e in scanner.spans(n, texts[i])]
                spans = [[{"start": s, "end": e, "kind": rules[n].kind} for s, n, e in sorted(f)] for f in found]
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, span_type)], names=[*kept, "spans"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "text")
    return source.mapInArrow(scan, f"{fields}, spans array<struct<start: int, end: int, kind: string>>")


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All secrets of every text: `doc_id` and `spans array<struct<start, end, kind>>`.

    Spans are code points, end exclusive, ordered by start, then by the order of the rules. Each slice of some
    megabytes of texts is a segment with its own inverted index: postings of those trigrams that some rule asks for,
    over the folded bytes of whole texts. A rule's Boolean query is answered by intersecting postings, and only admitted
    texts are searched with its pattern; rules without mandatory trigrams (long hexadecimal runs) search every text.
    Rows never leave their partition, so there is no shuffle and no skew.

    Null and empty texts have no spans, repeated rows are scanned each, an empty table gives no rows.
    """
    return _scan(docs, rules, text_col, (id_col,)).withColumnRenamed("keep_0", "doc_id")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every found span replaced by `[kind]`; overlapping spans become one mark.

    A mark names the first kind of a run of overlapping spans. Null texts stay null.
    """
    spotted = _scan(docs, rules, text_col, tuple(docs.columns))
    raw = F.col(f"keep_{docs.columns.index(text_col)}")
    # Fold the ordered spans into (text so far, end of what is copied); texts without spans are untouched.
    folded = F.aggregate(
        "spans", F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                F.concat(acc["done"], F.substr(raw, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("done"),
                s["end"].alias("at"),
            ),
        ).otherwise(F.struct(acc["done"].alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))),
    )
    text = F.when(F.size("spans") == 0, raw).otherwise(F.concat(folded["done"], F.substr(raw, folded["at"] + 1)))
    return spotted.select(*[(text if c == text_col else F.col(f"keep_{i}")).alias(c) for i, c in enumerate(docs.columns)])

"""Main text of web pages by maximum-scoring subsequence (operator 5)."""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundshift.llm.tables import slices

# Elements that hold no page text, whatever their content: scripts, styles, embedded objects and forms.
SKIPPED = frozenset(
    "script style noscript template iframe object svg math canvas audio video form button select textarea input label head title".split()
)
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
# Elements that only group others: their class, id and role say what they hold, their name does not.
CONTAINERS = frozenset("html body div section center ul ol dl table tbody thead tr td th form fieldset figure".split())
LANDMARKS = frozenset("article main nav aside footer header menu dialog".split())
CONTENT = frozenset("article main".split())
# What is believed of landmarks and of whole class, id and role names before pages are seen, as log odds.
BELIEF = 8.0
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement banner sponsored promo menu nav navbar navigation breadcrumb breadcrumbs sidebar footer "
    "header masthead cookie cookies consent notice gdpr popup modal newsletter subscribe signup login share sharing social related "
    "recommended comment comments respond disqus replies pagination pager toolbar complementary contentinfo search hidden".split()
)
# Weights where no page is labelled.
DEFAULT_WEIGHTS = {"word": 1.0, "tag": -0.1, "link": -2.0}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"""(?:\s|^)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def belief(key: str) -> float:
    """Log odds of a key that no labelled page has shown; a joined name counts if all its parts do."""
    name = key[1:]
    if key[0] == "<":
        return BELIEF if name in CONTENT else -BELIEF
    parts = [w for w in re.split(r"[-_]+", name) if w]
    return -BELIEF if key[0] == "@" and parts and UNLIKELY.issuperset(parts) else 0.0


def section_keys(name: str, attributes: str, in_article: bool) -> tuple[str, ...]:
    """Keys of an element that may decide about all it holds: its landmark name and its whole class, id and role names."""
    if name in LANDMARKS and not (name == "header" and in_article):
        keys = [f"<{name}"]
    elif name in CONTAINERS or name in LANDMARKS:
        keys = []
    else:
        return ()  # a paragraph or heading is what its surroundings are
    if attributes and name not in ("html", "body"):
        if HIDDEN.search(attributes):
            keys.append("@hidden")
        for m in NAMES.finditer(attributes):
            keys += [f"@{w}" for w in m[1].strip("\"'").lower().split()]
    return tuple(dict.fromkeys(keys))


def tokens(page: str) -> Iterator[tuple[str, str, str, tuple, bool]]:
    """(kind, value, block, sections, linked): text runs as ("text", raw text), tags as ("tag", name), outside skipped elements.

    `block` is the name of the innermost text-level block around a text; `sections` has the keys of the elements around it,
    innermost first, as a linked list (keys, outer); `linked` says that it stands in a link.
    """
    at, n = 0, len(page)
    # Open elements: name, skipped, block, sections, linked, inside an article. Each knows what it takes from those around it.
    stack: list[tuple] = [("", False, "", None, False, False)]
    opened: Counter = Counter()

    def close(name: str) -> None:
        while True:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == name:
                return

    while at < n:
        m = TOKEN.search(page, at)
        end = n if m is None else m.start()
        _, skipped, block, sections, linked, _ = stack[-1]
        if end > at and not skipped:
            yield "text", page[at:end], block, sections, linked
        if m is None:
            return
        at = m.end()
        if m[2] is None:
            continue
        name, attributes = m[2].lower(), m[3]
        if m[1]:
            if opened[name]:
                close(name)
            if not stack[-1][1] and name not in SKIPPED:
                yield "tag", name, "", None, False
            continue
        if name in RAW and not attributes.rstrip().endswith("/"):
            found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = found.end() if found else n
            continue
        if name not in INLINE and stack[-1][0] == "p":
            close("p")  # a block ends an open paragraph
        if name in ("li", "dt", "dd", "option", "tr", "td", "th") and stack[-1][0] == name:
            close(name)
        _, skipped, block, sections, linked, in_article = stack[-1]
        skipped = skipped or name in SKIPPED
        if not skipped:
            yield "tag", name, "", None, False
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        keys = section_keys(name, attributes, in_article)
        text_level = name not in INLINE and name not in CONTAINERS and name not in LANDMARKS
        stack.append((
            name, skipped, f"b:{name}" if text_level else "" if name in LANDMARKS else block, (keys, sections) if keys else sections,
            linked or name == "a", in_article or name in CONTENT,
        ))
        opened[name] += 1


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest positive sum, by one scan; the longest on ties."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and best > 0 and i + 1 - start > span[1] - span[0]):
            best, span = total, (start, i + 1)
    return span


def word_weight(block: str, section: float, linked: bool, weights: dict[str, float]) -> float:
    """Log odds of a word: of any word, of its block, of being a link, and twice those of the section that decides about it."""
    return weights["word"] + weights.get(block, 0.0) + 2 * section + (weights.get("link", DEFAULT_WEIGHTS["link"]) if linked else 0.0)


def extract(page: str, weights: dict[str, float], scan: bool = True) -> str:
    """Main text of one page: the blocks of the best region, in page order, one line each.

    A block's score is that of its words and of the tags around it. Inside the region only blocks whose section counts against
    them are left out. `scan=False` takes all blocks as the region.
    """
    decided: dict[int, tuple[float, bool]] = {}

    def section_odds(sections: tuple | None) -> tuple[float, bool]:
        """Odds of the innermost element around that is known, and whether a known one further out speaks for content."""
        passed = []
        while sections is not None and id(sections) not in decided:
            passed.append(sections)
            sections = sections[1]
        found, within = decided[id(sections)] if sections is not None else (0.0, False)
        for s in reversed(passed):
            if odds := sum(weights[k] if k in weights else belief(k) for k in s[0]):
                found, within = odds, within or found > 0
            decided[id(s)] = found, within
        return found, within

    lines: list[tuple[str, bool]] = []
    scores: list[float] = []
    run: list[str] = []
    score, against = 0.0, False
    kept = []  # sections stay alive while their ids are remembered

    def close() -> None:
        nonlocal score, against
        line = SPACE.sub(" ", entities.unescape("".join(run))).strip()
        if line or score:
            lines.append((line, against))
            scores.append(score)
        run.clear()
        score, against = 0.0, False

    for kind, value, block, sections, linked in tokens(page):
        if kind == "text":
            run.append(value)
            words = len(value.split())
            if words:
                kept.append(sections)
                section, within = section_odds(sections)
                weight = word_weight(block, section, linked, weights)
                furniture = section < 0 and weight < 0
                # Furniture in the middle of content does not part what is on either side.
                score += 0.0 if furniture and within else words * weight
                against = against or furniture
        elif value in ("br", "wbr", "img"):
            run.append(" " if value == "br" else "")
        elif value not in INLINE:
            close()
            score += weights["tag"]
    close()
    lo, hi = best_region(scores) if scan else (0, len(lines))
    return "\n".join(line for line, bad in lines[lo:hi] if line and not (bad and scan))


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (key, in content) over labelled pages, one set of rows a task."""
    counts: Counter = Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            inside = 0
            for kind, value, block, sections, linked in tokens(page):
                if kind == "tag":
                    inside = 1 - inside if value in CONTENT else inside
                    counts["tag", inside] += 1
                elif words := len(value.split()):
                    keys = {"word", block, *(sections[0] if sections else ())} | ({"link"} if linked else set())
                    for key in keys - {""}:
                        counts[key, inside] += words
    rows = [(k, i, n) for (k, i), n in counts.items()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int32(), pa.int64()))],
        names=["token", "inside", "n"],
    )


def fit_weights(pages: DataFrame, html_col: str = "html", train_pages: int = 2000) -> dict[str, float]:
    """Fitted log odds of words and tags inside and outside the content of labelled pages, nothing removed or clamped.

    Labelled are pages that mark their content with one `article` or `main` element and close it; at most about `train_pages` of
    them, chosen by hash, are used (a bound on the training sample). `word` and `tag` are shares of all tokens; a block (`b:p`), a
    landmark (`<nav`), a class, id or role name (`@ad`) and `link` are shares of the words. The sums of the sample's keys
    reach the driver.
    """
    marked = pages.select(F.col(html_col).cast("string").alias("html")).filter(
        F.col("html").rlike(r"(?i)<(article|main)[\s>]") & ~F.col("html").rlike(r"(?is)<(article|main)[\s>].*<(article|main)[\s>]")
        & F.col("html").rlike(r"(?i)</(article|main)\s*>")
    )
    share = min(1.0, train_pages / max(1, pages.count()))
    sample = marked.filter(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < int(math.ceil(share * 1_000_000)))
    rows = sample.mapInArrow(_tallies, "token string, inside int, n long").groupBy("token").agg(
        F.sum(F.when(F.col("inside") == 1, F.col("n")).otherwise(0)).alias("inside"),
        F.sum(F.when(F.col("inside") == 0, F.col("n")).otherwise(0)).alias("outside"),
    ).collect()
    seen = {r["token"]: (r["inside"], r["outside"]) for r in rows}
    if not all(seen.get("word", (0, 0))):
        return dict(DEFAULT_WEIGHTS)
    words = seen["word"]
    total = [w + t for w, t in zip(words, seen.get("tag", (0, 0)), strict=True)]
    odds = lambda key, of: math.log((seen[key][0] + 1) / (of[0] + 2)) - math.log((seen[key][1] + 1) / (of[1] + 2))
    return {key: odds(key, total if key in ("word", "tag") else words) for key in seen}


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Main text of every page: `page_id, url, text, n_chars`.

    A page is a sequence of words and tags with weights from labelled pages: words of content are positive, tags and words of
    menus, links, notices and adverts negative. One linear scan finds the contiguous region with the highest sum; what
    counts as furniture inside it is left out, so are scripts, styles, comments and forms everywhere. Its blocks are decoded, white
    space becomes one space, and blocks are joined by line breaks. Row-wise: no shuffle. Weights are fitted on
    labelled pages unless given; for landmarks and usual class names that no labelled page shows there is a prior belief.

    Null or empty html, or a page whose words all count against it, gives an empty text; malformed or cut markup is read as far
    as it goes; repeated rows are extracted each; an empty table gives no rows.
    """
    known = fit_weights(pages, html_col) if weights is None else weights
    source = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    shipped = json.dumps(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = json.loads(shipped)
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [extract(p, learned) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    return source.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")

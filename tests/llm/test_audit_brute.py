"""Hard negatives, source divergence and URL verdicts against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from groundshift.llm import divergence, rtree, urls
from groundshift.llm.queries import op13_url_verdicts

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, key string, windows string, deal string"


# --- hard negatives ---------------------------------------------------------------------


def plain_negatives(rows, every=50):
    kept = []
    for vec_id, x, label in rows:
        if vec_id is None or x is None or label is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        q = [math.floor(256 * float(np.float32(v))) for v in x]
        kept.append((vec_id, q, (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for a, (aid, aq, al) in enumerate(kept):
        if aid % every:
            continue
        scored = [(sum(map(int.__mul__, aq, q)), i, lb) for b, (i, q, lb) in enumerate(kept) if b != a and len(q) == len(aq)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for ps, pid, _ in [s for s in scored if s[2] == al][:5]:
            fit = [s for s in scored if s[2] != al and 50 * ps <= 100 * s[0] <= 95 * ps][:3]
            out += [(aid, pid, r + 1, s[1], ps, s[0]) for r, s in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **sizes):
    table = spark.createDataFrame([(*r, "k", "w", "d") for r in rows], VECTORS)
    vectors = rtree.labelled_vectors(table)
    found = rtree.hard_negatives(vectors, vectors.filter("id % 50 = 0"), **sizes)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 150, "leaf_rows": 8, "query_block": 4}])
def test_hard_negatives(spark, sizes):
    rng = random.Random(5)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in centre[i % 4]], rng.choice([0, 1, 1, 1, 2, None])) for i in range(600)]
    same = [0.5] * 6
    rows += [(1000 + i, same, i % 2) for i in range(150)]  # a third alike: ties by id
    rows += [(700, None, 1), (None, same, 1), (750, [None] * 6, 1), (800, [float("nan")] * 6, 1), (850, [float("inf")] * 6, 0)]
    rows += [(900, [1.0, 2.0], 1), (901, [2.0, 3.0], 1), (902, [1.0, 2.2], 2), (950, [], 1), (951, [], 2)]
    rows += [(100, rows[100][1], rows[100][2] or 0)]  # a repeated id
    assert mined(spark, rows, **sizes) == plain_negatives(rows)


def test_negative_and_zero_positives_have_narrow_windows(spark):
    rows = [(50, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.75, 0.0], 2), (3, [0.0, 1.0], 1), (4, [0.0, 5.0], 2)]
    assert mined(spark, rows) == plain_negatives(rows) == [(50, 3, 1, 4, 0, 0)]


def test_scores_beyond_floats(spark):
    rows = [(50, [3e6, 1.0], 1), (1, [3e6, 2.0], 1), (2, [2.5e6, 0.004], 2), (3, [2.5e6, 0.008], 2), (4, [2.5e6, 0.012], 3)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_no_vectors(spark):
    assert mined(spark, []) == []


def test_boxes_hold_their_rows_and_bound_their_scores():
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(0, 50, (1000, 5)))
    tree = rtree.RTree(rows, np.arange(1000), np.arange(1000), 16)
    query = np.floor(rng.normal(0, 50, 5))
    low, high = tree.intervals(query)
    scores = tree.rows @ query

    def rows_of(node):
        kids = tree.children[node]
        return list(range(*tree.spans[node])) if kids is None else [r for k in kids for r in rows_of(k)]

    assert sorted(tree.ids.tolist()) == list(range(1000)) and sorted(rows_of(tree.root)) == list(range(1000))
    for node in range(len(tree.children)):
        mine = scores[rows_of(node)]
        assert low[node] <= mine.min() and mine.max() <= high[node]


def test_clustered_boxes_are_pruned():
    rng = np.random.default_rng(4)
    rows = np.floor(np.concatenate([rng.normal(c, 2, (200, 3)) for c in (0, 100, -100, 300, -300)]))
    tree = rtree.RTree(rows, np.arange(1000), np.arange(1000), 16)
    opened = []

    class Counted(rtree.Wanted):
        def offer(self, ids, scores):
            opened.append(len(ids))
            super().offer(ids, scores)

    want = Counted(3, -math.inf, math.inf)
    rtree.search([tree], np.ones(3), -1, [want])
    assert want.scores.tolist() == sorted((rows @ np.ones(3)).tolist(), reverse=True)[:3]
    assert sum(opened) < 300


def test_boxes_that_overlap_are_scored_in_few_calls():
    rng = np.random.default_rng(6)
    rows = np.floor(rng.normal(0, 9, (3000, 48)))
    trees = [rtree.RTree(rows[n::3], np.arange(3000)[n::3] // 2, np.arange(3000)[n::3], 16) for n in range(3)]
    calls = []

    class Counted(rtree.Wanted):
        def offer(self, ids, scores):
            calls.append(len(ids))
            super().offer(ids, scores)

    for own in range(20):
        scores = (rows @ rows[own]).tolist()
        windows = [(3, -math.inf, math.inf), (5, 100, 400), (4, 250, 250), (2, 10**9, 10**9)]
        for k, least, most in windows:
            want = Counted(k, least, most)
            calls.clear()
            rtree.search(trees, rows[own], own, [want])
            fit = sorted((-s, i // 2) for i, s in enumerate(scores) if i != own and least <= s <= most)[:k]
            assert [(-s, i) for s, i in zip(want.scores.tolist(), want.ids.tolist(), strict=True)] == fit
            assert len(calls) <= 9
        together = [rtree.Wanted(*w) for w in windows]
        rtree.search(trees, rows[own], own, together)
        assert [w.best for w in together] == [sorted((-s, i // 2) for i, s in enumerate(scores) if i != own and a <= s <= b)[:k] for k, a, b in windows]


# --- source divergence ------------------------------------------------------------------


def plain_divergence(docs, least=10):
    by_lang, out = defaultdict(list), []
    for lang, source, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        by_lang[lang or ""].append((source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    for lang, rows in by_lang.items():
        df = Counter(t for _, terms in rows for t in set(terms))
        kept = {t for t, n in df.items() if n >= least}
        counts, v = defaultdict(Counter), len(kept)
        for source, terms in rows:
            counts[source].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c, t, v=v: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in counts.items():
            pairs = [(-sum(gap(share(c, t), share(d, t)) for t in kept), o.encode(), o) for o, d in counts.items() if o != s]
            terms = [
                (-gap(share(c, t), share(whole, t)), t.encode(), t) for t in kept if c[t] and share(c, t) > share(whole, t)
            ]
            out += [(lang, s, "pair", i, -val, r + 1) for r, (val, _, i) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", i, -val, r + 1) for r, (val, _, i) in enumerate(sorted(terms)[:10])]
    return sorted(out)


def odd_documents():
    rng = random.Random(11)
    words = ["Alpha", "beta", "ÉTÉ", "été", "naïve", "x", "ŠK", "don't", "a1b", "日本語", "tab\tbed", "\u2028", "gamma", "delta"]
    docs = []
    for i in range(400):
        source = rng.choice(["s0"] * 8 + [f"s{k}" for k in range(12)] + [None])
        text = " ".join(rng.choice(words[: 4 + i % 11]) + rng.choice(["", "", "s", str(i)]) for _ in range(rng.choice([0, 3, 30, 300])))
        docs.append((rng.choice(["en", "en", "fr", None]), source, text))
    docs += [("xx", "only", None), ("xx", "other", ""), ("yy", "alone", "few words"), ("en", "wordless", "12 34 !?"), ("en", "s1", None)]
    return docs + docs[:50]


@pytest.mark.parametrize("block_entries", [200_000, 7])
def test_source_divergence(spark, block_entries):
    docs = odd_documents()
    table = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "lang string, source string, text string, term string, n int, v int")
    found = divergence.source_divergence(table.repartition(5), block_entries=block_entries)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == plain_divergence(docs)


def test_divergence_over_blocks_of_sources_and_slices_of_terms(spark):
    docs = odd_documents()
    table = spark.createDataFrame(docs, "lang string, source string, text string")
    frequencies = divergence.merge_runs(divergence.index_runs(table, 3, 50)).toPandas()
    kept = frequencies.groupby(["lang", "term"])[["docs"]].sum().query("docs >= 10").reset_index()[["lang", "term"]]
    postings = frequencies.merge(kept)[["lang", "source", "term", "n"]]
    v = kept.groupby("lang").size().rename("v").reset_index()
    groups = frequencies[["lang", "source"]].drop_duplicates().merge(
        postings.groupby(["lang", "source"], as_index=False)["n"].sum(), how="left").fillna(0).merge(v)
    groups["n"] = groups["n"].astype("int64")
    values = divergence.pair_values(
        spark.createDataFrame(postings.merge(v), "lang string, source string, term string, n long, v long"),
        spark.createDataFrame(groups, "lang string, source string, n long, v long"), postings_per_task=13, block=3,
    ).collect()
    plain = {(r[0], r[1], r[3]): r[4] for r in plain_divergence(docs) if r[2] == "pair"}
    here = {(lang, source) for lang, source in zip(groups["lang"], groups["source"])}
    assert {(r["lang"], r["a"], r["b"]): r["value"] for r in values}.keys() <= plain.keys()
    assert all(plain[r["lang"], r["a"], r["b"]] == r["value"] == plain[r["lang"], r["b"], r["a"]] for r in values)
    pairs = {(r["lang"], frozenset((r["a"], r["b"]))) for r in values}
    assert len(pairs) == len(values) == sum(k * (k - 1) // 2 for k in Counter(lang for lang, _ in here).values())


def test_shares_are_exact_beyond_64_bits():
    counts, total = np.array([0, 5, 10**12, 9 * 10**15]), 10**16 + 7
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (c + 2) // total for c in counts.tolist()]
    assert divergence.shares(counts, np.full(4, total)).tolist() == [1 + 10**9 * (c + 2) // total for c in counts.tolist()]


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.source_divergence(empty).collect() == []


# --- URL verdicts -------------------------------------------------------------------------


def plain_rule(host, path):
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    return best


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):], re.S)[0]


def plain_words(pages):
    counts = Counter()
    for page in pages:
        text = re.sub(r"&[#a-zA-Z0-9]+;|<[^>]*>", " ", page or "")
        counts.update(w for w in re.findall(r"[a-zA-Z\u0080-\U0010ffff]+", text))
    low = Counter()
    for w, n in counts.items():
        low[re.sub("[A-Z]", lambda m: m[0].lower(), w)] += n
    low = Counter({w: n for w, n in low.items() if len(w) <= 24})
    total = sum(low.values())
    return {w: math.log(n / total) for w, n in low.items() if n >= 2e-6 * total}


def plain_segments(name, words):
    """All cuts of a short name, the most probable first."""
    unknown, best = min(words.values()), None
    for mask in range(1 << (len(name) - 1)):
        cuts = [0, *[i + 1 for i in range(len(name) - 1) if mask >> i & 1], len(name)]
        parts = [name[a:b] for a, b in zip(cuts, cuts[1:])]
        score = sum(words[p] if p in words else unknown - math.log(10) * len(p) for p in parts)
        if best is None or score > best[0] + 1e-9:
            best = (score, parts)
    return best


def test_viterbi_finds_the_best_cut():
    rng = random.Random(2)
    words = {w: math.log(rng.random()) for w in "the there her here re e t tea eat at ate cheap pills he ap".split()}
    segmenter = urls.Segmenter(words)
    for _ in range(150):
        name = "".join(rng.choice("theraclps") for _ in range(rng.randint(1, 11)))
        parts = segmenter[name]
        score = sum(words[p] if p in words else min(words.values()) - math.log(10) * len(p) for p in parts)
        assert "".join(parts) == name and math.isclose(score, plain_segments(name, words)[0], abs_tol=1e-9)
    assert urls.Segmenter({"cheap": -3.0, "pills": -3.0, "che": -9.0})["cheappills"] == ("cheap", "pills")
    assert urls.Segmenter({})["abc"] and urls.Segmenter(words)["the" * 3000] == ("the",) * 3000


def plain_verdicts(rows, pages):
    words = plain_words(pages)
    segmenter, skipped = urls.Segmenter(words), urls.rule_words(urls.RULES)
    split = {n: plain_split(u) for n, u in enumerate(rows)}
    tokens = {n: list(segmenter.tokens(*hp, skipped)) for n, hp in split.items()}
    counts, priors = {"allow": Counter(), "block": Counter()}, Counter()
    for n, hp in split.items():
        if rule := plain_rule(*hp):
            counts[rule[0]].update(tokens[n])
            priors[rule[0]] += 1
    seen = set(counts["allow"]) | set(counts["block"])
    out = {}
    for n, hp in split.items():
        z = 0.0
        if priors["allow"] and priors["block"]:
            z = math.log(priors["block"] / priors["allow"])
            for t in tokens[n]:
                if t in seen:
                    z += math.log((counts["block"][t] + 1) / (sum(counts["block"].values()) + len(seen) + 1))
                    z -= math.log((counts["allow"][t] + 1) / (sum(counts["allow"].values()) + len(seen) + 1))
        rule = plain_rule(*hp)
        out[n] = (*hp, rule and rule[1], rule[0] if rule else None, 1 / (1 + math.exp(-max(-700, min(700, z)))))
    return out


def check_verdicts(found, plain):
    assert set(found) == set(plain)
    for n, (host, path, rule, verdict, score) in plain.items():
        r = found[n]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert math.isclose(r["score"], score, rel_tol=1e-6)
        assert r["verdict"] == (verdict or ("block" if score > 0.5 else "allow")) or abs(score - 0.5) < 1e-9


def test_url_verdicts_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    numbers = {p["page_id"]: n for n, p in enumerate(pages)}
    found = {numbers[r["page_id"]]: r for r in op13_url_verdicts(spark, SF).collect()}
    check_verdicts(found, plain_verdicts([p["url"] for p in pages], [p["html"] for p in pages]))


def test_odd_urls(spark):
    rows = [
        None, "", "no scheme", "http://", "http://com", "http://COM/", "HTTP://Example.COM/en/x?y=z#w", "x://www.example.com/en/",
        "x://a.www.example.com/en/1", "x://notexample.com/en/", "x://example.com/En/", "x://b.net/es/", "x://b.net/es", "x://net/fr/#",
        "x://b.org?://c.com/", "x://b.org#/", "x://İstanbul.ORG/ÄÖ/%20/12345", "x://é.com/" + "wort/" * 3000, "x://a.com:80/", "a://b://c/com/",
        "x://u@www.example.com/en/", "x://line\nbreak.com/en/\nq", "x://" + "cheap" * 200 + ".org/", "x://freebets.org/bets",
    ] * 2
    html = ["<p>cheap bets free wort</p>", None, "", "<b>free</b> bets"]
    table = spark.createDataFrame(
        [(n if n != 5 else None, u, html[n % 4], "h", "p", "w") for n, u in enumerate(rows)],
        "page_id long, url string, html string, host string, path string, word string",
    )
    got = urls.judge_urls(table, words_from=table.select("html")).collect()
    found = {5 if r["page_id"] is None else r["page_id"]: r for r in got}
    assert len(got) == len(rows)
    check_verdicts(found, plain_verdicts(rows, [html[n % 4] for n in range(len(rows))]))


def test_names_are_segmented_and_learned(spark):
    rows = [f"x://cheappills{i}.net/fr/{i}" for i in range(20)] + [f"x://goodnews{i}.com/a{i}" for i in range(20)]
    rows += ["x://cheappillsnow.org/", "x://goodnewsnow.org/"]
    html = "cheap pills good news now " * 5
    table = spark.createDataFrame([(n, u, html) for n, u in enumerate(rows)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in urls.judge_urls(table, words_from=table.select("html")).collect()}
    assert found[40]["words"] == "cheap pills now org" and found[40]["verdict"] == "block"
    assert found[41]["words"] == "good news now org" and found[41]["verdict"] == "allow"


def test_urls_without_rules_or_rows(spark):
    table = spark.createDataFrame([(1, "x://a.org/"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge_urls(table).collect()} == {"allow"}
    assert urls.judge_urls(table.limit(0)).collect() == []

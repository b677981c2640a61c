"""Near-duplicates, top-k and decontamination against brute force on the driver's smallest documents and planted cases."""

import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from groundshift.llm import decontaminate, graph, neardup
from groundshift.llm.groups import links
from groundshift.llm.kdtree import quantised, top_k
from groundshift.llm.queries import op6_top_k
from groundshift.llm.words import hash_words

SF = "/root/testdata/sf0.001"


def classes(rows):
    return {r["doc_id"]: r["class_id"] for r in rows}


def brute_classes(texts: dict[int, str | None], weights: neardup.Weights) -> dict[int, int]:
    """Components of weighted Jaccard >= 0.8, from all pairs of texts."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
        s: dict = {}
        for k in range(max(1, len(w) - 4)) if w else ():
            s[tuple(w[k:k + 5])] = s.get(tuple(w[k:k + 5]), 0) + 1
        sets[i] = s
    df: dict = {}
    for s in sets.values():
        for x in s:
            df[x] = df.get(x, 0) + 1
    n = sum(1 for s in sets.values() if s)
    weigh = lambda x, tf: tf * np.log1p(1 / (df[x] / n + neardup.DF_DAMPING))
    weighted = {i: {x: weigh(x, tf) for x, tf in s.items()} for i, s in sets.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a >= b or texts[a] is None or texts[b] is None:
                continue
            same = texts[a] == texts[b]
            if not same and weighted[a] and weighted[b]:
                x, y = weighted[a], weighted[b]
                shared = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
                same = shared >= 0.8 * (sum(x.values()) + sum(y.values()) - shared)
            if same:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def corpus(seed: int = 3) -> dict[int, str | None]:
    rng = random.Random(seed)
    vocabulary = ["w" + str(rng.randrange(5000)) for _ in range(4000)]
    texts: dict[int, str | None] = {}
    for n in range(60):
        texts[n] = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 200, 400])))
    for n in range(60, 140):  # copies with a few changed words
        words = texts[rng.randrange(60)].split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts[n] = " ".join(words)
    texts |= {200: None, 201: None, 202: "", 203: "", 204: "!!!", 205: "?!", 206: "one two", 207: "One, two!"}
    return texts


def test_near_duplicates_equal_brute_force(spark, tmp_path):
    texts = corpus()
    rows = [(i, t) for i, t in texts.items()]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    weights = neardup.Weights(*neardup.document_frequencies(docs))
    found = near = neardup.near_duplicates(docs).collect()
    assert classes(found) == brute_classes(texts, weights)
    assert sum(r["stays"] for r in near) == len(set(classes(found).values()))
    assert len(neardup.drop_near_duplicates(docs).collect()) == len(set(classes(found).values()))


def test_near_duplicates_on_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert classes(neardup.near_duplicates(docs).collect()) == brute_classes(texts, None)


def test_large_group_of_near_copies(spark, tmp_path):
    """More copies than one task compares at once, each some words from a base that is not the hub."""
    rng = random.Random(5)
    base = [f"b{rng.randrange(10**6)}" for _ in range(300)]
    texts = {1000: " ".join(base)}
    for n in range(700):
        words = list(base)
        for _ in range(5):
            words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts[n] = " ".join(words)
    texts |= {2000 + n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(100)) for n in range(50)}
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4).write.parquet(path)
    found = classes(neardup.near_duplicates(spark.read.parquet(path)).collect())
    assert {found[n] for n in [*range(700), 1000]} == {0}
    assert all(found[2000 + n] == 2000 + n for n in range(50))


def test_near_duplicates_count_every_repetition(spark, tmp_path):
    """Lines repeated 300 and 3000 times differ; what stands beside a line repeated 2000 times weighs little."""
    line = "one two three four five six seven eight nine ten "
    other = lambda c: "".join(f"{c}{n} " for n in range(500))
    texts = {1: line * 300, 2: line * 3000, 3: line * 310, 4: line[4:] * 2000 + other("x"), 5: line[4:] * 2000 + other("y")}
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    found = classes(neardup.near_duplicates(docs).collect())
    assert found == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4} == brute_classes(texts, None)


def test_links_of_large_groups_lose_nothing(spark):
    """Numbers are linked if they differ by one: two long chains whose rows are linked to few hubs."""
    values = [*range(200), *range(500, 700)]
    rows = [("g", f"{n:04d}", n, 12) for n in values]
    members = spark.createDataFrame(rows, "group string, node string, payload long, blocks int")
    prepare = lambda payloads: np.array(payloads)
    linked = lambda values, i, js: np.abs(values[js] - values[i]) == 1
    edges = [(int(r["a"]), int(r["b"])) for r in links(members, prepare, linked, block_rows=32).collect()]
    root = {n: n for n in values}
    for _ in values:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {n: r for n, r in root.items()} == {n: 0 if n < 200 else 500 for n in values}


def test_links_of_rows_on_different_hubs(spark):
    """Chains that differ in their names, and so in the places and spacings of their hubs, stay whole each."""
    reach, length = {f"g{n:02d}": 1 + n % 4 for n in range(48)}, 240
    values = {g: [n for n in range(length) if n < length // 2 or n > length // 2 + w] for g, w in reach.items()}
    rows = [(g, f"{g}-{n:04d}", n * 8 + reach[g], 8) for g, mine in values.items() for n in mine]
    members = spark.createDataFrame(rows, "group string, node string, payload long, blocks int")
    linked = lambda x, i, js: np.abs(x[js] // 8 - x[i] // 8) <= x[i] % 8
    edges = links(members, np.array, linked, block_rows=32).collect()
    parent = {node: node for _, node, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in edges:
        parent[max(root(r["a"]), root(r["b"]))] = min(root(r["a"]), root(r["b"]))
    for g, mine in values.items():
        late = min(n for n in mine if n > length // 2)
        assert {n: root(f"{g}-{n:04d}") for n in mine} == {n: f"{g}-{0 if n < late else late:04d}" for n in mine}


def test_sampling_agrees_with_weighted_jaccard():
    weights = neardup.Weights(np.zeros(neardup.DF_BUCKETS), 1)
    words = [f"w{n}" for n in range(400)]
    other = words[:300] + [f"v{n}" for n in range(100)]
    texts = [" ".join(words), " ".join(other)]
    _, hashes, tf, numbers = weights.features(texts)
    sampler = neardup.Sampler(4000)
    drawn = sampler.sample(hashes, weights.log_weight(hashes, tf), np.cumsum(numbers) - numbers)
    shared = len(set(hashes[: numbers[0]].tolist()) & set(hashes[numbers[0]:].tolist()))
    assert abs((drawn[0] == drawn[1]).mean() - shared / (numbers.sum() - shared)) < 0.03


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "a b c d e f", 1), (None, "a b c d e f", 2), (7, "a b c d e f", 3), (7, "z z z", 4), (None, None, 5)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, pos int").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    found = sorted((r["doc_id"] or -1, r["class_id"] or -1, r["copies"]) for r in neardup.near_duplicates(docs).collect())
    assert found == [(-1, -1, 1), (-1, 7, 3), (-1, 7, 3), (7, 7, 1), (7, 7, 3)]
    assert sorted(r["pos"] for r in neardup.drop_near_duplicates(docs).collect()) == [3, 4, 5]


def brute_top(vectors, k):
    out = {}
    for q, x in vectors:
        if q % 20:
            continue
        scores = sorted(((-int(sum(a * b for a, b in zip(x, y))), v) for v, y in vectors if v != q))[:k]
        out[q] = [(v, -s) for s, v in scores]
    return out


@pytest.mark.parametrize("shard_rows,query_block", [(50, 4), (50, None), (None, 7), (None, None)])
def test_top_k_equals_brute_force(spark, shard_rows, query_block):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    raw = [(r["vec_id"], [int(np.floor(64.0 * float(x))) for x in r["embedding"]]) for r in table.collect()]
    vectors = quantised(table)
    rows = top_k(vectors, vectors.filter("id % 20 = 0"), 20, shard_rows, 16, query_block).collect()
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == brute_top(raw, 20)


def test_top_k_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]),
            (None, [1.0, 1.0]), (7, [1.0]), (20, []), (1, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = quantised(table)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(vectors, vectors.filter("id % 20 = 0"), 2).collect()]
    assert sorted(got) == [(0, 1, 1, 4096), (0, 2, 1, 4096)]
    none = table.limit(0)
    assert top_k(quantised(none), quantised(none), 2).count() == 0


def test_top_k_large_components_are_exact(spark):
    big = float(1 << 24) + 1
    rows = [(0, [big, 1.0 / 64]), (1, [big, 1.0]), (2, [big, 1.0 / 64]), (3, [-big, 0.0])]
    vectors = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in top_k(vectors, vectors.filter("id = 0"), 3).collect())
    x = int(big * 64)
    assert got == [(1, 1, x * x + 64), (2, 2, x * x + 1), (3, 3, -x * x)]


def test_query_of_top_k_has_twenty_each(spark):
    rows = op6_top_k(spark, SF).groupBy("query_id").count().collect()
    assert len(rows) == 25 and all(r["count"] == 20 for r in rows)


def changed(words: list[str], edits: int, rng: random.Random) -> list[str]:
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"new{rng.randrange(10**6)}")
    return words


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_passages_are_found(spark, share):
    """Recall of planted items at each level of edits, and no finding in documents without any."""
    rng = random.Random(11)
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    items += [(900, "alpha beta"), (901, "gamma delta epsilon zeta eta"), (902, None), (903, "  ")]
    filler = [w for r in pq.read_table(f"{SF}/documents.parquet").to_pylist() for w in (r["text"] or "").split()]
    docs, planted = [], set()
    for n, (item_id, text) in enumerate(items):
        words = (text or "").split()
        if not words:
            continue
        body = changed(words, int(len(hash_words(text)) * share), rng)
        around = [rng.choice(filler) for _ in range(300)]
        docs.append((n, " ".join(around[:150] + body + around[150:])))
        planted.add((n, item_id))
    docs += [(500 + n, " ".join(rng.choice(filler) for _ in range(400))) for n in range(100)] + [(700, None), (701, ""), (702, "...")]
    found = decontaminate.find_passages(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert pairs <= planted
    assert len(pairs) >= 0.99 * len(planted)
    if not share:
        assert pairs == planted and all(r["distance"] == 0 for r in found)
        for r in found:
            words = hash_words(docs[r["doc_id"]][1])[r["start_word"]: r["end_word"]]
            assert (words == hash_words(dict(items)[r["item_id"]])).all()


def test_passages_equal_exact_search_on_the_documents(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: " " + " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())) + " "
    held = [(r["item_id"], words(r["text"])) for r in items.collect()]
    exact = {(r["doc_id"], i) for r in docs.collect() for i, t in held if t in words(r["text"])}
    found = decontaminate.find_passages(docs, items).collect()
    assert exact == {(r["doc_id"], r["item_id"]) for r in found if r["distance"] == 0}


def test_many_items_take_several_passes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = {tuple(r) for r in decontaminate.find_passages(docs, items).collect()}
    many = {tuple(r) for r in decontaminate.find_passages(docs, items, items_a_pass=7).collect()}
    assert one == many
    assert decontaminate.find_passages(docs.limit(0), items).count() == 0
    assert decontaminate.find_passages(docs, items.limit(0)).count() == 0


def plain_match(item, text, most):
    """(distance, start, end) over all stretches, by the textbook table."""
    best = None
    for start in range(len(text) + 1):
        row = list(range(len(item) + 1))
        for end in range(start, len(text) + 1):
            if end > start:
                before, row = row, [row[0] + 1]
                for i, word in enumerate(item, start=1):
                    row.append(min(before[i - 1] + (word != text[end - 1]), before[i] + 1, row[i - 1] + 1))
            best = min(best or (row[-1], end, start), (row[-1], end, start))
    return (best[0], best[2], best[1]) if best[0] <= most else None


def test_best_matches_equal_plain_tables():
    rng = np.random.default_rng(5)
    items = [rng.integers(0, 4, rng.integers(1, 14)).astype(np.uint64) for _ in range(150)]
    texts = [rng.integers(0, 4, rng.integers(0, 22)).astype(np.uint64) for _ in items]
    most = [int(rng.integers(0, len(i) + 1)) for i in items]
    got = decontaminate.best_matches(items, texts, most)
    assert got == [plain_match(i.tolist(), t.tolist(), m) for i, t, m in zip(items, texts, most, strict=True)]


def test_long_item_and_items_with_one_opening_are_quick():
    rng = np.random.default_rng(6)
    words = lambda n: rng.integers(1, 1 << 60, n).astype(np.uint64)
    long = words(2000)
    began = time.perf_counter()
    assert decontaminate.edit_distance_within(long, np.concatenate([long[:900], long[950:]]), 400) == (50, 0, 1950)
    assert time.perf_counter() - began < 1
    opening = words(20)
    items = [(i, np.concatenate([opening, words(40)])) for i in range(1000)]
    index = decontaminate.Index(items, 0.2, decontaminate.WALKS, decontaminate.TABLES, decontaminate.SAMPLED)
    doc = np.concatenate([words(50), items[7][1], words(50), opening, words(50)])
    began = time.perf_counter()
    assert list(index.matches(doc, np.array([0]), np.array([len(doc)]))) == [(0, 7, 50, 110, 0)]
    assert time.perf_counter() - began < 5


def test_benchmark_in_passes_by_bytes(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = {tuple(r) for r in decontaminate.find_passages(docs, items).collect()}
    many = {tuple(r) for r in decontaminate.find_passages(docs, items, bytes_a_pass=4000).collect()}
    assert one == many and one


def plain_components(edges):
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_components_with_hubs_equal_plain_ones(spark):
    rng = random.Random(8)
    name = "n{:05d}".format
    star = [(name(9999), name(i)) for i in range(400)]  # a hub above all its neighbours
    low = [(name(1000), name(1001 + i)) for i in range(300)]  # and one below
    chain = [(name(2000 + i), name(2001 + i)) for i in range(60)]
    loose = [(name(rng.randrange(3000, 3400)), name(rng.randrange(3000, 3400))) for _ in range(250)]
    edges = [e for e in star + low + chain + loose if e[0] != e[1]]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges + edges[:50], "a string, b string")).collect()}
    assert got == plain_components(edges)

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from groundshift.operators import dedupe as D
from groundshift.operators.skew import number_rows, split_hot

SCHEMA = ("scene_id int, task_idx int, pos bigint, change_type string, confidence string,"
          " x double, y double, w double, h double")
RANK = {"low": 0, "medium": 1, "high": 2}


def iou(a, b):
    across = max(0.0, min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5]))
    down = max(0.0, min(a[6] + a[8], b[6] + b[8]) - max(a[6], b[6]))
    inter = across * down
    union = a[7] * a[8] + b[7] * b[8] - inter
    return 0.0 if union <= 0 else inter / union


def greedy(rows, threshold=0.4):
    """The sequential visit, one box at a time."""
    kept = []
    for r in sorted(rows, key=lambda r: (-RANK.get(r[4], 0), -(r[7] * r[8]), r[1], r[2])):
        if not any(k[0] == r[0] and k[3] == r[3] and iou(k, r) > threshold for k in kept):
            kept.append(r)
    kept.sort(key=lambda r: (r[0], r[6], r[5]))
    return kept


def numbered(kept):
    out, n = set(), {}
    for r in kept:
        n[r[0]] = n.get(r[0], 0) + 1
        out.add((r[0], r[1], r[2], n[r[0]]))
    return out


def keys(df):
    return {(r.scene_id, r.task_idx, r.pos) for r in df.collect()}


def make_rows(seed, n, scenes=2, spread=1.0):
    rng = random.Random(seed)
    return [
        (rng.randrange(scenes), rng.randrange(17), i, rng.choice(["added", "removed"]),
         rng.choice(["low", "medium", "high", "unsure"]), rng.random() * spread, rng.random() * spread,
         rng.choice([0.0, rng.random() * 0.2, 0.1]), rng.choice([rng.random() * 0.2, 0.1]))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_strategies_agree_on_continuous_boxes(spark, seed):
    rows = make_rows(seed, 400, spread=0.5)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(r[0], r[1], r[2]) for r in greedy(rows)}
    assert keys(D.dedupe(df, strategy="fold")) == want
    assert keys(D.dedupe(df, strategy="rounds", limit=20)) == want
    assert keys(D.dedupe(df, strategy="auto", limit=250)) == want


def test_hot_scene_of_copies_and_crowds(spark):
    """One scene holds most rows: copies of one box, a crowd of near copies, and empty boxes."""
    rng = random.Random(7)
    rows = [(0, i % 17, i, "added", rng.choice(["low", "high"]), 0.5, 0.5, 0.25, 0.25) for i in range(600)]
    rows += [(0, i % 17, i, "added", "low", 0.1 + rng.random() * 0.02, 0.1 + rng.random() * 0.02, 0.2, 0.2)
             for i in range(600, 1000)]
    rows += [(0, i % 17, i, "removed", "low", 0.0, 0.0, 0.0, 0.0) for i in range(1000, 1200)]
    rows += [(s, 0, 5000 + s, "added", "low", 0.5, 0.5, 0.25, 0.25) for s in range(1, 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    merged = D.merge_detections(df, limit=40)
    got = {(r.scene_id, r.task_idx, r.pos, r.n) for r in merged.collect()}
    kept = sorted(greedy(rows), key=lambda r: (
        r[0], r[6], r[5], -RANK.get(r[4], 0), -(r[7] * r[8]), r[1], r[2]))
    assert got == numbered(kept)
    assert all(r.id == f"chg-{r.n}" for r in merged.collect())


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(0, 6), st.integers(0, 6),
                          st.sampled_from(["low", "medium", "high"]), st.sampled_from(["added", "modified"])),
                min_size=1, max_size=40))
def test_property_fold_rounds_greedy(spark, boxes):
    rows = [(0, i % 3, i, t, c, x / 16, y / 16, w / 16, h / 16) for i, (x, y, w, h, c, t) in enumerate(boxes)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(r[0], r[1], r[2]) for r in greedy(rows)}
    fold = D.dedupe(df, strategy="fold")
    assert keys(fold) == want
    assert keys(D.dedupe(df, strategy="rounds", limit=3)) == want
    assert keys(D.dedupe(fold, strategy="fold")) == want


def chain(n, scene=0, kind="added"):
    """Equal boxes, each overlapping the next, in reading order."""
    return [(scene, 0, i, kind, "low", i * 0.003, 0.1, 0.01, 0.1) for i in range(n)]


def rounds_of(monkeypatch):
    calls = []
    visit = D._visit_cells
    monkeypatch.setattr(D, "_visit_cells", lambda *a: calls.append(1) or visit(*a))
    return calls


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    rows = chain(40) + chain(40, kind=None)
    calls = rounds_of(monkeypatch)
    df = spark.createDataFrame(rows, SCHEMA)
    assert keys(D.dedupe(df.where("change_type = 'added'"), strategy="rounds", limit=4)) == {(0, 0, r[2]) for r in greedy(rows[:40])}
    assert len(calls) <= 4
    # A missing type is a group like any other and is decided in rounds too.
    assert D.dedupe(df, strategy="rounds", limit=4).count() == 2 * len(greedy(rows[:40]))


def test_long_chain_and_crowd_in_one_scene(spark, monkeypatch):
    n, rng = 20_000, random.Random(3)
    crowd = [(0, 1, i, "removed", "low", 0.1 + rng.random() * 0.02, 0.1 + rng.random() * 0.02, 0.2, 0.2 - i * 1e-9)
             for i in range(50_000)]
    rows = chain(n)
    want, last = set(), None
    for r in rows:  # only the last kept box reaches this far
        if last is None or iou(last, r) <= 0.4:
            want.add(r[:3])
            last = r
    want |= {r[:3] for r in greedy(crowd)}
    calls = rounds_of(monkeypatch)
    got = keys(D.dedupe(spark.createDataFrame(rows + crowd, SCHEMA)))
    assert got == want
    assert len(calls) <= 20


def test_rounds_store_boxes_not_rows(spark, monkeypatch):
    """Whole rows are written once; a round stores numbers and boxes, and drops what it suppresses in its own visit."""
    rows = make_rows(5, 60, scenes=1, spread=0.2)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("description", F.lit("a long text"))
    made, joined = [], []
    stored, remaining = D.stored, D._remaining
    monkeypatch.setattr(D, "stored", lambda d, label: made.append((label, d.schema.simpleString())) or stored(d, label))
    monkeypatch.setattr(D, "_remaining", lambda *a: joined.append(1) or remaining(*a))
    want = {(r[0], r[1], r[2]) for r in greedy(rows)}
    assert keys(D.dedupe(df, strategy="rounds", limit=8)) == want
    assert [label for label, schema in made if "description" in schema] == ["boxes"]
    assert {label for label, _ in made} == {"boxes", "decided", "open"} and not joined
    # Cells that hold more rows than a visit takes leave rows that their kept boxes suppress.
    monkeypatch.setattr(D, "VISIT_ROWS", 12)
    assert keys(D.dedupe(df, strategy="rounds", limit=8)) == want
    assert joined


def test_threshold_is_strict_and_types_are_apart(spark):
    # 0.4 exactly: 4 of 10 units shared.
    rows = [(0, 0, 0, "added", "high", 0.0, 0.0, 0.7, 0.1), (0, 0, 1, "added", "low", 0.0, 0.0, 0.28, 0.1),
            (0, 0, 2, "removed", "low", 0.0, 0.0, 0.7, 0.1)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(r[0], r[1], r[2]) for r in greedy(rows)}
    assert keys(D.dedupe(df)) == want and (0, 0, 2) in want


def test_ties_follow_input_order(spark):
    rows = [(0, 2, 0, "added", "low", 0.1, 0.1, 0.1, 0.1), (0, 1, 5, "added", "low", 0.1, 0.1, 0.1, 0.1),
            (0, 1, 4, "added", "unsure", 0.1, 0.1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert keys(D.dedupe(df)) == {(0, 1, 4)}
    order = [(r.task_idx, r.pos) for r in D.with_priority(df).orderBy("priority").collect()]
    assert order == [(1, 4), (1, 5), (2, 0)]


def test_numbering_of_hot_keys(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 7, id % 50) as k", "(id * 37) % 1000 as v", "id")
    order = [df.v.asc(), df.id.asc()]
    plain = number_rows(df, ["k"], order, "n", check_hot=False)
    hot = number_rows(df, ["k"], order, "n", limit=200)
    assert split_hot(df, ["k"], 200).hot is not None
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in hot.collect()}


def test_ordinary_scenes_shuffle_once(spark, tmp_path):
    spark.createDataFrame(make_rows(1, 50), SCHEMA).write.parquet(str(tmp_path / "d"))
    merged = D.merge_detections(spark.read.parquet(str(tmp_path / "d")))
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_bad_arguments(spark):
    df = spark.createDataFrame(make_rows(1, 5), SCHEMA)
    with pytest.raises(ValueError):
        D.dedupe(df, strategy="other")
    with pytest.raises(ValueError):
        D.dedupe(df, threshold=0.0, strategy="rounds")

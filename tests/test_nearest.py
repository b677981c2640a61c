"""Nearest descriptors of large scenes against a plain search."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundshift.operators import registration as REG

SCHEMA = "scene_id bigint, kp_id bigint, x double, y double, desc array<bigint>"


def clustered(rng, scene, n, centres, flips, first=0):
    rows = []
    for i in range(n):
        bits = centres[rng.integers(len(centres))].copy()
        bits[rng.integers(0, 128, flips)] ^= 1
        words = np.packbits(bits).view(np.int64)
        rows.append((scene, first + i, float(i), float(-i), [int(w) for w in words]))
    return rows


def plain(query, train):
    out = {}
    by_scene = {}
    for s, i, _, _, d in train:
        by_scene.setdefault(s, []).append((i, np.array(d, np.int64).view(np.uint64)))
    for s, i, _, _, d in query:
        mine = by_scene.get(s)
        if mine:
            words = np.array(d, np.int64).view(np.uint64)
            far = np.bitwise_count(np.stack([w for _, w in mine]) ^ words).sum(axis=1)
            out[s, i] = sorted(zip(far.tolist(), [j for j, _ in mine]))[:2]
    return out


def found(near):
    return {(r.scene_id, r.q_id): [(n.d, n.t_id) for n in r.near] for r in near.collect()}


@pytest.fixture(scope="module")
def scenes():
    """Scene 1 holds most rows, in clusters; 2 has no structure; 3 is a copy; 4 is small, 5 has one train row, 6 none."""
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 2, (12, 128), dtype=np.uint8)
    noise = rng.integers(0, 2, (400, 128), dtype=np.uint8)
    train = clustered(rng, 1, 900, centres, 3) + clustered(rng, 2, 200, noise, 0) + clustered(rng, 3, 150, centres[:1], 0)
    query = clustered(rng, 1, 500, centres, 4) + clustered(rng, 2, 100, noise, 5) + clustered(rng, 3, 40, centres[:1], 0)
    query += clustered(rng, 1, 20, noise, 0, 5000)
    train += clustered(rng, 4, 20, centres, 2) + clustered(rng, 5, 1, centres, 2)
    query += clustered(rng, 4, 30, centres, 2) + clustered(rng, 5, 3, centres, 2) + clustered(rng, 6, 3, centres, 2)
    return query, train


@pytest.mark.parametrize("block, pivots", [(50, 16), (40, 3), (4096, 64)])
def test_nearest_two_equal_a_plain_search(spark, scenes, block, pivots):
    query, train = scenes
    near = REG.nearest_two(spark.createDataFrame(query, SCHEMA), spark.createDataFrame(train, SCHEMA), block, pivots)
    assert found(near) == plain(query, train)


def test_clustered_descriptors_need_few_distances(spark, scenes):
    query, train = (spark.createDataFrame([r for r in rows if r[0] == 1 and r[1] < 5000], SCHEMA) for rows in scenes)
    centres = REG._pivots(train, 64, 50).checkpoint()
    q, t = REG._celled(query, centres, 50, "q"), REG._celled(train, centres, 50, "t")
    pairs = q.join(t, q["q_cell"] == t["t_cell"])
    own = pairs.select(F.sum(F.size("q_id") * F.size("t_id"))).first()[0]
    first = pairs.drop(t["scene_id"]).mapInPandas(REG._nearest_two, f"scene_id bigint, {REG.NEAR_ROWS}").checkpoint()
    rest = REG.pruned_pairs(q, t, first, centres).select(F.sum(F.size("q_id") * F.size("t_id"))).first()[0] or 0
    assert own + rest < 0.5 * 500 * 900
    assert q.agg(F.max(F.size("q_id"))).first()[0] <= 150 and t.count() > 10


def test_no_keypoints(spark, scenes):
    none, train = spark.createDataFrame([], SCHEMA), spark.createDataFrame(scenes[1], SCHEMA)
    assert REG.nearest_two(none, train, 50).collect() == [] and REG.nearest_two(train, none, 50).collect() == []


def test_only_rows_within_the_bound_leave_a_task():
    rng = np.random.default_rng(3)
    q, t = (rng.integers(0, 2 ** 62, (n, 2)) for n in (6, 9))
    ids, far = np.arange(9), np.bitwise_count((q[:, None] ^ t[None]).view(np.uint64)).sum(axis=2).astype(int)
    bound = np.array([0, 200, far[2].min(), far[3].min() - 1, 1 << 30, 0])
    row = (1, ids[:6], ids[:6] * 1.0, ids[:6] * 1.0, q.ravel(), ids, ids * 1.0, ids * 1.0, t.ravel(), 128, t[0], bound)
    names = ["scene_id", "q_id", "q_x", "q_y", "q_desc", "t_id", "t_x", "t_y", "t_desc", "t_far", "centre", "bound"]
    got = pd.concat(REG._pruned(iter([pd.DataFrame([row], columns=names)])))
    wanted = [(i, d) for i in range(6) for d in sorted(far[i])[:2] if d <= bound[i]]
    assert sorted(zip(got["q_id"], got["d"])) == wanted


def test_blocks_of_a_cell_are_not_smaller_than_the_fixed_size(spark):
    """Small ``block`` values make cells, not pairs of tiny blocks; ids that repeat in another place keep their own rows."""
    rng = np.random.default_rng(4)
    train = clustered(rng, 1, 600, rng.integers(0, 2, (600, 128), dtype=np.uint8), 0)
    query = clustered(rng, 1, 100, rng.integers(0, 2, (100, 128), dtype=np.uint8), 0)
    query += [(1, i, -5.0, y, d) for (_, i, _, y, _), (_, _, _, _, d) in zip(query[:50], query[50:])]
    q, t = (spark.createDataFrame(rows, SCHEMA) for rows in (query, train))
    placed = REG._celled(t, REG._pivots(t, 8, 16).checkpoint(), max(16, REG.BLOCK_KEYPOINTS), "t")
    assert placed.count() == placed.select("t_cell").distinct().count() <= 8
    near = {(r.q_id, r.qx): [(n.d, n.t_id) for n in r.near] for r in REG.nearest_two(q, t, 16).collect()}
    for at, (_, i, x, y, d) in enumerate(query):
        assert near[i, x] == plain([(1, at, x, y, d)], train)[1, at]

import random

import numpy as np
import pytest

from groundshift.operators import registration as REG

H = np.array([[1.1, 0.02, 5.0], [-0.03, 0.95, 8.0], [1e-4, 5e-5, 1.0]])
KP = "scene_id int, kp_id bigint, x double, y double, desc array<bigint>"


def keypoints(n, seed=1, scene=0, outliers=0.2, words=4):
    rng = random.Random(seed)
    later, earlier = [], []
    for i in range(n):
        x, y = rng.random() * 1000, rng.random() * 800
        desc = [rng.getrandbits(63) for _ in range(words)]
        q = H @ [x, y, 1.0]
        u, v = (q[:2] / q[2]) if rng.random() > outliers else (rng.random() * 1000, rng.random() * 800)
        later.append((scene, i, x, y, desc))
        earlier.append((scene, i, float(u), float(v), [desc[0] ^ 5, *desc[1:]]))
    return later, earlier


def test_recovers_a_known_homography(spark):
    a1, b1 = keypoints(300, outliers=0.4)
    a2, b2 = keypoints(5, seed=2, scene=1)
    a3, b3 = keypoints(9, seed=3, scene=2)
    later, earlier = spark.createDataFrame(a1 + a2 + a3, KP), spark.createDataFrame(b1 + b2 + b3, KP)
    matches = REG.match_descriptors(later, earlier)
    fits = {r.scene_id: r for r in REG.fit_homography(matches).collect()}
    assert set(fits) == {0}
    assert np.allclose(np.array(fits[0].homography).reshape(3, 3), H, atol=1e-4, rtol=1e-3)
    pairs = spark.createDataFrame([(i, 50, 40, 100, 80) for i in range(3)],
                                  "scene_id int, work_w bigint, work_h bigint, tgt_w bigint, tgt_h bigint")
    status = {r.scene_id: r for r in REG.align_status(pairs, matches, REG.fit_homography(matches)).collect()}
    assert status[0].aligned and status[0].match_count == 300
    assert not status[1].aligned and status[1].match_count == 0
    assert status[2].homography == [0.5, 0, 0, 0, 0.5, 0, 0, 0, 1]


def test_many_blocks_give_the_same_neighbours(spark):
    later, earlier = keypoints(400, words=1)
    earlier += [(0, 1000 + i, 0.0, 0.0, earlier[i][4]) for i in range(50)]
    q, t = spark.createDataFrame(later, KP), spark.createDataFrame(earlier, KP)
    one = {(r.q_id, r.k): (r.t_id, r.distance) for r in REG.knn_hamming(q, t).collect()}
    many = {(r.q_id, r.k): (r.t_id, r.distance) for r in REG.knn_hamming(q, t, block=32).collect()}
    want = {}
    for _, i, _, _, d in later:
        near = sorted((bin((d[0] ^ e[0]) & (2 ** 64 - 1)).count("1"), j) for _, j, _, _, e in earlier)[:2]
        for k, (dist, j) in enumerate(near, 1):
            want[(i, k)] = (j, dist)
    assert one == want and many == want


def test_large_scene_is_scored_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(REG, "BLOCK_MATCHES", 64)
    later, earlier = keypoints(400, outliers=0.3)
    matches = REG.match_descriptors(spark.createDataFrame(later, KP), spark.createDataFrame(earlier, KP))
    fit = REG.fit_homography(matches).first()
    assert np.allclose(np.array(fit.homography).reshape(3, 3), H, atol=1e-4, rtol=1e-3)


@pytest.mark.parametrize("train", [0, 1, 2])
def test_few_neighbours(spark, train):
    later, earlier = keypoints(6)
    q, t = spark.createDataFrame(later, KP), spark.createDataFrame(earlier[:train], KP)
    near = REG.nearest_two(q, t)
    assert {len(r.near) for r in near.collect()} == ({train} if train else set())
    assert REG.ratio_test(near).count() == (0 if train < 2 else 2)


def test_gates(spark):
    a, b = keypoints(12)
    assert REG.match_descriptors(spark.createDataFrame(a, KP), spark.createDataFrame(b, KP)).count() == 12
    assert REG.match_descriptors(spark.createDataFrame(a[:11], KP), spark.createDataFrame(b, KP)).count() == 0
    assert REG.match_descriptors(spark.createDataFrame(a, KP), spark.createDataFrame(b[:7], KP)).count() == 0


def test_many_matches_and_outliers(spark):
    """20,000 matches of one scene, 60 % of them wrong: samples come from all matches."""
    rng = np.random.default_rng(4)
    n = 20_000
    src = rng.random((n, 2)) * 1000
    q = np.c_[src, np.ones(n)] @ H.T
    dst = q[:, :2] / q[:, 2:]
    wrong = rng.random(n) < 0.6
    dst[wrong] = rng.random((int(wrong.sum()), 2)) * 1000
    rows = [(0, i, i, float(a), float(b), float(c), float(d), n) for i, ((a, b), (c, d)) in enumerate(zip(src, dst))]
    matches = spark.createDataFrame(
        rows, "scene_id int, q_id bigint, t_id bigint, sx double, sy double, dx double, dy double, match_count bigint")
    fit = REG.fit_homography(matches).first()
    assert np.allclose(np.array(fit.homography).reshape(3, 3), H, atol=1e-3, rtol=1e-2)
    assert fit.inliers >= 0.99 * (~wrong).sum()


def _plain_trials(src, dst, seed, trials):
    """Support after each trial, one homography at a time."""
    ts, td = (REG._scaling(*p.mean(0), (p ** 2).sum(1).mean()) for p in (src, dst))
    best, seen = 0, []
    for pick in REG._draws(seed, len(src), trials):
        h = REG._solve(src[pick][None], dst[pick][None], ts, td).reshape(1, 3, 3)
        best = max(best, int(REG._inliers(h, src, dst, 5.0).sum()))
        seen.append(best)
    return seen


@pytest.mark.parametrize("wrong", [0.0, 0.3, 0.6, 0.97])
def test_trials_end_when_they_are_enough(spark, monkeypatch, wrong):
    """A scene in one row and the same scene in blocks take the same trials; clean scenes take few, hopeless ones all."""
    rng = np.random.default_rng(7)
    n = 400
    src = rng.random((n, 2)) * 1000
    q = np.c_[src, np.ones(n)] @ H.T
    dst = q[:, :2] / q[:, 2:]
    bad = rng.random(n) < wrong
    dst[bad] = rng.random((int(bad.sum()), 2)) * 1000
    rows = [(5, i, i, *map(float, (*src[i], *dst[i])), n) for i in range(n)]
    matches = spark.createDataFrame(
        rows, "scene_id int, q_id bigint, t_id bigint, sx double, sy double, dx double, dy double, match_count bigint")
    seed = matches.selectExpr("xxhash64(scene_id) as seed").first().seed
    seen = _plain_trials(src, dst, seed, REG.HYPOTHESES)
    ends = [e for e in REG._rounds(REG.HYPOTHESES) if REG._enough(seen[e - 1], n, e)]
    want = ends[0] if ends else REG.HYPOTHESES
    one = REG.fit_homography(matches).first()
    assert (one.trials, one.inliers) == (want, seen[want - 1])
    monkeypatch.setattr(REG, "BLOCK_MATCHES", 64)
    many = REG.fit_homography(matches).first()
    assert (many.trials, many.inliers) == (one.trials, one.inliers)
    if wrong < 0.9:
        assert one.inliers >= 0.98 * (~bad).sum() and np.allclose(one.homography, many.homography, atol=1e-6, rtol=1e-6)
    assert (one.trials == REG._rounds(REG.HYPOTHESES)[0]) == (wrong <= 0.3)


def test_scenes_of_all_sizes_and_hopeless_ones(spark, monkeypatch):
    """Scenes in one row, in blocks, decided early or late and without any fit stand side by side."""
    monkeypatch.setattr(REG, "BLOCK_MATCHES", 100)
    rng = np.random.default_rng(9)
    rows = []
    for scene, (n, wrong) in enumerate([(60, 0.0), (300, 0.0), (300, 0.7), (40, 1.0), (300, 1.0)]):
        src = np.zeros((n, 2)) if wrong == 1 else rng.random((n, 2)) * 1000
        q = np.c_[src, np.ones(n)] @ H.T
        dst = q[:, :2] / q[:, 2:]
        bad = rng.random(n) < wrong
        dst[bad] = rng.random((int(bad.sum()), 2)) * 1000
        rows += [(scene, i, i, *map(float, (*src[i], *dst[i])), n) for i in range(n)]
    matches = spark.createDataFrame(
        rows, "scene_id int, q_id bigint, t_id bigint, sx double, sy double, dx double, dy double, match_count bigint")
    fits = {r.scene_id: r for r in REG.fit_homography(matches).collect()}
    assert set(fits) == {0, 1, 2}  # all points in one place determine nothing
    assert fits[0].trials == fits[1].trials < fits[2].trials
    for r in fits.values():
        assert np.allclose(np.array(r.homography).reshape(3, 3), H, atol=1e-3, rtol=1e-2)
    assert REG.fit_homography(matches.where("false")).count() == 0


def test_samples_hold_four_different_matches():
    picks = REG._draws(3, 4, 500)
    assert all(sorted(p) == [0, 1, 2, 3] for p in picks.tolist())
    wide = REG._draws(3, 10**9, 500)
    assert (REG._draws(3, 10**9, 2000)[:500] == wide).all()
    assert len({tuple(p) for p in wide.tolist()}) == 500 and wide.max() > 9 * 10**8


def test_points_on_the_horizon_are_null(spark):
    points = spark.createDataFrame([(1.0, 0.0)], "x double, y double").selectExpr(
        "*", "array(1d, 0d, 0d, 0d, 1d, 0d, -1d, 0d, 1d) as homography")
    row = REG.project_points(points).first()
    assert row.hx is None and row.hy is None

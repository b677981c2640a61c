"""Registration of the later image to the earlier one from keypoint descriptors.

Keypoints are an input table (scene_id, kp_id, x, y, desc), with ``desc`` an array of longs holding the
bits of a binary descriptor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K
from ..session import ensure_checkpoint_dir
from .detector import spread_calls
from .skew import number_rows, shuffled

BLOCK_KEYPOINTS = 2048
BLOCK_MATCHES = 4096
# Distances taken at once between small blocks, and matches fitted by one task: both cost much for their few bytes.
COMPARED_TOGETHER = 1 << 19
MATCHES_PER_TASK = 1 << 16
# Pivots around which the descriptors of a large scene are grouped.
PIVOTS = 64
# Trials of a scene: with 80 % wrong matches, 2,000 draw a clean sample in 96 % of scenes.
HYPOTHESES = 2000
# Fixed value: a scene is done when its support makes it this likely that one of its samples so far was free of wrong matches.
CONFIDENCE = 0.995


def _blocked(keypoints: DataFrame, block: int, prefix: str) -> DataFrame:
    """Gather keypoints into blocks of about ``block`` rows per scene, whatever the scene's size."""
    counts = keypoints.groupBy("scene_id").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    row = F.struct("kp_id", "x", "y", "desc")
    return (
        keypoints.join(counts, "scene_id")
        .withColumn("_blk", F.pmod(F.xxhash64("kp_id"), F.col("_blocks")))
        .groupBy("scene_id", "_blk", "_blocks").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
        .select(
            "scene_id", F.col("_blk").alias(f"{prefix}_blk"), F.col("_blocks").alias(f"{prefix}_blocks"),
            *[F.col(f"_rows.{c}").alias(f"{prefix}_{n}") for c, n in (("kp_id", "id"), ("x", "x"), ("y", "y"))],
            F.flatten("_rows.desc").alias(f"{prefix}_desc"),
        )
    )


def _two_nearest(q: np.ndarray, t: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """How many of the two nearest rows of ``t`` there are, and their distances and places for every row of ``q``, one after the other."""
    k = min(2, len(t))
    found = []
    for at in range(0, len(q), 256):
        # Train rows are in id order, so distance and position in one number break ties by id.
        code = hamming(q[at:at + 256], t) * len(t) + np.arange(len(t))
        found.append(np.partition(code, k - 1, axis=1)[:, :k])
    code = np.concatenate(found).ravel()
    return k, code // len(t), code % len(t)


def _nearest_two(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The two nearest train rows of every query row, per pair of blocks; small pairs of blocks of the same sizes are compared together."""
    lists = ["q_id", "q_x", "q_y", "q_desc", "t_id", "t_x", "t_y", "t_desc"]
    for batch in batches:
        scene, columns = batch["scene_id"].to_numpy(), [batch[c].to_numpy() for c in lists]
        sizes: dict[tuple, list[int]] = {}
        for i, r in enumerate(zip(*columns)):
            sizes.setdefault(tuple((len(c), getattr(c, "dtype", None)) for c in r), []).append(i)
        parts, held = [], 0
        for (q_size, *_, t_size, _, _, _), members in sizes.items():
            n, m = q_size[0], t_size[0]
            many = max(1, COMPARED_TOGETHER // (n * m))
            for lo in range(0, len(members), many):
                some = members[lo:lo + many]
                q_id, qx, qy, q, t_id, tx, ty, t = (np.stack([np.asarray(c[i]) for i in some]) for c in columns)
                q, t = (np.asarray(w, np.int64).view(np.uint64).reshape(len(some), rows, -1) for w, rows in ((q, n), (t, m)))
                if len(some) == 1:
                    k, far, pos = _two_nearest(q[0], t[0])
                else:
                    k = min(2, m)
                    code = np.partition(hamming(q, t) * m + np.arange(m), k - 1, axis=2)[:, :, :k].ravel()
                    far, pos = code // m, code % m
                pair = np.repeat(np.arange(len(some)), n * k)
                parts.append(pd.DataFrame({
                    "scene_id": scene[some][pair], "q_id": np.repeat(q_id.ravel(), k), "qx": np.repeat(qx.ravel(), k),
                    "qy": np.repeat(qy.ravel(), k), "d": far, "t_id": t_id[pair, pos], "tx": tx[pair, pos], "ty": ty[pair, pos],
                }))
                held += len(pair)
                # Frames of other types are not put together: whole numbers would lose digits.
                if held >= 1 << 17:
                    yield from _alike(parts)
                    parts, held = [], 0
        yield from _alike(parts)


def _alike(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames of each combination of column types put together."""
    kinds: dict[tuple, list[pd.DataFrame]] = {}
    for part in parts:
        kinds.setdefault(tuple(part.dtypes), []).append(part)
    for some in kinds.values():
        yield some[0] if len(some) == 1 else pd.concat(some, ignore_index=True)


NEAR_ROWS = "q_id bigint, qx double, qy double, d int, t_id bigint, tx double, ty double"


def nearest_two(query: DataFrame, train: DataFrame, block: int = BLOCK_KEYPOINTS, pivots: int = PIVOTS) -> DataFrame:
    """Exact two nearest train keypoints of each query keypoint by Hamming distance, as array ``near``.

    Distances are taken between blocks inside tasks and only two candidates per query and block leave a task; the best two of all
    are kept on both sides of the shuffle. Ties go to the smaller id. A scene with more than ``block`` train keypoints is cut
    by ``pruned_candidates``; smaller ones compare each query block with the scene's one train block.
    """
    sizes = train.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_size"))
    large = sizes.where(F.col("_size") > block).select("scene_id")
    few_q, few_t = query, train
    found = None
    if not large.isEmpty():
        many = [df.join(large, "scene_id", "left_semi") for df in (query, train)]
        few_q, few_t = (df.join(large, "scene_id", "left_anti") for df in (query, train))
        found = pruned_candidates(*many, block, pivots)
    key = query.schema["scene_id"].dataType.simpleString()
    met = _blocked(few_q, block, "q").join(shuffled(_blocked(few_t, block, "t")), "scene_id").select(
        "scene_id", "q_id", "q_x", "q_y", "q_desc", "t_id", "t_x", "t_y", "t_desc"
    )
    direct = met.mapInPandas(_nearest_two, f"scene_id {key}, {NEAR_ROWS}")
    return _best_two(direct if found is None else direct.unionByName(found))


def _best_two(candidates: DataFrame) -> DataFrame:
    """The two best candidates of each query, ranked before and after the shuffle, so no list grows with the scene."""
    rank = F.row_number().over(Window.partitionBy("scene_id", "q_id", "qx", "qy").orderBy("d", "t_id", "tx", "ty"))
    best = candidates.withColumn("_k", rank).where("_k <= 2")
    return best.groupBy("scene_id", "q_id", "qx", "qy").agg(
        F.array_sort(F.collect_list(F.struct("d", "t_id", "tx", "ty"))).alias("near")
    )


# --- large scenes: cells around pivots, pruned by the triangle inequality ------------------------


def _words(column: pa.Array) -> np.ndarray:
    """Descriptors of a list column as rows of words."""
    return np.asarray(column.flatten(), np.int64).view(np.uint64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every row of ``a`` and every row of ``b``; of several pairs of these, stacked, for each pair."""
    bits = np.zeros((*a.shape[:-1], b.shape[-2]), np.int64)
    for word in range(a.shape[-1]):
        bits += np.bitwise_count(a[..., :, None, word] ^ b[..., None, :, word])
    return bits


def _pivots(train: DataFrame, count: int, block: int) -> DataFrame:
    """Up to ``count`` descriptors of each scene, four per ``block`` keypoints, chosen by hash, as one list."""
    sizes = train.groupBy("scene_id").agg(F.least(F.lit(count), F.ceil(F.count(F.lit(1)) * 4 / block)).alias("_slots"))
    slot = F.pmod(F.xxhash64("kp_id", F.lit(5)), F.col("_slots"))
    chosen = train.join(sizes, "scene_id").groupBy("scene_id", slot.alias("_slot")).agg(
        F.min_by("desc", F.struct(F.xxhash64("kp_id"), "kp_id")).alias("desc")
    )
    return chosen.groupBy("scene_id").agg(F.array_sort(F.array_distinct(F.collect_list("desc"))).alias("_pivots"))


def _celled(keypoints: DataFrame, pivots: DataFrame, block: int, prefix: str) -> DataFrame:
    """Blocks of at most about ``block`` keypoints that share their nearest pivot, with the largest distance from it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, scene = _words(batch.column("desc")), batch.column("scene_id").to_pylist()
            cell, far = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int32)
            bounds = [0, *[i for i in range(1, len(scene)) if scene[i] != scene[i - 1]], len(scene)]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                centres = np.array(batch.column("_pivots")[lo].as_py(), np.int64).view(np.uint64) if hi > lo else None
                for at in range(lo, hi, 4096):
                    bits = hamming(words[at:min(at + 4096, hi)], centres)
                    cell[at:at + len(bits)] = bits.argmin(axis=1)
                    far[at:at + len(bits)] = bits.min(axis=1)
            kept = [batch.column(c) for c in ("scene_id", "kp_id", "x", "y", "desc")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(cell), pa.array(far)], names=["scene_id", "kp_id", "x", "y", "desc", "cell", "far"])

    key = keypoints.schema["scene_id"].dataType.simpleString()
    placed = keypoints.select("scene_id", "kp_id", "x", "y", "desc").join(pivots, "scene_id").mapInArrow(
        assign, f"scene_id {key}, kp_id bigint, x double, y double, desc array<bigint>, cell int, far int"
    )
    ensure_checkpoint_dir(keypoints.sparkSession)
    placed = placed.checkpoint()
    counts = placed.groupBy("scene_id", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("_n"))
    row = F.struct("kp_id", "x", "y", "desc")
    return placed.join(counts, ["scene_id", "cell"]).withColumn("part", F.pmod(F.xxhash64("kp_id"), "_n")).groupBy(
        "scene_id", "cell", "part"
    ).agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.max("far").alias(f"{prefix}_far")).select(
        "scene_id", F.col("cell").alias(f"{prefix}_cell"), F.col("part").alias(f"{prefix}_part"), f"{prefix}_far",
        *[F.col(f"_rows.{c}").alias(f"{prefix}_{n}") for c, n in (("kp_id", "id"), ("x", "x"), ("y", "y"))],
        F.flatten("_rows.desc").alias(f"{prefix}_desc"),
    )


def _pruned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_nearest_two`` for the queries of a block that the train block can still serve: those within its reach of their bound."""
    names = ["scene_id", "q_id", "qx", "qy", "d", "t_id", "tx", "ty"]
    for batch in batches:
        parts = []
        for r in batch.itertuples(index=False):
            q = np.asarray(r.q_desc, np.int64).view(np.uint64).reshape(len(r.q_id), -1)
            bound = np.asarray(r.bound)
            centre = np.asarray(r.centre, np.int64).view(np.uint64).reshape(1, -1)
            # No train row is nearer than the distance from the centre less the block's radius. Ties may have a smaller id.
            near = hamming(q, centre)[:, 0] - r.t_far <= bound
            if near.any():
                t = np.asarray(r.t_desc, np.int64).view(np.uint64).reshape(len(r.t_id), -1)
                k, far, pos = _two_nearest(q[near], t)
                # Two rows within the bound are known already, so rows beyond it are never among the best two.
                good = far <= np.repeat(bound[near], k)
                mine, pos = np.repeat(np.flatnonzero(near), k)[good], pos[good]
                parts.append((np.full(len(mine), r.scene_id), *(np.asarray(c)[mine] for c in (r.q_id, r.q_x, r.q_y)),
                              far[good], *(np.asarray(c)[pos] for c in (r.t_id, r.t_x, r.t_y))))
        if parts:
            yield pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*parts))})


def _query_key(*names: str) -> list[Column]:
    """What tells queries apart: id and place, as an id may repeat. A missing coordinate may have become NaN or null."""
    return [F.col(names[0]), *[F.nanvl(c, F.lit(None).cast("double")) for c in names[1:]]]


def pruned_pairs(query: DataFrame, train: DataFrame, first: DataFrame, pivots: DataFrame) -> DataFrame:
    """Query and train blocks of different cells that may hold nearer rows than those found in the query's own cell.

    ``bound`` has the second distance found so far for each query of the block. Blocks are left out where the distance of their
    pivots less both radii exceeds the largest bound: by the triangle inequality none of their rows can be nearer.
    """
    second = first.groupBy(F.col("scene_id").alias("s_scene"), *[c.alias(f"s_{i}") for i, c in enumerate(_query_key("q_id", "qx", "qy"))]).agg(
        F.when(F.count(F.lit(1)) >= 2, F.max("d")).otherwise(F.lit(1 << 30)).alias("d2")
    )
    ids = query.select("scene_id", "q_cell", "q_part", F.explode(F.arrays_zip("q_id", "q_x", "q_y")).alias("_q")).select(
        "scene_id", "q_cell", "q_part", "_q.*")
    same = F.col("scene_id") == F.col("s_scene")
    for i, c in enumerate(_query_key("q_id", "q_x", "q_y")):
        same = same & c.eqNullSafe(F.col(f"s_{i}"))
    bounds = ids.join(shuffled(second), same).groupBy("scene_id", "q_cell", "q_part").agg(
        F.array_sort(F.collect_list(F.struct("q_id", "q_x", "q_y", "d2"))).alias("_b"), F.max("d2").alias("reach")
    ).select("scene_id", "q_cell", "q_part", F.col("_b.d2").alias("bound"), "reach")
    gap = F.aggregate(
        F.zip_with(F.get("_pivots", F.col("q_cell")), F.get("_pivots", F.col("t_cell")), lambda a, b: F.bit_count(a.bitwiseXOR(b))),
        F.lit(0), lambda total, bits: total + bits,
    )
    places = query.select("scene_id", "q_cell", "q_part", "q_far").join(bounds.drop("bound"), ["scene_id", "q_cell", "q_part"]).join(
        train.select("scene_id", "t_cell", "t_part", "t_far"), "scene_id"
    ).where("q_cell <> t_cell").join(pivots, "scene_id").where(gap - F.col("q_far") - F.col("t_far") <= F.col("reach"))
    wanted = places.select("scene_id", "q_cell", "q_part", "t_cell", "t_part", F.get("_pivots", F.col("t_cell")).alias("centre"))
    return wanted.join(query, ["scene_id", "q_cell", "q_part"]).join(bounds.drop("reach"), ["scene_id", "q_cell", "q_part"]).join(
        train, ["scene_id", "t_cell", "t_part"]
    )


def pruned_candidates(query: DataFrame, train: DataFrame, block: int, pivots: int = PIVOTS) -> DataFrame:
    """Candidates that hold the two nearest rows of every query, for scenes of many train blocks.

    Keypoints are grouped by their nearest pivot, of up to ``pivots`` a scene, into blocks with a radius. Queries first meet the train
    blocks of their own cell; the second distance found there is a bound with which only blocks and queries go on that the triangle
    inequality cannot rule out, and only rows within the bound leave a task. ``block`` gives the number of pivots; blocks hold up to
    ``BLOCK_KEYPOINTS`` keypoints of a cell, or ``block`` if that is more, since the pairs of blocks grow with the square of their number. Exact: in clustered
    descriptors little is left, in descriptors without structure nothing is saved but the comparison with the pivots is added. Scenes are cut into (cell, part) blocks, so no scene is bound to one task.
    """
    key = query.schema["scene_id"].dataType.simpleString()
    centres = _pivots(train, pivots, block).checkpoint()
    rows = max(block, BLOCK_KEYPOINTS)
    q, t = _celled(query, centres, rows, "q"), _celled(train, centres, rows, "t")
    columns = ["scene_id", "q_id", "q_x", "q_y", "q_desc", "t_id", "t_x", "t_y", "t_desc"]
    own = q.join(t, (q["scene_id"] == t["scene_id"]) & (q["q_cell"] == t["t_cell"])).drop(t["scene_id"]).select(*columns)
    first = own.mapInPandas(_nearest_two, f"scene_id {key}, {NEAR_ROWS}")
    rank = F.row_number().over(Window.partitionBy("scene_id", *_query_key("q_id", "qx", "qy")).orderBy("d", "t_id"))
    first = first.withColumn("_k", rank).where("_k <= 2").drop("_k").checkpoint()
    others = pruned_pairs(q, t, first, centres).select(*columns, "t_far", "centre", "bound")
    return first.unionByName(others.mapInPandas(_pruned, f"scene_id {key}, {NEAR_ROWS}"))


def knn_hamming(query: DataFrame, train: DataFrame, block: int = BLOCK_KEYPOINTS) -> DataFrame:
    """Two nearest neighbours as rows: (scene_id, q_id, k, t_id, distance)."""
    rows = nearest_two(query, train, block).select("scene_id", "q_id", F.posexplode("near").alias("_k", "_n"))
    return rows.select("scene_id", "q_id", (F.col("_k") + 1).alias("k"),
                       F.col("_n.t_id").alias("t_id"), F.col("_n.d").alias("distance"))


def ratio_test(nearest: DataFrame, ratio: float = K.RATIO_TEST) -> DataFrame:
    """Matches whose nearest neighbour is clearly closer than the second; both must exist."""
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    return nearest.where(first["d"] < F.lit(ratio) * second["d"]).select(
        "scene_id", "q_id", first["t_id"].alias("t_id"), first["d"].alias("distance"),
        F.col("qx").alias("sx"), F.col("qy").alias("sy"), first["tx"].alias("dx"), first["ty"].alias("dy"),
    )


def feature_gate(later: DataFrame, earlier: DataFrame, min_features: int = K.MIN_FEATURES) -> DataFrame:
    """Scenes with enough keypoints at both dates."""
    def rich(df: DataFrame) -> DataFrame:
        return df.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_features).select("scene_id")

    return rich(later).join(rich(earlier), "scene_id", "left_semi")


def match_gate(matches: DataFrame, min_matches: int = K.MIN_MATCHES) -> DataFrame:
    """Matches of scenes that have enough of them, with ``match_count``."""
    counts = matches.groupBy("scene_id").agg(F.count(F.lit(1)).alias("match_count")).where(
        F.col("match_count") >= min_matches
    )
    return matches.join(counts, "scene_id")


def match_descriptors(
    later: DataFrame,
    earlier: DataFrame,
    ratio: float = K.RATIO_TEST,
    min_features: int = K.MIN_FEATURES,
    min_matches: int = K.MIN_MATCHES,
    block: int = BLOCK_KEYPOINTS,
) -> DataFrame:
    """Good matches from the later (query) to the earlier (train) image, of scenes that pass both gates."""
    scenes = feature_gate(later, earlier, min_features)
    near = nearest_two(
        later.join(scenes, "scene_id", "left_semi"), earlier.join(scenes, "scene_id", "left_semi"), block
    )
    return match_gate(ratio_test(near, ratio), min_matches)


# --- homography ------------------------------------------------------------------------


def _scaling(mean_x: float, mean_y: float, mean_square: float) -> np.ndarray:
    """Similarity that moves points to mean 0 and root mean square distance sqrt(2)."""
    mean = (mean_x, mean_y)
    spread = np.sqrt(max(0.0, mean_square - mean_x ** 2 - mean_y ** 2))
    s = np.sqrt(2) / spread if spread > 1e-9 * (1 + abs(mean_x) + abs(mean_y)) else 1.0
    return np.array([[s, 0, -s * mean[0]], [0, s, -s * mean[1]], [0, 0, 1.0]])


def _apply(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        q = points @ h[..., :2].swapaxes(-1, -2) + h[..., None, :, 2]
        return q[..., :2] / q[..., 2:]


def _equations(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The two linear equations per match in the nine entries of the homography."""
    x, y = src[..., 0], src[..., 1]
    u, v = dst[..., 0], dst[..., 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    top = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], -1)
    low = np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], -1)
    return np.concatenate([top, low], -2)


def _draws(seed: int, n: int, count: int) -> np.ndarray:
    """``count`` samples of four different numbers below n; more samples begin with the same ones."""
    chance = np.random.default_rng(abs(int(seed))).random((count, 4))
    picks = np.empty((count, 4), np.int64)
    for i in range(4):
        # A number among those not drawn yet: step over the earlier ones in ascending order.
        at = (chance[:, i] * (n - i)).astype(np.int64)
        for earlier in np.sort(picks[:, :i], axis=1).T:
            at += at >= earlier
        picks[:, i] = at
    return picks


def _solve(src: np.ndarray, dst: np.ndarray, ts: np.ndarray, td: np.ndarray) -> np.ndarray:
    """Homographies through samples of four matches (samples, 4, 2); NaN where a sample determines none."""
    system = _equations(_apply(ts, src), _apply(td, dst))
    left, right = system[:, :, :8], -system[:, :, 8]
    with np.errstate(all="ignore"):
        # The condition is at most 2 / |det| * (norm / sqrt(n)) ** n, which decides most samples; others take their singular values.
        usable = 2 / np.abs(np.linalg.det(left)) * (np.square(left).sum((1, 2)) / 8) ** 4 < 1e7
        if not usable.all():
            usable[~usable] = np.linalg.cond(left[~usable]) < 1e8
    h = np.full((len(src), 9), np.nan)
    if usable.any():
        entries = np.linalg.solve(left[usable], right[usable][..., None])[..., 0]
        full = np.concatenate([entries, np.ones((len(entries), 1))], 1).reshape(-1, 3, 3)
        h[usable] = (np.linalg.inv(td) @ full @ ts).reshape(-1, 9)
    return h


def _rounds(trials: int) -> list[int]:
    """Numbers of trials after which a scene may be done; each round costs about as much as all before it, times three."""
    ends = [trials]
    while ends[0] > 200:
        ends.insert(0, ends[0] // 4)
    return ends


def _enough(inliers: int, matches: int, trials: int) -> bool:
    """Whether ``trials`` samples were enough, given the share of matches that support the best of them."""
    return (1 - (inliers / matches) ** 4) ** trials <= 1 - CONFIDENCE


def _hypotheses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Homographies of large scenes; rows hold the drawn matches of a round, four per sample."""
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            ts, td = _scaling(r.msx, r.msy, r.mss), _scaling(r.mdx, r.mdy, r.mds)
            h = _solve(np.stack([r.sx, r.sy], 1).reshape(-1, 4, 2), np.stack([r.dx, r.dy], 1).reshape(-1, 4, 2), ts, td)
            rows.append((r.scene_id, h.ravel(), ts.ravel(), td.ravel()))
        yield pd.DataFrame(rows, columns=["scene_id", "hyps", "ts", "td"])


def _all_draws(batches: Iterator[pd.DataFrame], first: int, last: int) -> Iterator[pd.DataFrame]:
    """The numbers of the matches that samples ``first`` to ``last`` of a scene use: (scene_id, at, number)."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            picks = _draws(r.seed, r.n, last)[first:].ravel()
            yield pd.DataFrame({"scene_id": r.scene_id, "at": np.arange(len(picks)), "number": picks + 1})


def _inliers(h: np.ndarray, src: np.ndarray, dst: np.ndarray, threshold: float) -> np.ndarray:
    with np.errstate(all="ignore"):
        error = ((_apply(h, src) - dst) ** 2).sum(-1)
    return error <= threshold ** 2


def _counts(h: np.ndarray, src: np.ndarray, dst: np.ndarray, threshold: float) -> np.ndarray:
    """Matches within the threshold of each homography; some homographies at a time bound the temporary arrays."""
    return np.concatenate([_inliers(h[at:at + 128], src, dst, threshold).sum(1) for at in range(0, len(h), 128)])


def _normal(rough: np.ndarray, src: np.ndarray, dst: np.ndarray, ts: np.ndarray, td: np.ndarray, threshold: float) -> np.ndarray:
    """Normal equations of the matches that support ``rough``."""
    good = _inliers(rough.reshape(1, 3, 3), src, dst, threshold)[0]
    a = _equations(_apply(ts, src[good]), _apply(td, dst[good]))
    return a.T @ a


def _refined(product: np.ndarray, rough: np.ndarray, ts: np.ndarray, td: np.ndarray) -> np.ndarray:
    """The least-squares homography of normal equations."""
    fine = np.linalg.eigh(product)[1][:, 0].reshape(3, 3)
    h = np.linalg.inv(td) @ fine @ ts
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else rough.reshape(3, 3)


def _best_sample(
    src: np.ndarray, dst: np.ndarray, ts: np.ndarray, td: np.ndarray, seed: int, threshold: float, trials: int
) -> tuple[int, np.ndarray, int]:
    """Support, homography and number of the trials of one scene, which end as soon as they are enough."""
    best, rough, done = 0, None, 0
    for end in _rounds(trials):
        picks = _draws(seed, len(src), end)[done:].ravel()
        h = _solve(src[picks].reshape(-1, 4, 2), dst[picks].reshape(-1, 4, 2), ts, td).reshape(-1, 3, 3)
        count = _counts(h, src, dst, threshold)
        at, done = int(count.argmax()), end
        if count[at] > best:
            best, rough = int(count[at]), h[at]
        if _enough(best, len(src), done):
            break
    return best, rough, done


def fit_homography(
    matches: DataFrame, threshold: float = K.RANSAC_PX, hypotheses: int = HYPOTHESES, store: bool = True
) -> DataFrame:
    """Homography (later to earlier) per scene by random sample consensus, refined on its inliers, and its ``trials``.

    ``matches`` comes from ``match_gate``. Samples are drawn deterministically from all matches of a scene, in growing rounds; a
    scene ends with the round after which, at the share of matches that support its best sample, one sample is free of wrong
    matches with probability ``CONFIDENCE``, at ``hypotheses`` samples the latest. Support is counted over all matches. A scene of up to
    one block of matches is fitted in one row; larger ones are counted in blocks, so a scene of any size spreads over tasks.
    The refinement is a least-squares fit from summed normal equations. Scenes without a usable sample give no row. Matches are read
    several times, so they are checkpointed here unless ``store`` is False.
    """
    ensure_checkpoint_dir(matches.sparkSession)
    matches = matches.checkpoint() if store else matches
    small = _fit_rows(matches.where(F.col("match_count") <= BLOCK_MATCHES), threshold, hypotheses)
    large = matches.where(F.col("match_count") > BLOCK_MATCHES)
    return small if large.isEmpty() else small.unionByName(_fit_blocks(large, threshold, hypotheses))


def _fit_rows(matches: DataFrame, threshold: float, trials: int) -> DataFrame:
    """Fits of scenes whose matches lie in one row each."""
    key = matches.schema["scene_id"].dataType.simpleString()
    points = ["sx", "sy", "dx", "dy"]
    rows = spread_calls(matches, calls_per_task=MATCHES_PER_TASK, keys=["scene_id"]).groupBy("scene_id").agg(
        F.xxhash64(F.first("scene_id")).alias("seed"), F.array_sort(F.collect_list(F.struct("q_id", *points))).alias("_m"),
    ).select("scene_id", "seed", *[F.col(f"_m.{p}").alias(p) for p in points])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                src, dst = np.stack([r.sx, r.sy], 1), np.stack([r.dx, r.dy], 1)
                if len(src) < 4:
                    continue
                ts, td = (_scaling(*p.mean(0), (p ** 2).sum(1).mean()) for p in (src, dst))
                inliers, rough, done = _best_sample(src, dst, ts, td, r.seed, threshold, trials)
                if inliers >= 4:
                    h = _refined(_normal(rough, src, dst, ts, td, threshold), rough, ts, td)
                    out.append((r.scene_id, h.ravel(), inliers, done))
            yield pd.DataFrame(out, columns=["scene_id", "homography", "inliers", "trials"])

    return rows.mapInPandas(fit, f"scene_id {key}, homography array<double>, inliers bigint, trials int")


def _fit_blocks(matches: DataFrame, threshold: float, trials: int) -> DataFrame:
    """Fits of scenes of many blocks of matches.

    Matches are numbered once; in a round only the drawn ones of the scenes that are still open meet in one row, four per sample, and
    their homographies meet all blocks. What a round decided is written, so the next one reads open scenes only.
    """
    key = matches.schema["scene_id"].dataType.simpleString()
    points = ["sx", "sy", "dx", "dy"]
    square = lambda x, y: F.avg(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    numbers = [*[f"m{p}" for p in points], "mss", "mds"]
    stats = matches.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n"), F.xxhash64(F.first("scene_id")).alias("seed"),
        *[F.avg(p).alias(f"m{p}") for p in points], square("sx", "sy").alias("mss"), square("dx", "dy").alias("mds"),
    ).checkpoint()
    numbered = number_rows(matches, ["scene_id"], [F.col("q_id").asc(), F.col("t_id").asc()], "number").select(
        "scene_id", "number", *points).checkpoint()
    blocks = numbered.withColumn("blk", F.floor((F.col("number") - 1) / BLOCK_MATCHES)).groupBy("scene_id", "blk").agg(
        F.array_sort(F.collect_list(F.struct("number", *points))).alias("_m")
    ).select("scene_id", *[F.col(f"_m.{p}").alias(p) for p in points])

    def support(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                src, dst = np.stack([r.sx, r.sy], 1), np.stack([r.dx, r.dy], 1)
                h = np.asarray(r.hyps).reshape(-1, 3, 3)
                yield pd.DataFrame({"scene_id": r.scene_id, "hyp": np.arange(len(h)), "part": _counts(h, src, dst, threshold)})

    types = "hyps array<double>, ts array<double>, td array<double>"
    open_scenes, best, first = stats, None, 0
    for last in _rounds(trials):
        wanted = open_scenes.select("scene_id", "seed", "n").mapInPandas(
            lambda it, a=first, b=last: _all_draws(it, a, b), f"scene_id {key}, at bigint, number bigint")
        drawn = numbered.join(wanted, ["scene_id", "number"]).groupBy("scene_id").agg(
            F.array_sort(F.collect_list(F.struct("at", *points))).alias("_d"))
        hyps = drawn.select("scene_id", *[F.col(f"_d.{p}").alias(p) for p in points]).join(
            open_scenes.select("scene_id", *numbers), "scene_id").mapInPandas(_hypotheses, f"scene_id {key}, {types}").checkpoint()
        counts = blocks.join(hyps.select("scene_id", "hyps"), "scene_id").mapInPandas(
            support, f"scene_id {key}, hyp int, part bigint").groupBy("scene_id", "hyp").agg(F.sum("part").alias("count"))
        winner = counts.groupBy("scene_id").agg(F.max(F.struct("count", (-F.col("hyp")).alias("neg"))).alias("_b")).join(
            hyps, "scene_id").select(
            "scene_id", F.col("_b.count").alias("inliers"), F.lit(last).alias("trials"),
            F.slice("hyps", 1 - 9 * F.col("_b.neg"), F.lit(9)).alias("rough"), "ts", "td")
        # Of equal support the earlier sample stays; its scene has come as far as this round all the same.
        both = winner if best is None else winner.unionByName(best)
        best = both.groupBy("scene_id").agg(
            F.max_by(F.struct("inliers", "rough", "ts", "td"), F.struct("inliers", -F.col("trials"))).alias("_w"), F.max("trials").alias("trials"),
        ).select("scene_id", "trials", "_w.*").checkpoint()
        share = F.col("inliers") / F.col("n")
        missed = F.pow(1 - F.pow(share, F.lit(4)), F.lit(last))
        open_scenes = open_scenes.join(best.select("scene_id", "inliers"), "scene_id", "left").where(
            F.coalesce(missed > 1 - CONFIDENCE, F.lit(True))).drop("inliers").checkpoint()
        first = last
        if open_scenes.isEmpty():
            break
    upper = [(i, j) for i in range(9) for j in range(i, 9)]

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                src, dst = np.stack([r.sx, r.sy], 1), np.stack([r.dx, r.dy], 1)
                ts, td = np.asarray(r.ts).reshape(3, 3), np.asarray(r.td).reshape(3, 3)
                product = _normal(np.asarray(r.rough), src, dst, ts, td, threshold)
                out.append((r.scene_id, [product[i, j] for i, j in upper]))
            yield pd.DataFrame(out, columns=["scene_id", "part"])

    supported = best.where("inliers >= 4")
    sums = blocks.join(supported.select("scene_id", "rough", "ts", "td"), "scene_id").mapInPandas(
        normal, f"scene_id {key}, part array<double>").groupBy("scene_id").agg(
        F.array(*[F.sum(F.get("part", F.lit(i))) for i in range(len(upper))]).alias("total")).join(supported, "scene_id")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                product = np.zeros((9, 9))
                for (i, j), value in zip(upper, r.total):
                    product[i, j] = product[j, i] = value
                h = _refined(product, np.asarray(r.rough), np.asarray(r.ts).reshape(3, 3), np.asarray(r.td).reshape(3, 3))
                out.append((r.scene_id, h.ravel(), r.inliers, r.trials))
            yield pd.DataFrame(out, columns=["scene_id", "homography", "inliers", "trials"])

    return sums.mapInPandas(solve, f"scene_id {key}, homography array<double>, inliers bigint, trials int")


def project_points(points: DataFrame, x: str = "x", y: str = "y", homography: str = "homography") -> DataFrame:
    """Add hx and hy: the point under the nine-number homography of its row; null on the horizon."""
    def h(i: int) -> Column:
        return F.get(homography, F.lit(i))

    px, py = F.col(x), F.col(y)
    depth = h(6) * px + h(7) * py + h(8)
    return points.withColumn("hx", F.try_divide(h(0) * px + h(1) * py + h(2), depth)).withColumn(
        "hy", F.try_divide(h(3) * px + h(4) * py + h(5), depth)
    )


def align_status(pairs: DataFrame, matches: DataFrame, homographies: DataFrame) -> DataFrame:
    """Add aligned, match_count and homography to scene pairs; scenes without a fit fall back.

    ``pairs`` has work_w, work_h and the later image's tgt_w, tgt_h. The fallback is the diagonal
    scaling of that image to the working frame, with aligned = false and match_count = 0.
    """
    counts = matches.groupBy("scene_id").agg(F.first("match_count").alias("_count"))
    fitted = homographies.select("scene_id", F.col("homography").alias("_h"))
    joined = pairs.join(counts, "scene_id", "left").join(fitted, "scene_id", "left")
    aligned = F.col("_h").isNotNull()
    return joined.select(
        *pairs.columns,
        aligned.alias("aligned"),
        F.when(aligned, F.coalesce("_count", F.lit(0).cast("bigint"))).otherwise(0).cast("bigint").alias("match_count"),
        F.coalesce("_h", fallback_homography()).alias("homography"),
    )


def fallback_homography() -> Column:
    """Diagonal scaling of the later image to the working frame."""
    zero, one = F.lit(0.0), F.lit(1.0)
    across, down = (F.try_divide(F.col(f"work_{c}"), F.col(f"tgt_{c}")) for c in "wh")
    return F.array(across, zero, zero, zero, down, zero, zero, zero, one)

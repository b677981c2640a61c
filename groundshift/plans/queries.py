"""One query per operator, each over the whole of its driver table."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions import boxes as B
from ..functions import pixels as P
from ..functions import text as X
from ..functions.numeric import clamp01, round_half_up
from ..operators import dedupe as D
from ..operators import frames as FR
from ..operators import geometry as G
from ..operators import raster as R
from ..operators import registration as REG
from ..operators import report as REP
from ..operators import responses as RE
from ..operators.detector import detect, detect_stored, spread_calls
from ..operators.skew import shuffled
from ..session import ensure_checkpoint_dir, scratch_path
from ..sources import images as S
from ..sources.reports import report_rows
from . import fixtures as fx
from .change_run import run_changes, run_images, run_requests

# Scenes whose tiles one task makes.
SCENES_PER_TASK = 16384

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def bigint(name: str):
    return F.col(name).cast("bigint").alias(name)


# --- shared inputs ----------------------------------------------------------------------


def _normalised(spark, sf):
    return RE.normalise_changes(fx.detections(spark, sf), bbox=None)


def _merged(spark, sf):
    return D.merge_detections(_normalised(spark, sf))


def _flagged(spark, sf):
    return REP.with_visible(_merged(spark, sf), ["added", "removed"], "medium", " Roof_A 50% ")


def _frames(spark, sf, max_dim=K.RUN_FRAME_MAX_DIM):
    return FR.working_frame(fx.scenes(spark, sf).select("scene_id", "width", "height"), max_dim=max_dim)


def _parsed(spark, sf):
    return RE.parse_responses(fx.responses(spark, sf))


def _tasks(spark, sf):
    """Responses with their task number, counted within the scene; parsed once and stored."""
    ensure_checkpoint_dir(spark)
    parsed = _parsed(spark, sf).checkpoint()
    numbered = D.number_rows(parsed, ["scene_id"], [F.col("event_id").asc()], "_n")
    return numbered.withColumn("task_idx", (F.col("_n") - 1).cast("int")).drop("_n")


def _response_changes(tasks):
    local = RE.explode_changes(tasks.where(~F.col("failed")).select("scene_id", "task_idx", "event_id", "changes"))
    return RE.normalise_changes(local)


def _run_summary(spark, sf):
    tasks = _tasks(spark, sf)
    merged = D.merge_detections(_response_changes(tasks).drop("event_id"))
    return REP.run_summary(tasks, merged)


# --- sources and sinks --------------------------------------------------------------------


def _paths(spark, sf):
    suffix = F.expr(
        "case page_id % 6 when 0 then '.PNG' when 1 then '.jpeg' when 2 then '.html' when 3 then ''"
        " when 4 then '.tar.TIFF' else '.webp' end"
    )
    return fx.table(spark, sf, "pages").select("page_id", F.concat("url", suffix).alias("path"))


@query
def s1_scan_gate(spark, sf):
    return S.gate_extension(_paths(spark, sf))


@query
def s3_size_guard(spark, sf):
    return S.split_accepted(fx.scenes(spark, sf).select("scene_id", "byte_len"))


@query
def s4_pair_scenes(spark, sf):
    return FR.pair_scenes(fx.images(spark, sf)).select(
        "scene_id", F.col("earlier.width").alias("ref_w"), F.col("earlier.height").alias("ref_h"),
        F.col("later.width").alias("tgt_w"), F.col("later.height").alias("tgt_h"),
    )


@query
def j9_unpaired_scenes(spark, sf):
    return FR.unpaired_scenes(fx.images(spark, sf))


@query
def s5_parse_data_url(spark, sf):
    prefix = F.expr(
        "case doc_id % 4 when 0 then 'data:image/png;base64,' when 1 then 'data:image/svg+xml;base64,'"
        " when 2 then 'data:text/plain;base64,' else 'DATA:image/png;base64,' end"
    )
    parts = X.data_url_parts(F.concat(prefix, F.col("text")))
    return fx.table(spark, sf, "documents").select("doc_id", parts.alias("p")).select(
        "doc_id", "p.media_type", "p.data", F.col("p").isNotNull().alias("valid")
    )


@query
def s6_to_data_url(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", X.to_data_url(F.encode("text", "utf-8"), "image/png").alias("url")
    )


@query
def s7_validate_requests(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        "doc_id", F.expr("case when doc_id % 5 = 0 then null else text end").alias("reference"),
        F.expr("case when doc_id % 7 = 0 then null else text end").alias("target"),
    )
    return RE.validate_requests(docs).select("doc_id", "reject_reason")


PROVIDERS = [("north", ["n-large", "n-small"], "n-large"), ("south", ["s-one"], "s-one")]


def _providers(spark):
    names, models, defaults = map(list, zip(*PROVIDERS))
    return spark.createDataFrame(pa.table({"provider": names, "models": models, "default_model": defaults}))


def _asked(spark, sf):
    return fx.table(spark, sf, "events").selectExpr(
        "event_id",
        "case event_id % 4 when 0 then 'north' when 1 then 'south' when 2 then 'west' else null end as provider",
        "case event_id % 5 when 0 then 'n-small' when 1 then 's-one' when 2 then null else 'other' end as model",
    )


@query
def n8_resolve_model(spark, sf):
    return RE.resolve_model(_asked(spark, sf), _providers(spark), "north")


@query
def n8_resolve_model_strict(spark, sf):
    return RE.resolve_model(_asked(spark, sf), _providers(spark), "north", strict=True)


@query
def s8_build_requests(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        "doc_id", F.expr("case when lang = 'de' then 'de' else 'en' end").alias("code"),
        F.lit("n-large").alias("resolved_model"),
        X.data_url_parts(X.to_data_url(F.encode("text", "utf-8"), "image/png")).alias("earlier"),
        X.data_url_parts(X.to_data_url(F.encode(F.reverse("text"), "utf-8"))).alias("later"),
    )
    return RE.build_requests(docs, F.col("code")).select("doc_id", "request_json")


@query
def s9_report_rows(spark, sf):
    labels = REP.label_table(spark)
    return report_rows(REP.report(_merged(spark, sf), labels, "de")).withColumn("n", F.col("n").cast("bigint"))


@query
def s10_failed_tasks(spark, sf):
    _, failed = RE.split_failed(_parsed(spark, sf))
    return failed.select("event_id", "scene_id", "failure")


# --- frames and tiles ------------------------------------------------------------------------


@query
def g1_working_frame(spark, sf):
    small = _frames(spark, sf, K.FRAME_MAX_DIM).withColumnsRenamed({"work_w": "small_w", "work_h": "small_h"})
    return FR.working_frame(small, max_dim=K.RUN_FRAME_MAX_DIM)


@query
def g2_fit_inside(spark, sf):
    return FR.fit_inside(fx.scenes(spark, sf).select("scene_id", "width", "height"))


@query
def g3_plan_grid(spark, sf):
    out = _frames(spark, sf).select("scene_id", "work_w", "work_h")
    for cap in (1, 3, 7, 16):
        out = FR.plan_grid(out, tile_px=380, max_tiles=cap).withColumnsRenamed(
            {"n_cols": f"cols_{cap}", "n_rows": f"rows_{cap}"})
    return out


TILE_COLUMNS = ["scene_id", "label", "x0", "y0", "sw", "sh", "out_w", "out_h", "gx", "gy", "gw", "gh"]


@query
def g4_explode_tiles(spark, sf):
    return FR.explode_tiles(_frames(spark, sf)).where("task_idx > 0").select(bigint("task_idx"), *TILE_COLUMNS)


@query
def g5_overview_tile(spark, sf):
    return FR.explode_tiles(_frames(spark, sf)).where("task_idx = 0").select(bigint("task_idx"), *TILE_COLUMNS)


@query
def g6_crop_size(spark, sf):
    w, h = FR.crop_size(F.col("width"), F.col("height"), K.TILE_OUT_PX)
    return fx.scenes(spark, sf).select("scene_id", w.alias("out_w"), h.alias("out_h"))


@query
def u1_ordered_tasks(spark, sf):
    # Spread before their rows are multiplied, so that no task sorts the tiles of very many scenes.
    tiles = FR.explode_tiles(spread_calls(_frames(spark, sf), calls_per_task=SCENES_PER_TASK, keys=["scene_id"]))
    return tiles.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.min_by("label", "task_idx").alias("first_label"),
        F.max_by("label", "task_idx").alias("last_label"),
    )


# --- boxes ---------------------------------------------------------------------------------


@query
def g8_map_to_global(spark, sf):
    tiles = FR.explode_tiles(_frames(spark, sf))
    # Every box gets a scene and a task that exist.
    sizes = tiles.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_tasks"))
    n_scenes = fx.table(spark, sf, "part").count()
    det = fx.detections(spark, sf).withColumn("scene_id", F.col("scene_id") % n_scenes).join(shuffled(sizes), "scene_id")
    det = det.withColumn("task_idx", (F.col("det_id") % F.col("n_tasks")).cast("int")).drop("n_tasks")
    return G.map_to_global(det, tiles).select("det_id", "scene_id", bigint("task_idx"), *"xywh")


@query
def g9_box_area(spark, sf):
    return fx.detections(spark, sf).select("det_id", B.area(B.box()).alias("area"))


@query
def g10_iou(spark, sf):
    turned = B.box(F.col("y"), F.col("x"), F.col("h"), F.col("w"))
    return fx.detections(spark, sf).select("det_id", B.iou(B.box(), turned).alias("iou"))


@query
def g11_rescale_boxes(spark, sf):
    sized = fx.detections(spark, sf).withColumns({
        "width": F.expr("400 + (det_id * 37) % 6000"), "height": F.expr("(det_id % 11) * (300 + (det_id * 53) % 5000)"),
    }).select("det_id", "width", "height", *"xywh")
    return G.rescale_boxes(sized)


def _points(spark, sf):
    return fx.detections(spark, sf).selectExpr(
        "det_id", "scene_id", "(det_id * 5 % 64 + 0.5e0) / 64 as px", "(det_id * 3 % 64 + 0.5e0) / 64 as py"
    )


def _spot_boxes(spark, sf):
    return REP.with_visible(_normalised(spark, sf), min_conf="medium", query="roof_a 50%")


@query
def g13_lit_points(spark, sf):
    return G.lit_points(_points(spark, sf), _spot_boxes(spark, sf))


@query
def g13_dim_points(spark, sf):
    return G.dim_points(_points(spark, sf), _spot_boxes(spark, sf)).groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n_dim"))


@query
def j6_iou_pairs(spark, sf):
    return G.iou_pairs(_normalised(spark, sf))


# --- parsing ---------------------------------------------------------------------------------


@query
def n1_first_text(spark, sf):
    def block(kind, text):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    raw, none = F.col("raw_text"), F.lit(None).cast("string")
    padded = F.concat(F.lit(" \t "), raw, F.lit(" \n"))
    content = (
        F.when(F.col("event_id") % 3 == 0, F.array(block("image", none), block("text", padded), block("text", F.lit("x"))))
        .when(F.col("event_id") % 3 == 1, F.array(block("image", raw)))
        .otherwise(F.array(block("text", raw), block("text", F.lit("y"))))
    )
    return fx.responses(spark, sf).select("event_id", X.first_text(content).alias("first_text"))


@query
def n2_strip_fences(spark, sf):
    wrapped = F.when(
        F.expr("cast(floor(event_id / 12) as bigint) % 2 = 0"), F.concat(F.lit("```\n"), F.col("raw_text"), F.lit("\n``` "))
    ).otherwise(F.col("raw_text"))
    return fx.responses(spark, sf).select("event_id", X.strip_fences(wrapped).alias("body"))


@query
def n3_parse_responses(spark, sf):
    return _parsed(spark, sf).select(
        "event_id", "failed", "failure", "summary",
        F.coalesce(F.size("changes"), F.lit(0)).cast("bigint").alias("n_changes"),
    )


@query
def n4_explode_changes(spark, sf):
    rows = RE.explode_changes(_parsed(spark, sf))
    return rows.select("event_id", bigint("pos"), "category", "change_type", "description", "confidence")


@query
def n5_normalise(spark, sf):
    return _normalised(spark, sf).select("det_id", "category", "change_type", "description", "confidence")


@query
def n6_clamp_box(spark, sf):
    raw = F.expr(
        "case when det_id % 29 = 0 then null when det_id % 31 = 0 then array(x * 2 - 0.5d)"
        " else array(x * 2 - 0.5d, y * 2 - 0.5d, w * 2, h * 3, 9.0d) end"
    )
    box = B.clamp_box(raw)
    return fx.detections(spark, sf).select("det_id", box.alias("b")).select("det_id", "b.*")


@query
def n6_response_boxes(spark, sf):
    rows = RE.normalise_changes(RE.explode_changes(_parsed(spark, sf)))
    return rows.select("event_id", bigint("pos"), "category", "change_type", "description", "confidence", *"xywh")


@query
def n7_response_defaults(spark, sf):
    rows = RE.with_local_id(RE.explode_changes(_parsed(spark, sf)))
    return rows.select("event_id", "id", "summary", "model")


@query
def n9_classify_errors(spark, sf):
    return RE.classify_errors(fx.responses(spark, sf)).select("event_id", "error_class")


# --- dimension lookups -------------------------------------------------------------------------


@query
def j3_confidence_pct(spark, sf):
    rows = REP.with_confidence_pct(_normalised(spark, sf))
    return rows.select("det_id", bigint("confidence_pct"), "confidence_label")


def _lang():
    return F.expr("case det_id % 3 when 0 then 'de' when 1 then 'en' else 'fr' end")


@query
def j4_translate(spark, sf):
    key = F.expr("case when det_id % 5 = 0 then concat('report.', category) else concat('cat.', category) end")
    return REP.translate(
        _normalised(spark, sf).select("det_id", "category"), REP.label_table(spark), key, _lang(), "words"
    ).select("det_id", "words")


@query
def j5_category_label(spark, sf):
    rows = REP.with_category_label(_normalised(spark, sf), REP.label_table(spark), _lang())
    return rows.select("det_id", "category_label")


# --- aggregates ----------------------------------------------------------------------------------


@query
def a1_counts_by_type(spark, sf):
    return REP.counts_by_type(_merged(spark, sf))


@query
def a2_visible_counts(spark, sf):
    return REP.visible_counts(_flagged(spark, sf))


@query
def a3_failed_count(spark, sf):
    return _run_summary(spark, sf).select("scene_id", "n_tasks", "n_failed")


@query
def a4_run_status(spark, sf):
    # Every third scene fails as a whole, every third one not at all, so that all three states occur.
    tasks = _tasks(spark, sf).withColumn(
        "failed", F.expr("case scene_id % 3 when 0 then failed when 1 then true else false end"))
    merged = D.merge_detections(_response_changes(tasks).drop("event_id"))
    return REP.run_summary(tasks, merged).select("scene_id", "status")


@query
def a5_first_error(spark, sf):
    return _run_summary(spark, sf).select("scene_id", "first_error")


@query
def a6_summary_pick(spark, sf):
    return _run_summary(spark, sf).select("scene_id", "summary", "n_changes")


@query
def a7_first_model(spark, sf):
    return _run_summary(spark, sf).select("scene_id", "model")


@query
def a8_progress(spark, sf):
    return REP.progress(FR.explode_tiles(_frames(spark, sf)), fx.responses(spark, sf))


# --- order and dedupe ---------------------------------------------------------------------------


@query
def d1_priority(spark, sf):
    return D.with_priority(fx.detections(spark, sf)).select("det_id", "priority")


@query
def d2_dedupe(spark, sf):
    return D.dedupe(_normalised(spark, sf)).select("det_id", "scene_id", "change_type")


@query
def d2_dedupe_rounds(spark, sf):
    return D.dedupe(_normalised(spark, sf), strategy="rounds", limit=8).select("det_id", "scene_id", "change_type")


@query
def d3_reading_order(spark, sf):
    return D.number_changes(_normalised(spark, sf)).select("det_id", "n")


@query
def d4_sequential_ids(spark, sf):
    return _merged(spark, sf).select("det_id", "scene_id", "id")


@query
def d5_stable_numbers(spark, sf):
    return _flagged(spark, sf).where("visible").select("det_id", "n")


# --- filters ---------------------------------------------------------------------------------------


@query
def f1_type_filter(spark, sf):
    return REP.filter_changes(_normalised(spark, sf), types=["added", "removed"]).select("det_id")


@query
def f2_min_confidence(spark, sf):
    return REP.filter_changes(fx.detections(spark, sf), types=[*K.CHANGE_TYPES, "moved"], min_conf="medium").select("det_id")


@query
def f3_text_search(spark, sf):
    return REP.filter_changes(_normalised(spark, sf), query="  ROOF_a 50% ").select("det_id")


@query
def f4_visible_flag(spark, sf):
    return REP.with_visible(_normalised(spark, sf), ["added", "modified"], "high", "hall").select("det_id", "visible")


# --- scalars -----------------------------------------------------------------------------------------


@query
def x1_clamp01(spark, sf):
    return fx.detections(spark, sf).select("det_id", clamp01(F.col("x") * 3 - 0.5).alias("v"))


@query
def x2_round_half_up(spark, sf):
    return fx.detections(spark, sf).select("det_id", round_half_up((F.col("det_id") % 41 - 20) / 8).alias("v"))


@query
def x3_interpolate(spark, sf):
    counts = REP.visible_counts(_flagged(spark, sf))
    lang = F.expr("case when scene_id % 2 = 0 then 'de' else 'en' end")
    return REP.report_heading(counts, REP.label_table(spark), lang).select("scene_id", "heading")


@query
def x3_error_text(spark, sf):
    lang = F.expr("case when scene_id % 2 = 0 then 'de' else 'en' end")
    return REP.error_text(_run_summary(spark, sf), REP.label_table(spark), lang).select("scene_id", "error_text")


# --- rasters -------------------------------------------------------------------------------------------


def _blocks(spark, sf, sample=fx.U16_SAMPLE):
    return R.to_blocks(fx.pixels(spark, sf, sample), fx.RASTER_BLOCK)


def _checksum(blocks, extra=()):
    """Per scene and band: count, sum and a sum weighted by position; exact for whole samples."""
    long = R.explode_blocks(blocks, fx.RASTER_BLOCK)
    weight = F.pmod(F.col("px") * 31 + F.col("py") * 17, F.lit(97))
    return long.groupBy("scene_id", "band", *extra).agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * weight).alias("placed")
    ).withColumn("band", F.col("band").cast("bigint"))


@query
def a9_raster_range(spark, sf):
    return R.raster_range(R.keep_bands(_blocks(spark, sf, fx.FLOAT_SAMPLE))).select("scene_id", "lo", "hi")


@query
def x7_grey(spark, sf):
    grey = R.explode_blocks(R.grey_blocks(_blocks(spark, sf, fx.U8_SAMPLE)), fx.RASTER_BLOCK)
    return grey.select("scene_id", bigint("px"), bigint("py"), F.col("v").alias("grey"))


@query
def x8_keep_bands(spark, sf):
    return _checksum(R.keep_bands(_blocks(spark, sf)))


@query
def x9_u16_to_u8(spark, sf):
    long = fx.pixels(spark, sf).where("band < 3")
    return long.groupBy("scene_id", "band").agg(
        F.sum(P.u16_to_u8(F.col("v")).cast("bigint")).alias("total")).withColumn("band", F.col("band").cast("bigint"))


@query
def x10_rescale_u8(spark, sf):
    blocks = _blocks(spark, sf, fx.FLOAT_SAMPLE).withColumn("dtype", F.lit("f32"))
    return _checksum(R.rescale_u8(blocks))


@query
def x10_rescale_by_dtype(spark, sf):
    dtype = F.expr("case scene_id % 3 when 0 then 'u8' when 1 then 'u16' else 'i32' end")
    return _checksum(R.rescale_u8(_blocks(spark, sf).withColumn("dtype", dtype)))


@query
def g7_crop(spark, sf):
    frames = fx.raster_pairs(spark, sf, fx.RASTER_W, fx.RASTER_H)
    tiles = FR.explode_tiles(frames, tile_px=10)
    pieces = R.crop(_blocks(spark, sf), tiles, fx.RASTER_BLOCK)
    at = pieces.select("scene_id", "task_idx", "band", "ox", "oy", "pw", F.posexplode("v").alias("i", "v"))
    tx = F.col("ox") + F.pmod("i", "pw")
    ty = F.col("oy") + F.floor(F.col("i") / F.col("pw"))
    return at.groupBy("scene_id", "task_idx", "band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"),
        F.sum(F.col("v") * F.pmod(tx * 31 + ty * 17, F.lit(97))).alias("placed"),
    ).select("scene_id", bigint("task_idx"), bigint("band"), "n", "total", "placed")


@query
def g7_crop_scaled(spark, sf):
    frames = fx.raster_pairs(spark, sf, fx.RASTER_W, fx.RASTER_H)
    tiles = FR.explode_tiles(frames, tile_px=10, max_tile_px=7, overview_px=17)
    long = R.explode_blocks(R.crop_scaled(_blocks(spark, sf), tiles, fx.RASTER_BLOCK), fx.RASTER_BLOCK)
    return long.groupBy("scene_id", "task_idx", "band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"),
        F.sum(F.col("v") * F.pmod(F.col("px") * 31 + F.col("py") * 17, F.lit(97))).alias("placed"),
    ).select("scene_id", bigint("task_idx"), bigint("band"), "n", "total", "placed")


# --- registration ------------------------------------------------------------------------------------


def _matches(spark, sf, odd=False):
    later, earlier = fx.keypoints(spark, sf, odd)
    return REG.match_descriptors(later, earlier)


def _corners_agree(found, wanted) -> Column:
    """Whether two nine-number homographies place the corners of a 256 x 256 image within half a pixel."""
    def place(h, x, y):
        depth = h[6] * x + h[7] * y + h[8]
        return (h[0] * x + h[1] * y + h[2]) / depth, (h[3] * x + h[4] * y + h[5]) / depth

    close = F.lit(True)
    for x, y in ((0.0, 0.0), (255.0, 0.0), (0.0, 255.0), (255.0, 255.0)):
        (u, v), (s, t) = place(found, x, y), place(wanted, x, y)
        close = close & (F.abs(u - s) < 0.5) & (F.abs(v - t) < 0.5)
    return close


@query
def j7_knn_hamming(spark, sf):
    later, earlier = fx.keypoints(spark, sf)
    rows = REG.knn_hamming(later, earlier)
    return rows.select(*[bigint(c) for c in ("scene_id", "q_id", "k", "t_id", "distance")])


@query
def d6_top_two(spark, sf):
    later, earlier = fx.keypoints(spark, sf)
    near = REG.nearest_two(later, earlier, block=16)
    d = F.transform("near", lambda m: m["d"])
    return near.select(bigint("scene_id"), bigint("q_id"), F.get(d, F.lit(0)).cast("bigint").alias("d1"),
                       F.get(d, F.lit(1)).cast("bigint").alias("d2"))


@query
def f6_ratio_test(spark, sf):
    later, earlier = fx.keypoints(spark, sf)
    return REG.ratio_test(REG.nearest_two(later, earlier)).select(
        *[bigint(c) for c in ("scene_id", "q_id", "t_id", "distance")])


@query
def f5_match_gate(spark, sf):
    return _matches(spark, sf, odd=True).select(bigint("scene_id"), "match_count").distinct()


@query
def r1_match_descriptors(spark, sf):
    return _matches(spark, sf).select(bigint("scene_id"), "q_id", "t_id", "sx", "sy", "dx", "dy")


@query
def r2_fit_homography(spark, sf):
    fits = REG.fit_homography(_matches(spark, sf))
    known = [F.lit(v) for v in fx.HOMOGRAPHY]
    found = [F.get("homography", F.lit(i)) for i in range(9)]
    return fits.select(bigint("scene_id"), "inliers", _corners_agree(found, known).alias("corners_agree"))


@query
def r3_project_points(spark, sf):
    later, _ = fx.keypoints(spark, sf)
    placed = later.withColumn("homography", F.array(*[F.lit(v) for v in fx.HOMOGRAPHY]))
    return REG.project_points(placed).select(bigint("scene_id"), "kp_id", "hx", "hy")


@query
def r4_warp_shift(spark, sf):
    shift = [1.0, 0.0, 3.0, 0.0, 1.0, 2.0, 0.0, 0.0, 1.0]
    frames = fx.raster_pairs(spark, sf, 40, 30).withColumn("homography", F.array(*[F.lit(v) for v in shift]))
    return _checksum(R.warp(_blocks(spark, sf), frames, fx.RASTER_BLOCK))


@query
def r4_warp_perspective(spark, sf):
    """A frame with the horizon inside: pixels beyond it map back to the source from the other side, or miss it."""
    matrix = F.array(*[F.lit(v) for v in fx.PERSPECTIVE])
    frames = fx.raster_pairs(spark, sf, 56, 40).withColumn("homography", matrix)
    return _checksum(R.warp(_blocks(spark, sf), frames, fx.RASTER_BLOCK))


@query
def r5_fallback_resize(spark, sf):
    frames = fx.raster_pairs(spark, sf, 64, 48).withColumn("homography", REG.fallback_homography())
    return _checksum(R.warp(_blocks(spark, sf), frames, fx.RASTER_BLOCK))


@query
def r6_align_status(spark, sf):
    ensure_checkpoint_dir(spark)
    matches = _matches(spark, sf, odd=True).checkpoint()
    pairs = fx.table(spark, sf, "embeddings").groupBy(F.col("label").alias("scene_id")).agg(
        (F.count(F.lit(1)) + 200).alias("work_w"), F.lit(256).cast("bigint").alias("work_h"),
        F.lit(256).cast("bigint").alias("tgt_w"), F.lit(256).cast("bigint").alias("tgt_h"),
    )
    status = REG.align_status(pairs, matches, REG.fit_homography(matches, store=False))
    zero, one = F.lit(0.0), F.lit(1.0)
    scaling = [F.col("work_w") / F.col("tgt_w"), zero, zero, zero, F.col("work_h") / F.col("tgt_h"), zero, zero, zero, one]
    wanted = [F.when(F.col("aligned"), F.lit(k)).otherwise(s) for k, s in zip(fx.HOMOGRAPHY, scaling)]
    found = [F.get("homography", F.lit(i)) for i in range(9)]
    return status.select(
        bigint("scene_id"), "work_w", "work_h", "aligned", "match_count", _corners_agree(found, wanted).alias("corners_agree"))


# --- detector --------------------------------------------------------------------------------------------


def make_stub():
    """A deterministic detector: one change per tile, every fifth task fails."""
    kinds = K.CHANGE_TYPES

    def stub(row: dict) -> str:
        code = int(row["scene_id"]) + int(row["task_idx"])
        if code % 5 == 0:
            raise RuntimeError(f"no answer {code}")
        change = {
            "category": "house", "change_type": kinds[code % 3], "description": f"tile {row['task_idx']}",
            "confidence": K.CONFIDENCES[code % 2], "bbox": [0.25, 0.25, 0.5, 0.75],
        }
        return json.dumps({"summary": "", "changes": [change]}, separators=(",", ":"))

    return stub


@query
def v1_detect(spark, sf):
    tiles = FR.explode_tiles(_frames(spark, sf))
    return detect(tiles.select("scene_id", "task_idx"), make_stub, ["scene_id", "task_idx"]).select(
        "scene_id", bigint("task_idx"), "raw_text", "error")


@query
def v1_detect_resumed(spark, sf):
    """A first run over two thirds of the scenes, then one over all: stored answers stay, failed ones are tried again."""
    tiles = FR.explode_tiles(_frames(spark, sf)).select("scene_id", "task_idx")
    path = scratch_path(spark, "answers")
    detect_stored(tiles.where("scene_id % 3 <> 0"), make_stub, ["scene_id", "task_idx"], path)
    return detect_stored(tiles, make_stub, ["scene_id", "task_idx"], path, retry_failed=True).select(
        "scene_id", bigint("task_idx"), "raw_text", "error", bigint("attempt"))


def _run(spark, sf):
    pairs = FR.pair_scenes(fx.images(spark, sf)).select("scene_id", "earlier.width", "earlier.height")
    return run_changes(pairs, make_stub, "stub")


@query
def e1_run_changes(spark, sf):
    return _run(spark, sf).changes.select("scene_id", "n", "change_type", "confidence", "description", *"xywh")


@query
def e2_run_summary(spark, sf):
    return _run(spark, sf).summary


def make_pixel_stub():
    """A detector that reads pixels: one change per tile, described by how much brighter the earlier date is."""
    kinds = K.CHANGE_TYPES

    def stub(row: dict) -> str:
        total = {"earlier": 0, "later": 0}
        for piece in row["pieces"]:
            if piece["band"] == 0:
                total[piece["epoch"]] += int(piece["v"].sum())
        brighter = total["earlier"] - total["later"]
        change = {
            "category": "house", "change_type": kinds[brighter % 3], "description": f"brighter by {brighter}",
            "confidence": "high", "bbox": [0.25, 0.25, 0.5, 0.5],
        }
        return json.dumps({"summary": "", "changes": [change]}, separators=(",", ":"))

    return stub


@query
def e3_run_images(spark, sf):
    pairs = fx.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("scene_id"),
        *[F.lit(v).cast("bigint").alias(n) for n, v in (("width", fx.RASTER_W), ("height", fx.RASTER_H),
                                                        ("tgt_w", fx.RASTER_W), ("tgt_h", fx.RASTER_H))],
        F.lit(fx.RASTER_BANDS).alias("n_bands"),
    )
    blocks = R.to_blocks(fx.dated_pixels(spark, sf), fx.RASTER_BLOCK)
    later, earlier = fx.raster_keypoints(spark, sf, fx.LATER_SHIFT), fx.raster_keypoints(spark, sf)
    run = run_images(pairs, blocks, later, earlier, make_pixel_stub, "stub", size=fx.RASTER_BLOCK)
    return run.changes.select("scene_id", "n", "change_type", "confidence", "description", *"xywh")


@query
def r4_resize_earlier(spark, sf):
    frames = fx.raster_pairs(spark, sf, 16, 12)
    blocks = R.to_blocks(fx.dated_pixels(spark, sf), fx.RASTER_BLOCK)
    return _checksum(R.resize(blocks, frames, fx.RASTER_BLOCK, "earlier"))


def make_service_stub():
    """A model service that reports the sizes of both images of a request, and refuses models of one provider."""
    def send(request: str) -> str:
        asked = json.loads(request)
        if asked["model"] == "s-one":
            raise PermissionError("403 for this model")
        blocks = asked["messages"][0]["content"]
        before, after = (len(b["source"]["data"]) for b in blocks if b["type"] == "image")
        change = {"category": "plot", "change_type": "modified", "description": f"{before} and {after}", "confidence": "low", "bbox": [0, 0, 1, 1]}
        answer = json.dumps({"summary": "", "changes": [change]})
        return json.dumps({"content": [{"type": "text", "text": f" ```json\n{answer}\n``` "}]})

    return send


@query
def e4_run_requests(spark, sf):
    """Every document is a scene of one tile, its text and its first ten characters the two images."""
    def image(text):
        return X.to_data_url(F.encode(text, "utf-8"), "image/png")

    code = F.col("doc_id") % 7
    whole = F.coalesce("text", F.lit(""))
    tasks = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("scene_id"), F.lit(0).alias("task_idx"),
        *[F.lit(v).alias(n) for n, v in (("gx", 0.0), ("gy", 0.0), ("gw", 1.0), ("gh", 1.0))],
        F.when(code != 1, image(whole)).alias("reference"),
        F.when(code == 2, F.lit("no image")).otherwise(image(F.left(whole, F.lit(10)))).alias("target"),
        F.when(code == 3, F.lit("south")).alias("provider"), F.when(code == 4, F.lit("n-small")).alias("model"),
    )
    run = run_requests(tasks, _providers(spark), "north", make_service_stub, "de")
    found = run.changes.select("scene_id", "description")
    return run.responses.join(found, "scene_id", "left").select("scene_id", "model", "failed", "error_class", "failure", "description")

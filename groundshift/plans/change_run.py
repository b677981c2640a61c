"""From scene pairs to merged changes and run summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.text import data_url_parts, first_text
from ..operators.dedupe import merge_detections
from ..operators.detector import Detector, detect, detect_stored, newest_answers, spread_calls, stored_answers
from ..operators.frames import explode_tiles, working_frame
from ..operators.raster import BLOCK, crop_scaled, resize, tile_pieces, warp
from ..operators.registration import align_status, fit_homography, match_descriptors
from ..operators.geometry import map_in_place
from ..operators.report import run_summary
from ..operators.responses import (
    RequestText, build_requests, classify_errors, explode_changes, normalise_changes, parse_responses, resolve_model, validate_requests,
)
from ..operators.skew import shuffled
from ..session import ensure_checkpoint_dir
from ..sources.reports import write_scenes

TILE_FRACTIONS = ["gx", "gy", "gw", "gh"]
# Aligned scenes whose blocks one task plans.
FRAMES_PER_TASK = 4096


@dataclass
class ChangeRun:
    """Tables of one run: parsed responses, merged changes, one summary row per scene."""

    responses: DataFrame
    changes: DataFrame
    summary: DataFrame


def plan_tasks(pairs: DataFrame, max_dim: int = K.RUN_FRAME_MAX_DIM) -> DataFrame:
    """Detector tasks of pairs with width and height of the earlier image."""
    return explode_tiles(working_frame(pairs, max_dim=max_dim))


def run_changes(
    pairs: DataFrame,
    make_detector: Callable[[], Detector],
    model: str = "",
    parallelism: int | None = None,
    store: bool = True,
    answers: str | None = None,
    retry_failed: bool = False,
) -> ChangeRun:
    """Detect and merge the changes of all pairs.

    Responses carry the fractions of their tile, so mapping to scene coordinates needs no join. With a folder for ``answers`` they are
    kept there and a later run, or one after a failure, calls only what is not there yet (see ``detect_stored``).
    """
    raw = _answers(plan_tasks(pairs), make_detector, answers, retry_failed, parallelism=parallelism)
    return merge_responses(raw.withColumn("model", F.lit(model)), store)


def _answers(tasks: DataFrame, make_detector, path: str | None, retry_failed: bool, more: tuple[str, ...] = (), **options) -> DataFrame:
    carry = ["scene_id", "task_idx", *TILE_FRACTIONS, *more]
    if path is None:
        return detect(tasks, make_detector, carry, **options)
    options.pop("calls", None)
    return detect_stored(tasks, make_detector, carry, path, retry_failed, **options).drop("attempt")


def rerun_failed(
    pairs: DataFrame, make_detector: Callable[[], Detector], answers: str, changes: str, model: str = "", parallelism: int | None = None,
) -> ChangeRun:
    """Call the quarantined tasks of a stored run again and merge only their scenes; the tables of these scenes.

    ``answers`` is the folder of a run by ``run_changes`` over the same pairs, ``changes`` what ``write_scenes`` wrote of it. Tasks whose
    newest answer is an error or cannot be parsed are called once more, and new changes replace the partitions of their
    scenes. Other scenes are neither read nor written, and the result equals that of a full run with the same answers: a
    failed task has no boxes, so a scene that had changes keeps some. Without failed tasks nothing is called or written.
    """
    carry = ["scene_id", "task_idx", *TILE_FRACTIONS]
    tasks = plan_tasks(pairs)
    ensure_checkpoint_dir(pairs.sparkSession)
    known = newest_answers(stored_answers(tasks, carry, answers))
    failed = parse_responses(known).where("failed").select("scene_id", "task_idx").checkpoint()
    mine = tasks.join(failed.select("scene_id").distinct(), "scene_id", "left_semi")
    raw = detect_stored(mine, make_detector, carry, answers, retry=failed, parallelism=parallelism).drop("attempt")
    run = merge_responses(raw.withColumn("model", F.lit(model)))
    write_scenes(run.changes, changes)
    return run


def align_pairs(pairs: DataFrame, later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Pairs (scene_id, width, height, tgt_w, tgt_h) with working frame, homography and alignment status.

    ``later`` and ``earlier`` are keypoint tables. Scenes that cannot be registered take the scaling of the later
    image to the frame.
    """
    frames = working_frame(pairs, max_dim=K.RUN_FRAME_MAX_DIM).where("work_w >= 1 and work_h >= 1")
    ensure_checkpoint_dir(pairs.sparkSession)
    matches = match_descriptors(later, earlier).checkpoint()
    # One small row a scene, read by warp, resize and tiling: the fit is computed once, and rows that become many blocks are spread.
    aligned = align_status(frames, matches, fit_homography(matches, store=False))
    return spread_calls(aligned, frames.count(), FRAMES_PER_TASK, keys=["scene_id"]).checkpoint()


def run_images(
    pairs: DataFrame,
    blocks: DataFrame,
    later: DataFrame,
    earlier: DataFrame,
    make_detector: Callable[[], Detector],
    model: str = "",
    parallelism: int | None = None,
    size: int = BLOCK,
    answers: str | None = None,
    retry_failed: bool = False,
    **tiling,
) -> ChangeRun:
    """The whole run on pixels: align, bring both images to the working frame, cut tiles, detect, merge.

    ``pairs`` has scene_id, width, height (earlier image), tgt_w, tgt_h (later image) and n_bands; ``blocks`` the pixel
    blocks of both epochs. A detector row carries its tile and ``pieces``, the pixels of both epochs in it, reduced to the tile's output
    size. Answers that fail are kept with their error, see ``merge_responses``; ``answers`` and ``retry_failed`` are those of
    ``run_changes``, and ``tiling`` those of ``explode_tiles``.
    """
    tasks, tiles = image_tasks(pairs, blocks, later, earlier, size, **tiling)
    # Tiles are counted without their pixels.
    raw = _answers(tasks, make_detector, answers, retry_failed, parallelism=parallelism, calls=None if answers else tiles.count())
    return merge_responses(raw.withColumn("model", F.lit(model)))


def image_tasks(
    pairs: DataFrame, blocks: DataFrame, later: DataFrame, earlier: DataFrame, size: int = BLOCK, **tiling,
) -> tuple[DataFrame, DataFrame]:
    """Detector tasks with the ``pieces`` of their aligned, reduced tiles, and the tiles alone; arguments as for ``run_images``."""
    aligned = align_pairs(pairs, later, earlier)
    as_earlier = aligned.withColumns({"tgt_w": F.col("width"), "tgt_h": F.col("height")}).drop("homography")
    scene = warp(blocks, aligned, size, "later").unionByName(resize(blocks, as_earlier, size, "earlier"))
    tiles = explode_tiles(aligned.select("scene_id", "work_w", "work_h"), **tiling)
    return tiles.join(shuffled(tile_pieces(crop_scaled(scene, tiles, size, sample="float"))), ["scene_id", "task_idx"], "left"), tiles


def run_requests(
    tasks: DataFrame,
    providers: DataFrame,
    default_provider: str,
    make_send: Callable[[], Callable[[str], str]],
    lang: str | None = None,
    text: RequestText | None = None,
    parallelism: int | None = None,
    answers: str | None = None,
    retry_failed: bool = False,
) -> ChangeRun:
    """Ask a model service about tiles and merge its answers.

    ``tasks`` are tiles with both images as data URLs, ``reference`` and ``target``, and the wanted ``provider`` and ``model``, which are
    resolved against ``providers`` as ``resolve_model`` does. ``make_send`` returns a callable from the request, as JSON text, to the
    body of the response, whose first text block is the answer; any other body is an empty answer, which fails to parse.
    Tiles without two images, or with something else than image data URLs, are failed rows and nothing is sent. Responses
    carry the resolved model and ``error_class``. ``answers`` and ``retry_failed`` are those of ``run_changes``.
    """
    def make_detector() -> Detector:
        send = make_send()
        return lambda row: send(row["request_json"])

    key = ["scene_id", "task_idx", *TILE_FRACTIONS]
    checked = validate_requests(tasks).withColumns({"earlier": data_url_parts(F.col("reference")), "later": data_url_parts(F.col("target"))})
    unreadable = F.when(F.col("earlier").isNull() | F.col("later").isNull(), "image data URLs are required")
    resolved = resolve_model(checked.withColumn("reject_reason", F.coalesce("reject_reason", unreadable)), providers, default_provider)
    good = build_requests(resolved.where("reject_reason is null").withColumn("model", F.col("resolved_model")), lang, text)
    sent = _answers(good.select(*key, "model", "request_json"), make_detector, answers, retry_failed, ("model",), parallelism=parallelism)
    body = F.from_json("raw_text", "content array<struct<type: string, text: string>>")
    raw = sent.withColumn("raw_text", F.when(F.col("error").isNull(), first_text(body["content"])))
    rejected = resolved.where("reject_reason is not null").select(
        *key, F.col("resolved_model").alias("model"), F.lit(None).cast("string").alias("raw_text"), F.col("reject_reason").alias("error"))
    every = raw.unionByName(rejected).withColumn("http_status", F.lit(None).cast("int"))
    return merge_responses(classify_errors(every).drop("http_status"))


def merge_responses(raw: DataFrame, store: bool = True) -> ChangeRun:
    """Parse, map and merge task responses (scene_id, task_idx, raw_text, error, model, gx, gy, gw, gh).

    Changes and summary both read the parsed responses, so these are checkpointed when ``store`` is
    set: every detector call and every parse then happens once.
    """
    parsed = parse_responses(raw)
    if store:
        ensure_checkpoint_dir(raw.sparkSession)
        parsed = parsed.checkpoint()
    local = explode_changes(parsed.where(~F.col("failed")).select("scene_id", "task_idx", *TILE_FRACTIONS, "changes"))
    changes = merge_detections(map_in_place(normalise_changes(local)))
    responses = parsed.drop("changes")
    return ChangeRun(responses, changes, run_summary(responses, changes))

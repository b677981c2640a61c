"""Detector calls: spread by number, several in flight, and never repeated once stored."""

import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from groundshift.plans.change_run import rerun_failed, run_changes
from groundshift.sources.reports import write_scenes
from groundshift.operators.detector import detect, detect_stored, python_values, spread_calls


def tasks(spark, scenes, per_scene=3):
    return spark.range(scenes).select(F.col("id").alias("scene_id"), F.explode(F.sequence(F.lit(0), F.lit(per_scene - 1))).alias("task_idx"))


def logging_detector(folder, fails=()):
    """Leaves one file a call, so calls are counted across Python workers."""
    def make():
        def call(row):
            (folder / f"{row['scene_id']}-{row['task_idx']}-{uuid.uuid4().hex}").touch()
            if row["scene_id"] in fails:
                raise ValueError(f"scene {row['scene_id']}")
            return f"{row['scene_id']}/{row['task_idx']}"
        return call
    return make


def calls(folder):
    return sorted(tuple(map(int, f.name.split("-")[:2])) for f in folder.iterdir())


def rows(df):
    return {(r.scene_id, r.task_idx): (r.raw_text, r.error, r.attempt) for r in df.collect()}


def test_rows_are_spread_by_their_number(spark):
    few = tasks(spark, 40).coalesce(1)
    assert spread_calls(few, calls_per_task=10).rdd.getNumPartitions() == 12
    assert spread_calls(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread_calls(few.limit(2), calls=2).rdd.getNumPartitions() == 2
    assert spread_calls(few.limit(0)).rdd.getNumPartitions() == 1
    assert spread_calls(few, parallelism=3).rdd.getNumPartitions() == 3
    sizes = [len(p) for p in detect(few, lambda: lambda row: "a", ["scene_id"], calls_per_task=10).rdd.glom().collect()]
    assert len(sizes) == 12 and max(sizes) < 40


def test_calls_of_one_task_overlap(spark):
    def make():
        def call(row):
            time.sleep(0.25)
            return str(time.time())
        return call

    one = tasks(spark, 16, 1).coalesce(1)
    detect(one, make, ["scene_id"], parallelism=1, in_flight=16).collect()
    start = time.time()
    ends = [float(r.raw_text) for r in detect(one, make, ["scene_id"], parallelism=1, in_flight=16).collect()]
    assert max(ends) - min(ends) < 1.0 and time.time() - start < 3.5
    ends = sorted(float(r.raw_text) for r in detect(one.limit(4), make, ["scene_id"], parallelism=1, in_flight=1).collect())
    assert all(b - a >= 0.2 for a, b in zip(ends, ends[1:]))


def test_answers_stay_with_their_rows_and_errors_are_kept(spark):
    def make():
        def call(row):
            if row["task_idx"] == 1:
                raise ValueError("no")
            return f"{row['scene_id']}:{type(row['scene_id']).__name__}"
        return call

    got = detect(tasks(spark, 50), make, ["scene_id", "task_idx"], in_flight=8).collect()
    assert len(got) == 150
    for r in got:
        assert (r.raw_text, r.error) == ((None, "no") if r.task_idx == 1 else (f"{r.scene_id}:int", None))


def test_a_detector_that_cannot_be_made_is_an_error_of_its_rows(spark):
    def make():
        raise OSError("no service")

    assert {r.error for r in detect(tasks(spark, 3), make, ["scene_id"]).collect()} == {"no service"}


def test_lists_of_numbers_reach_the_detector_as_arrays():
    rows_ = [{"a": [1.0, 2.0], "s": [{"v": [1, 2, 3], "n": "x"}, {"v": [], "n": None}]}, {"a": None, "s": []}, {"a": [3.0], "s": None}]
    table = pa.Table.from_pylist(rows_).slice(0, 3)
    a, s = (python_values(table.column(c).combine_chunks()) for c in "as")
    assert isinstance(a[0], np.ndarray) and a[0].tolist() == [1.0, 2.0] and a[1] is None and a[2].tolist() == [3.0]
    assert s[0][0]["v"].tolist() == [1, 2, 3] and s[0][1]["n"] is None and s[1] == [] and s[2] is None
    part = python_values(table.column("s").combine_chunks().slice(1, 2))
    assert part == [[], None]
    assert python_values(pa.array([[1, None], [2]])) == [[1, None], [2]]


def test_a_stored_call_is_not_repeated(spark, tmp_path):
    log, answers = tmp_path / "log", str(tmp_path / "answers")
    log.mkdir()
    carry = ["scene_id", "task_idx"]
    first = detect_stored(tasks(spark, 4), logging_detector(log), carry, answers)
    assert len(rows(first)) == 12 and calls(log) == sorted(rows(first))
    again = rows(detect_stored(tasks(spark, 6), logging_detector(log), carry, answers))
    assert calls(log) == sorted(again) and len(again) == 18
    assert again[0, 0] == ("0/0", None, 1) and again[5, 2] == ("5/2", None, 2)
    assert rows(detect_stored(tasks(spark, 2), logging_detector(log), carry, answers)).keys() == {(s, t) for s in (0, 1) for t in range(3)}
    assert len(calls(log)) == 18


def test_a_killed_run_goes_on_after_its_last_wave(spark, tmp_path):
    log, answers = tmp_path / "log", str(tmp_path / "answers")
    log.mkdir()
    carry = ["scene_id", "task_idx"]

    class Killed(BaseException):
        pass

    working = logging_detector(log)

    def dying():
        call = working()

        def attempt(row):
            if row["scene_id"] == 11:
                raise Killed("executor gone")  # not an Exception: the Spark job fails
            return call(row)
        return attempt

    try:
        detect_stored(tasks(spark, 20), dying, carry, answers, calls_per_wave=6).collect()
        raise AssertionError("the first run should fail")
    except Exception as problem:
        assert "executor gone" in str(problem)
    stored = {(r.scene_id, r.task_idx) for r in spark.read.parquet(answers).collect()}
    before = calls(log)
    full = rows(detect_stored(tasks(spark, 20), logging_detector(log), carry, answers, calls_per_wave=6))
    assert len(full) == 60 and all(error is None for _, error, _ in full.values())
    later = list(calls(log))
    for call in before:
        later.remove(call)
    assert not stored & set(later) and set(later) | stored == set(full) and len(later) == len(set(later))


def test_failed_calls_are_tried_again_when_asked(spark, tmp_path):
    log, answers = tmp_path / "log", str(tmp_path / "answers")
    log.mkdir()
    carry = ["scene_id", "task_idx"]
    detect_stored(tasks(spark, 5), logging_detector(log, fails=(2, 3)), carry, answers)
    kept = rows(detect_stored(tasks(spark, 5), logging_detector(log), carry, answers))
    assert kept[2, 0] == (None, "scene 2", 1) and len(calls(log)) == 15
    mended = rows(detect_stored(tasks(spark, 5), logging_detector(log, fails=(3,)), carry, answers, retry_failed=True))
    assert mended[2, 0] == ("2/0", None, 2) and mended[3, 1] == (None, "scene 3", 2) and mended[4, 0][2] == 1 and len(calls(log)) == 21


def test_no_tasks(spark, tmp_path):
    none = tasks(spark, 0)
    assert detect(none, lambda: str, ["scene_id"]).collect() == []
    assert detect_stored(none, lambda: str, ["scene_id", "task_idx"], str(tmp_path / "answers")).collect() == []


def answering(bad=(), garbled=()):
    """One box a task, in a place of its own; some scenes' second task fails or answers nonsense."""
    def make():
        def call(row):
            if row["task_idx"] == 1 and row["scene_id"] in bad:
                raise ValueError("down")
            if row["task_idx"] == 1 and row["scene_id"] in garbled:
                return "not JSON"
            box = '{"x": 0.1, "y": 0.2, "w": 0.3, "h": 0.2}'
            return '{"summary": "s", "changes": [{"type": "new", "category": "building", "description": "d", "confidence": 0.9, "bbox": %s}]}' % box
        return call
    return make


def test_rerun_merges_touched_scenes_only(spark, tmp_path):
    pairs = spark.range(6).selectExpr("id as scene_id", "2000 as width", "1500 as height")
    table = str(tmp_path / "changes")
    files = lambda: {f.relative_to(table): f.stat().st_mtime_ns for f in (tmp_path / "changes").rglob("*.parquet")}
    columns = lambda df: sorted(map(str, (r.asDict() for r in df.select(sorted(df.columns)).collect())))
    first = run_changes(pairs, answering(bad=(2,), garbled=(4,)), answers=str(tmp_path / "answers"))
    write_scenes(first.changes, table)
    before = files()
    rerun_failed(pairs, answering(), str(tmp_path / "answers"), table)
    after = files()
    scene = lambda f: f.parts[0]
    assert {scene(f) for f in set(before) ^ set(after)} == {"scene_id=2", "scene_id=4"}
    assert all(after[f] == t for f, t in before.items() if scene(f) not in ("scene_id=2", "scene_id=4"))
    stored = spark.read.parquet(str(tmp_path / "answers"))
    assert {(r.scene_id, r.task_idx) for r in stored.where("attempt = 2").collect()} == {(2, 1), (4, 1)}
    full = run_changes(pairs, answering()).changes
    assert columns(spark.read.parquet(table).withColumn("scene_id", F.col("scene_id").cast("long"))) == columns(full)
    kept = files()
    assert rerun_failed(pairs, answering(), str(tmp_path / "answers"), table).changes.count() == 0 and files() == kept

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from groundshift.operators import report as REP
from groundshift.operators.detector import detect
from groundshift.operators.responses import parse_responses, split_failed
from groundshift.plans.change_run import run_changes
from groundshift.sources.reports import REPORT_COLUMNS, write_failures, write_report, write_requests

# The detectors below run in tasks, which cannot import a test module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = "scene_id int, n bigint, id string, category string, change_type string, description string, confidence string"


def changes(spark):
    rows = [
        (0, 1, "chg-1", "house", "added", "Roof_A 50% larger", "high"),
        (0, 2, "chg-2", "silo", "removed", "Roof-A 500 larger", "low"),
        (0, 3, "chg-3", "road", "modified", 'new "ring" road, east\nside', "medium"),
        (1, 1, "chg-1", "road", "moved", "x", "unsure"),
    ]
    df = spark.createDataFrame(rows, ROWS)
    return df.withColumns({c: F.lit(0.5) for c in "xywh"})


def visible(df, **kw):
    return {(r.scene_id, r.n) for r in REP.with_visible(df, **kw).where("visible").collect()}


def test_filters(spark):
    df = changes(spark)
    assert visible(df) == {(0, 1), (0, 2), (0, 3)}
    assert visible(df, query="roof_a 50%") == {(0, 1)}
    assert visible(df, query="LARGER house") == {(0, 1)}
    assert visible(df, query="   ") == {(0, 1), (0, 2), (0, 3)}
    assert visible(df, min_conf="medium") == {(0, 1), (0, 3)}
    assert visible(df, types=["moved"], min_conf="high") == {(1, 1)}
    assert {r.n for r in REP.filter_changes(df, ["added", "removed"], "medium").collect()} == {1}


def test_counts_keep_zeros(spark):
    got = {r.scene_id: tuple(r)[1:] for r in REP.counts_by_type(changes(spark)).collect()}
    assert got == {0: (1, 1, 1), 1: (0, 0, 0)}


def test_labels_fall_back(spark):
    labels = REP.label_table(spark).where("not (lang = 'de' and key = 'cat.house')")
    got = {r.n: r.category_label for r in
           REP.with_category_label(changes(spark).where("scene_id = 0"), labels, "de").collect()}
    assert got == {1: "house", 2: "silo", 3: "Straße"}
    keys = spark.createDataFrame([("cat.road", "fr"), ("none", "de"), ("cat.road", None)], "k string, l string")
    assert [r.t for r in REP.translate(keys, labels, F.col("k"), F.col("l"), "t").collect()] == ["road", "none", "road"]


def test_headings(spark):
    counts = spark.createDataFrame([(0, 3, 3), (1, 2, 3)], "scene_id int, n_visible bigint, n_total bigint")
    got = {r.scene_id: r.heading for r in REP.report_heading(counts, REP.label_table(spark), "de").collect()}
    assert got == {0: "Veränderungsbericht (3)", 1: "Veränderungsbericht (2 von 3)"}


def test_csv_export_holds_all_rows(spark, tmp_path):
    out = REP.report(changes(spark), REP.label_table(spark), "en", min_conf="high")
    write_report(out, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == REPORT_COLUMNS and back.count() == 4
    assert {r.description for r in back.collect()} == {r.description for r in changes(spark).collect()}
    write_report(REP.report(changes(spark), REP.label_table(spark), only_visible=True), str(tmp_path / "pq"), "parquet", ["scene_id"])
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 3


def summary(spark, responses, n_changes):
    df = spark.createDataFrame(
        responses, "scene_id int, task_idx int, failed boolean, failure string, summary string, model string")
    rows = [(0, i) for i in range(n_changes)]
    merged = spark.createDataFrame(rows, "scene_id int, n int")
    return REP.run_summary(df, merged).first().asDict()


def test_run_summary(spark):
    ok = summary(spark, [(0, 0, False, None, "over", ""), (0, 1, False, None, "tile", "m2"), (0, 2, False, None, "", "m3")], 2)
    assert ok == {"scene_id": 0, "summary": "over", "model": "m2", "n_changes": 2, "n_tasks": 3, "n_failed": 0,
                  "first_error": None, "status": "none"}
    some = summary(spark, [(0, 2, True, "late", "", ""), (0, 1, True, "", "", ""), (0, 0, False, None, "", "")], 1)
    assert (some["summary"], some["first_error"], some["status"], some["model"]) == (
        "1 change detected across 3 regions.", "unknown error", "some", "")
    gone = summary(spark, [(0, 0, True, "first", "x", "m"), (0, 1, True, "second", "", "")], 0)
    assert (gone["summary"], gone["first_error"], gone["status"], gone["model"]) == (
        "0 changes detected across 2 regions.", "first", "all", "")


def test_progress_counts_failures(spark):
    tiles = spark.createDataFrame([(s, t) for s in (0, 1) for t in range(3)], "scene_id int, task_idx int")
    done = spark.createDataFrame([(0, 0, "e"), (0, 1, None)], "scene_id int, task_idx int, error string")
    assert {tuple(r) for r in REP.progress(tiles, done).collect()} == {(0, 2, 3), (1, 0, 3)}


def make_counting_detector():
    seen = []

    def call(row):
        seen.append(row["k"])
        if row["k"] % 2:
            raise ValueError(f"bad {row['k']}")
        return str(row["k"])

    return call


def test_detector_isolates_failures(spark):
    out = detect(spark.range(20).withColumnRenamed("id", "k"), make_counting_detector, ["k"], parallelism=3)
    rows = {r.k: (r.raw_text, r.error) for r in out.collect()}
    assert rows == {k: (None, f"bad {k}") if k % 2 else (str(k), None) for k in range(20)}
    assert detect(spark.range(5).withColumnRenamed("id", "k"), make_counting_detector, ["k"], None).count() == 5


def make_seam_detector():
    """Reports one fixed spot of the scene from every tile that sees it."""
    def call(row):
        x, y = (0.5 - row["gx"]) / row["gw"], (0.5 - row["gy"]) / row["gh"]
        if not (0 <= x <= 1 and 0 <= y <= 1):
            return '{"summary":"","changes":[]}'
        box = [x, y, 0.05 / row["gw"], 0.05 / row["gh"]]
        return "```json\n" + json.dumps({"summary": "", "changes": [
            {"category": "house", "change_type": "added", "description": "d", "confidence": "high", "bbox": box}]}) + "\n```"

    return call


def test_run_merges_what_several_tiles_report(spark):
    pairs = spark.createDataFrame([(s, 2000, 1500) for s in range(3)], "scene_id int, width bigint, height bigint")
    run = run_changes(pairs, make_seam_detector, "m")
    got = run.changes.collect()
    assert len(got) == 3 and all(abs(r.x - 0.5) < 1e-9 and r.id == "chg-1" for r in got)
    summary_rows = run.summary.collect()
    assert {(r.n_tasks, r.n_changes, r.status, r.summary, r.model) for r in summary_rows} == {
        (7, 1, "none", "1 change detected across 7 regions.", "m")}


def test_quarantine_and_request_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "{}", None), (2, "x", None), (3, None, "boom")], "k int, raw_text string, error string")
    good, failed = split_failed(parse_responses(df))
    assert [r.k for r in good.collect()] == [1]
    write_failures(failed, str(tmp_path / "f"))
    assert {r.k for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {2, 3}
    write_requests(spark.createDataFrame([('{"a":1}',)], "request_json string"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().a == 1

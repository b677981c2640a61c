from pyspark.sql import functions as F

from groundshift.operators.responses import explode_changes, normalise_changes, parse_responses
from groundshift.streaming.progress import stream_progress

SCHEMA = "scene_id int, task_idx int, raw_text string, error string"


def run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()


def test_progress_and_row_operators_on_a_stream(spark, tmp_path):
    folder = str(tmp_path / "responses")
    spark.createDataFrame(
        [(0, 0, '{"changes":[{"category":"road"}]}', None), (0, 1, None, "e"), (1, 0, "bad", None)], SCHEMA
    ).write.json(folder)
    source = spark.readStream.schema(SCHEMA).json(folder)
    totals = spark.createDataFrame([(0, 3), (1, 1), (2, 9)], "scene_id int, total int")
    run(stream_progress(source, totals), "done", "complete")
    assert {(r.scene_id, r.done, r.total) for r in spark.table("done").collect()} == {(0, 2, 3), (1, 1, 1)}
    run(normalise_changes(explode_changes(parse_responses(source))).drop("bbox").select(
        "scene_id", "category", F.col("x")), "found", "append")
    assert [tuple(r) for r in spark.table("found").collect()] == [(0, "road", 0.0)]

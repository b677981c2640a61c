"""Progress of a run while responses are still arriving.

The row-wise operators (request validation and building, parsing, normalisation, filters) take a
streaming DataFrame as they are. Merging a scene needs all of its responses and stays a batch step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_progress(responses: DataFrame, totals: DataFrame) -> DataFrame:
    """Running done and total counts per scene, for ``update`` or ``complete`` output.

    ``totals`` (scene_id, total) is a static table with one row per scene. State is one counter per
    scene; failed responses count as done.
    """
    done = responses.groupBy("scene_id").agg(F.count(F.lit(1)).alias("done"))
    return done.join(totals, "scene_id").select("scene_id", "done", "total")

"""Report and request sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

REPORT_COLUMNS = [
    "scene_id", "n", "id", "type_label", "category_label", "description", "confidence_label",
    "x", "y", "w", "h",
]


def report_rows(report: DataFrame) -> DataFrame:
    """The flat rows an export holds: boxes as four columns."""
    return report.select(*REPORT_COLUMNS)


def write_report(report: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None) -> None:
    """Write report rows as CSV (with header) or Parquet, in parallel; nothing is gathered."""
    writer = report_rows(report).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"').option("quoteAll", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_requests(requests: DataFrame, path: str) -> None:
    """Write request bodies as JSON lines."""
    requests.select(F.col("request_json").alias("value")).write.mode("overwrite").text(path)


def write_failures(failed: DataFrame, path: str) -> None:
    """Write the quarantine table of failed tasks."""
    columns = [c for c in failed.columns if c != "changes"]
    failed.select(*columns).write.mode("overwrite").parquet(path)


def write_scenes(changes: DataFrame, path: str) -> None:
    """Write changes as Parquet, one partition a scene; the scenes in the table replace theirs, all others keep their files."""
    writer = changes.repartition("scene_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("scene_id").parquet(path)

"""Filters, counts, labels and run summaries."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions.text import interpolate
from .dedupe import confidence_rank

# --- filters --------------------------------------------------------------------------


def type_filter(types: Iterable[str] = K.CHANGE_TYPES) -> Column:
    return F.col("change_type").isin(list(types))


def confidence_filter(min_conf: str = "low") -> Column:
    """At least this confidence; a confidence outside the scale is never hidden."""
    return F.coalesce(confidence_rank(F.col("confidence")) >= K.CONFIDENCES.index(min_conf), F.lit(True))


def text_filter(query: str = "") -> Column:
    """Literal, case-insensitive search in description and category; a blank query hides nothing."""
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    haystack = F.lower(F.concat(F.col("description"), F.lit(" "), F.col("category")))
    return F.contains(haystack, F.lit(needle))


def with_visible(
    changes: DataFrame, types: Iterable[str] = K.CHANGE_TYPES, min_conf: str = "low", query: str = ""
) -> DataFrame:
    """Add the flag every view shares; numbers given earlier are not affected."""
    return changes.withColumn("visible", type_filter(types) & confidence_filter(min_conf) & text_filter(query))


def filter_changes(
    changes: DataFrame, types: Iterable[str] = K.CHANGE_TYPES, min_conf: str = "low", query: str = ""
) -> DataFrame:
    """Only the visible rows; simple predicates reach the scan."""
    return changes.where(type_filter(types)).where(confidence_filter(min_conf)).where(text_filter(query))


# --- counts ---------------------------------------------------------------------------


def counts_by_type(changes: DataFrame) -> DataFrame:
    """Per scene, the number of changes of each type over all changes, zeros included."""
    return changes.groupBy("scene_id").agg(
        *[F.count_if(F.col("change_type") == t).alias(f"n_{t}") for t in K.CHANGE_TYPES]
    )


def visible_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("scene_id").agg(
        F.count_if("visible").alias("n_visible"), F.count(F.lit(1)).alias("n_total")
    )


def progress(tiles: DataFrame, responses: DataFrame) -> DataFrame:
    """Done and total tasks per scene; a failed task counts as done.

    Both sides are counted before the join, so it meets one row per scene.
    """
    total = tiles.groupBy("scene_id").agg(F.count(F.lit(1)).alias("total"))
    done = responses.groupBy("scene_id").agg(F.count(F.lit(1)).alias("done"))
    return total.join(done, "scene_id", "left").select(
        "scene_id", F.coalesce("done", F.lit(0).cast("bigint")).alias("done"), "total"
    )


def run_summary(responses: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per scene over its task responses and merged changes.

    ``responses`` has one row per task with failed, failure, summary and model. All columns are
    partial aggregates, so a scene of any size is combined map-side first.
    """
    ok = ~F.col("failed")
    tasks = responses.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if("failed").alias("n_failed"),
        F.min(F.when(F.col("failed"), F.struct("task_idx", F.coalesce("failure", F.lit("")).alias("e")))).alias("_err"),
        F.max(F.when(ok & (F.col("task_idx") == 0), F.col("summary"))).alias("_overview"),
        F.min(F.when(ok & (F.col("model") != ""), F.struct("task_idx", "model"))).alias("_model"),
    )
    merged = changes.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_changes"))
    n = F.coalesce("n_changes", F.lit(0).cast("bigint"))
    counted = F.concat(
        n.cast("string"), F.lit(K.COUNTED_NOUN), F.when(n == 1, "").otherwise(K.COUNTED_PLURAL),
        F.lit(K.COUNTED_VERB), F.col("n_tasks").cast("string"), F.lit(K.COUNTED_END),
    )
    failed = F.col("n_failed") > 0
    return tasks.join(merged, "scene_id", "left").select(
        "scene_id",
        F.coalesce(F.nullif("_overview", F.lit("")), counted).alias("summary"),
        F.coalesce("_model.model", F.lit("")).alias("model"),
        n.alias("n_changes"), "n_tasks", "n_failed",
        F.when(failed, F.coalesce(F.nullif("_err.e", F.lit("")), F.lit(K.UNKNOWN_ERROR))).alias("first_error"),
        F.when(~failed, "none").when(F.col("n_failed") == F.col("n_tasks"), "all").otherwise("some").alias("status"),
    )


# --- labels ---------------------------------------------------------------------------


def label_table(spark: SparkSession) -> DataFrame:
    """The built-in label dimension (lang, key, template).

    A local relation, whose size Spark knows, so it is broadcast without shuffling what it is joined to; a larger
    table of the caller's is not forced.
    """
    columns = ("lang", "key", "template")
    return spark.createDataFrame(pa.table(dict(zip(columns, map(list, zip(*K.LABELS))))))


def translate(df: DataFrame, labels: DataFrame, key: Column, lang: Column | str, out: str) -> DataFrame:
    """Add the template of ``key``: in ``lang``, else in English, else the key itself."""
    code = F.lit(lang) if isinstance(lang, str) else lang
    local = labels.select(F.col("lang").alias("_l"), F.col("key").alias("_k"), F.col("template").alias("_t"))
    english = labels.where(F.col("lang") == "en").select(F.col("key").alias("_ek"), F.col("template").alias("_et"))
    keyed = df.withColumn("_lang", code).withColumn("_key", key)
    found = keyed.join(local, (F.col("_lang") == F.col("_l")) & (F.col("_key") == F.col("_k")), "left").join(
        english, F.col("_key") == F.col("_ek"), "left"
    )
    return found.withColumn(out, F.coalesce("_t", "_et", "_key")).select(*df.columns, out)


def with_confidence_pct(changes: DataFrame) -> DataFrame:
    """Add the percent of a confidence and its label."""
    pct = F.lit(None).cast("int")
    for name, value in K.CONFIDENCE_PCT.items():
        pct = F.when(F.col("confidence") == name, F.lit(value)).otherwise(pct)
    return changes.withColumn("confidence_pct", pct).withColumn(
        "confidence_label", F.concat(F.col("confidence_pct").cast("string"), F.lit("%"))
    )


def with_category_label(changes: DataFrame, labels: DataFrame, lang: Column | str) -> DataFrame:
    """Add the translated category; an unknown category shows as it is."""
    key = F.concat(F.lit("cat."), F.col("category"))
    out = translate(changes, labels, key, lang, "_label")
    return out.withColumn(
        "category_label", F.when(F.col("_label") == key, F.col("category")).otherwise(F.col("_label"))
    ).drop("_label")


def report_heading(counts: DataFrame, labels: DataFrame, lang: Column | str) -> DataFrame:
    """Heading per scene from n_visible and n_total: 'n' or 'n of total'."""
    some_hidden = F.col("n_visible") != F.col("n_total")
    key = F.when(some_hidden, "report.headingOf").otherwise("report.heading")
    out = translate(counts, labels, key, lang, "_template")
    return out.withColumn(
        "heading", interpolate(F.col("_template"), {"n": F.col("n_visible"), "total": F.col("n_total")})
    ).drop("_template")


def error_text(summary: DataFrame, labels: DataFrame, lang: Column | str) -> DataFrame:
    """Message for scenes with failed tasks; null where none failed."""
    key = F.when(F.col("status") == "all", "error.allFailed").otherwise("error.someFailed")
    out = translate(summary, labels, key, lang, "_template")
    words = {"failed": F.col("n_failed"), "total": F.col("n_tasks"), "err": F.col("first_error")}
    return out.withColumn(
        "error_text", F.when(F.col("n_failed") > 0, interpolate(F.col("_template"), words))
    ).drop("_template")


def report(
    changes: DataFrame,
    labels: DataFrame,
    lang: str = "en",
    types: Iterable[str] = K.CHANGE_TYPES,
    min_conf: str = "low",
    query: str = "",
    only_visible: bool = False,
) -> DataFrame:
    """Labelled report rows with the flag ``visible``. Exports take all rows unless ``only_visible``."""
    flagged = with_visible(changes, types, min_conf, query)
    rows = flagged.where("visible") if only_visible else flagged
    rows = with_confidence_pct(with_category_label(rows, labels, lang))
    return translate(rows, labels, F.concat(F.lit("type."), F.col("change_type")), lang, "type_label")

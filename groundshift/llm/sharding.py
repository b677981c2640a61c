"""Contiguous shards of equal bytes from global prefix sums (operator 9, JVM only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundshift.llm.tables import small_side
from groundshift.session import ensure_checkpoint_dir

ROW_OVERHEAD = 16


def shard_by_bytes(
    docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", payload: tuple[str, ...] = ()
) -> DataFrame:
    """Cut the rows, in order of id, into `n_shards` runs whose byte sums are as equal as whole rows allow.

    Returns `doc_id, size, text_crc32, shard, slot` and the payload columns. The size of a row is its UTF-8 bytes
    plus 16. A row belongs to the shard in which its middle byte falls, so a shard misses its target by at most one
    row at either end.

    Rows are range partitioned by id and input position and kept in a checkpoint, so partition numbers and order are
    fixed; each partition's total is summed, totals are accumulated over partitions, and a running sum inside the
    partition completes the global prefix sum. No window spans more than one range partition; only the totals (one
    row a partition) meet in one task. Runs the job that writes the checkpoint when called.

    Null text counts as empty, null ids come first, rows that repeat an id keep their input order and may be parted,
    an empty table gives no rows. Other columns of the input are ignored unless named in `payload`.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keep = [F.col(c).alias(f"_payload_{i}") for i, c in enumerate(payload)]
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_pos"),
        *keep,
    )
    order = ["doc_id", "_pos"]
    fixed = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    placed = fixed.withColumn("_part", F.spark_partition_id())
    totals = placed.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    summed = (
        placed.withColumn("_upto", F.sum("size").over(inside))
        .withColumn("_row", F.row_number().over(inside))
        .join(small_side(bases), "_part")
    )
    twice_middle = 2 * (F.col("_bytes_before") + F.col("_upto")) - F.col("size")
    numbered = summed.select(
        "doc_id", "size", "text_crc32", *[f"_payload_{i}" for i in range(len(payload))],
        (F.col("_rows_before") + F.col("_row") - 1).alias("_index"),
        F.least(F.lit(n_shards - 1), F.floor(twice_middle / (2 * F.col("_total")) * n_shards)).cast("int").alias("shard"),
    )
    starts = numbered.groupBy("shard").agg(F.min("_index").alias("_first"))
    return numbered.join(small_side(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_index") - F.col("_first")).alias("slot"),
        *[F.col(f"_payload_{i}").alias(c) for i, c in enumerate(payload)],
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the shards as folders `shard=K` of Parquet files, rows by slot."""
    sharded = shard_by_bytes(docs, n_shards, id_col, text_col, payload=(text_col,))
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

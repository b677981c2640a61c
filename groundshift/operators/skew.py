"""Handling of keys that hold far more rows than one task should see."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import ensure_checkpoint_dir

HOT_ROWS = 4096
# Lists of hot keys up to this length are broadcast; longer ones join by shuffle.
BROADCAST_KEYS = 100_000


def shuffled(df: DataFrame) -> DataFrame:
    """Mark a side of a join whose size Spark cannot know, because explodes or Python steps multiply its rows.

    Such a side looks as small as the table it comes from and would be collected on the driver to be broadcast.
    """
    return df.hint("merge")


@dataclass
class HotSplit:
    """Rows of ordinary keys, and rows of keys above the limit (None when there are none)."""

    cold: DataFrame
    hot: DataFrame | None
    hot_rows: int


def split_hot(df: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> HotSplit:
    """Separate the keys with more than ``limit`` rows.

    One partially aggregated pass over the key columns finds them; only two numbers reach the driver.
    At most ``rows / limit`` keys can be hot.
    """
    hot_keys = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    found = hot_keys.agg(F.count(F.lit(1)).alias("k"), F.sum("_n").alias("n")).first()
    if not found["k"]:
        return HotSplit(df, None, 0)
    ensure_checkpoint_dir(df.sparkSession)
    hot_keys = hot_keys.select(*keys).checkpoint()
    if found["k"] <= BROADCAST_KEYS:
        hot_keys = F.broadcast(hot_keys)
    return HotSplit(
        df.join(hot_keys, keys, "left_anti"),
        df.join(hot_keys, keys, "left_semi"),
        int(found["n"]),
    )


def crowded_parts(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """``keys`` with more than ``limit`` rows and into how many ``parts`` of about that many to cut them; None without any."""
    crowds = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    ensure_checkpoint_dir(df.sparkSession)
    crowds = crowds.select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("parts")).checkpoint()
    found = crowds.count()
    if not found:
        return None
    return F.broadcast(crowds) if found <= BROADCAST_KEYS else crowds


def deal_parts(df: DataFrame, crowds: DataFrame, keys: list[str], own: str, other: str, row: Column) -> DataFrame:
    """Deal the rows of crowded keys to their parts (column ``own``), once for every part of the other side (``other``).

    Two tables dealt with ``own`` and ``other`` swapped meet each pair of their rows exactly once by equality of both columns.
    """
    parts = F.coalesce("parts", F.lit(1))
    dealt = df.join(crowds, keys, "left").withColumn(own, F.pmod(F.xxhash64(row), parts).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str,
    limit: int = HOT_ROWS,
    check_hot: bool = True,
) -> DataFrame:
    """Row number within ``keys`` by ``order``, which must be a total order.

    Ordinary keys use one window. Keys above ``limit`` are range-partitioned by the full order, so a
    key spans many tasks, and numbered from per-partition counts.
    """
    split = split_hot(df, keys, limit) if check_hot else HotSplit(df, None, 0)
    window = W.partitionBy(*keys).orderBy(*order)
    numbered = split.cold.withColumn(name, F.row_number().over(window).cast("bigint"))
    if split.hot is None:
        return numbered
    return numbered.unionByName(number_hot_rows(split.hot, keys, order, name, split.hot_rows, limit))


def number_hot_rows(
    hot: DataFrame, keys: list[str], order: list[Column], name: str, rows: int, limit: int = HOT_ROWS
) -> DataFrame:
    """Number rows of large keys without putting one key into one task."""
    spark = hot.sparkSession
    ensure_checkpoint_dir(spark)
    default = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(default, -(-rows // max(limit, 1_000_000)))
    by = [F.col(k).asc() for k in keys] + list(order)
    # The checkpoint freezes the sampled range bounds, so counts and rows see the same partitions.
    laid_out = (
        hot.repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
        .checkpoint()
    )
    sizes = laid_out.groupBy(*keys, "_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        laid_out.join(offsets, [*keys, "_part"])
        .withColumn(name, F.col("_before") + F.col("_seq") - F.col("_first") + 1)
        .select(*hot.columns, name)
    )

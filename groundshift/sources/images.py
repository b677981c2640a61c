"""Image files: listing, gates and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import IMAGE_EXTENSIONS, MAX_IMAGE_BYTES


# The extensions in any case, so that other files are not opened.
IMAGE_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in IMAGE_EXTENSIONS) + "}"


def extension(path: Column) -> Column:
    """Text after the last dot, lower case; the whole path if it has no dot."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def gate_extension(df: DataFrame, path: str = "path") -> DataFrame:
    """Silently drop paths that are not images by extension; adds ``ext``."""
    return df.withColumn("ext", extension(F.col(path))).where(F.col("ext").isin(IMAGE_EXTENSIONS))


def scan_images(
    spark: SparkSession, path: str, with_content: bool = False, max_bytes: int = MAX_IMAGE_BYTES
) -> DataFrame:
    """Image files below ``path``: the listing of all, or contents of those up to ``max_bytes``.

    The limit is pushed to the source, so larger files are never read. List without content and use
    ``split_accepted`` to report them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if with_content:
        files = files.where(F.col("length") <= max_bytes)
    columns = ["path", F.col("length").alias("byte_len"), "modificationTime"]
    return gate_extension(files.select(*columns, *(["content"] if with_content else [])))


def split_accepted(df: DataFrame, size: str = "byte_len", max_bytes: int = MAX_IMAGE_BYTES) -> DataFrame:
    """Add ``reject_reason``: missing file, too large, or null when accepted."""
    return df.withColumn(
        "reject_reason",
        F.when(F.col(size).isNull(), "missing").when(
            F.col(size) > max_bytes,
            F.concat(F.lit("size "), F.col(size).cast("string"), F.lit(f" exceeds {max_bytes} bytes")),
        ),
    )


def decode_images(
    spark: SparkSession, path: str, drop_invalid: bool = False, max_bytes: int = MAX_IMAGE_BYTES
) -> DataFrame:
    """Decode the image files up to ``max_bytes`` with Spark's image source, inside tasks.

    The limit is on file metadata, so files above it are dropped from the scan and never opened; ``rejected_images`` lists them. Files
    that cannot be decoded are rows with a ``reject_reason``, unless ``drop_invalid`` is set. Samples are one byte per
    channel in BGR order, row-major; sixteen-bit files are reduced by the decoder.
    """
    found = (
        spark.read.format("image").option("recursiveFileLookup", "true")
        .option("dropInvalid", str(drop_invalid).lower()).option("pathGlobFilter", IMAGE_GLOB).load(path)
        .where(F.col("_metadata.file_size") <= max_bytes)
    )
    return gate_extension(found.select(
        F.col("image.origin").alias("path"), F.col("_metadata.file_size").alias("byte_len"), F.col("image.width").alias("width"),
        F.col("image.height").alias("height"), F.col("image.nChannels").alias("n_channels"),
        F.col("image.data").alias("data"),
        F.when(F.col("image.width") < 0, "Image could not be decoded").alias("reject_reason"),
    ))


def rejected_images(spark: SparkSession, path: str, max_bytes: int = MAX_IMAGE_BYTES) -> DataFrame:
    """Image files that ``decode_images`` gives no samples of, with their reason: (path, byte_len, ext, reject_reason).

    Files above the limit come from the listing alone; the others are those that cannot be decoded.
    """
    large = split_accepted(scan_images(spark, path), max_bytes=max_bytes).where("reject_reason is not null")
    broken = decode_images(spark, path, max_bytes=max_bytes).where("reject_reason is not null")
    columns = ["path", "byte_len", "ext", "reject_reason"]
    return large.select(*columns).unionByName(broken.select(*columns))

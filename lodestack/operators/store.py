"""The block store as a table: put if absent, existence, verification and ordered reassembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.hashing import content_id


def unique_blocks(chunks: DataFrame) -> DataFrame:
    """One (hash, size, data) for each distinct content; equal hashes have equal bytes, so any one does."""
    return chunks.select("hash", "size", "data").dropDuplicates(["hash"])


def absent(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chunks whose block is not in the store yet; only hashes of the store are read."""
    return unique_blocks(chunks.join(blocks.select("hash"), "hash", "left_anti"))


def present(hashes: DataFrame, blocks: DataFrame) -> DataFrame:
    return hashes.join(blocks.select("hash"), "hash", "left_semi")


def put(chunks: DataFrame, path: str) -> None:
    """Appends the blocks that the store at path lacks. Parquet files are spread by hash suffix: prefixes are all alike."""
    blocks = read_if_there(chunks.sparkSession, path)
    new = unique_blocks(chunks) if blocks is None else absent(chunks, blocks)
    new.write.mode("append").parquet(path)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, None where nothing was written yet; a table that cannot be read is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def verify(expected: DataFrame, blocks: DataFrame, algo: str = "sha2-256") -> DataFrame:
    """expected (…, size, hash) with status (ok, corrupt, missing) and size_differs, which is a warning only.

    A block is hashed once, before the join, however many files use it.
    """
    checked = blocks.select("hash", (content_id(F.col("data"), algo) == F.col("hash")).alias("_sound"), F.octet_length("data").cast("long").alias("_size"))
    joined = expected.join(checked, "hash", "left")
    status = F.when(F.col("_sound").isNull(), "missing").when(F.col("_sound"), "ok").otherwise("corrupt")
    return joined.withColumn("status", status).withColumn("size_differs", F.coalesce(F.col("_size") != F.col("size"), F.lit(False))).drop("_sound", "_size")


def deliver(expected: DataFrame, blocks: DataFrame, algo: str = "sha2-256") -> DataFrame:
    """Ordered chunk rows of files for download: a missing or corrupt block raises, and is never skipped."""
    checked = blocks.select("hash", "data", (content_id(F.col("data"), algo) == F.col("hash")).alias("_sound"))
    joined = expected.join(checked, "hash", "left")
    data = F.when(F.coalesce("_sound", F.lit(False)), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("missing or corrupt block "), F.col("hash"))).cast("binary"))
    return joined.withColumn("data", data).drop("_sound")


def reassemble(delivered: DataFrame, key: str) -> DataFrame:
    """key and content: each file in one cell, for files that fit one (2 GiB); larger ones stay chunk rows."""
    return delivered.groupBy(key).agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY idx)").alias("content"))

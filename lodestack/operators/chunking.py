"""Fixed-size chunks of whole files and of streams of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK_SIZE = 262_144
SPAN = 4096


def split(files: DataFrame, chunk_size: int = CHUNK_SIZE, content: str = "content") -> DataFrame:
    """The other columns of files, with idx, size and data for each chunk; an empty file has none."""
    n = F.ceil(F.octet_length(content) / F.lit(chunk_size))
    rest = [c for c in files.columns if c != content]
    at = F.col("idx").cast("int") * chunk_size + 1
    indexed = files.where(F.octet_length(content) > 0).select(*rest, content, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("idx"))
    return indexed.select(*rest, "idx", F.substring(F.col(content), at, F.lit(chunk_size)).alias("data")).withColumn("size", F.octet_length("data").cast("long"))


def rechunk(frames: DataFrame, chunk_size: int = CHUNK_SIZE, key: str = "conn_id", order: str = "seq", payload: str = "payload") -> DataFrame:
    """key, idx, size and data of the stream that each key's payloads make in order, however they were framed.

    A frame's byte offset is a running sum, in two steps: over the lengths of runs of SPAN places in the order, then over the frames of a run, so that a key's
    bytes are never in one window. The parts of a frame go to the chunks they fall in, and are put together by offset.
    """
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    length = F.octet_length(payload).cast("long")
    sized = frames.where(length > 0).select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.floor(F.col(order) / SPAN).alias("_run"), F.col(payload).alias("_p"), length.alias("_n"))
    runs = sized.groupBy("_key", "_run").agg(F.sum("_n").alias("_sum"))
    runs = runs.select("_key", "_run", F.coalesce(F.sum("_sum").over(earlier("_key").orderBy("_run")), F.lit(0)).alias("_base"))
    placed = sized.join(runs, ["_key", "_run"]).select(F.col("_key").alias(key), "_p", "_n", (F.col("_base") + F.coalesce(F.sum("_n").over(earlier("_key", "_run").orderBy("_order")), F.lit(0))).alias("_off"))
    first, last = F.floor(F.col("_off") / chunk_size), F.floor((F.col("_off") + F.col("_n") - 1) / chunk_size)
    parts = placed.select("*", F.explode(F.sequence(first, last)).alias("idx"))
    start = F.greatest(F.col("idx") * chunk_size, F.col("_off"))
    end = F.least((F.col("idx") + 1) * chunk_size, F.col("_off") + F.col("_n"))
    cut = parts.select(key, "idx", start.alias("_at"), F.substring(F.col("_p"), (start - F.col("_off") + 1).cast("int"), (end - start).cast("int")).alias("_part"))
    return cut.groupBy(key, "idx").agg(F.expr("listagg(_part) WITHIN GROUP (ORDER BY _at)").alias("data")).withColumn("size", F.octet_length("data").cast("long"))

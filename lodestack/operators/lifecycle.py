"""State derived from an append-only log: owners, live files, reference counts, garbage, resumable uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.acl import PREFIX


def owners(log: DataFrame) -> DataFrame:
    """cid and token of the last upload, which may be none: an anonymous upload takes the owner away. log (seq, op, cid, token)."""
    last = log.where("op = 'PUT'").groupBy("cid").agg(F.max_by("token", "seq").alias("token"))
    return last.withColumn("token", F.when(F.col("token").startswith(PREFIX), F.col("token")))


def live(log: DataFrame) -> DataFrame:
    """cids whose last operation is an upload."""
    return log.groupBy("cid").agg(F.max_by("op", "seq").alias("op")).where("op = 'PUT'").select("cid")


def refcounts(uploads: DataFrame, chunks: DataFrame) -> DataFrame:
    """hash, literal_refs (an increment for every chunk of every upload) and live_refs (of every distinct live file). uploads (cid, n_uploads, live); chunks (cid, hash), one row each occurrence."""
    per_file = chunks.groupBy("cid", "hash").agg(F.count("*").alias("n"))
    return per_file.join(uploads, "cid").groupBy("hash").agg(F.sum(F.col("n") * F.col("n_uploads")).alias("literal_refs"), F.sum(F.when(F.col("live"), F.col("n")).otherwise(0)).alias("live_refs"))


def uploads(log: DataFrame) -> DataFrame:
    """cid, n_uploads and whether it is live."""
    return log.groupBy("cid").agg(F.count(F.when(F.col("op") == "PUT", 1)).alias("n_uploads"), (F.max_by("op", "seq") == "PUT").alias("live"))


def garbage(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """Blocks that no live file refers to."""
    return blocks.join(refs.where("live_refs > 0").select("hash"), "hash", "left_anti")


def remaining(chunks: DataFrame, progress: DataFrame, key: str = "file_id") -> DataFrame:
    """Chunks still to be sent of uploads in progress (key, committed)."""
    return chunks.join(progress.select(key, "committed"), key).where("idx >= committed").drop("committed")

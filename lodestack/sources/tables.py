"""The driver tables as files, frames and logs, and the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import chunking, manifest
from lodestack.operators.acl import owner_token

CHUNK = 1024  # test documents are small; the default size would never cut one
FRAME_CHUNK = 256


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir, which is set here only where it is not (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestack-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, filename, source, lang, n_chars, content."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "source", "lang", "n_chars", F.encode("text", "utf-8").alias("content"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an upload named after its language only, so that copies share an identifier: file_id is the place in the log; src0 is anonymous."""
    files = document_files(spark, sf_dir).withColumn("filename", F.concat("lang", F.lit(".txt")))
    return files.withColumn("token", F.when(F.col("source") != "src0", token_of(F.col("source"))))


def token_of(source):
    return owner_token(source, F.concat(F.lit("pw-"), source))


def chunked(files: DataFrame, size: int = CHUNK) -> DataFrame:
    return manifest.hashed(chunking.split(files, size))


def hashes(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """file_id, idx, size, hash: no bytes."""
    return chunked(files.select("file_id", "content"), size).select("file_id", "idx", "size", "hash")


def manifests(files: DataFrame, size: int = CHUNK) -> DataFrame:
    return manifest.of_files(files.select("file_id", "filename", "content"), size)


def stored_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uploads' manifests with their token and source, written once: one scan and one digest of the documents serve all that is derived from them."""
    whole = manifest.of_files(uploads(spark, sf_dir).select("file_id", "filename", "content", "token", "source"), CHUNK)
    path = shared_path(spark, "uploads")
    whole.drop("manifest_json").write.parquet(path)
    return spark.read.parquet(path)


def log(made: DataFrame, deletes: bool = False) -> DataFrame:
    """seq, op, cid, token of stored_uploads, and after them, if asked for, the deletion of every file that src1 uploaded."""
    put = made.select(F.col("file_id").alias("seq"), F.lit("PUT").alias("op"), "cid", "token", "source")
    if deletes:
        gone = put.where("source = 'src1'").groupBy("cid").agg(F.max("token").alias("token")).select(F.lit(1 << 62).alias("seq"), F.lit("DELETE").alias("op"), "cid", "token", F.lit("src1").alias("source"))
        put = put.unionByName(gone)
    return put.drop("source")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conn_id, seq, payload: a conversation is a connection, a turn a frame."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("conn_id"), F.col("turn").alias("seq"), F.encode("text", "utf-8").alias("payload"))

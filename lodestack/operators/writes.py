"""Changes to a store: blocks, manifests and users are tables that only grow, and what holds now follows from a log that is appended last.

A file is there once its PUT is in the log, whose rows one Spark job commits together; blocks and manifests written before it are found by a later
attempt and not written again. Callers give each operation its place (seq); there is one writer at a time, as for any Parquet table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import acl, lifecycle, manifest, store
from lodestack.operators.chunking import CHUNK_SIZE, split
from lodestack.sources.tables import shared_path

LOG = "seq long, op string, cid string, token string, at timestamp"
USERS = "username string, password_hash string, created_at timestamp"
PROGRESS = "seq long, upload_id string, committed long, total_size long, token string, done boolean"
#: Replies to a request to go on with an upload.
RESUME_OK, RESUME_UNKNOWN, RESUME_EMPTY = "RESUME_OK", "RESUME_ERROR: no manifest found for upload_id", "RESUME_ERROR: invalid arguments"


def _table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    found = store.read_if_there(spark, f"{root}/{name}")
    return spark.createDataFrame([], schema) if found is None else found


def log(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, "log", LOG)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/manifests")


def users(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, "users", USERS)


def _written(df: DataFrame, name: str) -> DataFrame:
    """df as it is now: outcomes must not change with the tables they were decided on."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def put_files(files: DataFrame, root: str, chunk_size: int = CHUNK_SIZE) -> None:
    """files (seq, filename, content, token): new blocks, new manifests, then the log. A token without the owner's prefix is none."""
    spark = files.sparkSession
    store.put(manifest.hashed(split(files.select("content"), chunk_size)), f"{root}/blocks")
    made = _written(manifest.of_files(files.select("seq", "filename", "content", "token"), chunk_size), "put")
    known = store.read_if_there(spark, f"{root}/manifests")
    new = made.select("cid", "filename", "total_size", "chunk_count", "chunks", "manifest_json").dropDuplicates(["cid"])
    (new if known is None else new.join(known.select("cid"), "cid", "left_anti")).write.mode("append").parquet(f"{root}/manifests")
    token = F.when(F.col("token").startswith(acl.PREFIX), F.col("token"))
    made.select("seq", F.lit("PUT").alias("op"), "cid", token.alias("token"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{root}/log")


def delete_files(requests: DataFrame, root: str) -> DataFrame:
    """requests (seq, cid, token) with their outcome: AUTH_ERROR, `missing` (of what is not live nothing happens) or `deleted`, for which a row goes to the log."""
    now = log(requests.sparkSession, root)
    state = now.groupBy("cid").agg(F.max_by("op", "seq").alias("_op"), F.max_by("token", "seq").alias("_owner"))
    joined = requests.join(state, "cid", "left")
    live = F.coalesce(F.col("_op") == "PUT", F.lit(False))
    owner = F.when(live, F.col("_owner"))  # the owner goes with the file
    outcome = F.when(~acl.may_delete(owner, F.col("token")), "AUTH_ERROR").when(live, "deleted").otherwise("missing")
    out = _written(joined.select("seq", "cid", "token", outcome.alias("outcome")), "delete")
    gone = out.where("outcome = 'deleted'").select("seq", F.lit("DELETE").alias("op"), "cid", F.lit(None).cast("string").alias("token"), F.current_timestamp().alias("at"))
    gone.write.mode("append").parquet(f"{root}/log")
    return out


def create_users(signups: DataFrame, root: str) -> DataFrame:
    """signups (seq, username, password_hash) with `created`: the first of a name that is not taken yet; users are appended."""
    taken = users(signups.sparkSession, root).select("username", F.lit(True).alias("_taken"))
    first = signups.groupBy("username").agg(F.min("seq").alias("_first"))
    joined = signups.join(first, "username").join(taken, "username", "left")
    out = _written(joined.select("seq", "username", "password_hash", (F.col("_taken").isNull() & (F.col("seq") == F.col("_first"))).alias("created")), "signups")
    out.where("created").select("username", "password_hash", F.current_timestamp().alias("created_at")).write.mode("append").parquet(f"{root}/users")
    return out


def save_progress(steps: DataFrame, root: str) -> None:
    """steps (seq, upload_id, committed, total_size, token, done): where uploads in progress stand; one that is done, or given up, is no longer in progress."""
    steps.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in PROGRESS.split(", ")]).write.mode("append").parquet(f"{root}/progress")


def in_progress(spark: SparkSession, root: str) -> DataFrame:
    """upload_id, committed, total_size and token of uploads that may be gone on with."""
    steps = _table(spark, root, "progress", PROGRESS)
    last = steps.groupBy("upload_id").agg(F.max_by(F.struct("committed", "total_size", "token", "done"), "seq").alias("s"))
    return last.where("NOT s.done").select("upload_id", "s.committed", "s.total_size", "s.token")


def resume(requests: DataFrame, root: str) -> DataFrame:
    """requests (…, upload_id) with the reply and, where it is RESUME_OK, next_index, that of the first chunk not committed."""
    known = in_progress(requests.sparkSession, root).select("upload_id", F.col("committed").alias("next_index"))
    joined = requests.join(known, "upload_id", "left")
    reply = F.when(F.coalesce("upload_id", F.lit("")) == "", RESUME_EMPTY).when(F.col("next_index").isNull(), RESUME_UNKNOWN).otherwise(RESUME_OK)
    return joined.withColumn("reply", reply)


def session_files(spark: SparkSession, root: str) -> DataFrame:
    """What sessions look files up in: cid, owned, owner and there."""
    state = log(spark, root).groupBy("cid").agg(F.max_by("op", "seq").alias("op"), F.max_by("token", "seq").alias("owner"))
    return state.where("op = 'PUT'").select("cid", F.col("owner").isNotNull().alias("owned"), "owner", F.lit(True).alias("there"))


def live_files(spark: SparkSession, root: str) -> DataFrame:
    """cid, filename, total_size, n_uploads and owner of every file that is there."""
    now = log(spark, root)
    up = lifecycle.uploads(now).where("live").select("cid", "n_uploads")
    return manifests(spark, root).select("cid", "filename", "total_size").join(up, "cid").join(session_files(spark, root).select("cid", F.col("owner").alias("token")), "cid")

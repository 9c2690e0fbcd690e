"""Import of another store's files: block files, manifest texts, owner files and the users file."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.manifest import parse

USERS = "map<string, struct<password_hash: string, created_at: double>>"


def _name(path: str = "path"):
    return F.element_at(F.split(F.col(path), "/"), -1)


def blocks(spark: SparkSession, root: str) -> DataFrame:
    """hash, size and data of every file under root/blocks; what is not named by an identifier is no block."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/blocks")
    return found.select(_name().alias("hash"), F.col("length").alias("size"), F.col("content").alias("data")).where(F.col("hash").rlike("^b[a-z2-7]{56}$"))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """cid and fields of every manifest under root/manifests; fields are null where the text is unsound."""
    texts = spark.read.text(f"{root}/manifests/*.json", wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "").alias("cid"), F.col("value").alias("manifest_json"))
    return parse(texts)


def owners(paths_and_texts: DataFrame) -> DataFrame:
    """cid and token from owner files (path, text): the name up to .owner, the first line."""
    named = paths_and_texts.where(F.col("path").contains(".owner"))
    return named.select(F.substring_index(_name(), ".owner", 1).alias("cid"), F.regexp_replace("text", r"(?s)[\r\n].*", "").alias("token"))


def users(texts: DataFrame, text: str = "text") -> DataFrame:
    """username, password_hash and created_at from users files; a malformed one has no users."""
    got = texts.select(F.explode(F.from_json(F.col(text), USERS)).alias("username", "u"))
    return got.select("username", F.col("u.password_hash").alias("password_hash"), F.timestamp_seconds("u.created_at").alias("created_at"))


def export(blocks_df: DataFrame, manifests_df: DataFrame, root: str) -> None:
    """Writes the files that blocks() and manifests() read, from the tasks, to a root that pyarrow's file systems reach; a retried task writes the same bytes again."""

    def write(rows: Iterator[Row]) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for r in rows:
            path = f"{base}/{r['path']}"
            store.create_dir(path.rpartition("/")[0])
            unready = f"{base}/unready-{uuid.uuid4().hex}"
            with store.open_output_stream(unready) as out:
                out.write(bytes(r["data"]))
            store.move(unready, path)

    b, m = F.col("hash"), F.col("cid")
    named = blocks_df.select(F.concat_ws("/", F.lit("blocks"), F.substring(b, 1, 2), F.substring(b, 3, 2), b).alias("path"), "data")
    texts = manifests_df.select(F.concat(F.lit("manifests/"), m, F.lit(".json")).alias("path"), F.encode("manifest_json", "utf-8").alias("data"))
    named.unionByName(texts).foreachPartition(write)

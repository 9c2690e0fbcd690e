"""Manifests: the ordered chunk list of a file as text, whose own identifier is the file's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.hashing import content_id, digest_hex, id_of_digest

VERSION = 1
CHUNKS = "array<struct<index: bigint, size: bigint, hash: string>>"
SCHEMA = f"version bigint, hash_algo string, chunk_size bigint, total_size bigint, filename string, chunks {CHUNKS}"


def hashed(chunks: DataFrame, algo: str = "sha2-256") -> DataFrame:
    """chunks with their identifiers; a chunk has bytes, so none is null, and no join needs to compute one just to test that."""
    return chunks.withColumn("hash", F.coalesce(content_id(F.col("data"), algo), F.lit("")))


def manifest_text(filename: Column, total_size: Column, chunks: Column, chunk_size: int, algo: str) -> Column:
    """The exact bytes that are hashed. Names are not escaped, so that identifiers agree; never parse this for names with quotes."""
    line = lambda c: F.concat(F.lit('    { "index": '), c["index"].cast("string"), F.lit(', "size": '), c["size"].cast("string"), F.lit(', "hash": "'), c["hash"], F.lit('" }'))
    lines = F.array_join(F.transform(chunks, line), ",\n")
    return F.concat(
        F.lit(f'{{\n  "version": {VERSION},\n  "hash_algo": "{algo}",\n  "chunk_size": {chunk_size},\n  "total_size": '), total_size.cast("string"),
        F.lit(',\n  "filename": "'), filename, F.lit('",\n  "chunks": [\n'), lines, F.when(lines != "", F.lit("\n")).otherwise(F.lit("")), F.lit("  ]\n}\n"),
    )


def build(files: DataFrame, chunks: DataFrame, chunk_size: int, algo: str = "sha2-256", key: str = "file_id") -> DataFrame:
    """key, filename, cid, total_size, chunk_count, chunks and manifest_json for every row of files (key, filename); chunks (key, idx, size, hash).

    The chunk lists are of hashes only; bytes stay out of this plan.
    """
    lists = chunks.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col("idx").cast("long").alias("index"), F.col("size").cast("long").alias("size"), "hash"))).alias("chunks"),
        F.sum("size").cast("long").alias("total_size"),
        F.count("*").alias("chunk_count"),
    )
    none = F.array().cast(CHUNKS)
    whole = files.select(key, F.when(F.coalesce("filename", F.lit("")) == "", "unnamed").otherwise(F.col("filename")).alias("filename")).join(lists, key, "left")
    filled = whole.select(key, "filename", F.coalesce("chunks", none).alias("chunks"), F.coalesce("total_size", F.lit(0)).alias("total_size"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    return _named(filled, chunk_size, algo)


def _named(whole: DataFrame, chunk_size: int, algo: str) -> DataFrame:
    text = whole.withColumn("manifest_json", manifest_text(F.col("filename"), F.col("total_size"), F.col("chunks"), chunk_size, algo))
    return text.withColumn("cid", F.coalesce(content_id(F.encode("manifest_json", "utf-8"), algo), F.lit("")))


def of_files(files: DataFrame, chunk_size: int) -> DataFrame:
    """What build() gives, for whole files (filename, content, …; the other columns stay), each in its own row: no shuffle, and each chunk is hashed once."""
    n = F.ceil(F.octet_length("content") / F.lit(chunk_size))
    parts = F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>")), lambda i: F.struct(i.alias("index"), F.substring(F.col("content"), i.cast("int") * chunk_size + 1, F.lit(chunk_size)).alias("data")))
    digests = F.transform(parts, lambda p: F.struct(p["index"].alias("index"), F.octet_length(p["data"]).cast("long").alias("size"), digest_hex(p["data"]).alias("hex")))
    chunks = F.transform(digests, lambda x: F.struct(x["index"].alias("index"), x["size"].alias("size"), id_of_digest(x["hex"]).alias("hash")))
    rest = [c for c in files.columns if c not in ("filename", "content")]
    name = F.when(F.coalesce("filename", F.lit("")) == "", "unnamed").otherwise(F.col("filename"))
    size = F.coalesce(F.octet_length("content").cast("long"), F.lit(0)).alias("total_size")
    listed = files.select(*rest, name.alias("filename"), F.coalesce(chunks, F.array().cast(CHUNKS)).alias("chunks"), size)
    return _named(listed.withColumn("chunk_count", F.size("chunks").cast("long")), chunk_size, "sha2-256")


def parse(manifests: DataFrame, text: str = "manifest_json") -> DataFrame:
    """manifests with the manifest's fields; names with control characters, quotes or backslashes, and texts without their sizes, give null fields."""
    got = F.from_json(text, SCHEMA)
    sound = got["chunk_size"].isNotNull() & got["total_size"].isNotNull() & (F.octet_length(got["filename"]) < 256) & ~got["filename"].rlike(r'[\x00-\x1f"\\]')
    kept = manifests.withColumn("_m", F.when(sound, got))
    fields = [F.col(f"_m.{f}").alias(f) for f in ("version", "chunk_size", "total_size", "filename", "chunks")]
    algo = F.when(F.col("_m").isNotNull(), F.coalesce("_m.hash_algo", F.lit("blake3"))).alias("hash_algo")
    own = [c for c in manifests.columns if c not in ("version", "hash_algo", "chunk_size", "total_size", "filename", "chunks")]
    return kept.select(*own, *fields, algo)


def explode_chunks(manifests: DataFrame, *keep: str) -> DataFrame:
    return manifests.select(*keep, F.explode("chunks").alias("c")).select(*keep, F.col("c.index").alias("idx"), F.col("c.size").alias("size"), F.col("c.hash").alias("hash"))

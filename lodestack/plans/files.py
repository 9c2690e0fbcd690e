"""Queries over stored files: chunks, identifiers, blocks, manifests, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions import hashing
from lodestack.operators import chunking, manifest, store
from lodestack.sources import tables as T

CORRUPT, GONE = "a", "b"  # last letters of the hashes whose blocks are damaged or dropped where a query needs such


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunking.split(T.document_files(spark, d).select("file_id", "content"), T.CHUNK)
    return chunks.select("file_id", "idx", "size", F.sha2("data", 256).alias("data_sha256"))


def chunk_cid(spark: SparkSession, d: str) -> DataFrame:
    return T.hashes(T.document_files(spark, d)).select("file_id", "idx", "hash")


def unique_blocks(spark: SparkSession, d: str) -> DataFrame:
    return T.hashes(T.document_files(spark, d)).select("hash", "size").dropDuplicates(["hash"])


def dedup_report(spark: SparkSession, d: str) -> DataFrame:
    per_block = T.hashes(T.document_files(spark, d)).groupBy("hash").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return per_block.agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_blocks"), F.sum(F.col("n") * F.col("size")).alias("logical_bytes"), F.sum("size").alias("stored_bytes"))


def _second_set(spark: SparkSession, d: str) -> DataFrame:
    """benchmark items and web pages, as files not stored yet."""
    items = T.table(spark, d, "benchmark").select(F.col("item_id").alias("file_id"), F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("filename"), F.encode("text", "utf-8").alias("content"))
    pages = T.table(spark, d, "pages").select((-F.col("page_id") - 1).alias("file_id"), F.col("url").alias("filename"), F.encode("html", "utf-8").alias("content"))
    return items.unionByName(pages)


def new_blocks(spark: SparkSession, d: str) -> DataFrame:
    stored = T.hashes(T.document_files(spark, d))
    return store.absent(T.chunked(_second_set(spark, d).select("file_id", "content")), stored).select("hash", "size")


def block_exists(spark: SparkSession, d: str) -> DataFrame:
    stored = T.hashes(T.document_files(spark, d))
    wanted = T.hashes(_second_set(spark, d).unionByName(T.document_files(spark, d).select("file_id", "filename", "content"))).select("hash").distinct()
    return store.present(wanted, stored).agg(F.count("*").alias("n_present"))


def build_manifests(spark: SparkSession, d: str) -> DataFrame:
    built = T.manifests(T.document_files(spark, d))
    return built.select("file_id", "cid", "total_size", "chunk_count", F.sha2(F.encode("manifest_json", "utf-8"), 256).alias("manifest_sha256"))


def parse_manifest(spark: SparkSession, d: str) -> DataFrame:
    texts = T.manifests(T.document_files(spark, d)).select("cid", "manifest_json")
    return manifest.parse(texts).select("cid", "version", "hash_algo", "chunk_size", "total_size", "filename", F.size("chunks").cast("long").alias("n_chunks"))


def explode_manifest(spark: SparkSession, d: str) -> DataFrame:
    texts = T.manifests(T.document_files(spark, d)).select("cid", "manifest_json")
    return manifest.explode_chunks(manifest.parse(texts), "cid")


def reassemble(spark: SparkSession, d: str) -> DataFrame:
    files = T.document_files(spark, d)
    chunks = T.chunked(files.select("file_id", "content"))
    expected = chunks.select("file_id", "idx", "size", "hash")
    whole = store.reassemble(store.deliver(expected, store.unique_blocks(chunks)), "file_id")
    return whole.select("file_id", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("content_sha256"))


def _damaged(chunks: DataFrame) -> DataFrame:
    """The store with the first byte of some blocks zeroed and others dropped."""
    zeroed = F.concat(F.lit(b"\x00"), F.expr("substring(data, 2)"))
    return store.unique_blocks(chunks).where(~F.col("hash").endswith(GONE)).withColumn("data", F.when(F.col("hash").endswith(CORRUPT), zeroed).otherwise(F.col("data")))


def verify_blocks(spark: SparkSession, d: str) -> DataFrame:
    chunks = T.chunked(T.document_files(spark, d).select("file_id", "content"))
    return store.verify(chunks.select("file_id", "idx", "size", "hash"), _damaged(chunks)).select("file_id", "idx", "hash", "status")


def size_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Blocks cut short by a byte, where their hash ends in CORRUPT, against the sizes in the manifests."""
    chunks = T.chunked(T.document_files(spark, d).select("file_id", "content"))
    short = store.unique_blocks(chunks).withColumn("data", F.when(F.col("hash").endswith(CORRUPT), F.expr("substring(data, 1, octet_length(data) - 1)")).otherwise(F.col("data")))
    checked = store.verify(chunks.select("file_id", "idx", "size", "hash"), short)
    return checked.groupBy("file_id").agg(F.count(F.when(F.col("size_differs"), 1)).alias("n_differ"), F.count("*").alias("n_chunks"))


def declared_size_check(spark: SparkSession, d: str) -> DataFrame:
    """Uploads that declare their number of characters: too few bytes where one takes several. 0 declares nothing (German ones)."""
    f = T.document_files(spark, d)
    declared = F.when(F.col("lang") == "de", F.lit(0)).otherwise(F.col("n_chars"))
    received = F.octet_length("content").cast("long")
    return f.select("file_id", declared.alias("declared"), received.alias("received"), F.when((declared != 0) & (declared != received), F.lit(-2)).otherwise(F.lit(0)).alias("rc"))


def rechunk_frames(spark: SparkSession, d: str) -> DataFrame:
    return chunking.rechunk(T.frames(spark, d), T.FRAME_CHUNK).select("conn_id", "idx", "size", F.sha2("data", 256).alias("data_sha256"))


def upload_progress(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunking.split(T.document_files(spark, d).select("file_id", "content"), T.CHUNK).select("file_id", "idx", "size")
    so_far = Window.partitionBy("file_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.select("file_id", "idx", F.sum("size").over(so_far).alias("received"), F.row_number().over(Window.partitionBy("file_id").orderBy("idx")).cast("long").alias("n_committed"))


def shard_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Blocks by the two-level prefix folders that paths have, and by hash suffix, which spreads."""
    b = T.hashes(T.document_files(spark, d)).select("hash").distinct()
    prefix = b.select(F.lit("prefix").alias("scheme"), F.concat_ws("/", F.substring("hash", 1, 2), F.substring("hash", 3, 2)).alias("shard"))
    suffix = b.select(F.lit("suffix").alias("scheme"), F.substring("hash", -1, 1).alias("shard"))
    return prefix.unionByName(suffix).groupBy("scheme", "shard").agg(F.count("*").alias("n_blocks"))


def same_bytes_other_name(spark: SparkSession, d: str) -> DataFrame:
    f = T.document_files(spark, d).select("file_id", "filename", "content")
    h = T.hashes(f)
    one, two = manifest.build(f.select("file_id", "filename"), h, T.CHUNK), manifest.build(f.select("file_id", F.concat(F.lit("copy-of-"), "filename").alias("filename")), h, T.CHUNK)
    both = one.select("file_id", "cid", F.col("chunks").alias("c1")).join(two.select("file_id", F.col("cid").alias("copy_cid"), F.col("chunks").alias("c2")), "file_id")
    return both.select("file_id", "cid", "copy_cid", (F.col("cid") != F.col("copy_cid")).alias("cids_differ"), (F.col("c1") == F.col("c2")).alias("same_chunks"))


def client_slices(spark: SparkSession, d: str) -> DataFrame:
    """Pages sliced at the default size by the client, then chunked again at it, against chunking whole pages."""
    f = T.table(spark, d, "pages").select(F.col("page_id").alias("conn_id"), F.encode("html", "utf-8").alias("content"))
    sliced = chunking.split(f, chunking.CHUNK_SIZE).select("conn_id", F.col("idx").alias("seq"), F.col("data").alias("payload"))
    again = chunking.rechunk(sliced, chunking.CHUNK_SIZE).select("conn_id", "idx", F.sha2("data", 256).alias("again"))
    whole = chunking.split(f, chunking.CHUNK_SIZE).select("conn_id", "idx", "size", F.sha2("data", 256).alias("data_sha256"))
    return whole.join(again, ["conn_id", "idx"], "full").select(F.col("conn_id").alias("page_id"), "idx", "size", "data_sha256", (F.col("again") == F.col("data_sha256")).alias("same"))


def empty_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Spanish documents emptied: the engine stores them as files without chunks, the gateway turns them away, a download chunk without bytes is an error."""
    f = T.document_files(spark, d).withColumn("content", F.when(F.col("lang") == "es", F.lit(b"")).otherwise(F.col("content")))
    built = T.manifests(f).select("file_id", "cid", "total_size", "chunk_count")
    return built.select("file_id", "cid", "total_size", "chunk_count", (F.col("total_size") > 0).alias("gateway_accepts"), F.when(F.col("chunk_count") == 0, "done").otherwise("chunks").alias("download"))


def upload_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of uploads begun at a fixed second, and the previews of hashes that logs show."""
    built = T.manifests(T.document_files(spark, d))
    return built.select("file_id", F.substring(F.concat_ws("-", "filename", F.lit("1700000000")), 1, 255).alias("upload_id"), F.left("cid", F.lit(10)).alias("hash_preview"))


def blake3_cids(spark: SparkSession, d: str) -> DataFrame:
    f = T.document_files(spark, d)
    chunks = manifest.hashed(chunking.split(f.select("file_id", "content"), T.CHUNK), "blake3").select("file_id", "idx", "size", "hash")
    return manifest.build(f.select("file_id", "filename"), chunks, T.CHUNK, "blake3").select("file_id", "cid", "total_size", "chunk_count", hashing.is_content_id(F.col("cid")).alias("sound"))


def foreign_import(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's files written in the other store's layout, imported and verified."""
    from lodestack.sources import foreign

    f = T.table(spark, d, "benchmark").select(F.col("item_id").alias("file_id"), F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("filename"), F.encode("text", "utf-8").alias("content"))
    root = T.shared_path(spark, "foreign")
    foreign.export(store.unique_blocks(T.chunked(f.select("file_id", "content"))), T.manifests(f), root)
    expected = manifest.explode_chunks(foreign.manifests(spark, root), "cid", "filename")
    checked = store.verify(expected, foreign.blocks(spark, root))
    return checked.groupBy("cid", "filename").agg(F.count("*").alias("n_chunks"), F.count(F.when(F.col("status") == "ok", 1)).alias("n_ok"))

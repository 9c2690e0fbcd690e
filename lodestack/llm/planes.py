"""Token-id output by bit-plane shuffling: id blocks transposed into planes, each compressed with zstandard.

Layout. Documents are range-partitioned and sorted by doc_id; a partition is a shard. A shard's ids form one
stream, cut into blocks of `block_ids`. A block is one row of a Parquet table in the shared folder (Spark's
committer gives retries and lost executors a whole table): its payload, and its part of the chunk index, namely
shard, block number, first id and the documents whose ids it holds. Any block decodes alone.

Payload: `BPS1`, one byte for the mode (0 byte planes, 1 bit planes), one byte for the number of planes kept
(planes above the largest id are not stored), the number of ids and each plane's compressed length as
little-endian unsigned 32-bit integers, then the planes, lowest first.

Nulls, edges: a null or empty text is the end id alone; null doc_ids come first; rows of one doc_id are ordered by a hash of the text, equal ones as they are
read, and each keeps its own ids; very long texts are cut over blocks; other columns are not read, so none can clash; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.common import documents, fresh_path, id_text
from lodestack.llm.tokens import ID, default_path, encoder

END_ID, BLOCK_IDS, MAX_SHARDS = 0, 65_536, 100_000
MAGIC = b"BPS1"
CHUNKS = "shard int, block int, first_id long, n_ids int, doc_ids array<long>, doc_starts array<long>, doc_tokens array<long>, doc_offsets array<long>, payload binary"


def encode_block(ids: np.ndarray, mode: str = "byte", level: int = 3) -> bytes:
    raw = np.ascontiguousarray(ids, ID).view(np.uint8).reshape(-1, 4)
    top = int(ids.max()) if len(ids) else 0
    if mode == "byte":
        planes = [np.ascontiguousarray(raw[:, k]) for k in range((top.bit_length() + 7) // 8)]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k], bitorder="little") for k in range(top.bit_length())]
    packed = [zstandard.ZstdCompressor(level=level).compress(p.tobytes()) for p in planes]
    return MAGIC + struct.pack(f"<BBI{len(packed)}I", mode == "bit", len(packed), len(ids), *map(len, packed)) + b"".join(packed)


def decode_block(payload: bytes) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a block of bit planes")
    bit, kept, n = struct.unpack_from("<BBI", payload, 4)
    sizes, at = struct.unpack_from(f"<{kept}I", payload, 10), 10 + 4 * kept
    out = np.zeros((n, 32 if bit else 4), np.uint8)
    for k, length in enumerate(sizes):
        plane = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[at : at + length]), np.uint8)
        out[:, k] = np.unpackbits(plane, bitorder="little")[:n] if bit else plane
        at += length
    return (np.packbits(out, axis=1, bitorder="little") if bit else out).reshape(-1).view(ID)


def _times(a: int, b: int) -> int:
    """The product of two polynomials over GF(2), modulo the CRC-32 polynomial, highest bit first."""
    out, bit = 0, 1 << 31
    while a:
        if a & bit:
            out ^= b
            a ^= bit
        bit >>= 1
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc32_joined(first: int, second: int, length: int) -> int:
    """The crc32 of two byte strings end to end, from their own and the second's length."""
    shift, power = 1 << 31, 1 << 23
    while length:
        if length & 1:
            shift = _times(power, shift)
        power, length = _times(power, power), length >> 1
    return _times(shift, first) ^ second


def write_planes(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, mode: str = "byte", level: int = 3) -> None:
    """Writes the ids of every document to path, in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(tokenizer_path).encode, int(end_id).to_bytes(ID.itemsize, "little")
        shard, block, first, start = TaskContext.get().partitionId(), 0, 0, 0
        held, held_ids = [], 0
        pieces: list[tuple] = []  # (doc_id, the document's start in the shard, its ids in all, ids of it before this block)

        def chunk() -> pa.RecordBatch:
            nonlocal block, first, held, held_ids, pieces
            ids = np.concatenate([np.frombuffer(x, ID) for x in held])
            cols = [[shard], [block], [first], [len(ids)], *([[p[k] for p in pieces]] for k in range(4)), [encode_block(ids, mode, level)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 4, pa.binary()]
            block, first, held, held_ids, pieces = block + 1, first + len(ids), [], 0, []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in CHUNKS.split(", ")])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids, at = ids + end, 0
                n = len(ids) // ID.itemsize
                while at < n:
                    part = min(n - at, block_ids - held_ids)
                    held.append(ids[at * ID.itemsize : (at + part) * ID.itemsize])
                    pieces.append((doc_id, start, n, at))
                    at, held_ids = at + part, held_ids + part
                    if held_ids == block_ids:
                        yield chunk()
                start += n
        if held:
            yield chunk()

    rows = id_text(docs).withColumn("row", F.monotonically_increasing_id())
    key = [F.col("doc_id"), F.xxhash64("text"), F.col("row")]  # so that rows of one doc_id, and equal rows, can be dealt over several shards
    rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(run, CHUNKS).write.option("compression", "uncompressed").parquet(path)


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document in the files at path: doc_id, start, n_tokens and the crc32 of its ids."""
    piece = "shard int, doc_start long, doc_id long, n_tokens long, at long, n long, crc long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["payload"]).tobytes()
                doc_ids, starts, totals, offsets = (row[k] for k in ("doc_ids", "doc_starts", "doc_tokens", "doc_offsets"))
                out, at = [], 0
                for doc_id, start, total, offset in zip(doc_ids, starts, totals, offsets):
                    n = min(total - offset, row["n_ids"] - at)
                    out.append((row["shard"], start, doc_id, total, offset, n, zlib.crc32(ids[at * 4 : (at + n) * 4])))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 0 else pa.int64()) for k, x in enumerate(zip(*out))], [x.split()[0] for x in piece.split(", ")])

    @F.pandas_udf("long")
    def joined(parts):
        def one(rows) -> int:
            rows = sorted(rows, key=lambda r: r["at"])
            crc = rows[0]["crc"]
            for r in rows[1:]:
                crc = crc32_joined(crc, r["crc"], 4 * r["n"])
            return crc

        return parts.map(one)

    chunks = spark.read.schema(CHUNKS).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, that is, each file
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("ids")).select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    pieces = chunks.mapInArrow(run, piece)
    whole = pieces.where("n = n_tokens").select("shard", "doc_start", "doc_id", "n_tokens", F.col("crc").alias("ids_crc32"))
    cut = (
        pieces.where("n < n_tokens")
        .groupBy("shard", "doc_start", "doc_id", "n_tokens")
        .agg(F.collect_list(F.struct("at", "n", "crc")).alias("parts"))
        .select("shard", "doc_start", "doc_id", "n_tokens", joined("parts").alias("ids_crc32"))
    )
    if shards.limit(MAX_SHARDS + 1).count() <= MAX_SHARDS:  # as many as the exchange that wrote them has partitions
        shards = F.broadcast(shards)
    return whole.unionByName(cut).join(shards, "shard").select("doc_id", (F.col("shard_start") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "planes")
    write_planes(documents(spark, sf_dir), default_path("byte_bpe_50k.json"), path)
    return read_planes(spark, path)

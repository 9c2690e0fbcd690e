"""Chunks, identifiers, manifests and the block store, on small fixtures."""

import base64
import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestack.functions import wire
from lodestack.functions.blake3 import blake3_many
from lodestack.functions.hashing import content_id
from lodestack.operators import chunking, manifest, store

C = 16


def plain_cid(data: bytes) -> str:
    raw = b"\x71\x12\x20" + hashlib.sha256(data).digest()
    return "b" + base64.b32encode(raw).decode().lower().rstrip("=")


def files(spark, contents):
    return spark.createDataFrame([(k, f"f{k}", c) for k, c in enumerate(contents)], "file_id long, filename string, content binary")


def chunks_of(spark, contents):
    return manifest.hashed(chunking.split(files(spark, contents), C))


def test_sizes_around_the_chunk_size(spark):
    contents = [b"", b"x" * (C - 1), b"x" * C, b"x" * (C + 1), b"x" * (2 * C)]
    found = chunking.split(files(spark, contents), C).groupBy("file_id").agg(F.count("*").alias("n"), F.max("size").alias("m")).collect()
    assert {r.file_id: (r.n, r.m) for r in found} == {1: (1, C - 1), 2: (1, C), 3: (2, C), 4: (2, C)}


def test_identifiers_match_plain_python(spark):
    values = [b"", b"a", bytes(range(256)) * 5]
    got = spark.createDataFrame([(v,) for v in values], "v binary").select(content_id(F.col("v")).alias("c")).collect()
    assert [r.c for r in got] == [plain_cid(v) for v in values]


def test_blake3_published_vectors():
    # inputs are the bytes 0, 1, .. 250, repeated; digests as published with the specification
    data = lambda n: bytes(k % 251 for k in range(n))
    vectors = {
        0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
        1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    }
    assert dict(zip(vectors, blake3_many([data(n) for n in vectors]))) == vectors
    assert blake3_many([b"abc"]) == ["6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"]


def test_blake3_batches_agree_with_single_inputs():
    inputs = [bytes(k % 251 for k in range(n)) for n in (0, 1, 64, 65, 1023, 1024, 1025, 2048, 2049, 5000, 9000)]
    assert blake3_many(inputs) == [blake3_many([x])[0] for x in inputs]
    assert len(set(blake3_many(inputs))) == len(inputs)


def test_manifest_bytes(spark):
    built = {r.file_id: r for r in manifest.build(files(spark, [b"", b"x" * C, b"x" * (C + 1)]).select("file_id", "filename"), chunks_of(spark, [b"", b"x" * C, b"x" * (C + 1)]), C).collect()}
    head = lambda total, name: f'{{\n  "version": 1,\n  "hash_algo": "sha2-256",\n  "chunk_size": {C},\n  "total_size": {total},\n  "filename": "{name}",\n  "chunks": [\n'
    full, tail = plain_cid(b"x" * C), plain_cid(b"x")
    assert built[0].manifest_json == head(0, "f0") + "  ]\n}\n"
    assert built[1].manifest_json == head(C, "f1") + f'    {{ "index": 0, "size": {C}, "hash": "{full}" }}\n  ]\n}}\n'
    assert built[2].manifest_json == head(C + 1, "f2") + f'    {{ "index": 0, "size": {C}, "hash": "{full}" }},\n    {{ "index": 1, "size": 1, "hash": "{tail}" }}\n  ]\n}}\n'
    assert all(r.cid == plain_cid(r.manifest_json.encode()) for r in built.values())


def test_manifest_parse_rejects_unsound_text(spark):
    texts = ['{"chunk_size": 1, "total_size": 2, "filename": "a", "chunks": []}', "{", '{"chunk_size": 1, "filename": "a"}', '{"chunk_size": 1, "total_size": 2, "filename": "a\\"b", "chunks": []}']
    got = manifest.parse(spark.createDataFrame([(t,) for t in texts], "manifest_json string")).collect()
    assert [r.filename for r in got] == ["a", None, None, None] and got[0].hash_algo == "blake3"


def test_store_round_trip_and_damage(spark, tmp_path):
    contents = [b"ab" * 40, "é".encode() * 33, b"ab" * 40]
    chunks = chunks_of(spark, contents)
    path = str(tmp_path / "blocks")
    store.put(chunks, path)
    n = spark.read.parquet(path).count()
    store.put(chunks, path)
    blocks = spark.read.parquet(path)
    assert blocks.count() == n == chunks.select("hash").distinct().count()
    whole = store.reassemble(store.deliver(chunks.select("file_id", "idx", "size", "hash"), blocks), "file_id").collect()
    assert {r.file_id: bytes(r.content) for r in whole} == dict(enumerate(contents))
    bad = blocks.withColumn("data", F.lit(b"?"))
    assert {r.status for r in store.verify(chunks.select("hash", "size"), bad).collect()} == {"corrupt"}
    assert {r.status for r in store.verify(chunks.select("hash", "size"), blocks.limit(0)).collect()} == {"missing"}
    with pytest.raises(PySparkException):
        store.deliver(chunks.select("file_id", "idx", "size", "hash"), blocks.limit(0)).collect()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.binary(min_size=1, max_size=120), cuts=st.lists(st.integers(0, 120), max_size=6))
def test_framing_does_not_matter(spark, data, cuts):
    edges = sorted({0, len(data), *[c for c in cuts if c < len(data)]})
    frames = [(1, k, data[a:b]) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    got = chunking.rechunk(spark.createDataFrame(frames, "conn_id long, seq long, payload binary"), C).orderBy("idx").collect()
    assert [bytes(r.data) for r in got] == [data[k : k + C] for k in range(0, len(data), C)]


def test_frames_round_trip(spark):
    rows = [(2, b""), (0x91, b"abc"), (0xB0, bytes(300))]
    f = spark.createDataFrame(rows, "op int, payload binary").withColumn("frame", wire.encode_frame(F.col("op"), F.col("payload")))
    got = f.select("frame", "payload", "op", wire.decode_frame(F.col("frame")).alias("x"), wire.decode_frame(F.expr("substring(frame, 1, 4)")).alias("cut")).collect()
    for r in got:
        assert bytes(r.frame) == bytes([r.op]) + len(r.payload).to_bytes(4, "big") + bytes(r.payload)
        assert (r.x.op, bytes(r.x.payload)) == (r.op, bytes(r.payload)) and r.cut is None

"""Access decisions, lifecycle and sessions."""

import itertools
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestack.functions.wire import OPS
from lodestack.operators import acl, lifecycle, session, store, writes
from lodestack.sources import foreign
from lodestack.streaming import sessions
from lodestack.streaming.sessions import run_to_end


def test_access_decision_table(spark):
    stored, tokens = [None, "", "plain", "owner-a"], [None, "owner-a", "owner-b", "plain"]
    rows = list(itertools.product(stored, tokens))
    got = spark.createDataFrame(rows, "s string, t string").select("s", "t", acl.may_download(F.col("s"), F.col("t")).alias("get"), acl.may_delete(F.col("s"), F.col("t")).alias("drop"), acl.may_delete(F.col("s"), F.col("t"), strict=False).alias("loose")).collect()
    for r in got:
        open_ = not (r.s or "").startswith("owner-") or r.s == r.t
        assert r.get == open_
        assert r["drop"] == (r.t is None if r.s is None else open_)
        assert r.loose == (False if r.s is None else open_)


def test_last_upload_decides_the_owner(spark):
    log = spark.createDataFrame([(1, "PUT", "c", "owner-a"), (2, "PUT", "c", "owner-b"), (3, "PUT", "d", "owner-a"), (4, "PUT", "d", None), (5, "PUT", "e", "plain"), (6, "DELETE", "c", None)], "seq long, op string, cid string, token string")
    assert {r.cid: r.token for r in lifecycle.owners(log).collect()} == {"c": "owner-b", "d": None, "e": None}
    assert {r.cid for r in lifecycle.live(log).collect()} == {"d", "e"}


def test_counts_and_garbage(spark):
    log = spark.createDataFrame([(1, "PUT", "c"), (2, "PUT", "c"), (3, "PUT", "d"), (4, "DELETE", "d")], "seq long, op string, cid string")
    chunks = spark.createDataFrame([("c", "x"), ("c", "x"), ("c", "y"), ("d", "y"), ("d", "z")], "cid string, hash string")
    refs = lifecycle.refcounts(lifecycle.uploads(log), chunks)
    assert {r.hash: (r.literal_refs, r.live_refs) for r in refs.collect()} == {"x": (4, 2), "y": (3, 1), "z": (1, 0)}
    blocks = spark.createDataFrame([("x",), ("y",), ("z",), ("orphan",)], "hash string")
    assert {r.hash for r in lifecycle.garbage(blocks, refs).collect()} == {"z", "orphan"}


def frames_of(spark, script):
    return spark.createDataFrame([(conn, seq, OPS.get(op, op), payload) for conn, steps in script.items() for seq, (op, payload) in enumerate(steps)], "conn_id long, seq long, op int, payload binary")


SIZE = lambda n: n.to_bytes(8, "big")
SCRIPT = {
    1: [("AUTH", b"owner-a"), ("UPLOAD_START", SIZE(3) + b"f"), ("UPLOAD_CHUNK", b"abc"), ("UPLOAD_FINISH", b""), ("LIST_FILES", b"")],
    2: [("UPLOAD_START", SIZE(9) + b"f"), ("UPLOAD_CHUNK", b"abc"), ("UPLOAD_FINISH", b"")],
    3: [("UPLOAD_START", SIZE(0)), ("UPLOAD_CHUNK", b"abc"), ("UPLOAD_FINISH", b"")],
    4: [("UPLOAD_START", SIZE(1)), ("UPLOAD_START", SIZE(1))],
    5: [("UPLOAD_CHUNK", b"abc"), ("LIST_FILES", b"")],
    6: [("UPLOAD_START", b"1234567")],
    7: [("UPLOAD_START", SIZE(1)), ("UPLOAD_CHUNK", b"")],
    8: [(0x77, b"")],
    9: [("AUTH", b"")],
    10: [("AUTH", b"owner-a"), ("AUTH", b"owner-b"), ("AUTH", b""), ("LIST_FILES", b"")],
    11: [("UPLOAD_START", SIZE(5) + b"g"), ("UPLOAD_CHUNK", b"ab")],
    12: [("DOWNLOAD_START", b"open"), ("DOWNLOAD_START", b"open"), ("DELETE_FILE", b"gone"), ("DELETE_FILE", b"")],
    13: [("DOWNLOAD_START", b"mine")], 14: [("AUTH", b"owner-a"), ("DOWNLOAD_START", b"mine"), ("DELETE_FILE", b"mine"), ("DELETE_FILE", b"open")],
    15: [("DOWNLOAD_START", b"")], 16: [("AUTH", b"owner-b"), ("DELETE_FILE", b"mine")], 17: [("DELETE_FILE", b"plain"), ("LIST_FILES", b"")],
    18: [("UPLOAD_RESUME", b"up"), ("UPLOAD_CHUNK", b"abc"), ("UPLOAD_RESUME", b"up")], 19: [("UPLOAD_RESUME", b"")], 20: [("UPLOAD_RESUME", b"other")],
    21: [("UPLOAD_RESUME", b"up"), ("UPLOAD_CHUNK", b"abc"), ("UPLOAD_FINISH", b"")],
}
OUTCOMES = {
    1: [("uploaded", "f"), ("list", "owner-a")], 2: [("size_mismatch", "f")], 3: [("uploaded", "unnamed")], 4: [("closed", "upload under way")], 5: [("closed", "no upload")],
    6: [("closed", "short start")], 7: [("closed", "empty chunk")], 8: [("closed", "unknown opcode")], 9: [("closed", "empty token")], 10: [("list", "owner-a")],
    11: [("aborted", "g")], 12: [("download", "open"), ("download", "open"), ("delete", "gone"), ("closed", "empty delete")],
    13: [("closed", "AUTH_ERROR")], 14: [("download", "mine"), ("delete", "mine"), ("closed", "AUTH_ERROR")], 15: [("closed", "DOWNLOAD_ERROR")], 16: [("closed", "AUTH_ERROR")], 17: [("delete", "plain"), ("list", "")],
    18: [("resumed", "up"), ("closed", "upload under way")], 19: [("closed", "RESUME_ERROR")], 20: [("closed", "RESUME_ERROR")], 21: [("resumed", "up"), ("uploaded", "up")],
}


def outcomes(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.conn_id, r.seq)):
        found.setdefault(r.conn_id, []).append((r.event, r.detail))
    return found


def known(spark):
    files = [("open", False, None, True), ("mine", True, "owner-a", True), ("plain", True, "someone", True)]
    return spark.createDataFrame(files, "cid string, owned boolean, owner string, there boolean"), spark.createDataFrame([("up",)], "upload_id string")


def test_sessions(spark):
    assert outcomes(session.run_sessions(frames_of(spark, SCRIPT), *known(spark)).collect()) == OUTCOMES


def test_only_control_frames_keep_their_bytes(spark):
    rows = session.control(frames_of(spark, SCRIPT)).collect()
    assert all(r.payload is None for r in rows if r.op == OPS["UPLOAD_CHUNK"]) and {r.length for r in rows if r.op == OPS["UPLOAD_CHUNK"]} == {0, 2, 3}


class State:
    """What a step needs of a group's state."""

    def __init__(self, value=None, timed_out=False):
        self.value, self.hasTimedOut, self.timeout = value, timed_out, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_idle_connections_end_and_are_forgotten():
    frame = lambda seq, op, payload: pd.DataFrame([(1, seq, OPS[op], len(payload), payload, False, None, False)], columns=[x.split()[0] for x in session.CONTROL.split(", ")])
    run = lambda state, *frames: [tuple(r) for out in sessions.step((1,), iter(frames), state, True) for r in out.itertuples(index=False)]
    state = State()
    assert run(state, frame(1, "UPLOAD_CHUNK", b"x"), frame(0, "UPLOAD_START", SIZE(5) + b"g")) == [] and state.timeout == sessions.IDLE_MS
    state.hasTimedOut = True
    assert run(state) == [(1, 2, "aborted", "g", 1)] and not state.exists
    state = State()
    assert run(state, frame(0, "UPLOAD_CHUNK", b"x")) == [(1, 0, "closed", "no upload", 0)]
    assert state.value == (True, None, None, "", 0, 0) and run(state, frame(1, "LIST_FILES", b"")) == []
    state.hasTimedOut = True
    assert run(state) == [] and not state.exists


def test_a_store_that_cannot_be_read_is_an_error(spark, tmp_path):
    chunks = spark.createDataFrame([("h", 1, b"x")], "hash string, size long, data binary")
    (tmp_path / "blocks").mkdir()
    (tmp_path / "blocks" / "part-0.parquet").write_bytes(b"no such format")
    with pytest.raises(Exception):  # noqa: B017
        store.put(chunks, str(tmp_path / "blocks"))


def test_writes(spark, tmp_path):
    root, mine = str(tmp_path / "store"), "owner-a"
    put = lambda *rows: writes.put_files(spark.createDataFrame(rows, "seq long, filename string, content binary, token string"), root, 4)
    put((1, "f", b"abcdefgh", mine), (2, "g", b"", None))
    put((3, "f", b"abcdefgh", "plain"), (4, "h", b"abcdxyz", mine))
    live = {r.filename: r for r in writes.live_files(spark, root).collect()}
    assert {k: (r.n_uploads, r.token, r.total_size) for k, r in live.items()} == {"f": (2, None, 8), "g": (1, None, 0), "h": (1, mine, 7)}
    assert spark.read.parquet(f"{root}/blocks").count() == 3 and writes.manifests(spark, root).count() == 3
    asked = [(10, live["f"].cid, None), (11, live["g"].cid, mine), (12, live["h"].cid, mine), (13, "x", None)]
    out = writes.delete_files(spark.createDataFrame(asked, "seq long, cid string, token string"), root)
    assert {r.seq: r.outcome for r in out.collect()} == {10: "deleted", 11: "AUTH_ERROR", 12: "deleted", 13: "missing"}
    assert [r.filename for r in writes.live_files(spark, root).collect()] == ["g"]
    put((20, "h", b"abcdxyz", None))
    assert {(r.filename, r.token) for r in writes.live_files(spark, root).collect()} == {("g", None), ("h", None)}


def test_users_and_progress(spark, tmp_path):
    root = str(tmp_path / "store")
    sign = lambda *rows: {r.seq: r.created for r in writes.create_users(spark.createDataFrame(rows, "seq long, username string, password_hash string"), root).collect()}
    assert sign((1, "a", "x"), (2, "a", "y"), (3, "b", "z")) == {1: True, 2: False, 3: True}
    assert sign((4, "b", "q"), (5, "c", "r")) == {4: False, 5: True}
    assert {(r.username, r.password_hash) for r in writes.users(spark, root).collect()} == {("a", "x"), ("b", "z"), ("c", "r")}
    save = lambda *rows: writes.save_progress(spark.createDataFrame(rows, writes.PROGRESS), root)
    save((1, "u", 2, 10, None, False), (2, "v", 1, 10, None, False))
    save((3, "u", 5, 10, None, False), (4, "v", 2, 10, None, True))
    got = writes.resume(spark.createDataFrame([("u",), ("v",), ("",), (None,)], "upload_id string"), root).collect()
    assert {r.upload_id: (r.reply, r.next_index) for r in got} == {"u": (writes.RESUME_OK, 5), "v": (writes.RESUME_UNKNOWN, None), "": (writes.RESUME_EMPTY, None), None: (writes.RESUME_EMPTY, None)}


def test_pages_of_a_listing(spark):
    letters = "abcdefghijklmnopqrstuvwxyz234567"
    rows = [("t", f"b{k:052d}" + "".join(letters[(k * 7919) >> s & 31] for s in (15, 10, 5, 0)), f"f{k}", k) for k in range(500)] + [("u", "b" * 57, "g", 1)]
    pages = acl.listing_pages(spark.createDataFrame(rows, "token string, cid string, filename string, size long"), 50).collect()
    files = [(r.token, x["filename"]) for r in pages for x in json.loads(r.response)]
    assert sorted(files) == sorted((t, f) for t, _, f, _ in rows) and len(pages) == 11 and max(len(json.loads(r.response)) for r in pages) < 120


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    frames = frames_of(spark, SCRIPT)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in ("seq < 2", "seq >= 2"):
        frames.where(part).write.mode("append").parquet(source)
        run_to_end(spark.readStream.schema(frames.schema).parquet(source), out, checkpoint, *known(spark))
    # a stream has no end at which to give up
    want = {k: v for k, v in OUTCOMES.items() if k != 11}
    assert outcomes(spark.read.parquet(out).collect()) == want


def test_users_files(spark):
    texts = ['{"a": {"password_hash": "x", "created_at": 1.5}, "b": {"password_hash": "y", "created_at": 2}}', "{oops", "{}"]
    assert {r.username: r.password_hash for r in foreign.users(spark.createDataFrame([(t,) for t in texts], "text string")).collect()} == {"a": "x", "b": "y"}

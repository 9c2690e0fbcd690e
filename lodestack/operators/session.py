"""The connection's state machine over frames, one step a frame, used by the batch and the streaming form."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.wire import OPS
from lodestack.operators.acl import PREFIX

SCHEMA = "conn_id long, seq long, event string, detail string, received long"
_START, _CHUNK, _FINISH, _RESUME, _AUTH, _DOWNLOAD, _DELETE, _LIST = (OPS[k] for k in ("UPLOAD_START", "UPLOAD_CHUNK", "UPLOAD_FINISH", "UPLOAD_RESUME", "AUTH", "DOWNLOAD_START", "DELETE_FILE", "LIST_FILES"))
#: What a frame needs of the rest of the store: the owner file's token (owned: whether there is one) and whether the file, or the upload in progress, is there.
CONTROL = "conn_id long, seq long, op int, length long, payload binary, owned boolean, owner string, there boolean"


@dataclass
class Session:
    """A connection: whether it is closed, its token, and the upload it is in the middle of. Totals only: bytes are never held. Downloads are over before the next frame."""

    closed: bool = False
    token: str | None = None
    declared: int | None = None  # of the upload under way
    filename: str = ""
    received: int = 0

    def step(self, op: int, length: int, payload: bytes, owned: bool, owner: str | None, there: bool) -> tuple[str, str] | None:
        """(event, detail) if the frame has an outcome; after `closed`, frames are not read. payload: of control frames only."""
        if self.closed:
            return None
        fault = self._fault(op, length) or self._refusal(op, owned, owner, there)
        if fault:
            self.closed, self.declared = True, None
            return "closed", fault
        if op == _AUTH:
            self.token = self.token if self.token is not None else payload.decode("utf-8", "replace")
        elif op == _START:
            self.declared, self.filename, self.received = int.from_bytes(payload[:8], "big"), payload[8:].decode("utf-8", "replace") or "unnamed", 0
        elif op == _RESUME:
            self.declared, self.filename, self.received = 0, payload.decode("utf-8", "replace"), 0
            return "resumed", self.filename
        elif op == _CHUNK:
            self.received += length
        elif op == _FINISH:
            event = "size_mismatch" if self.declared and self.declared != self.received else "uploaded"
            self.declared = None
            return event, self.filename
        elif op == _DOWNLOAD:
            return "download", payload.decode("utf-8", "replace") or "unnamed-cid"
        elif op == _DELETE:
            return "delete", payload.decode("utf-8", "replace")
        else:
            return "list", self.token or ""
        return None

    def _fault(self, op: int, length: int) -> str:
        """What is wrong with the frame itself, or with its place."""
        busy = self.declared is not None
        if op not in (_START, _CHUNK, _FINISH, _RESUME, _AUTH, _DOWNLOAD, _DELETE, _LIST):
            return "unknown opcode"
        if op == _AUTH and not length and self.token is None:
            return "empty token"
        if op in (_START, _RESUME) and busy:
            return "upload under way"
        if op == _START and length < 8:
            return "short start"
        if op == _RESUME and not length:
            return "RESUME_ERROR"
        if op in (_CHUNK, _FINISH) and not busy:
            return "no upload"
        if op == _CHUNK and not length:
            return "empty chunk"
        if op == _DELETE and not length:
            return "empty delete"
        return ""

    def _refusal(self, op: int, owned: bool, owner: str | None, there: bool) -> str:
        """The error reply with which a request is turned away. Access comes before existence; a file that is not there may be deleted."""
        protected = owned and (owner or "").startswith(PREFIX)
        if op in (_DOWNLOAD, _DELETE) and protected and owner != self.token:
            return "AUTH_ERROR"
        if op == _DELETE and not owned and self.token is not None:
            return "AUTH_ERROR"
        if op == _DOWNLOAD and not there:
            return "DOWNLOAD_ERROR"
        if op == _RESUME and not there:
            return "RESUME_ERROR"
        return ""

    def end(self) -> tuple[str, str] | None:
        """The connection's end; an upload under way is given up, its blocks stay unreferenced."""
        return ("aborted", self.filename) if self.declared is not None and not self.closed else None


def control(frames: DataFrame, files: DataFrame | None = None, uploads: DataFrame | None = None) -> DataFrame:
    """frames (conn_id, seq, op, payload) as CONTROL: bytes of chunks become their length, and names are looked up in files (cid, owned, owner, there) and uploads
    in progress (upload_id), as they are now; without these no file and no upload is there."""
    op = F.col("op").cast("int")
    named = F.when(op != _CHUNK, F.col("payload"))
    rows = frames.select(F.col("conn_id").cast("long").alias("conn_id"), F.col("seq").cast("long").alias("seq"), op.alias("op"), F.coalesce(F.octet_length("payload").cast("long"), F.lit(0)).alias("length"), named.alias("payload"))
    no = F.lit(False)
    if files is None and uploads is None:
        return rows.select("*", no.alias("owned"), F.lit(None).cast("string").alias("owner"), no.alias("there"))
    name = F.when(F.col("op").isin(_DOWNLOAD, _DELETE, _RESUME), F.when((F.col("op") == _DOWNLOAD) & (F.col("length") == 0), "unnamed-cid").otherwise(F.decode("payload", "utf-8")))
    rows = rows.withColumn("_kind", F.when(F.col("op") == _RESUME, "upload").otherwise("file")).withColumn("_name", name)
    known = None
    for table in (files and files.select(F.lit("file").alias("_kind"), F.col("cid").alias("_name"), "owned", "owner", "there"), uploads and uploads.select(F.lit("upload").alias("_kind"), F.col("upload_id").alias("_name"), no.alias("owned"), F.lit(None).cast("string").alias("owner"), F.lit(True).alias("there"))):
        if table is not None:
            known = table if known is None else known.unionByName(table)
    asked = rows.where("_name IS NOT NULL").join(known, ["_kind", "_name"], "left")
    rest = rows.where("_name IS NULL").select("*", no.alias("owned"), F.lit(None).cast("string").alias("owner"), no.alias("there"))
    both = asked.unionByName(rest, allowMissingColumns=True)
    return both.select("conn_id", "seq", "op", "length", "payload", F.coalesce("owned", no).alias("owned"), "owner", F.coalesce("there", no).alias("there"))


def run_sessions(frames: DataFrame, files: DataFrame | None = None, uploads: DataFrame | None = None) -> DataFrame:
    """Outcomes (SCHEMA) of frames (conn_id, seq, op, payload); aborted uploads have the seq after the last frame. One pass over each
    task's sorted connections, with one connection's totals in memory; see control() for files and uploads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conn, session, last, out = None, Session(), -1, []
        started = False

        def table() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*out)) if out else [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

        def close() -> None:
            if started and (ended := session.end()):
                out.append((conn, last + 1, *ended, session.received))

        for batch in batches:
            for c, seq, op, length, payload, *known in zip(*(x.to_pylist() for x in batch.columns)):
                if not started or c != conn:
                    close()
                    conn, session, started = c, Session(), True
                if event := session.step(op, length, payload or b"", *known):
                    out.append((conn, seq, *event, session.received))
                last = seq
            yield table()
        close()
        yield table()

    return control(frames, files, uploads).repartition("conn_id").sortWithinPartitions("conn_id", "seq").mapInArrow(run, SCHEMA)

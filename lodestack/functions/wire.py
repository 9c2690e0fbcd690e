"""Binary frames as column expressions: one byte of opcode, a big-endian 32-bit length, the payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Opcodes of requests and replies.
OPS = {
    "UPLOAD_START": 0x01, "UPLOAD_CHUNK": 0x02, "UPLOAD_FINISH": 0x03, "UPLOAD_RESUME": 0x04, "AUTH": 0x05,
    "DOWNLOAD_START": 0x11, "DELETE_FILE": 0x20, "LIST_FILES": 0x30,
    "UPLOAD_DONE": 0x81, "DOWNLOAD_CHUNK": 0x91, "DOWNLOAD_DONE": 0x92, "LIST_RESPONSE": 0xB0,
}
#: Replies that mean failure.
ERRORS = ("UPLOAD_ERROR", "AUTH_ERROR", "DOWNLOAD_ERROR")


def unsigned(data: Column, start: int, size: int) -> Column:
    """The big-endian number in `size` bytes from the 1-based start; above 2**63 it does not fit a long and is null."""
    return F.conv(F.hex(F.substring(data, start, size)), 16, 10).try_cast("long")


def big_endian(number: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * size, "0"))


def encode_frame(op: Column, payload: Column) -> Column:
    body = F.coalesce(payload, F.lit(b""))
    return F.concat(big_endian(op, 1), big_endian(F.octet_length(body), 4), body)


def decode_frame(frame: Column) -> Column:
    """struct(op, length, payload), null where the frame is cut short."""
    length = unsigned(frame, 2, 4)
    whole = (F.octet_length(frame) >= 5) & (F.octet_length(frame) >= 5 + length)
    return F.when(whole, F.struct(unsigned(frame, 1, 1).cast("short").alias("op"), length.alias("length"), F.substring(frame, F.lit(6), length.cast("int")).alias("payload")))


def start_payload(size: Column, filename: Column) -> Column:
    return F.concat(big_endian(size, 8), F.encode(filename, "utf-8"))


def reply_failed(reply: Column) -> Column:
    """Whether a reply's text means that nothing was done: a sentinel or nothing at all."""
    return F.coalesce(reply, F.lit("")).isin("", *ERRORS)

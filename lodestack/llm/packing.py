"""Harmonic packing of token ids into fixed-length training sequences.

A document of L ids first fills whole sequences of `capacity` ids. What remains, r ids, falls in the
reciprocal-capacity class j = capacity // r (capped at `classes`), and each class's bin takes exactly j
remainders. The room that a full bin has left is filled with ids cut from remainders that arrive later.
Every task packs the rows it reads on its own: no shuffle, and at most `classes` open bins and one sequence
of unfilled room in memory. What is open at the end of a task is strung together; the last sequence is cut
into powers of two, which need no padding.

Nulls, edges: a null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed
as documents of their own; a very long text fills whole sequences first; of open bins the one last left short is filled first; other columns are not
read, so none can clash; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestack.llm.common import documents, id_text
from lodestack.llm.tokens import ID, default_path, encoder

CAPACITY, CLASSES, END_ID = 4096, 32, 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class int"
FULL, FILLER, REST = 1, 0, -1

Piece = tuple  # (document number in the task, start, ids as bytes, class)


class HarmonicPacker:
    """add() documents, then finish(); both give finished sequences, lists of pieces."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES):
        self.capacity, self.classes, self.width = capacity, classes, ID.itemsize
        self.bins: dict[int, list[Piece]] = {}
        self.short: list[tuple[int, list[Piece]]] = []  # (room left, pieces) of bins that have their fixed count
        self.room = 0

    def add(self, doc: int, ids: bytes) -> Iterator[list[Piece]]:
        w, c = self.width, self.capacity
        total, start = len(ids) // w, 0
        while total - start >= c:
            yield [(doc, start, ids[start * w : (start + c) * w], FULL)]
            start += c
        rest = total - start
        if not rest:
            return
        if rest <= self.room:
            while rest:
                room, pieces = self.short.pop()
                n = min(room, rest)
                pieces.append((doc, start, ids[start * w : (start + n) * w], FILLER))
                start, rest, self.room = start + n, rest - n, self.room - n
                if n == room:
                    yield pieces
                else:
                    self.short.append((room - n, pieces))
            return
        j = min(c // rest, self.classes)
        held = self.bins.setdefault(j, [])
        held.append((doc, start, ids[start * w :], j))
        if len(held) == j:
            room = c - sum(len(p[2]) for p in held) // w
            del self.bins[j]
            if room:
                self.short.append((room, held))
                self.room += room
            else:
                yield held

    def finish(self) -> Iterator[list[Piece]]:
        w, pieces, filled = self.width, [], 0
        for doc, start, ids, _ in (p for held in [*self.bins.values(), *(x[1] for x in self.short)] for p in held):
            while ids:
                part = ids[: (self.capacity - filled) * w]
                n = len(part) // w
                pieces.append((doc, start, part, REST))
                start, ids, filled = start + n, ids[n * w :], filled + n
                if filled == self.capacity:
                    yield pieces
                    pieces, filled = [], 0
        while filled:
            power, taken, got = 1 << (filled.bit_length() - 1), [], 0
            while got < power:
                doc, start, ids, k = pieces.pop(0)
                n = min(len(ids) // w, power - got)
                taken.append((doc, start, ids[: n * w], k))
                got += n
                if n * w < len(ids):
                    pieces.insert(0, (doc, start + n, ids[n * w :], k))
            yield taken
            filled -= power
        self.bins, self.short, self.room = {}, [], 0


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """A row for each piece, of SCHEMA. class: the reciprocal class its bin belongs to; 0: cut to fill a bin's room, -1: strung together at a task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo = encoder(tokenizer_path)
        end = int(end_id).to_bytes(ID.itemsize, "little")
        packer, sequence = HarmonicPacker(capacity, classes), TaskContext.get().partitionId() << 40
        open_docs: dict[int, list] = {}  # number: [doc_id, ids in all, ids not yet in a sequence]
        number, rows = 0, []

        def take(sequences: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for pieces in sequences:
                offset = 0
                for doc, start, ids, k in pieces:
                    known, n = open_docs[doc], len(ids) // ID.itemsize
                    rows.append((known[0], start, n, zlib.crc32(ids), known[1], sequence, offset, k))
                    offset += n
                    known[2] -= n
                    if not known[2]:
                        del open_docs[doc]
                sequence += 1

        def table() -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n == "class" else pa.int64()) for n, x in zip(names, zip(*rows))], names)
            rows.clear()
            return out

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), memo.encode(t.as_py() for t in batch.column(1))):
                ids += end
                open_docs[number] = [doc_id, len(ids) // ID.itemsize, len(ids) // ID.itemsize]
                take(packer.add(number, ids))
                number += 1
                if len(rows) >= 20_000:
                    yield table()
        memo.forget()
        take(packer.finish())
        if rows:
            yield table()

    return id_text(docs).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_path("word_bpe_49k.json"))

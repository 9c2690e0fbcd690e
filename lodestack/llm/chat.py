"""Chat formatting: roles recovered by a hidden Markov model, then rendered as canonical turns.

States are roles. Each line of a transcript shows one symbol: the speaker marker it begins with, whether it opens its row, and its
length, question mark and (for a row's first line) the row's length, in classes. Emissions and transitions are counted over all
rows whose role is known, lines of one row sharing it; markers, which training rows may lack, get pseudo-counts that favour the role they name. Viterbi's
path over a conversation's lines gives every line its role; lines of a row that share a role are one segment, rendered as

    <|role|>
    text without its marker
    <|end|>

Long conversations are cut in blocks of `BLOCK` turns (a crowded block further, by turn and text hash). A block's lines reduce
to a matrix of best path scores from each state before it to each state at its end; one row for each block goes along the
conversation to fix the states at the block's ends, then every block finds its own path between them. The path is
the one that the whole sequence would give. Only the matrices of a conversation meet in one task, in a stream. Symbols, without text, are written
once and serve counting and the ends; texts are shuffled once, to be rendered beside the ends of their block.

The query fits on the conversations outside a fold (crc32 of conv_id modulo FOLDS is not 0) and tells in `held_out` which rows are in it.

Nulls, edges: rows are ordered by turn (nulls first), then by two hashes of the text; equal rows (conversation, turn and text) are one turn and
give one row, with their number in n_rows, and the least of their roles is the known one; a null text is an empty one, which is one empty line; all null conv_ids are one conversation, which is not learned from;
very long texts are read whole, a symbol for each line, and long conversations in blocks; paths of equal score: the state first by name; other columns are not read, so none can clash;
without any known role the states are user and assistant, alike but for markers; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.common import stored

BLOCK, CROWDED, MARKED = 256, 4096, 20.0
FOLDS, FEW_BLOCKS = 5, 10_000  # up to so many crowded blocks are handed to all tasks, more are joined
#: What speakers are called, by role.
MARKERS = {
    "user": "user human customer client me question q prompter".split(),
    "assistant": "assistant ai bot gpt agent model answer a".split(),
    "system": "system instruction instructions".split(),
    "tool": "tool function observation".split(),
}
_ROLES = list(MARKERS)
_NAMED = {name: role for role, names in MARKERS.items() for name in names}
_MARKER = re.compile(r"[\s>*#\[<|]*(" + "|".join(sorted(_NAMED, key=len, reverse=True)) + r")[\]*|>]*\s*(?::|\|>|>|\]|-\s)\s*", re.IGNORECASE)
LENGTHS = (0, 20, 60, 120, 200, 300, 450, 700, 1100, 2000)
N_SYMBOLS = (len(_ROLES) + 1) * 2 * (len(LENGTHS) + 1) * 2 * (len(LENGTHS) + 1)


def marker(line: str) -> tuple[str | None, int]:
    """The role that the line's speaker marker names and where the text after it begins."""
    found = _MARKER.match(line)
    return (_NAMED[found[1].lower()], found.end()) if found else (None, 0)


def _class(n: int) -> int:
    return int(np.searchsorted(LENGTHS, n, "left"))


def symbols(text: str) -> list[int]:
    """The symbol of each line."""
    out = []
    for k, line in enumerate(text.split("\n")):
        role, _ = marker(line)
        cell = 0 if role is None else 1 + _ROLES.index(role)
        for size, value in ((2, k == 0), (len(LENGTHS) + 1, _class(len(line))), (2, "?" in line), (len(LENGTHS) + 1, _class(len(text)) if k == 0 else 0)):
            cell = cell * size + int(value)
        out.append(cell)
    return out


def _marker_of(symbol: int) -> int:
    return symbol // (N_SYMBOLS // (len(_ROLES) + 1))


@dataclass
class Model:
    """Log probabilities. move: between rows, from each state and, last, from the start; stay: to a row's next line; turn: to one with a marker, which any state may follow."""

    roles: list[str]
    move: np.ndarray
    stay: np.ndarray
    turn: np.ndarray
    show: np.ndarray

    @classmethod
    def of(cls, emissions: dict[tuple[str, int], int], moves: dict[tuple[str | None, str], int]) -> Model:
        roles = sorted({r for r, _ in emissions}) or ["assistant", "user"]
        s = len(roles)
        show = np.full((s, N_SYMBOLS), 0.05)
        for (role, symbol), n in emissions.items():
            show[roles.index(role), symbol] += n
        named = np.array([_marker_of(k) for k in range(N_SYMBOLS)])
        for k, role in enumerate(roles):
            show[k, named > 0] += 0.05 * show[k].sum() / N_SYMBOLS
            if role in _ROLES:
                show[k, named == 1 + _ROLES.index(role)] *= 1 + MARKED * s
        move = np.full((s + 1, s), 0.5)
        for (before, after), n in moves.items():
            move[s if before is None else roles.index(before), roles.index(after)] += n
        stay = np.full((s, s), 0.02)
        np.fill_diagonal(stay, 1.0)
        return cls(roles, *(np.log(x / x.sum(1, keepdims=True)) for x in (move, stay, np.ones((s, s)), show)))

    def steps(self, rows: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(transition, emission) of each line of consecutive rows."""
        s = len(self.roles)
        return [(self.move[:s] if k == 0 else self.turn if _marker_of(x) else self.stay, self.show[:, x]) for row in rows for k, x in enumerate(row)]

    def matrix(self, rows: list[list[int]]) -> np.ndarray:
        """Best scores of a block: from each state before it, the last row standing for the start, to each state at its end."""
        best = None
        for move, show in self.steps(rows):
            best = self.move + show if best is None else (best[:, :, None] + move[None]).max(1) + show
        return best

    def path(self, rows: list[list[int]], entry: int, exit_state: int | None) -> list[int]:
        """The best states of a block's lines, coming from entry and, if told, ending in exit_state."""
        steps, back = self.steps(rows), []
        score = self.move[entry] + steps[0][1]
        for move, show in steps[1:]:
            moved = score[:, None] + move
            back.append(moved.argmax(0))
            score = moved.max(0) + show
        state = int(score.argmax()) if exit_state is None else exit_state
        out = [state]
        for b in reversed(back):
            state = int(b[state])
            out.append(state)
        return out[::-1]


_PLACE = ["conv_id", "blk", "sub"]


def _rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, two hashes of it (h, g) and the block (blk) of each row."""
    c = conversations
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), c["role"].alias("role"), F.coalesce(c["text"], F.lit("")).alias("text"))
    return rows.withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), "text"), "blk": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))})


def _placed(rows: DataFrame, crowd: DataFrame) -> DataFrame:
    """rows with sub, which cuts the crowded blocks (cc, cb) further."""
    fine = (F.coalesce(F.col("turn") - F.col("blk") * BLOCK, F.lit(0)) * 65536 + F.shiftright("h", 48) + 32768).cast("long")
    met = rows.join(crowd, rows["conv_id"].eqNullSafe(crowd["cc"]) & (rows["blk"] == crowd["cb"]), "left")
    return met.withColumn("sub", F.when(F.col("cb").isNotNull(), fine).otherwise(F.lit(0))).drop("cc", "cb")


def _turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(each distinct turn once, without text: conv_id, blk, sub, turn, h, g, role, n_rows and its lines' symbols; the crowded blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([symbols(t.as_py()) for t in batch.column(6)], pa.list_(pa.int32()))], ["conv_id", "blk", "turn", "h", "g", "role", "symbols"])

    shown = rows.select("conv_id", "blk", "turn", "h", "g", "role", "text").mapInArrow(run, "conv_id long, blk long, turn long, h long, g long, role string, symbols array<int>")
    one = stored(shown.groupBy("conv_id", "blk", "turn", "h", "g").agg(F.min("role").alias("role"), F.count("*").alias("n_rows"), F.first("symbols").alias("symbols")), "chat-turns")
    crowd = stored(one.groupBy("conv_id", "blk").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select(F.col("conv_id").alias("cc"), F.col("blk").alias("cb")), "chat-crowded")
    crowd = F.broadcast(crowd) if crowd.limit(FEW_BLOCKS + 1).count() <= FEW_BLOCKS else crowd
    return _placed(one, crowd), crowd


def _held_out(conv_id):
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(marked: DataFrame) -> Model:
    """From all turns of _turns with a role. The driver gets counts by role and symbol and by pair of roles."""
    emissions = {(r["role"], r["symbol"]): r["n"] for r in marked.where("role IS NOT NULL").select("role", F.explode("symbols").alias("symbol")).groupBy("role", "symbol").agg(F.count("*").alias("n")).collect()}
    in_block = Window.partitionBy(*_PLACE).orderBy("turn", "h", "g")
    inside = marked.select("role", F.lag("role").over(in_block).alias("before"), F.row_number().over(in_block).alias("k"))
    ends = marked.groupBy(*_PLACE).agg(F.min_by("role", F.struct("turn", "h", "g")).alias("role"), F.max_by("role", F.struct("turn", "h", "g")).alias("last"))
    along = Window.partitionBy("conv_id").orderBy("blk", "sub")  # a row for each block
    between = ends.select("role", F.lag("last").over(along).alias("before"), F.row_number().over(along).alias("k"))
    count = lambda df: df.groupBy("before", "role").agg(F.count("*").alias("n"))
    pairs = count(inside.where("k > 1 AND before IS NOT NULL AND role IS NOT NULL")).unionByName(count(between.where("role IS NOT NULL AND (k = 1 OR before IS NOT NULL)")))
    moves = {(r["before"], r["role"]): r["n"] for r in pairs.groupBy("before", "role").agg(F.sum("n").alias("n")).collect()}
    return Model.of(emissions, moves)


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first `key` columns, over batch borders."""
    held, now = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:key] != now:
                yield now, held
                held = []
            now = row[:key]
            held.append(row)
    if held:
        yield now, held


def _emit(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], size: int = 5000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names)


def _ends(marked: DataFrame, model: Model) -> DataFrame:
    """conv_id, blk, sub with the states before the block and at its end on the whole conversation's best path."""
    s, long = len(model.roles), pa.int64()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*key, model.matrix([r[5] for r in got]).ravel().tolist()) for key, got in _groups(batches, 3))
        yield from _emit(rows, [long, long, long, pa.list_(pa.float64())], ["conv_id", "blk", "sub", "m"])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve() -> Iterator[tuple]:
            for (conv,), blocks in _groups(batches, 1):
                score, back = None, []
                for _, _, _, m in blocks:
                    m = np.array(m).reshape(s + 1, s)
                    if score is None:
                        back.append(np.full(s, s))
                        score = m[s]
                    else:
                        moved = score[:, None] + m[:s]
                        back.append(moved.argmax(0))
                        score = moved.max(0)
                state = int(score.argmax())
                for (_, blk, sub, _), b in zip(reversed(blocks), reversed(back)):
                    yield conv, blk, sub, int(b[state]), state
                    state = int(b[state])

        yield from _emit(solve(), [long, long, long, pa.int32(), pa.int32()], ["conv_id", "blk", "sub", "entry", "exit"])

    matrices = marked.select(*_PLACE, "turn", "h", "symbols", "g").repartition(*_PLACE).sortWithinPartitions(*_PLACE, "turn", "h", "g").mapInArrow(reduce, "conv_id long, blk long, sub long, m array<double>")
    return matrices.repartition("conv_id").sortWithinPartitions("conv_id", "blk", "sub").mapInArrow(along, "conv_id long, blk long, sub long, entry int, exit int")


def render(text: str, roles: list[str]) -> tuple[str, int]:
    """Canonical turns of a row's lines, and their number."""
    parts: list[tuple[str, list[str]]] = []
    for line, role in zip(text.split("\n"), roles):
        named, at = marker(line)
        if not parts or parts[-1][0] != role or (named and parts[-1][1]):
            parts.append((role, []))
        parts[-1][1].append(line[at:])
    return "\n".join(f"<|{role}|>\n" + "\n".join(lines).strip("\n") + "\n<|end|>" for role, lines in parts), len(parts)


SCHEMA = "conv_id long, turn long, held_out boolean, role_pred string, n_segments int, n_rows long, rendered string"


def format_chats(conversations: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each distinct turn, of SCHEMA. Without a model one is fitted to the known roles of the conversations outside the held-out fold."""
    rows = _rows(conversations)
    marked, crowd = _turns(rows)
    model = model or fit(marked.where(F.col("conv_id").isNotNull() & ~_held_out(F.col("conv_id"))))
    nothing = lambda kind: F.lit(None).cast(kind)
    # the ends of a block go before its rows, in one exchange: a join could be dealt anew and tear blocks apart
    ends = _ends(marked, model).select(*_PLACE, nothing("long").alias("turn"), nothing("long").alias("h"), nothing("long").alias("g"), "entry", "exit", nothing("boolean").alias("held_out"), nothing("string").alias("text"))
    texts = _placed(rows, crowd).select(*_PLACE, "turn", "h", "g", nothing("int").alias("entry"), nothing("int").alias("exit"), _held_out(F.col("conv_id")).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve() -> Iterator[tuple]:
            for _, (ends_of, *got) in _groups(batches, 3):
                kept: list[list] = []  # equal rows lie side by side
                for row in got:
                    if kept and kept[-1][0][3:6] == row[3:6]:
                        kept[-1][1] += 1
                    else:
                        kept.append([row, 1])
                shown = [symbols(row[9]) for row, _ in kept]
                states, at = model.path(shown, ends_of[6], ends_of[7]), 0
                for (row, n_rows), x in zip(kept, shown):
                    roles = [model.roles[k] for k in states[at : at + len(x)]]
                    at += len(x)
                    text, segments = render(row[9], roles)
                    yield row[0], row[3], row[8], roles[0], segments, n_rows, text

        yield from _emit(solve(), [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.string()], [x.split()[0] for x in SCHEMA.split(", ")])

    return texts.unionByName(ends).repartition(*_PLACE).sortWithinPartitions(*_PLACE, F.col("entry").desc_nulls_last(), "turn", "h", "g").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))

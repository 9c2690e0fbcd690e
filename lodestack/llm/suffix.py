"""Repeated-passage removal by longest previous factors in suffix order, over the whole corpus.

A byte goes if a string of `min_bytes` that covers it also starts elsewhere. Beside that, passages of PASSAGE_WORDS words or more
that stand in more than one document are counted, whatever their bytes: the same search over words in place of bytes.

Filter. Of the grams in each window (a string of the least length) the one with the least hash is the window's anchor (the leftmost
of equal ones): a function of the window alone, so equal windows have equal anchors at equal offsets.
An anchor owns the consecutive windows that chose it; its context is the text they cover. Only anchors whose gram hash
occurs twice or more go on. Occurrences with the same context are one class; a class of two or more repeats throughout.

Suffix order. Where a gram has several classes and one of them is not known to repeat, their contexts are brought together, and the suffixes at all
windows they own are sorted, equal ones by place in the corpus (document, offset). From that order and the common prefixes of its neighbours,
a scan for each suffix's previous and next smaller position gives the longest previous factors: a window whose factor
is as long as itself is a later copy, and the window it is a copy of repeats. A gram with more than GROUP contexts is dealt over
several sorts, and the first of each class of equal windows in each of these are matched over all of them by hash.
`keep="first"` removes later copies only, `keep="none"` all.

The work is linear in the text: about one anchor for every hundred bytes is shuffled, then contexts of the anchors that
repeat in part only. Texts are shuffled twice, compressed. Strings are told apart by the hash of their gram and an XXH3 hash of the whole context, 128 bits together.

Nulls, edges: a null or empty text has no bytes; a null doc_id stays null and comes first; repeated rows are documents of their
own, numbered as they are first written, so that each is elsewhere for the other and one of them is the first; very long texts are read whole, in segments; of equal
strings the first by doc_id is the first; other columns are not read, so none can clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import documents, id_text, stored

MIN_BYTES, GRAM = 400, 200
PASSAGE_WORDS, WORD_GRAM = 50, 16
GROUP, SORTED_WINDOWS, SEGMENT = 1000, 50_000, 1 << 22
BYTES, WORDS = 0, 1
WIDTH = (1, 8)  # bytes of a symbol
_DRAW = np.random.default_rng(20_240_229)
_LETTER = _DRAW.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_DRAW.integers(0, 1 << 63)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64((1 << 24) - 1)
_SOLID = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substrings of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * _power(_BASE, len(symbols)), out=self.sums[1:])
        self.back = _power(_INVERSE, len(symbols) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def grams(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return _mixed((self.sums[k:] - self.sums[:n]) * self.back[:n])


def word_symbols(raw: np.ndarray, rolling: Rolling) -> np.ndarray:
    """A 64-bit hash of each word of the text."""
    solid = np.concatenate([[False], _SOLID[raw], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return rolling(edges[::2], edges[1::2])


def _window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` keys: least up to and least from each place within blocks of that width."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[: n - width + 1], upto[width - 1 : n])


def anchors(rolling: Rolling, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first owned window, windows owned) of each anchor."""
    windows, width = len(rolling.sums) - least, least - gram + 1
    if windows < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, chosen = rolling.grams(gram), []
    for at in range(0, windows, SEGMENT):
        part = grams[at : min(at + SEGMENT, windows) + width - 1]
        keys = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        chosen.append((_window_least(keys, width) & _LOW).astype(np.int64) + at)
    chosen = np.concatenate(chosen)
    first = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
    return grams[chosen[first]], first, np.diff(np.append(first, windows))


class Sizes:
    """The least lengths searched for and the gram lengths, for bytes and for words."""

    def __init__(self, min_bytes: int = MIN_BYTES, gram: int = GRAM, words: int = PASSAGE_WORDS, word_gram: int = WORD_GRAM):
        self.least, self.gram = (min_bytes, words), (gram, word_gram)

    def sequences(self, raw: bytes) -> Iterator[tuple[int, np.ndarray, Rolling]]:
        """(kind, symbols, their hashes) of a text long enough to have windows."""
        letters = np.frombuffer(raw, np.uint8)
        if len(letters) < min(self.least[BYTES], 2 * self.least[WORDS] - 1):
            return
        rolling = Rolling(_LETTER[letters])
        yield BYTES, letters, rolling
        words = word_symbols(letters, rolling)
        yield WORDS, words, Rolling(words)

    def gram_hashes(self, kind: int, found: np.ndarray) -> np.ndarray:
        return (found if kind == BYTES else _mixed(found + _M2)).view(np.int64)


def _pack(first: np.ndarray, kind: int, owned: np.ndarray) -> np.ndarray:
    return (first << 13) | (kind << 12) | owned


def _unpacked(pack: int) -> tuple[int, int, int]:
    """(first owned window, kind, windows owned)."""
    return pack >> 13, (pack >> 12) & 1, pack & 0xFFF


def suffix_order(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows, equal ones by place, and how many bytes each shares with the one before it in that order (0 for the first)."""
    n, depth = windows.shape
    order = np.argsort(np.ascontiguousarray(windows).view(np.dtype((np.void, depth))).ravel(), kind="stable")
    common, common[0] = np.zeros(n, np.int64), 0
    for at in range(1, n, 8192):
        ends = slice(at, min(n, at + 8192))
        apart = windows[order[ends]] != windows[order[at - 1 : ends.stop - 1]]
        common[ends] = np.where(apart.any(1), apart.argmax(1), depth)
    return order, common


def longest_previous_factors(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix, by place, the longest prefix that it shares with one at a smaller place, up to depth.

    The longest is with the nearest smaller place before or after it in suffix order; one scan with a stack finds both. In a run
    of equal suffixes all but the first have one just before them, so that only runs' firsts are scanned.
    """
    out = np.full(len(order), depth, np.int64)
    heads = np.flatnonzero(common < depth)
    stack: list[tuple[int, int]] = []  # (place, common prefix with the one below)
    for place, shared in zip([*order[heads].tolist(), -1], [*common[heads].tolist(), 0]):
        while stack and place < stack[-1][0]:
            top, below = stack.pop()
            out[top] = max(below, shared)
            shared = min(below, shared)
        stack.append((place, shared))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, doc (a null id as the least long), u (the row's number) and z, the text compressed, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([compress(x.as_buffer()) for x in batch.column(1)], pa.binary())], ["doc_id", "z"])

    packed = id_text(docs).select("doc_id", F.encode("text", "utf-8").alias("raw")).mapInArrow(run, "doc_id long, z binary")
    return stored(packed.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.monotonically_increasing_id().alias("u"), "z"), "suffix-texts")


def _gram_hashes(texts: DataFrame, sizes: Sizes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            found = [sizes.gram_hashes(kind, anchors(rolling, sizes.least[kind], sizes.gram[kind])[0]) for z in batch.column(0) for kind, _, rolling in sizes.sequences(expand(z.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], ["h"])

    return texts.select("z").mapInArrow(run, "h long")


_ANCHORS = "h long, c long, doc long, u long, pack long"


def _anchors(texts: DataFrame, sizes: Sizes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        expand, digest = zstandard.ZstdDecompressor().decompress, xxhash.xxh3_64_intdigest
        for batch in batches:
            columns: list[list] = [[np.zeros(0, np.int64)] for _ in range(5)]
            for doc, u, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for kind, symbols, rolling in sizes.sequences(expand(z.as_py())):
                    h, first, owned = anchors(rolling, sizes.least[kind], sizes.gram[kind])
                    view, w = memoryview(symbols).cast("B"), WIDTH[kind]
                    c = np.array([digest(view[a:b]) for a, b in zip((first * w).tolist(), ((first + owned - 1 + sizes.least[kind]) * w).tolist())], np.uint64)
                    for column, x in zip(columns, (sizes.gram_hashes(kind, h), c.view(np.int64), np.full(len(h), doc), np.full(len(h), u), _pack(first, kind, owned))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in columns], [x.split()[0] for x in _ANCHORS.split(", ")])

    return texts.select("doc", "u", "z").mapInArrow(run, _ANCHORS)


_WANTED = "h long, c long, salt int, salted boolean, settled boolean, doc long, pack long"


def _contexts(wanted: DataFrame, texts: DataFrame, sizes: Sizes) -> DataFrame:
    """wanted (_WANTED and u) with the context's bytes; each text is opened once for all its contexts."""
    names = [x.split()[0] for x in _WANTED.split(", ")]
    lists = wanted.groupBy("u").agg(F.collect_list(F.struct(*names)).alias("l"))  # as many as the text's length allows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        rows: list[tuple] = []

        def table() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [*names, "u", "raw"])
            rows.clear()
            return out

        for batch in batches:
            for u, asked, z in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                views: dict[int, memoryview] = {}
                for kind, symbols, _ in sizes.sequences(expand(z.as_py())):
                    views[kind] = memoryview(symbols).cast("B")
                for x in asked.as_py():
                    first, kind, owned = _unpacked(x["pack"])
                    rows.append((*(x[k] for k in names), u, bytes(views[kind][first * WIDTH[kind] : (first + owned - 1 + sizes.least[kind]) * WIDTH[kind]])))
                if len(rows) >= 10_000:
                    yield table()
        if rows:
            yield table()

    return lists.join(texts.select("u", "z"), "u").select("u", "l", "z").mapInArrow(run, f"{_WANTED}, u long, raw binary")


_FOUND = "h long, c long, every binary, later binary, t int, wh long, settled boolean, doc long, u long, at long"


def _sorted_groups(contexts: DataFrame, sizes: Sizes) -> DataFrame:
    """Rows of _FOUND: masks of owned windows that repeat and that are later copies, within a gram and salt; for salted grams also, with t,
    the first of each class of equal windows."""

    def solve(rows: list[tuple]) -> Iterator[tuple]:
        import xxhash

        rows.sort(key=lambda r: (r[5], r[7], r[6]))  # the order of the corpus
        kind = _unpacked(rows[0][6])[1]
        width, depth = WIDTH[kind], WIDTH[kind] * sizes.least[kind]
        owned = [_unpacked(r[6])[2] for r in rows]
        at = np.concatenate([[0], np.cumsum(owned)])
        windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.frombuffer(r[8], np.uint8), depth)[::width][:n] for r, n in zip(rows, owned)])
        order, common = suffix_order(windows)
        later = longest_previous_factors(order, common, depth) >= depth
        run_at = np.flatnonzero(common < depth)
        size = np.diff(np.append(run_at, len(order)))
        again = size > 1
        if kind == WORDS:  # in more than one document
            u, settled = np.repeat([r[7] for r in rows], owned)[order], np.repeat([r[4] for r in rows], owned)[order]
            again = (np.minimum.reduceat(u, run_at) != np.maximum.reduceat(u, run_at)) | np.logical_or.reduceat(settled, run_at)
        every = np.empty(len(order), bool)
        every[order] = np.repeat(again, size)
        for k, (h, c, _, salted, settled, doc, pack, u, _) in enumerate(rows):
            mine = slice(at[k], at[k + 1])
            yield h, c, np.packbits(every[mine]).tobytes(), np.packbits(later[mine]).tobytes(), None, None, None, None, None, None
            if salted:
                first = _unpacked(pack)[0]
                for t in np.flatnonzero(~later[mine] | ~every[mine]).tolist():
                    digest = xxhash.xxh64_intdigest(windows[at[k] + t].tobytes(), 42)
                    yield h, c, None, None, t, digest - (1 << 64) if digest >> 63 else digest, bool(settled or every[at[k] + t]), doc, u, first + t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in _FOUND.split(", ")]
        held: tuple[list, list] = [], []  # by kind: whole groups, sorted together, as equal windows have equal grams
        size, last, ready = [0, 0], None, []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*ready), kinds)], names)
            ready.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if (row[0], row[2]) != last:
                    last = row[0], row[2]
                    for kind in (BYTES, WORDS):
                        if size[kind] >= SORTED_WINDOWS:
                            ready += solve(held[kind])
                            held[kind].clear()
                            size[kind] = 0
                    if len(ready) >= 20_000:
                        yield out()
                _, kind, owned = _unpacked(row[6])
                held[kind].append(row)
                size[kind] += owned
        for rows in filter(None, held):
            ready += solve(rows)
        if ready:
            yield out()

    return contexts.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(run, _FOUND)


def repeats(texts: DataFrame, keep: str, sizes: Sizes, group: int = GROUP) -> DataFrame:
    """(u, l): for each row the anchors with repeated windows: pack, full (all of them), masks, matches over salts, and whether the row is the first of its class."""
    # written first: a join of two plain exchanges is one whose hot grams are split at run time
    twice = stored(_gram_hashes(texts, sizes).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "suffix-grams")
    found = stored(_anchors(texts, sizes).join(twice, "h"), "suffix-anchors")
    words = F.shiftright("rep.pack", 12).bitwiseAND(F.lit(1)) == WORDS
    counted = found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc", "u", "pack")).alias("rep"), (F.min("u") != F.max("u")).alias("apart"))
    classes = stored(counted.select("h", "c", "n", "rep", F.when(words, F.col("apart")).otherwise(F.col("n") > 1).alias("settled")), "suffix-classes")
    grams = classes.groupBy("h").agg(F.count("*").alias("n_classes"), F.count(F.when(~F.col("settled"), 1)).alias("n_open"))
    grams = stored(grams.where("n_classes > 1" + (" AND n_open > 0" if keep == "none" else "")).select("h", "n_classes"), "suffix-grams")
    parts = F.ceil(F.col("n_classes") / group)
    wanted = classes.join(grams, "h").select("h", "c", F.pmod(F.xxhash64("c"), parts).cast("int").alias("salt"), (parts > 1).alias("salted"), "settled", "rep.doc", "rep.pack", "rep.u")
    solved = stored(_sorted_groups(_contexts(wanted, texts, sizes), sizes), "suffix-order")
    masks = solved.where("t IS NULL").select("h", "c", "every", "later")
    firsts = solved.where("t IS NOT NULL").select("h", "c", "t", "wh", "settled", "u", F.struct("doc", "u", "at").alias("place"))
    met = firsts.groupBy("h", "wh").agg(F.count("*").alias("n"), F.min("place").alias("first"), ((F.min("u") != F.max("u")) | F.max("settled")).alias("apart")).where("n > 1")
    across = firsts.join(met, ["h", "wh"]).groupBy("h", "c").agg(F.collect_list(F.struct("t", (F.col("place") != F.col("first")).alias("later"), "apart")).alias("across"))
    known = classes.join(masks, ["h", "c"], "left").join(across, ["h", "c"], "left").where("settled OR every IS NOT NULL")
    known = stored(known.select("h", "c", F.col("settled").alias("full"), "rep", "every", "later", "across"), "suffix-known")
    is_first = F.struct("doc", "u", "pack") == F.col("rep")
    marked = found.join(known, ["h", "c"]).select("u", F.struct("pack", "full", "every", "later", "across", is_first.alias("is_first")).alias("x"))
    return marked.groupBy("u").agg(F.collect_list("x").alias("l"))  # a row's anchors: as many as the text's length allows


def covered(n: int, found: list[dict], kind: int, least: int, keep: str) -> np.ndarray:
    """Which of a text's n symbols (of one kind) go."""
    starts = np.zeros(n + 1, bool)
    for x in found:
        first, of, owned = _unpacked(x["pack"])
        if of != kind:
            continue
        mine, copies = starts[first : first + owned], keep == "none" or not x["is_first"]
        if x["full"] and copies:
            mine[:] = True
            continue
        mask = x["every"] if copies else x["later"]
        if mask is not None:
            mine |= np.unpackbits(np.frombuffer(mask, np.uint8), count=owned).astype(bool)
        for y in x["across"] or ():
            if (copies or y["later"]) and (kind == BYTES or y["apart"]):
                mine[y["t"]] = True
    steps = starts.astype(np.int64)
    np.add.at(steps, np.flatnonzero(starts) + least, -1)
    return np.cumsum(steps)[:n] > 0


def _runs(gone: np.ndarray) -> int:
    return int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, kept binary"


def remove_repeats(docs: DataFrame, keep: str = "first", min_bytes: int = MIN_BYTES, gram: int = GRAM, group: int = GROUP, with_bytes: bool = True) -> DataFrame:
    """A row for each document, of SCHEMA; kept, the bytes that stay, is null unless with_bytes.

    n_passages: runs of words covered by strings of PASSAGE_WORDS words that are in another document too; they are counted, not removed.
    """
    sizes, texts = Sizes(min_bytes, gram), _texts(docs)
    marked = texts.select("doc_id", "u", "z").join(repeats(texts, keep, sizes, group), "u", "left").select("doc_id", "z", "l")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for doc_id, z, found in zip(*batch.columns):
                doc_id, raw, found = doc_id.as_py(), expand(z.as_py()), found.as_py() or []
                kept, spans, passages = raw, 0, 0
                if found:
                    gone = covered(len(raw), found, BYTES, min_bytes, keep)
                    kept, spans = np.frombuffer(raw, np.uint8)[~gone].tobytes(), _runs(gone)
                    passages = _runs(covered(len(raw) // 2 + 1, found, WORDS, PASSAGE_WORDS, "none"))
                rows.append((doc_id, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), passages, kept if with_bytes else None))
            columns = zip(*rows) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return marked.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), keep="none", with_bytes=False).drop("kept")

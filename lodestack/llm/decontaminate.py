"""Benchmark decontamination: every training passage queries a BM25 index of the test items by block-max WAND.

Words are lower-cased, ASCII punctuation deleted, cut at ASCII white space. An item's impact for a term is its
BM25 weight divided by the item's score against itself, so that a passage holding the whole item scores 1. The
index has, for each term, postings by item and, for blocks of `block` items, the largest impact in the block.
A document is read in overlapping passages of twice the longest item's words, so that each copy lies whole in
one. For each passage, terms whose largest impacts sum to at most `slack` are left for the second step;
the others' block maxima add up to a bound, in arrays for many passages at once, and only blocks whose bound plus slack reaches `threshold` are opened.
In an open block a cursor for each of the passage's terms goes along the postings, in the order of their items: the pivot is the first item up to which the
block maxima sum to the threshold, and only there is an item scored; cursors before it skip to it. All items at or above the threshold are verified: of the item's question (its
sentences but the last) and answer (its last sentence), each as word 5-grams, the passage must hold
`overlap` or more.

The items go to the tasks as a broadcast of at most `max_index_chars` characters; more items make more indexes of
that size, each read against all documents. Term statistics are those of all items, counted on Spark.

Nulls, edges: null or empty texts and items match nothing; null doc_ids are kept apart as null; repeated rows
each give their own pairs; an item without words is never found; very long texts are read whole, in slices of at most about CELLS bounds; a score equal to
the threshold is a hit, and of a document's passages with one item the best score is told; other columns are not read, so none can clash; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import documents, id_text

K1, B, BLOCK, THRESHOLD, SLACK, NGRAM, OVERLAP = 1.2, 0.75, 4, 0.6, 0.05, 5, 0.5
MAX_INDEX_CHARS, CELLS, BULK_WORDS = 16_000_000, 1_000_000, 100_000
_PUNCTUATION = string.punctuation.encode()
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of all sentences but the last, and of the last; a single sentence is cut after two thirds of its words."""
    sentences = [w for w in map(words_of, _SENTENCE_END.split(text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = max(1, len(words) * 2 // 3)
    return words[:cut], words[cut:]


def _grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def overlap(part: list[bytes], passage: list[bytes], n: int = NGRAM) -> float:
    """The share of part's word n-grams that passage holds; a shorter part is one n-gram of its own length, an empty one is held."""
    n = min(n, len(part))
    if not n:
        return 1.0
    wanted = _grams(part, n)
    return len(wanted & _grams(passage, n)) / len(wanted)


class Index:
    """BM25 postings of the items, with block maxima, as arrays over terms (compressed rows)."""

    def __init__(self, items: list[tuple[int | None, str]], block: int = BLOCK, slack: float = SLACK, statistics: tuple[int, float, dict[bytes, int]] | None = None):
        """statistics: items in all, their mean length and each term's number of items; those of the given items unless told."""
        words = [(i, t, words_of(t)) for i, t in items]
        words = sorted(((i, t, w) for i, t, w in words if w), key=lambda x: len(x[2]))  # alike lengths share blocks: tighter maxima
        self.ids, self.texts = [x[0] for x in words], [x[1] for x in words]
        self.longest, self.block = max((len(x[2]) for x in words), default=0), block
        counts = [Counter(x[2]) for x in words]
        n, mean, df = statistics or (len(words), sum(len(x[2]) for x in words) / max(len(words), 1), Counter(t for c in counts for t in c))
        self.terms = {t: k for k, t in enumerate(sorted({t for c in counts for t in c}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for item, c in enumerate(counts):
            room = K1 * (1 - B + B * sum(c.values()) / mean)
            weights = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + room) for t, f in c.items()}
            whole = sum(weights.values())
            for t, w in weights.items():
                postings[self.terms[t]].append((item, w / whole))
        self.n_blocks = -(-len(words) // block)
        by_block = []
        for p in postings:
            best: dict[int, float] = {}
            for item, w in p:
                best[item // block] = max(best.get(item // block, 0.0), w)
            by_block.append(sorted(best.items()))
        self.item_at, self.items, self.impacts = self._rows(postings)
        self.block_at, self.blocks, self.maxima = self._rows(by_block)
        top = np.array([max(w for _, w in p) for p in postings])
        order = np.argsort(top, kind="stable")
        self.essential = np.ones(len(top), bool)
        self.essential[order[np.cumsum(top[order]) <= slack]] = False
        self.slack = slack

    @staticmethod
    def _rows(lists: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        flat = [y for x in lists for y in x]
        return at, np.array([y[0] for y in flat], np.int64), np.array([y[1] for y in flat], np.float64)

    @staticmethod
    def _spread(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry of the given rows: which of them it belongs to, and where it is."""
        n = at[rows + 1] - at[rows]
        of = np.repeat(np.arange(len(rows)), n)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + at[rows][of]

    def in_block(self, terms: list[int], block: int, threshold: float) -> Iterator[tuple[int, float]]:
        """(item, score) of the block's items that reach the threshold, by WAND with the block's maxima. terms: distinct, with a posting in the block."""
        cursors = []  # [item under the cursor, its place, the end of the block's postings, the block's maximum]
        for t in terms:
            a, b = int(self.item_at[t]), int(self.item_at[t + 1])
            at, end = (a + int(np.searchsorted(self.items[a:b], k * self.block)) for k in (block, block + 1))
            if at < end:
                cursors.append([int(self.items[at]), at, end, float(self.impacts[at:end].max())])
        while cursors:
            cursors.sort()
            most, pivot = 0.0, None
            for item, _, _, top in cursors:
                most += top
                if most >= threshold - 1e-9:
                    pivot = item
                    break
            if pivot is None:
                return
            if cursors[0][0] == pivot:
                score = sum(float(self.impacts[c[1]]) for c in cursors if c[0] == pivot)
                if score >= threshold - 1e-9:
                    yield pivot, score
                pivot += 1
            for c in cursors:  # those before the pivot skip to it
                while c[0] < pivot:
                    c[1] += 1
                    c[0] = int(self.items[c[1]]) if c[1] < c[2] else len(self.ids)
            cursors = [c for c in cursors if c[1] < c[2]]

    def search(self, passage: np.ndarray, term: np.ndarray, n_passages: int, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, float]]:
        """(passage, item, score) of all scores that reach the threshold. passage, term: each passage's distinct terms, sorted by passage."""
        step = max(1, CELLS // max(1, self.n_blocks))
        for begin in range(0, n_passages, step):
            rows = slice(*np.searchsorted(passage, [begin, begin + step]).tolist())
            yield from self._slice(passage[rows] - begin, term[rows], min(step, n_passages - begin), begin, threshold)

    def _slice(self, passage: np.ndarray, term: np.ndarray, n_passages: int, begin: int, threshold: float) -> Iterator[tuple[int, int, float]]:
        keep = self.essential[term]
        of, at = self._spread(self.block_at, term[keep])
        bound = np.bincount(passage[keep][of] * self.n_blocks + self.blocks[at], self.maxima[at], n_passages * self.n_blocks)
        for cell in np.flatnonzero(bound >= threshold - self.slack - 1e-9).tolist():
            p, block = divmod(cell, self.n_blocks)
            mine = slice(*np.searchsorted(passage, [p, p + 1]).tolist())
            for item, score in self.in_block(term[mine].tolist(), block, threshold):
                yield begin + p, item, score


def find_in_texts(texts: list[str], index: Index, threshold: float = THRESHOLD, least: float = OVERLAP) -> list[tuple[int, int, float, float, float]]:
    """(text number, item number, score, question overlap, answer overlap) of every verified pair, the best passage of each."""
    stride = index.longest
    if not stride:
        return []
    get, out = index.terms.get, []
    at = 0
    while at < len(texts):
        known, first, n_passages, split, sum_words = False, [], 0, [], 0
        while at < len(texts) and (not known or (n_passages * index.n_blocks < CELLS and sum_words < BULK_WORDS)):
            words = words_of(texts[at])
            ids = np.array([get(w, -1) for w in words], np.int64)
            first.append((at, n_passages))
            place = np.flatnonzero(ids >= 0)
            own = place // stride  # word p is in the passages that start at (p // stride) and the one before
            passages = max(1, -(-len(words) // stride))
            for shift in (0, 1):
                ok = own >= shift
                split.append((own[ok] - shift + n_passages, ids[place[ok]]))
            known, sum_words = True, sum_words + len(words)
            n_passages += passages
            at += 1
        width = len(index.terms)
        key = np.unique(np.concatenate([p * width + t for p, t in split]))
        starts = np.array([f[1] for f in first])
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        kept_words: dict[int, list[bytes]] = {}
        for p, item, score in index.search(key // width, key % width, n_passages, threshold):
            text, begin = first[int(np.searchsorted(starts, p, "right")) - 1]
            if text not in kept_words:
                kept_words = {text: words_of(texts[text])}
            passage = kept_words[text][(p - begin) * stride : (p - begin + 2) * stride]
            question, answer = (overlap(part, passage) for part in question_and_answer(index.texts[item]))
            if question >= least and answer >= least:
                best[text, item] = max(best.get((text, item), (0.0, 0.0, 0.0)), (score, question, answer))
        out += [(*k, *v) for k, v in sorted(best.items())]
    return out


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _indexes(items: DataFrame, max_index_chars: int) -> Iterator[Index]:
    """Indexes over all items, each of about max_index_chars characters at most."""
    rows = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // max_index_chars)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, parts))))
    if parts <= 1:
        got = rows.orderBy("item_id", "text").collect()
        if got:
            yield Index([(r["item_id"], r["text"]) for r in got])
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(1)]
            terms = [sorted(set(w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, words), pa.int64()), pa.array(terms, pa.list_(pa.binary()))], ["part", "n", "terms"])

    read = rows.select("part", "text").mapInArrow(run, "part long, n long, terms array<binary>").where("n > 0")
    size = read.agg(F.count("*").alias("items"), F.avg("n").alias("mean")).first()
    terms = read.select("part", F.explode("terms").alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("n"))
    for k in range(parts):
        known = {bytes(r["term"]): r["n"] for r in terms.where(F.col("part") == k).select("term").distinct().join(df, "term").collect()}  # of one index's items
        got = rows.where(F.col("part") == k).orderBy("item_id", "text").collect()
        yield Index([(r["item_id"], r["text"]) for r in got], statistics=(size["items"], size["mean"], known))


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP, max_index_chars: int = MAX_INDEX_CHARS) -> DataFrame:
    """A row for each document and test item that it holds, of SCHEMA."""
    spark, texts = docs.sparkSession, id_text(docs)
    out = spark.createDataFrame([], SCHEMA)
    for index in _indexes(items, max_index_chars):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = find_in_texts(batch.column(1).to_pylist(), sent.value, threshold, least)
                rows = [(ids[d], sent.value.ids[i], *rest) for d, i, *rest in found]
                columns = zip(*rows) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(columns)], [x.split()[0] for x in SCHEMA.split(", ")])

        out = out.unionByName(texts.mapInArrow(run, SCHEMA))
    return out


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP, max_index_chars: int = MAX_INDEX_CHARS) -> DataFrame:
    """docs without the rows that hold a test item; all columns stay."""
    for index in _indexes(items, max_index_chars):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def clean(texts, sent=sent):
            found = find_in_texts(["" if t is None else t for t in texts], sent.value, threshold, least)
            kept = np.ones(len(texts), bool)
            kept[[f[0] for f in found]] = False
            return type(texts)(kept)

        docs = docs.where(clean("text"))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

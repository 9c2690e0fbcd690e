"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines within it.

Features of a whole text are counts of hashed byte 1-, 2- and 3-grams of its lower-cased letters, square-rooted and scaled to
length 1. The family is the best of one-versus-one machines between families; the language is the best
of one-versus-one machines between the languages of that family. A language outside FAMILIES is a
family of its own.

Machines are fitted to the `languages` most frequent languages at most.

Training reads text and language only of the rows it is given. It is fitted on a sample that the parameter
`per_language` bounds (expected rows for each language, drawn by a hash of id and text); the numbers of rows by
language, which set the sampling rates, are counted over all of them.

Nulls, edges: a text that is null or has no letter gets `und` and score 0; without training rows every text
does; rows without a language are not learned from; a null doc_id is in no fold (held_out false, not learned from); repeated rows
keep a row each; very long texts are read whole, into counts; of languages that win as many duels the surer stays, then the first by name; other columns
than text, lang and doc_id are not read, so none can clash; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import documents

#: Language families by language code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
DIMS, PER_LANGUAGE, LANGUAGES, EPOCHS, PENALTY = 4096, 400, 100, 30, 1e-4
FOLDS, HELD_OUT = 5, 0
LETTER = re.compile(r"[^\W\d_]")
_FOLD_CASE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Square-rooted, length-1 counts of the byte n-grams of the lower-cased text, other bytes than letters being spaces."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD_CASE), np.uint8).astype(np.uint32)
    raw = np.concatenate([[32], raw, [32]]).astype(np.uint32)
    pairs = raw[:-1] * np.uint32(257) + raw[1:]
    triples = pairs[:-1] * np.uint32(263) + raw[2:] + np.uint32(1 << 20)
    grams = np.concatenate([raw, pairs, triples]) * np.uint32(2654435761)
    counts = np.bincount(grams >> np.uint32(20), minlength=DIMS).astype(np.float32)
    out = np.sqrt(counts)
    return out / np.linalg.norm(out)


def fit_machine(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, penalty: float = PENALTY) -> np.ndarray:
    """Weights, bias last, of a linear support vector machine for y in -1, 1: dual coordinate descent on the hinge loss."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    upper, norms = 1.0 / (penalty * len(x)), (x * x).sum(1)
    alpha, w, order = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), upper)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


@dataclass
class Node:
    """One-versus-one machines between the classes: weights has a row for each pair."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    scale: float = 4.0

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> Node:
        classes = sorted(set(labels))
        node, index = cls(classes), np.array([classes.index(c) for c in labels])
        for a, b in itertools.combinations(range(len(classes)), 2):
            rows = (index == a) | (index == b)
            node.pairs.append((a, b))
            w = fit_machine(x[rows], np.where(index[rows] == a, 1.0, -1.0))
            node.weights = w[None] if node.weights is None else np.vstack([node.weights, w])
        return node

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The class with the most duels won, ties by summed confidence; the mean confidence of its duels."""
        if not self.pairs:
            return self.classes[0], 1.0
        sure = 1 / (1 + np.exp(-self.scale * (self.weights[:, :-1] @ x + self.weights[:, -1])))
        won, total = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        for (a, b), p in zip(self.pairs, sure):
            won[a if p >= 0.5 else b] += 1
            total[a] += p
            total[b] += 1 - p
        best = max(range(len(self.classes)), key=lambda k: (won[k], total[k]))
        return self.classes[best], float(total[best] / (len(self.classes) - 1))


@dataclass
class Model:
    families: Node | None
    languages: dict[str, Node]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or self.families is None or not LETTER.search(text):
            return "und", 0.0
        x = features(text)
        family, p = self.families.predict(x)
        language, q = self.languages[family].predict(x)
        return language, p * q


def fit(training: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """A model of the languages in training (doc_id, text, lang), from about per_language rows of each of the most frequent ones."""
    rows = training.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    rate = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per_language / n))]) if counts else None
    if rate is None:
        return Model(None, {})
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, features(text).tobytes()) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if LETTER.search(text)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.binary()))], ["lang", "x"])

    sample = rows.where(draw < F.element_at(rate, F.col("lang"))).select("text", "lang").mapInArrow(run, "lang string, x binary").collect()
    if not sample:
        return Model(None, {})
    sample.sort(key=lambda r: (r["lang"], r["x"]))
    x, langs = np.stack([np.frombuffer(r["x"], np.float32) for r in sample]), [r["lang"] for r in sample]
    families = [_FAMILY.get(c, c) for c in langs]
    within = {f: Node.fit(x[[g == f for g in families]], [c for c, g in zip(langs, families) if g == f]) for f in set(families)}
    return Model(Node.fit(x, families), within)


def with_fold(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang")).withColumn("held_out", held_out)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
            )

    return with_fold(docs).select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def fit_on_folds(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fitted on the rows outside the held-out fold."""
    return fit(with_fold(docs).where("NOT held_out AND doc_id IS NOT NULL"), per_language)


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.0) -> DataFrame:
    """The rows of docs whose language is told with more than min_score; all columns stay."""

    @F.pandas_udf("boolean")
    def told(texts):
        return texts.map(lambda t: model.predict(t)[1] > min_score)

    return docs.where(told("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit_on_folds(docs))

"""Secret scanning: fixed patterns, and a guess-cost model for values in credential context.

A value that follows a credential word and a separator is scored by the fewest guesses that would reach it:
dynamic programming over its characters finds the cheapest segmentation into common words, dates, repeats,
keyboard walks and brute-force spans; the cost of a segmentation is the product of its parts' guesses times the
factorial of their number. Words are ranked: first those that attackers try first, then the corpus's own most frequent words, counted over all documents
(`learn_words`, `size` of them at most). Repeats have any period (one over 40 is beyond the ceiling by its length alone); repeats and keyboard walks are taken to their end.
Values that take at least `min_log10` guesses are reported as `guess` spans, beside
the fixed patterns' own spans, which always stay; only one that lies within an `assign` span is not told again. A low score on a fixed pattern's value is told in `weak`, not
used to drop it.

Nulls, edges: a null or empty text has no spans; a null doc_id stays null; repeated rows keep a row each; an
empty table gives no rows. Values are scored whole, whatever their length; costs are told up to CEILING. Words of equal count rank in
alphabetical order; segmentations of equal cost give that cost; of overlapping matches of one kind the leftmost stays; other columns are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import documents, id_text, stored


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


KINDS = ("assign", "access", "hex", "guess", "guess")  # the last: one that overlaps an assign span and reaches beyond it
ASSIGN = re.compile("(?:" + _either_case("password|passwd|secret|token|api_?key") + ")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")  # a shorter run fails whole, as its later starts would
HEX = re.compile("[0-9a-f]{24,}")  # likewise: runs are maximal
#: Wider credential context than the fixed patterns: more words, any value without white space or quotes.
CONTEXT = re.compile(
    "(?<![A-Za-z])(?:" + _either_case("password|passwd|passphrase|pwd|pass|secret|token|api[_-]?key|credential|private_?key|client_?secret|auth_?key")
    + ")[\"']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*[\"']?([^\\s\"'<>|,;]{6,})"
)
MIN_VALUE, MIN_LOG10 = 6, 10.0
CEILING = 64.0  # costs are told up to this one: no guesser comes near
WORDS, SHORTEST, LONGEST = 20_000, 4, 24  # how many of the corpus's words are ranked, and their lengths
UNITS = range(1, 41)  # periods of repeats: the unit of a longer one alone takes guesses beyond the ceiling

#: Words that attackers try first, most likely first.
COMMON_WORDS = (
    "password pass word admin login user guest root test demo secret token key access master change changeme "
    "welcome letmein hello monkey dragon sunshine princess shadow football baseball superman batman qwerty "
    "love iloveyou summer winter spring autumn server default system example sample temp public private "
    "database oracle mysql postgres redis docker cloud service account owner my the your new old"
).split()
#: A keyboard's rows, plain and shifted; each row stands half a key to the right of the one above.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ("!@#$%^&*()_+", "QWERTYUIOP{}", "ASDFGHJKL:\"", "ZXCVBNM<>?")
#: Months as dates name them, in the four languages.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec mai okt dez ene abr ago dic fev avr juin juil aout".split()
#: Letters that other characters stand for.
LEET = str.maketrans("@4310$57!", "aaeiosst" + "i")

_RANK = {w: k + 1 for k, w in enumerate(COMMON_WORDS)}
_PLACE = {c: (r, k) for rows in (ROWS, SHIFTED) for r, row in enumerate(rows) for k, c in enumerate(row)}
_TURN = {(0, 1): 0, (0, -1): 1, (1, 0): 2, (1, -1): 3, (-1, 0): 4, (-1, 1): 5}  # a step's direction: along a row, or to a key that touches in the next
_YEAR, _DAY, _MONTH = "(?:19|20)[0-9]{2}", "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])"
#: Dates by form and log10 of how many there are: a year, month and day in any order with years of two or four digits, a named month with day or year.
_DATES = [
    (re.compile(_YEAR), 2.0),
    *((re.compile(f"{a}[-/.]?{b}[-/.]?{c}"), math.log10(365 * 100)) for y in (_YEAR, "[0-9]{2}") for a, b, c in ((y, _MONTH, _DAY), (_DAY, _MONTH, y), (_MONTH, _DAY, y))),
    *((re.compile(f"{_DAY}?[-/.]?(?:{'|'.join(MONTHS)})[a-z]{{0,6}}?[-/.]?{y}", re.IGNORECASE), math.log10(365 * 100)) for y in (_YEAR, "[0-9]{2}")),
]
_LOG_FACTORIAL = np.array([x for k in range(200) if (x := math.lgamma(k + 1) / math.log(10)) < CEILING])  # more parts reach the ceiling by their order alone


def _alphabet(value: str) -> int:
    return max(10, 10 * any(c.isdigit() for c in value) + 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 33 * any(not c.isalnum() for c in value))


class _Parts:
    """The parts of a value that are cheaper than brute force may be, by where they start."""

    def __init__(self, value: str, ranks: dict[str, int]):
        self.value, self.n, self.ranks = value, len(value), ranks
        self.lower = value.lower() if value.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        self.plain = self.lower.translate(LEET)
        self.repeats = self._repeats(np.fromiter(map(ord, value), np.int32, self.n))
        self.walk_end, self.turns = self._walks()

    def _repeats(self, codes: np.ndarray) -> dict[int, list[tuple[int, float]]]:
        out: dict[int, list[tuple[int, float]]] = {}
        for unit in UNITS:
            m = self.n - unit  # places compared with the one a unit later
            if m < unit:
                break
            apart = codes[unit:] != codes[:-unit]
            if apart.all():
                continue
            ends = np.minimum.accumulate(np.where(apart, np.arange(m), m)[::-1])[::-1]  # where the period that holds here ends
            copies = 1 + (ends - np.arange(m)) // unit
            for i in np.flatnonzero(copies * unit >= max(3, 2 * unit)).tolist():
                n = int(copies[i])
                out.setdefault(i, []).append((i + n * unit, math.log10(95) * unit * 0.8 + math.log10(n)))
        return out

    def _walks(self) -> tuple[list[int], list[int]]:
        """For each place the end of the walk that goes on from it, and how often walks have turned up to it."""
        steps = [_TURN.get((b[0] - a[0], b[1] - a[1])) if (a := _PLACE.get(x)) and (b := _PLACE.get(y)) else None for x, y in zip(self.value, self.value[1:])]
        ends, turns = [self.n] * self.n, [0] * (self.n + 1)
        for i in range(self.n - 2, -1, -1):
            ends[i] = i + 1 if steps[i] is None else ends[i + 1]
        for i in range(1, len(steps)):
            turns[i + 1] = turns[i] + (steps[i] != steps[i - 1])
        return ends, turns

    def at(self, i: int) -> Iterator[tuple[int, float]]:
        """(end, log10 guesses) of each part that starts at i."""
        n, lower, plain, value = self.n, self.lower, self.plain, self.value
        for j in range(i + 2, min(n, i + LONGEST) + 1):
            rank = self.ranks.get(plain[i:j])
            if rank:
                extra = (lower[i:j] != value[i:j]) + (plain[i:j] != lower[i:j])
                yield j, math.log10(rank * 2**extra + 1)
        for form, cost in _DATES:
            if found := form.match(value, i):
                yield found.end(), cost
        yield from self.repeats.get(i, ())
        end = self.walk_end[i]
        if end >= i + 3:
            yield end, math.log10(len(_PLACE) / 2 * (end - i)) + math.log10(5) * (self.turns[end - 1] - self.turns[i + 1])


def cheapest(value: str, ranks: dict[str, int] = _RANK) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes, CEILING if it is that or more.

    best[k]: the least cost of the characters so far in k parts; brute[k]: of those, where the last part is brute
    force, which is one part whatever its length. More characters or parts never cost less, so that places where all is at the
    ceiling lead nowhere, and the walk along the value ends when no part reaches beyond them.
    """
    n = len(value)
    if not n:
        return 0.0
    parts, step = _Parts(value, ranks), math.log10(_alphabet(value))
    none = np.full(len(_LOG_FACTORIAL), np.inf)
    best, brute = none.copy(), none
    best[0] = 0.0
    ahead: dict[int, np.ndarray] = {}  # by where they end, costs of segmentations whose last part is not brute force
    for i in range(n):
        if (best + _LOG_FACTORIAL).min() >= CEILING:
            if not ahead:
                return CEILING
            best = brute = none
        else:
            longer = np.append(np.inf, best[:-1])
            for j, cost in parts.at(i):
                ahead[j] = np.minimum(ahead.get(j, none), longer + cost)
            brute = np.minimum(brute, longer) + step
            best = brute
        best = np.minimum(best, ahead.pop(i + 1, none))
    return min(CEILING, float((best + _LOG_FACTORIAL).min()))


class Guesser:
    """cheapest() with the ranks of words learned from a corpus, after those of COMMON_WORDS; short values' costs are remembered."""

    def __init__(self, words: list[str] | tuple[str, ...] = ()):
        self.ranks = dict(_RANK)
        for w in words:
            self.ranks.setdefault(w.translate(LEET), len(self.ranks) + 1)
        self.known: dict[str, float] = {}

    def __call__(self, value: str) -> float:
        found = self.known.get(value)
        if found is None:
            found = cheapest(value, self.ranks)
            if len(value) <= 128 and len(self.known) < 65_536:
                self.known[value] = found
        return found


guess_cost = Guesser()


def learn_words(docs: DataFrame, size: int = WORDS) -> list[str]:
    """The most frequent words of SHORTEST to LONGEST letters a to z over all documents, down to the count at which there are `size` of them at most.

    That count follows from how many words have each count; the driver gets a row for each of the highest counts, then the words.
    """
    words = id_text(docs).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w").between(SHORTEST, LONGEST))
    counts = stored(words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1"), "secret-words")
    least, taken = None, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).limit(size).collect():
        taken += r["c"]
        if taken > size:
            break
        least = r["n"]
    found = counts.where(F.col("n") >= least).collect() if least else []
    return [r["w"] for r in sorted(found, key=lambda r: (-r["n"], r["w"]))]


def scan(text: str, min_log10: float = MIN_LOG10, cost_of: Guesser = guess_cost) -> tuple[list[tuple[int, int, int]], float | None, int]:
    """((kind number, start, end) of every span, the hardest value's log10 guesses, weak values)."""
    spans, hardest, weak = [], None, 0
    taken = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= MIN_VALUE:
                spans.append((0, m.start(), m.end()))
                taken.append(m.span())
                cost = cost_of(m[1])
                hardest, weak = max(hardest or 0.0, cost), weak + (cost < min_log10)
    if "AKIA" in text:
        spans += [(1, *m.span()) for m in ACCESS.finditer(text)]
    spans += [(2, *m.span()) for m in HEX.finditer(text)]
    if ":" in text or "=" in text:
        for m in CONTEXT.finditer(text):
            cost = cost_of(m[1])
            hardest = max(hardest or 0.0, cost)
            k = bisect_right(taken, m.start(), key=lambda x: x[1])  # the first that ends beyond this one's start
            if cost >= min_log10:
                if k == len(taken) or taken[k][0] >= m.end():
                    spans.append((3, *m.span()))
                elif m.start() < taken[k][0] or taken[k][1] < m.end():
                    spans.append((4, *m.span()))
    return spans, hardest, weak


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, hardest_log10 double, n_weak long"


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, min_log10: float = MIN_LOG10, words: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """A row for each document, of SCHEMA. Spans are kind:start:end in code points, by start, then kind. words: ranked ones, as of learn_words."""
    cost_of = Guesser(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                spans, hardest, weak = scan(text.as_py(), min_log10, cost_of)
                spans.sort(key=lambda s: (s[1], s[0]))
                base = [s for s in spans if s[0] < 3]
                counts = [sum(s[0] == k for s in spans) for k in range(5)]
                rows.append((doc_id, *counts[:3], hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans), counts[3] + counts[4], hardest, weak))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return id_text(docs).mapInArrow(run, SCHEMA)


def redacted(text: str, min_log10: float = MIN_LOG10, mark: str = "[SECRET]", cost_of: Guesser = guess_cost) -> str:
    """The text with every span, joined where they overlap, replaced by mark."""
    spans, _, _ = scan(text, min_log10, cost_of)
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, min_log10: float = MIN_LOG10, words: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """docs with secrets in text replaced, and n_chars, if there is such a column, counted anew. A null text stays null."""
    cost_of = Guesser(words)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: None if t is None else redacted(t, min_log10, cost_of=cost_of))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find_secrets(docs, words=learn_words(docs))

"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Candidates are the fixed patterns' raw matches, whether or not they pass their check, and looser shapes: `ssn`; `local`, a phone number
without a plus; `obfuscated`, a mail address in words; `iban`; `ipv6`; `birth`, a date; `name`, by title or first name. Five labelers vote
yes, no or abstain on each: the fixed check (a check sum, a valid address or date), the shape, a gazetteer, the words before it and the characters beside it.

One pass over the texts stores each document's candidates with their votes and features. Votes are counted over all documents by kind and
pattern, at most KINDS x 3 ** labelers rows; on these counts expectation-maximisation estimates each labeler's reliability, for each kind with
the pooled one as prior, and each pattern's probability. A logistic span classifier over kind, votes and the span's own features (length, digits, capitals, signs, neighbours, the word before) is fitted to those
probabilities on a sample of about `sample` candidates. What passes a fixed pattern's check
stays whatever the classifier says; other candidates are added at `threshold` and above.

Nulls, edges: a null or empty text has no spans; a null doc_id stays null; repeated rows keep a row each; very long texts are
read whole, in time linear in them; of added spans that overlap the first by start, then by kind, stays (ties: by end); other columns are not read, so none
can clash; an empty table gives no rows; without any candidate the classifier adds nothing.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import documents, id_text, stored

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "local", "obfuscated", "iban", "ipv6", "birth", "name")
LABELERS = ("check", "shape", "gazetteer", "context", "edges")
YES, NO, ABSTAIN = 1, 0, 2
CONTEXT_CHARS, THRESHOLD, ROUNDS, SAMPLE, POOLED = 40, 0.9, 200, 20_000, 10.0

_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")  # a run of digits that fails does so from any of its places
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")
_OBFUSCATED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:\x20?[\[({]at[\])}]\x20?|\x20at\x20)[A-Za-z0-9-]+(?:(?:\x20?[\[({]dot[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]+)+", re.IGNORECASE)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![0-9A-Fa-f:.])")
_DATE = re.compile(r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9/-])")

#: Titles and frequent first names of the four languages.
_TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Mme Mlle Monsieur Madame Sr Sra Señor Señora Don Doña".split()
_FIRST_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Thomas Sarah Charles Karen Daniel Emma "
    "Hans Peter Klaus Jürgen Stefan Andreas Ursula Monika Petra Sabine Lukas Anna Pierre Jean Michel Philippe Marie Nathalie Isabelle Sophie Camille Julien "
    "José Carlos Manuel Antonio Francisco Javier Carmen Ana Lucía María Pilar Miguel"
).split()
_NAME = re.compile(r"(?<!\w)(?:(?:" + "|".join(_TITLES) + r")\b\.?\x20[A-ZÀ-Þ][\w'-]+(?:\x20[A-ZÀ-Þ][\w'-]+)?|(?:" + "|".join(_FIRST_NAMES) + r")\x20[A-ZÀ-Þ][\w'-]+)")
_NAME_WORDS = frozenset([*_TITLES, *(f"{t}." for t in _TITLES), *_FIRST_NAMES])
#: Lengths of account numbers by country.
_IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}

#: Common top-level domains.
_TLDS = frozenset("com org net edu gov io co info biz de fr es it nl uk us ca au ch at be pt pl se no dk fi br mx jp in".split())
#: Telephone country codes of one and two digits, and of three by their first two.
_COUNTRIES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: Words before a span that speak for or against personal data.
_FOR = {
    "email": ("mail", "contact", "write to", "correo"), "ip": ("ip", "host", "client", "address", "from"), "card": ("card", "visa", "credit", "debit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "local": ("phone", "tel", "call", "mobile", "fax"), "ssn": ("ssn", "social security"),
    "obfuscated": ("mail", "contact", "write to", "correo", "reach"), "iban": ("iban", "account", "konto", "compte", "cuenta"), "ipv6": ("ip", "host", "client", "address", "from"),
    "birth": ("born", "birth", "dob", "geboren", "geburt", "né le", "née le", "naissance", "nacid", "nacimiento"), "name": ("name", "contact", "signed", "dear", "nom", "nombre", "patient", "customer"),
}
_AGAINST = ("version", "isbn", "invoice", "order no", "serial", "build", "part no", "release")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: around each @, the run before it and the dotted name after it."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_PART:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _digits(part: str) -> str:
    return "".join(c for c in part if c in "0123456789")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _passes(kind: str, part: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in part.split("."))
    if kind == "card":
        return 13 <= len(d := _digits(part)) <= 19 and _luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(part)) <= 15
    if kind == "iban":
        letters = part.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in letters[4:] + letters[:4])) % 97 == 1
    if kind == "ipv6":
        try:
            return bool(ipaddress.IPv6Address(part))
        except ValueError:
            return False
    return kind == "email"


def _date(part: str) -> datetime.date | None:
    a, b, c = map(int, re.split("[./-]", part))
    for year, month, day in ((a, b, c),) if a > 31 else ((c, b, a), (c, a, b)):
        try:
            return datetime.date(year, month, day)
        except ValueError:
            pass
    return None


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    for a, b in _emails(text):
        yield "email", a, b
    patterns = []
    if _DIGIT.search(text):
        patterns += [("ip", _IP), ("card", _CARD), *([("phone", _PHONE)] if "+" in text else []), ("ssn", _SSN), ("local", _LOCAL), ("iban", _IBAN), ("birth", _DATE)]
    if ":" in text and ("::" in text or text.count(":") > 6):
        patterns.append(("ipv6", _IPV6))
    if any(sign in text for sign in ("at]", "at)", "at}", "AT]", "AT)", " dot ", " DOT ")):
        patterns.append(("obfuscated", _OBFUSCATED))
    if not _NAME_WORDS.isdisjoint(text.split()):
        patterns.append(("name", _NAME))
    for kind, pattern in patterns:
        for m in pattern.finditer(text):
            if kind == "card" and m.end() - m.start() < 12:  # shorter runs of digits are plain numbers
                continue
            if kind == "ipv6" and (m[0].count(":") < 3 and "::" not in m[0] or len(m[0]) < 5):
                continue
            yield kind, m.start(), m.end()


def votes(kind: str, text: str, a: int, b: int) -> tuple[int, ...]:
    """The vote of each of LABELERS."""
    part, digits = text[a:b], _digits(text[a:b])
    check = (YES if _passes(kind, part) else NO) if kind in (*BASE_KINDS, "iban", "ipv6") else ABSTAIN
    if kind == "email":
        shape, known = (YES if part[0] not in ".-" and len(part) <= 254 else NO), part.rsplit(".", 1)[1].lower() in _TLDS
    elif kind == "obfuscated":
        words = re.split(r"[^A-Za-z0-9-]+", part.strip())
        shape, known = (YES if len(part) <= 254 and ("at]" in part.lower() or "at)" in part.lower() or " dot " in part.lower()) else NO), words[-1].lower() in _TLDS
    elif kind == "ip":
        octets = [p.lstrip("0") or "0" for p in part.split(".")]
        shape, known = (YES if all(len(p) <= 3 for p in octets) and max(map(len, octets)) > 1 else NO), octets[0].isdigit() and len(octets[0]) <= 3 and 1 <= int(octets[0]) <= 223
    elif kind == "ipv6":
        shape, known = (YES if part.count(":") == 7 or part.count("::") == 1 else NO), part[:1] in "23fF"
    elif kind == "iban":
        letters = part.replace(" ", "")
        shape, known = (YES if 15 <= len(letters) <= 34 else NO), _IBAN_LENGTH.get(letters[:2]) == len(letters)
    elif kind == "birth":
        when = _date(part)  # that it is one is no sign of a birth
        shape, known = (ABSTAIN if when else NO), None if when and 1900 <= when.year <= 2020 else False
    elif kind == "name":
        words = [w for w in part.split() if w.strip(".") not in _TITLES]
        shape, known = (YES if words and all(w[1:].islower() for w in words) else NO), True if any(w in _FIRST_NAMES for w in words) else None
    elif kind == "card":
        shape, known = (YES if len(digits) in (13, 14, 15, 16, 19) else NO), digits[:1] in "3456" and digits[:1] != ""
    elif kind == "ssn":
        shape, known = (YES if digits[3:5] != "00" and digits[5:] != "0000" else NO), digits[:3] not in ("000", "666") and digits[0] != "9"
    else:
        shape, known = (YES if 10 <= len(digits) <= 15 else NO), digits[:1] in _COUNTRIES or digits[:2] in _COUNTRIES if kind == "phone" else digits[0] not in "01"
    before = text[max(0, a - CONTEXT_CHARS) : a].lower()
    context = YES if any(w in before for w in _FOR[kind]) else NO if any(w in before for w in _AGAINST) or kind in ("birth", "name") else ABSTAIN
    beside = text[a - 1 : a].isalnum() + text[b : b + 1].isalnum()
    return check, shape, ABSTAIN if known is None else YES if known else NO, context, NO if beside else YES


HASHED = 16


def features(text: str, a: int, b: int) -> list[float]:
    """What the span and its surroundings look like, for the classifier: none of it is a vote."""
    part, n = text[a:b], b - a
    before = text[max(0, a - CONTEXT_CHARS) : a].split()
    word = [0.0] * HASHED
    if before:
        word[zlib.crc32(before[-1].lower().strip(".:,;()").encode("utf-8", "surrogatepass")) % HASHED] = 1.0
    digits, capitals = sum(c.isdigit() for c in part), sum(c.isupper() for c in part)
    signs = n - sum(c.isalnum() or c == " " for c in part)
    beside = [float(f(c)) for c in (text[a - 1 : a], text[b : b + 1]) for f in (str.isspace, str.isalpha, lambda c: c in "\"'([<>])")]
    return [min(n, 60) / 60, digits / n, capitals / n, signs / n, part.count(" ") / n, float(part[-1].isdigit()), *beside, *word]


N_FEATURES = 12 + HASHED


Ballot = tuple[str, tuple[int, ...]]


@dataclass
class Model:
    """reliability: by kind and labeler, P(vote | not personal) and P(vote | personal); weights: the classifier's, bias last."""

    reliability: dict[tuple[str, str], np.ndarray]
    weights: np.ndarray | None

    @staticmethod
    def inputs(kind: str, ballot: tuple[int, ...], x: list[float] | None = None) -> np.ndarray:
        out = np.zeros(len(KINDS) + 2 * len(LABELERS) + N_FEATURES + 1)
        out[KINDS.index(kind)] = out[-1] = 1
        for k, v in enumerate(ballot):
            if v != ABSTAIN:
                out[len(KINDS) + 2 * k + v] = 1
        if x is not None:
            out[-1 - N_FEATURES : -1] = x
        return out

    def probability(self, kind: str, ballot: tuple[int, ...], x: list[float] | None = None) -> float:
        return 0.0 if self.weights is None else float(1 / (1 + np.exp(-np.clip(self.inputs(kind, ballot, x) @ self.weights, -30, 30))))


def maximise(counts: dict[Ballot, int], rounds: int = ROUNDS) -> tuple[dict[Ballot, float], dict[tuple[str, str], np.ndarray]]:
    """(the probability of each kind and ballot, reliabilities), from the number of candidates by kind and ballot."""
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    kind = np.array([KINDS.index(k) for k, _ in keys])
    ballots = np.array([b for _, b in keys])
    yes, no = (ballots == YES).sum(1), (ballots == NO).sum(1)
    p = np.clip((yes + 0.5) / (yes + no + 1), 0.05, 0.95)  # the majority to begin with: "personal" stays the side that more labelers mean by yes
    table = np.empty((len(KINDS), len(LABELERS), 2, 3))
    for _ in range(rounds):
        prior = np.array([(1 + (n * p)[kind == k].sum()) / (2 + n[kind == k].sum()) for k in range(len(KINDS))])
        for j in range(len(LABELERS)):
            for c, w in enumerate((n * (1 - p), n * p)):
                votes_of = lambda rows: np.array([w[rows & (ballots[:, j] == v)].sum() for v in (NO, YES, ABSTAIN)])  # noqa: E731, B023
                pooled = votes_of(kind >= 0) + 1 + np.eye(3)[c]  # starts from one vote of each sort, two of the right one
                for k in range(len(KINDS)):
                    got = votes_of(kind == k) + POOLED * pooled / pooled.sum()
                    table[k, j, c] = got / got.sum()
        score = np.log(prior[kind]) - np.log1p(-prior[kind])
        for j in range(len(LABELERS)):
            score += np.where(ballots[:, j] == ABSTAIN, 0.0, np.log(table[kind, j, 1, ballots[:, j]] / table[kind, j, 0, ballots[:, j]]))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        done = np.abs(new - p).max() < 1e-6
        p = new
        if done:
            break
    return dict(zip(keys, p.tolist())), {(k, name): table[i, j] for i, k in enumerate(KINDS) for j, name in enumerate(LABELERS)}


def fit(counts: dict[Ballot, int], sample: list[tuple[str, tuple[int, ...], list[float]]] | None = None) -> Model:
    """counts: all candidates by kind and ballot; sample: some of them with their features (without any, the counts stand for them)."""
    if not counts:
        return Model({}, None)
    p, reliability = maximise(counts)
    rows = sorted(sample) if sample else []
    # every ballot there is takes part, if only with the weight of its count among as many as the sample has
    x = np.stack([*(Model.inputs(*r) for r in rows), *(Model.inputs(k, b) for k, b in sorted(counts))])
    y = np.array([*(p[r[0], r[1]] for r in rows), *(p[k] for k in sorted(counts))])
    alone = np.array([counts[k] for k in sorted(counts)], float)
    share = np.concatenate([np.full(len(rows), 1.0), alone / alone.sum()])
    share /= share.sum()
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method on the weighted cross-entropy with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (q - y)) + 1e-3 * w
        hessian = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(reliability, w)


_SPANS = "doc_id long, found array<struct<kind: int, a: int, b: int, base: boolean, ballot: int, x: array<float>>>"


def mark(docs: DataFrame) -> DataFrame:
    """Each document's candidates (_SPANS), written once; ballot has a digit to base 3 for each labeler."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("base", pa.bool_()), ("ballot", pa.int32()), ("x", pa.list_(pa.float32()))])
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text, found = text.as_py(), []
                for kind, a, b in candidates(text):
                    base = kind in BASE_KINDS and _passes(kind, text[a:b])
                    found.append((KINDS.index(kind), a, b, base, int("".join(map(str, votes(kind, text, a, b))), 3), features(text, a, b)))
                rows.append([dict(zip(("kind", "a", "b", "base", "ballot", "x"), f)) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], ["doc_id", "found"])

    return stored(id_text(docs).mapInArrow(run, _SPANS), "personal-candidates")


def _ballot(code: int) -> tuple[int, ...]:
    return tuple(code // 3**k % 3 for k in reversed(range(len(LABELERS))))


def learn(marked: DataFrame, sample: int = SAMPLE) -> Model:
    """From all candidates of marked; the driver gets their counts by kind and ballot, and about `sample` of them with features."""
    spans = marked.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.kind", "f.a", "f.ballot", "f.x")
    counts = {(KINDS[r["kind"]], _ballot(r["ballot"])): r["n"] for r in spans.groupBy("kind", "ballot").agg(F.count("*").alias("n")).collect()}
    rate = min(1.0, sample / max(1, sum(counts.values())))
    drawn = spans.where(F.pmod(F.xxhash64("doc_id", "kind", "a"), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))).select("kind", "ballot", "x")
    return fit(counts, [(KINDS[r["kind"]], _ballot(r["ballot"]), list(r["x"])) for r in drawn.collect()])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def chosen(found: list[dict], model: Model, threshold: float = THRESHOLD) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans), each (kind number, start, end), of a document's candidates."""
    base = [(f["kind"], f["a"], f["b"]) for f in found if f["base"]]
    likely = [(f["kind"], f["a"], f["b"]) for f in found if not f["base"] and model.probability(KINDS[f["kind"]], _ballot(f["ballot"]), f["x"]) >= threshold]
    # base spans by start, each with the furthest end so far: an added span overlaps one if the last that starts before its end reaches it
    starts = sorted((a, b) for _, a, b in base)
    ends = list(accumulate((b for _, b in starts), max))
    added, free = [], 0
    for kind, a, b in sorted(likely, key=lambda s: (s[1], s[0], s[2])):
        k = bisect_left(starts, (b,))
        if a >= free and (not k or ends[k - 1] <= a):
            added.append((kind, a, b))
            free = b
    return base, added


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal(marked: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document of mark(docs), of SCHEMA. Spans are kind:start:end in code points, by kind, then start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                base, added = chosen(found.as_py(), model, threshold)
                counts = [sum(s[0] == k for s in base) for k in range(len(BASE_KINDS))]
                rows.append((doc_id, *counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + added), len(added), len(base) + len(added)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return marked.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(documents(spark, sf_dir))
    return find_personal(marked, learn(marked))

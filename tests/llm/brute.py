"""Plain versions of the operators, for small tables: as the contracts word them, one document or one pair at a time."""

import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

from lodestack.llm import secrets

SECRET_KINDS = ("assign", "access", "hex")


def either(word):
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + either("password|passwd|secret|token|api_?key") + ")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_secrets(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], SECRET_KINDS.index(s[0])))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


KEYS = {}
for rows in (("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"), ("!@#$%^&*()_+", "QWERTYUIOP{}", "ASDFGHJKL:\"", "ZXCVBNM<>?")):
    KEYS |= {c: (2 * k + r, r) for r, row in enumerate(rows) for k, c in enumerate(row)}  # in half keys


def step(a, b):
    """How one goes from key a to a key b that touches it, in half keys and rows."""
    if a in KEYS and b in KEYS:
        x, y = KEYS[b][0] - KEYS[a][0], KEYS[b][1] - KEYS[a][1]
        if (abs(x), abs(y)) in ((2, 0), (1, 1)):
            return x, y
    return None


def guess_cost(value):
    """log10 guesses of the cheapest of all segmentations of a short value, by number of parts."""
    lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain, n = lower.translate(secrets.LEET), len(value)
    pool = 10 * any(map(str.isdigit, value)) + 26 * any(map(str.islower, value)) + 26 * any(map(str.isupper, value)) + 33 * (not all(map(str.isalnum, value)))

    def part(i, j):
        size, costs = j - i, [(j - i) * math.log10(max(10, pool))]
        if plain[i:j] in secrets.COMMON_WORDS:
            rank = secrets.COMMON_WORDS.index(plain[i:j]) + 1
            costs.append(math.log10(rank * 2 ** ((lower[i:j] != value[i:j]) + (plain[i:j] != lower[i:j])) + 1))
        costs += [cost for form, cost in secrets._DATES if (found := form.match(value, i)) and found.end() == j]
        for unit in range(1, size // 2 + 1):
            whole = size // unit
            if size % unit == 0 and size >= 3 and value[i : i + unit] * whole == value[i:j] and not value.startswith(value[i : i + unit], j):
                costs.append(math.log10(95) * unit * 0.8 + math.log10(whole))
        ways = [step(a, b) for a, b in zip(value[i:j], value[i + 1 : j])]
        if size >= 3 and None not in ways and (j == n or step(value[j - 1], value[j]) is None):
            costs.append(math.log10(45 * size) + math.log10(5) * sum(a != b for a, b in zip(ways, ways[1:])))
        return min(costs)

    best = [{0: 0.0}]
    for j in range(1, n + 1):
        now = {}
        for i in range(j):
            cost = part(i, j)
            for k, c in best[i].items():
                now[k + 1] = min(now.get(k + 1, math.inf), c + cost)
        best.append(now)
    return min(c + math.log10(math.factorial(k)) for k, c in best[n].items())


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_personal(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def simhash(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(fps):
    """The least id of each row's component, by trying all pairs of distinct fingerprints. fps: {id: fingerprint}"""
    distinct = sorted(set(fps.values()))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            parent[f] = parent[parent[f]]
            f = parent[f]
        return f

    array = np.array(distinct, np.uint64)
    for k, f in enumerate(distinct):
        for other in array[k + 1 :][np.bitwise_count(array[k + 1 :] ^ np.uint64(f)) <= 2].tolist():
            parent[root(f)] = root(other)
    least = {}
    for i, f in fps.items():
        least[root(f)] = min(least.get(root(f), i), i)
    return {i: least[root(f)] for i, f in fps.items()}


def repeats(texts, size=400, keep="none"):
    """(bytes, removed, runs, sha256 of the rest) for each text, by counting every string of `size` bytes."""
    raws, where = [t.encode() for t in texts], {}
    for d, raw in enumerate(raws):
        for s in range(len(raw) - size + 1):
            where.setdefault(raw[s : s + size], []).append((d, s))
    gone = [np.zeros(len(raw) + 1, bool) for raw in raws]
    for places in where.values():
        if len(places) > 1:
            for d, s in places[keep == "first" :]:
                gone[d][s : s + size] = True
    out = []
    for raw, g in zip(raws, gone):
        g = g[: len(raw)]
        rest = np.frombuffer(raw, np.uint8)[~g].tobytes()
        runs = int(np.diff(np.concatenate([[0], g.astype(int)])).clip(0).sum())
        out.append((len(raw), int(g.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def passages(texts, size=50):
    """Runs of words covered by strings of `size` words that are in another text too, for each text."""
    words, where = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts], {}
    for d, w in enumerate(words):
        for k in range(len(w) - size + 1):
            where.setdefault(tuple(w[k : k + size]), []).append((d, k))
    gone = [np.zeros(len(w), bool) for w in words]
    for places in where.values():
        if len({d for d, _ in places}) > 1:
            for d, k in places:
                gone[d][k : k + size] = True
    return [int(np.diff(np.concatenate([[0], g.astype(int)])).clip(0).sum()) for g in gone]


def ids_crc32(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())

"""SimHash, components, repeats and leaks against plain versions."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from conftest import ITEMS, edge_texts, prose

from lodestack.llm import decontaminate, simhash, suffix
from lodestack.llm.components import connected

TEXTS = [t or "" for t in edge_texts()]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint(t) == brute.simhash(t)


@pytest.mark.parametrize("bucket", [64, 2])
def test_components_of_fingerprints(spark, bucket):
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(60)]
    for f in list(fps[:30]):
        for _ in range(4):  # chains and balls around some, at one to three bits
            f ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 3)))
            fps.append(f)
    crowd = r.getrandbits(64)
    fps += [crowd ^ (1 << b) for b in range(12)] + [0, 1, 3]
    table = dict(enumerate(dict.fromkeys(fps)))
    signed = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in table.items()], "doc_id long, fp long")
    found = {x.node: x.component for x in connected(simhash.links(signed, bucket=bucket)).collect()}
    want = brute.simhash_components(table)
    groups = {}
    for i, f in table.items():
        s = f - (1 << 64) if f >> 63 else f
        groups.setdefault(want[i], set()).add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_pigeonhole_plan_is_sound():
    rng = np.random.default_rng(1)
    bits = (rng.random((500, 64)) < 0.5).astype(float)
    for n in (10, 10**5, 10**12):
        p = simhash.plan(n, (bits.T @ bits) / 500 * n)
        assert sum(t + 1 for t in p.thresholds) == simhash.DISTANCE + 1
        assert sorted(b for g in p.groups for b in g) == list(range(64))
    masks = p.masks()
    for _ in range(300):  # any two at the distance meet under some mask
        a = int(rng.integers(0, 1 << 63))
        b = a ^ sum(1 << int(k) for k in rng.choice(64, 2, replace=False))
        assert any(a & m == b & m for m in masks)


def test_components_of_a_long_chain(spark):
    n = 200
    chain = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(500, 500), (700, 600)], "a long, b long")
    got = {r.node: r.component for r in connected(chain).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, 600: 600, 700: 600}


def test_near_duplicates(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, TEXTS)).collect()}
    want = brute.simhash_components({i: brute.simhash(t) for i, t in enumerate(TEXTS)})
    assert {i: r.component_id for i, r in got.items()} == want


def test_one_of_each_stays(spark):
    base = [prose(50 + k, 250) for k in range(12)]
    near = [t.replace(t.split()[100], "changed", 1) for t in base[:6]]
    rows = [(k, t, "x") for k, t in enumerate(base + near + base[:3])]
    rows += [rows[0], (None, base[11], "x"), (90, None, "x"), (91, "", "x")]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, w0 string"))
    assert kept.columns == ["doc_id", "text", "w0"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*range(11), None, 90], key=str)  # the null id comes first


def test_similarity_is_exact(spark):
    words = prose(90, 3000).split()[:400]

    def changed(n):  # n words apart, each of which changes five shingles of 396
        out = list(words)
        for k in range(n):
            out[10 + 20 * k] += "z"
        return " ".join(out)

    junk = " ".join(["spam"] * 40)
    texts = [" ".join(words), changed(8), changed(9), junk, junk + " " + " ".join(prose(91, 60).split()[:12])]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    alike = [len(sets[0] & x) / len(sets[0] | x) for x in sets[1:3]]
    assert alike[0] > 0.8 > alike[1]
    kept = simhash.keep_one_of_each(docs(spark, [texts[0], *texts[2:]]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3]  # alike fingerprints, but not texts
    kept = simhash.keep_one_of_each(docs(spark, texts[:2]))
    assert [r.doc_id for r in kept.collect()] == [0]


def test_repeated_lines_do_not_hide_copies(spark):
    body, line = prose(92, 300), "\n" + " ".join(prose(93, 60).split()[:12])
    texts = [body + line * 40, body + line * 2]
    assert simhash.shingle_set(texts[0], 5) == simhash.shingle_set(texts[1], 5)
    assert [r.doc_id for r in simhash.keep_one_of_each(docs(spark, texts)).collect()] == [0]


def test_all_copies_of_a_hub_are_found(spark):
    r, words = random.Random(12), prose(94, 3000).split()[:400]

    def edited(n, places):  # n words changed, each in five shingles of 396
        out = list(words)
        for k in r.sample(places, n):
            out[k] = f"{out[k]}{r.getrandbits(40)}"
        return " ".join(out)

    texts = [edited(8, range(5, 395, 6)) for _ in range(2000)]
    texts.insert(1234, " ".join(words))
    chain = prose(95, 3000).split()[:400]  # each is near the one before, and not the others
    for k in range(30):
        chain[8 * k : 8 * k + 8] = [f"{w}q" for w in chain[8 * k : 8 * k + 8]]
        chain[330 + k] += "q"
        texts.append(" ".join(chain))
    sets = [simhash.shingle_set(t, 5) for t in texts]
    alike = [[len(x & y) / len(x | y) for y in sets[k + 1 :: 97]] for k, x in enumerate(sets[:40])]
    assert all(len(x & sets[1234]) / len(x | sets[1234]) >= 0.8 for x in sets[:2001]) and max(map(max, alike[:1])) < 0.8
    assert all(len(x & y) / len(x | y) >= 0.8 for x, y in zip(sets[2001:], sets[2002:])) and len(sets[2001] & sets[-1]) / len(sets[2001] | sets[-1]) < 0.8
    kept = sorted(x.doc_id for x in simhash.keep_one_of_each(docs(spark, texts)).collect())
    assert kept == [0, 2001]


def test_near_copies_come_by_the_pigeonhole_search(spark):
    base = [prose(900 + k, 600) for k in range(8)]
    near = [t.replace(t.split()[100], "changed", 1) for t in base]
    fps = [simhash.most_set(simhash.shingle_hashes(t, 5)) for t in base + near]
    alike = [k for k in range(8) if (fps[k] ^ fps[k + 8]).bit_count() <= simhash.DISTANCE]
    assert len(alike) >= 3
    rows = docs(spark, base + near + [base[0].upper()]).selectExpr("doc_id AS rid", "0L AS tie", "text")
    groups = simhash._groups(rows, 5)
    at = {r.id: r.first.rid for r in groups.select("id", "first").collect()}
    found = {tuple(sorted((at[r.a], at[r.b]))) for r in simhash.alike_pairs(groups).collect()}
    assert found >= {(k, k + 8) for k in alike} and all((fps[a] ^ fps[b]).bit_count() <= simhash.DISTANCE for a, b in found)


def near_components(texts):
    """The least text of each text's component, by trying all pairs."""
    sets, parent = [simhash.shingle_set(t, 5) for t in texts], list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, x in enumerate(sets):
        for j in range(k):
            if (both := len(x & sets[j])) >= 0.8 * (len(x) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((root(k), root(j)))
                parent[b] = a
    return [root(k) for k in range(len(texts))]


def test_a_large_group_of_edits_is_not_tried_pair_by_pair(spark, monkeypatch):
    r, words = random.Random(31), prose(96, 3000).split()[:150]

    def edited(words, n):
        out = list(words)
        for k in r.sample(range(len(out)), n):
            out[k] = f"{out[k]}{r.getrandbits(40)}" if r.random() < 0.7 else r.choice(words)
        return " ".join(out)

    texts = [edited(words, r.choice([1, 2, 3, 5, 7, 8])) for _ in range(500)]
    for size in (9, 12, 16):  # far from the rest, and near to one another
        far = edited(words, size).split()
        texts += [edited(far, r.choice([1, 2])) for _ in range(12)]
        texts += [" ".join(far[: 150 - cut]) for cut in (3, 20, 45)]
    texts += [" ".join(words[:-cut] if cut else words) for cut in range(0, 60, 3)]
    r.shuffle(texts)
    tried = []
    monkeypatch.setattr(simhash, "verified", lambda pairs, *a, f=simhash.verified: tried.append(pairs.count()) or f(pairs, *a))
    kept = sorted(x.doc_id for x in simhash.keep_one_of_each(docs(spark, texts)).collect())
    want = sorted(set(near_components(texts)))
    assert kept == want and len(want) > 50
    assert sum(tried) < 20 * len(texts), tried


def test_residual_pairs_miss_none(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 0)
    r = random.Random(8)
    hub = [f"h{k}" for k in range(40)]
    texts = [" ".join(hub)]
    for _ in range(400):  # of other lengths, cut, joined and edited, with few words to choose from
        t = hub[r.choice([0, 0, 3, 8]) : r.choice([40, 40, 36, 30])] + [f"t{k}" for k in range(r.choice([0, 0, 2, 5, 9]))]
        for _ in range(r.choice([0, 1, 2, 3])):
            t[r.randrange(len(t))] = f"e{r.randrange(3)}"
        texts.append(" ".join(t))
    texts = list(dict.fromkeys(texts))
    sets = [simhash.shingle_set(t, 5) for t in texts]
    mixed = spark.createDataFrame([(0, len(texts), 0, (k, len(s), None, k)) for k, s in enumerate(sets)], "s long, c long, main long, x struct<id: long, n: int, signs: string, component: long>")
    packed = spark.createDataFrame([(k, bytearray(zstandard.compress(t.encode()))) for k, t in enumerate(texts)], "id long, z binary")
    direct, found = simhash.residual_pairs(simhash.residuals(mixed, packed, 5), 0.8)
    links, pairs = ({(x.a, x.b) for x in df.collect()} for df in (direct, found))
    alike = {(a, b) for b in range(len(texts)) for a in range(b) if (n := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9}
    near = {b for a, b in alike if a == 0}
    assert links == {(0, b) for b in near}
    needed = {(a, b) for a, b in alike if a and not {a, b} <= near}
    assert needed <= pairs and len(needed) > 100


def test_near_copies_take_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, most = spark.conf.get(key), []

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    def seen(rows, *a, f=simhash._groups):
        most.append(rows.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0])
        return f(rows, *a)

    monkeypatch.setattr(simhash, "_groups", seen)
    texts = [" ".join([f"w{k}"] * 100_000) for k in range(40)]
    rows = docs(spark, texts).repartition(1)
    assert simhash.keep_one_of_each(rows).count() == 40
    assert 0 < most[0] < 6 << 20 and sum(map(len, texts)) > 12 << 20 and spark.conf.get(key) == before


@pytest.mark.parametrize("group", [1000, 2])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeats(spark, keep, group):
    shared, edge = prose(70, 120), prose(71, 70)
    texts = TEXTS[:14] + [prose(k, 60) + shared + prose(k + 9, 60) for k in range(6)] + [f"{k}" + edge + f"{k}" for k in range(6)] + ["ab" * 700, "é" * 500, shared + shared]
    texts += ["a b c d " * 40, "a b c d " * 30 + "x", "\n".join([prose(72, 60)] * 2), prose(73, 55), "x " + prose(73, 55) + " y"]
    rows = suffix.remove_repeats(docs(spark, texts), keep=keep, group=group).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == dict(enumerate(brute.repeats(texts, 400, keep)))
    assert {r.doc_id: r.n_passages for r in rows} == dict(enumerate(brute.passages(texts)))


def test_one_of_equal_rows_is_the_first(spark):
    x = prose(5, 200)
    rows = spark.createDataFrame([(1, x), (1, x), (1, x), (2, x), (None, x), (None, x), (7, None)], "doc_id long, text string")
    for keep, kept in (("first", [None]), ("none", [])):
        got = suffix.remove_repeats(rows, keep=keep).collect()
        assert [r.doc_id for r in got if r.n_bytes and not r.n_removed] == kept and len(got) == 7


def test_longest_previous_factors():
    r = np.random.default_rng(0)
    for n in (1, 5, 80):
        windows = np.lib.stride_tricks.sliding_window_view(r.integers(0, 3, n + 5, dtype=np.uint8), 6)
        shared = lambda a, b: next((k for k in range(6) if a[k] != b[k]), 6)
        want = [max([shared(windows[i], windows[j]) for j in range(i)], default=0) for i in range(n)]
        assert suffix.longest_previous_factors(*suffix.suffix_order(windows), 6).tolist() == want


def plain_leaks(texts, items):
    found = set()
    for d, t in enumerate(texts):
        words = decontaminate.words_of(t)
        for i, item in enumerate(items):
            parts = decontaminate.question_and_answer(item)
            if sum(map(len, parts)) and all(decontaminate.overlap(p, words) >= 0.5 for p in parts):
                found.add((d, i))
    return found


def test_wand_finds_all_and_skips(monkeypatch):
    r = random.Random(6)
    pool = [f"w{k}" for k in range(1500)]
    items = [(k, " ".join(r.choices(pool, k=r.randint(5, 40)))) for k in range(400)]
    index = decontaminate.Index(items)
    passages = [sorted({index.terms[w.encode()] for w in (items[k][1].split() if k < 50 else r.choices(pool, k=80)) if w.encode() in index.terms}) for k in range(120)]
    want = {}
    for p, terms in enumerate(passages):
        for t in terms:
            for at in range(index.item_at[t], index.item_at[t + 1]):
                want[p, int(index.items[at])] = want.get((p, int(index.items[at])), 0.0) + index.impacts[at]
    opened = []
    monkeypatch.setattr(decontaminate.Index, "in_block", lambda self, terms, block, threshold, f=decontaminate.Index.in_block: opened.append(block) or f(self, terms, block, threshold))
    flat = [np.array([x for p, terms in enumerate(passages) for x in (v(p, t) for t in terms)]) for v in (lambda p, t: p, lambda p, t: t)]
    for cells in (10**6, 500):  # all passages at once, a few at a time
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        opened.clear()
        got = {(p, i): s for p, i, s in index.search(*flat, len(passages), 0.5)}
        assert {k: round(v, 9) for k, v in got.items()} == {k: round(float(v), 9) for k, v in want.items() if v >= 0.5 - 1e-9} and len(got) >= 50
        assert 0 < len(opened) < 0.5 * index.n_blocks * len(passages)


def test_leaks(spark):
    items = ITEMS + [prose(200 + k, 40) for k in range(40)] + [""]
    r = random.Random(5)
    texts = TEXTS + [prose(300 + k, 500) for k in range(20)]
    texts += [prose(400 + k, r.randint(0, 300)) + "\n" + items[k % 43].upper() + "!\n" + prose(500 + k, 100) for k in range(30)]
    texts += [" ".join(items[5].split()[:10]), items[6].replace(items[6].split()[7], "other", 1)]
    for chars in (10**7, 1500):  # one index, several
        found = decontaminate.find_leaks(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), max_index_chars=chars)
        assert {(x.doc_id, x.item_id) for x in found.collect()} == plain_leaks(texts, items)
    clean = decontaminate.keep_clean(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {x.doc_id for x in clean.collect()} == set(range(len(texts))) - {d for d, _ in plain_leaks(texts, items)}

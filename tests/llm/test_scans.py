"""Secrets, personal data, quality and language against plain versions."""

import random
import re

import brute
import duckdb
import pytest
from conftest import edge_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import langid, pii, quality, registry, secrets

ROWS = [(k, r[1] or "") for k, r in enumerate(edge_rows())]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_base_secrets(spark):
    for r in secrets.find_secrets(docs(spark)).collect():
        want = brute.base_secrets(dict(ROWS)[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in want) for k in brute.SECRET_KINDS]
        assert r.base_sha256 == brute.digest(want)
        assert [s for s in r.spans.split(",") if s and not s.startswith("guess")] == [f"{k}:{a}:{b}" for k, a, b in want]


def test_guess_cost_orders_values():
    cost = secrets.guess_cost
    assert cost("password1") < cost("p4ssw0rd99") < cost("Zq8!rT2#kLm9vX")
    assert cost("qwertyuiop") < 5 and cost("aaaaaaaaaaaa") < 5 and cost("19991231") < 6
    assert cost("") == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["password", "Admin", "p4ss", "1999-12-31", "2021", "qwerty", "lkjh", "aaaa", "xyxyxy", "é", "İ", "12mar99", "310190", "qazxsw", "!QAZ", "abcdefg", "dEc2019"]), st.text(st.characters(min_codepoint=33, max_codepoint=126), max_size=5)), max_size=6))
def test_guess_cost_is_the_cheapest_segmentation(parts):
    value = "".join(parts)
    assert abs(secrets.guess_cost(value) - min(secrets.CEILING, brute.guess_cost(value))) < 1e-9


def test_values_are_scored_whole():
    r = random.Random(1)
    noise = "".join(r.choice("abcdefghijkmnopqrstuvwxyz23456789+/") for _ in range(100_000))
    cost = secrets.guess_cost
    assert cost("x" * 100) < cost("x" * 10_000) < 6  # a repeat costs what its count takes
    assert cost("x" * 90 + "Zq8!rT2#kLm9vX") > 20 > 6 > cost("x" * 104)  # what comes late counts
    assert cost(noise) == secrets.CEILING == cost("password" * 20_000 + noise)


def test_many_matches_in_one_text():
    text = "password=abcdefgh pwd: Zq8!rT2#kLm9vX client_secret=abcdef!Zq8rT2kLm9 " * 20_000
    spans, _, _ = secrets.scan(text)
    assert [sum(s[0] == k for s in spans) for k in range(4)] == [40_000, 0, 0, 20_000]


def test_wider_context_is_added_and_redacted():
    text = "pwd: Zq8!rT2#kLm9vX and pwd: password1 and token = abcdef"
    spans, _, weak = secrets.scan(text)
    assert [k for k, _, _ in spans] == [0, 3] and weak == 1
    assert secrets.redacted(text) == "[SECRET] and pwd: password1 and [SECRET]"


def test_a_value_beyond_the_base_span_is_kept_whole(spark):
    texts = ["password=Xk9mQ2!vR7#pL4$z end", "password=Xk9mQ2vR7pL4z8Wq end", 'client_secret: "Xk9mQ2vR7pL4z8Wq" end', "password=qwerty! end"]
    got = {r.doc_id: r for r in secrets.find_secrets(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[k].spans for k in range(4)] == ["assign:0:15,guess:0:25", "assign:0:25", "guess:0:32,assign:7:32", "assign:0:15"]
    assert [(got[k].n_assign, got[k].n_guess) for k in range(4)] == [(1, 1), (1, 0), (1, 1), (1, 0)]
    assert [secrets.redacted(t) for t in texts[:3]] == ["[SECRET] end", "[SECRET] end", '[SECRET]" end']


def test_words_of_the_corpus_are_ranked(spark):
    rows = [(1, "Zebrafish zebrafish ocelot the a"), (2, "zebrafish, marmoset ocelot"), (3, None), (4, "marmoset")]
    assert [secrets.learn_words(docs(spark, rows), n) for n in (0, 1, 2, 3)] == [[], ["zebrafish"], ["zebrafish"], ["zebrafish", "marmoset", "ocelot"]]
    text = "pwd: zebrafishmarmoset"
    got = {n: secrets.find_secrets(docs(spark, [(1, text)]), words=secrets.learn_words(docs(spark, rows), n)).first() for n in (0, 5)}
    assert (got[0].spans, got[5].spans) == ("guess:0:22", "") and got[5].hardest_log10 < 5


def test_planted_credentials(spark):
    r = random.Random(4)
    strong = ["".join(r.choice("abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!#%+") for _ in range(16)) for _ in range(40)]
    weak = ["password123", "qwertyuiop", "summer2019", "letmein!!", "1q2w3e4r", "12mar1987", "aaaaaaaaaa", "admin-2020", "dragondragon", "welcome1"]
    texts = [f"{prose(k, 30)} pwd: {v} {prose(k + 1, 30)}" for k, v in enumerate(strong + weak)]
    found = {x.doc_id: x.n_guess for x in secrets.find_secrets(docs(spark, list(enumerate(texts)))).collect()}
    assert [found[k] for k in range(40)] == [1] * 40 and sum(found[40 + k] for k in range(10)) == 0


PERSONAL = [
    "mail jane [at] example [dot] com now", "contact bob.k(at)mail.example.org today", "IBAN DE89370400440532013000 please", "account GB82 WEST 1234 5698 7654 32 is open", "born 12.03.1984 in town",
    "date of birth: 1990-07-31.", "client 2001:db8:85a3::8a2e:370:7334 said", "contact Mr. John Smith about it", "name: María Pilar Gómez", "ssn 123-45-6789 on file", "call 555-210-9999 at noon", "phone (555) 321-7654 rings",
]
CLEAN = [
    "we met at noon and dot products matter", "serial DE00 1111 2222 3333 4444 55 part no", "released 12.03.2019 as version", "the time is 12:30:45:10 now", "Dr ABC", "order no 000-12-3456 was sent", "build 111-222-3333 done", "ratio 1:2:3:4:5:6:7:8:9:10",
    "a march on 1999-13-45 is not a date", "invoice 900-00-0000 of May",
]


def test_added_personal_data(spark):
    texts = [t for k in range(20) for t in (f"{prose(k, 8)} {x} {prose(k + 1, 8)}" for x in PERSONAL + CLEAN)]
    marked = pii.mark(docs(spark, list(enumerate(texts))))
    model = pii.learn(marked)
    rows = {r.doc_id: r for r in pii.find_personal(marked, model).collect()}
    n = len(PERSONAL) + len(CLEAN)
    hit = [rows[i].n_added > 0 for i in range(len(texts))]
    caught, false = sum(h for i, h in enumerate(hit) if i % n < len(PERSONAL)), sum(h for i, h in enumerate(hit) if i % n >= len(PERSONAL))
    print("personal data added: recall", caught / 20 / len(PERSONAL), "precision", caught / (caught + false), [PERSONAL[k] for k in range(len(PERSONAL)) if not hit[k]], [CLEAN[k] for k in range(len(CLEAN)) if hit[len(PERSONAL) + k]])
    assert caught >= 0.9 * 20 * len(PERSONAL) and caught >= 0.9 * (caught + false)
    for i, r in rows.items():
        assert r.base_sha256 == brute.digest(sorted(brute.base_personal(texts[i]), key=lambda s: (pii.KINDS.index(s[0]), s[1])))


def test_base_personal(spark):
    marked = pii.mark(docs(spark))
    model = pii.learn(marked)
    for r in pii.find_personal(marked, model).collect():
        want = brute.base_personal(dict(ROWS)[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == brute.digest(want)


@pytest.mark.parametrize("text", ["a@b.c@d.e", "a@b.c_d@e.f", "@a.b", "a@@b.c", "a@b", "x.@-.-", "a@b..c", "é@b.c a@é.c", "1.2.3.4.5.6.7.8 01.02.03.300", "+1 2 3", "+123456789-", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0"])
def test_base_personal_oddities(text):
    got = sorted((k, a, b) for k, a, b in pii.candidates(text) if k in pii.BASE_KINDS and pii._passes(k, text[a:b]))
    assert got == sorted(brute.base_personal(text))


def test_reliabilities_and_classifier():
    good = ("local", (pii.ABSTAIN, pii.YES, pii.YES, pii.YES, pii.YES))
    bad = ("local", (pii.ABSTAIN, pii.NO, pii.NO, pii.NO, pii.NO))
    model = pii.fit({good: 80, bad: 80, ("email", (pii.YES,) * 5): 50})
    assert model.probability(*good) > 0.9 > 0.1 > model.probability(*bad)
    assert model.reliability["local", "gazetteer"][1, pii.YES] > 0.8 > 0.2 > model.reliability["local", "gazetteer"][0, pii.YES]


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 2000 else None
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), None if hit is None else len(hit)


@pytest.mark.parametrize("bits", [20, 3])
def test_quality_measures(spark, monkeypatch, bits):
    monkeypatch.setattr(quality, "INDEX_BITS", bits)  # 3: the way for documents with more windows than places
    rows = [*ROWS, (100, "a b c a b c a b"), (101, "a a a a"), (102, "a b a b a b\na b a b a b"), (103, prose(5, 900, 5))]
    for r in quality.ledger(docs(spark, rows)).collect():
        want = plain_quality(dict(rows)[r.doc_id])
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == tuple(g if w is None else w for g, w in zip(got, want)), r.doc_id


def test_policies_and_ablations(spark):
    rows = [(1, "word " * 10), (2, prose(6, 200)), (3, "### " * 30 + prose(7, 100)), (4, "a b c " * 100)]
    kept = quality.ledger(docs(spark, rows))
    assert {r.doc_id: r.kept for r in quality.verdicts(kept).collect()} == {1: False, 2: True, 3: False, 4: False}
    assert {r.doc_id: r.kept for r in quality.verdicts(kept, quality.BASE).collect()} == {1: False, 2: True, 3: True, 4: False}
    found = {r.rule: (r.n_failed, r.n_only_this) for r in quality.ablations(kept).collect()}
    bits = {r.doc_id: r.failed for r in kept.collect()}
    for rule, (n, only) in found.items():
        assert n == sum(b & quality.BIT[rule] != 0 for b in bits.values()) and only == sum(b == quality.BIT[rule] for b in bits.values())


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_queries_match_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = registry.queries()[name](spark, sf)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(cursor.fetchall())


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = langid.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_rejects_and_keeps(spark):
    rows = [(k, f"the house and the tree {k}", "en") for k in range(40)] + [(100 + k, f"la maison et le arbre est {k}", "fr") for k in range(40)] + [(200, None, None), (201, "123 !?", "en"), (202, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_on_folds(d)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d, model).collect()}
    assert all(got[k] == ("und", 0.0) for k in (200, 201, 202))
    assert all(got[r[0]][0] == r[2] for r in rows[:80])
    assert {r.doc_id for r in langid.keep_identified(d, model).collect()} == {r[0] for r in rows[:80]}
    assert langid.identify(d, langid.fit(d.where(F.lit(False)))).where("lang_pred <> 'und'").count() == 0


def test_long_runs_of_digits_take_linear_time():
    text = "7" * 300_000 + ".1.2.3 " + "8" * 300_000 + " 10.0.0.1.9 1.2.3"
    assert [m.span() for m in pii._IP.finditer(text)] == [(0, 300_006), (600_008, 600_016)]

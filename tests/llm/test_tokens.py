"""Packing, id files and chats: exact round trips."""

import itertools
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import CHATS, edge_rows, prose
from tokenizers import Tokenizer

from lodestack.llm import chat, packing, planes, tokens
from lodestack.llm.tokens import MemoEncoder, default_path

ODD = ["a  b", "a \n b", "\n\n x  ", "don't  stop", "Σίσυφος ΣΑΣ É ﬁ ß ẞ İi", "x\x1cy z", "¿qué? «oui» 12.5 a_b <|endoftext|> end", "tab\tsep\r\nnext\x0b", " lead", "it's we'll 'S", "a\x00b c", "é éx"]


def ids(name, text):
    return Tokenizer.from_file(default_path(name)).encode(text, add_special_tokens=False).ids


def check_encoder(name, texts, **limits):
    e, t = MemoEncoder(default_path(name), **limits), Tokenizer.from_file(default_path(name))
    for text, got, want in zip(texts, e.encode(texts), t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembering_changes_no_id(name, monkeypatch):
    monkeypatch.setattr(tokens, "BULK_CHARS", 2000)
    check_encoder(name, ODD + [r[1] or "" for r in edge_rows()] + [prose(9, 200)] * 2, max_entries=50)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_those_of_the_file(name):
    check_encoder(name, ["ab <|endoftext|> cd", "<|endoftext|>", "x<|startoftext|>y <|endoftext|><|endoftext|> it's", "<|ENDOFTEXT|> a", "<| endoftext|>", "É<|endoftext|>\u0338 é"])
    assert ids("byte_bpe_50k.json", "hello <|endoftext|> world") == [31373, 220, 50256, 995]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_white_space_and_odd_letters(name):
    space = [" ", "\n", "\xa0", "\x1c", "\x85", "\u2003", "\t"]
    texts = ["a" + "".join(w) + "b" for k in range(5) for w in itertools.product(space, repeat=k)] + ["".join(w) for k in range(4) for w in itertools.product(space, repeat=k)]
    r = random.Random(1)
    letters = [*space, *"ab.,'s1é!≯Σσİक़", "\u0301", "\u0338", "'ll", "don't", "<|endoftext|>"]
    check_encoder(name, texts + ["".join(r.choices(letters, k=r.randint(0, 14))) for _ in range(4000)])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_of_words_marks_and_line_ends(name, monkeypatch):
    heads, tails = ["", "\n", "\n\n", "x.\n"], ["", ".", ",", "'", "'s", "***", "$$$", "!?", "_", "(a)", "\n"]
    words = ["", "Word", "naïve", "Ünï", "İstanbul", "ŉa", "Σίσυφος", "ΣΑΣ", "слово", "ªº", "12", "28.68", "a1", "é", "日本", "'s", "--"]
    chunks = [h + w + t for h in heads for w in words for t in tails]
    texts = ["a " + " ".join(chunks), *(f"it is {c} so" for c in chunks), *(f"is {c}" for c in chunks), *chunks, *(f"it {a}\n{b} so" for a in words for b in words)]
    monkeypatch.setattr(tokens, "BULK_CHARS", 300)
    check_encoder(name, texts)
    check_encoder(name, texts, max_entries=40)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_letters_are_single_pre_tokens(name):
    e = MemoEncoder(default_path(name))
    letters = list(map(chr, e.letters))
    assert set("azAZéñÜß") <= set(letters)
    r = random.Random(3)
    check_encoder(name, [f"a {x}{y}. {y}{x}b" for x, y in itertools.product(letters, "aéΣя")] + [" ".join("".join(r.choices(letters, k=6)) for _ in range(20)) for _ in range(500)])


def test_chunks_met_again_are_not_learned_again(monkeypatch):
    """A full memo drops the chunks not met for long, and keeps those that go on being met. What it holds stays bounded."""
    monkeypatch.setattr(tokens, "BULK_CHARS", 1)
    e = MemoEncoder(default_path("byte_bpe_50k.json"), max_entries=100)
    learned, word = [], e._word
    e._word = lambda w, space: learned.append(w) or word(w, space)
    r = random.Random(5)
    for _ in e.encode("a common " + " ".join("".join(r.choices("abcdefgh", k=9)) for _ in range(20)) for _ in range(100)):
        assert len(e.known) + len(e.older) <= 100 + 2 * 22
    assert len(learned) > 1900 and learned.count("common") == 1


def test_line_ends_share_their_words():
    """A line's end between two words is a cut, so that its two words are remembered apart."""
    e = MemoEncoder(default_path("byte_bpe_50k.json"))
    list(e.encode("it is " + " ".join(f"{a}.\n{b}" for a in ("so", "not", "here") for b in ("Then", "Now", "We")) for _ in range(2)))
    assert set(e.known) == {"", "is", "so.", "not.", "here.", "\nThen", "\nNow", "\nWe"}


def test_a_packing_task_leaves_no_memo_in_its_worker(spark, tmp_path):
    path = default_path("word_bpe_49k.json")

    def held(batches):
        import os

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(e.known) if (e := tokens._ENCODERS.get(path)) else -1])], ["pid", "n"])

    docs = spark.createDataFrame([(k, prose(k, 300)) for k in range(8)], "doc_id long, text string").repartition(4)
    packing.pack(docs, path).write.parquet(f"{tmp_path}/packed")
    left = {r.pid: r.n for r in spark.range(8).repartition(8).mapInArrow(held, "pid long, n long").collect()}
    assert set(left.values()) - {-1} == {1}  # the empty chunk alone; -1: a worker that packed nothing


def check_packed(rows):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    return by_doc, padding


def test_packing(spark):
    texts = [(k, prose(600 + k, random.Random(k).choice([3, 50, 400, 3000, 9000]))) for k in range(60)] + [(900, ""), (901, None)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), default_path("word_bpe_49k.json")).collect()
    want = {i: ids("word_bpe_49k.json", t or "") + [packing.END_ID] for i, t in texts}
    by_doc, padding = check_packed(rows)
    assert padding == 0
    for (i, total), pieces in by_doc.items():
        at = 0
        assert total == len(want[i])
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == brute.ids_crc32(want[i][at : at + p.length])
            at += p.length
        assert at == total
    assert set(i for i, _ in by_doc) == set(want)


def test_harmonic_bins_hold_their_count():
    packer, rng = packing.HarmonicPacker(64, 8), random.Random(2)
    done = []
    for k in range(500):
        done += packer.add(k, bytes(4 * rng.randint(1, 150)))
    done += packer.finish()
    for pieces in done:
        classes = [c for *_, c in pieces if c > 1]
        if classes and all(c == classes[0] for c in classes) and not any(c == packing.REST for *_, c in pieces):
            assert len(classes) == classes[0]


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_blocks_round_trip(mode):
    rng = np.random.default_rng(4)
    for values in ([], [0], [0, 0, 0], [1], [50256] * 9, rng.integers(0, 50257, 70_001), rng.integers(0, 1 << 32, 13, dtype=np.uint64)):
        a = np.array(values, "<u4")
        assert planes.decode_block(planes.encode_block(a, mode)).tolist() == a.tolist()


def test_joined_crc():
    a, b = bytes(range(200)), bytes(range(50, 250)) * 3
    assert planes.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert planes.crc32_joined(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


@pytest.mark.parametrize("block", [7, 65_536])
def test_files_round_trip(spark, tmp_path, block):
    rows = [(k * 3 % 41, prose(700 + k, 30)) for k in range(41)] + [(50, None), (51, ""), (52, ODD[3])]
    path = str(tmp_path / "ids")
    planes.write_planes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), default_path("byte_bpe_50k.json"), path, block_ids=block, mode="bit" if block == 7 else "byte")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in planes.read_planes(spark, path).collect()}
    at, want = 0, {}
    for i, t in sorted(rows):
        tokens = ids("byte_bpe_50k.json", t or "") + [planes.END_ID]
        want[i] = (at, len(tokens), brute.ids_crc32(tokens))
        at += len(tokens)
    assert got == want


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, symbols string")


def plain_viterbi(model, rows):
    """The roles of each row's first line on the best path over all lines, by trying every predecessor of every state."""
    paths = None
    for row in rows:
        for k, x in enumerate(row):
            new = {}
            for now in range(len(model.roles)):
                shown = float(model.show[now, x])
                if paths is None:
                    new[now] = (float(model.move[len(model.roles), now]) + shown, [now])
                else:
                    move = model.move if k == 0 else model.turn if chat._marker_of(x) else model.stay
                    score, before = max((paths[b][0] + float(move[b, now]), -b) for b in paths)
                    new[now] = (score + shown, [*paths[-before][1], now])
            paths = new
    _, best = max((score, -state) for state, (score, _) in paths.items())
    path, at, out = paths[-best][1], 0, []
    for row in rows:
        out.append(model.roles[path[at]])
        at += len(row)
    return out


def test_blocks_give_the_whole_path(spark, monkeypatch):
    r = random.Random(8)
    rows = [(c, t, ["user", "assistant"][t % 2], prose(t + 100 * c, 5 if t % 2 == 0 else 60), "") for c in range(3) for t in range(r.randint(5, 40))]
    table = chats(spark, rows)
    model = chat.fit(chat._turns(chat._rows(table))[0])
    whole = {(x.conv_id, x.turn): x.role_pred for x in chat.format_chats(table, model).collect()}
    for block, crowded in ((3, 4096), (16, 2)):
        monkeypatch.setattr(chat, "BLOCK", block)
        monkeypatch.setattr(chat, "CROWDED", crowded)
        assert {(x.conv_id, x.turn): x.role_pred for x in chat.format_chats(table, model).collect()} == whole
    monkeypatch.setattr(chat, "FEW_BLOCKS", 0)  # more crowded blocks than are handed out
    assert {(x.conv_id, x.turn): x.role_pred for x in chat.format_chats(table, model).collect()} == whole
    assert sum(whole[c, t] == role for c, t, role, *_ in rows) > 0.95 * len(rows)
    for c in range(3):
        assert plain_viterbi(model, [chat.symbols(x[3]) for x in rows if x[0] == c]) == [whole[c, t] for t in range(sum(x[0] == c for x in rows))]


def test_transcripts_with_markers(spark):
    """One row for each transcript, roles by marker and line alone: no row's role is known."""
    r, names = random.Random(9), {"user": ["User", "Human", "### Human", "Q"], "assistant": ["Assistant", "AI", "<|assistant|>", "A"]}
    rows, want = [], {}
    for c in range(30):
        lines = []
        for t in range(r.randint(2, 8)):
            role = ("user", "assistant")[t % 2]
            name = r.choice(names[role])
            lines.append((role, f"{name}{'' if name.endswith('>') else ':'} {prose(c * 10 + t, 6)}".replace("\n", " ")))
            if r.random() < 0.3:
                lines.append((role, prose(c * 10 + t, 5).replace("\n", " ")))  # goes on without a marker
        rows.append((c, 0, None, "\n".join(x for _, x in lines), ""))
        want[c] = [role for k, (role, _) in enumerate(lines) if k == 0 or chat.marker(lines[k][1])[0]]
    got = {x.conv_id: [line[2:-2] for line in x.rendered.split("\n") if line.startswith("<|") and line != "<|end|>"] for x in chat.format_chats(chats(spark, rows)).collect()}
    right = sum(got[c] == want[c] for c in want)
    assert right >= 0.9 * len(want), right


def test_roles_of_held_out_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = {(x.conv_id, x.turn): x for x in chat.format_chats(table).collect()}
    held = [(x.role, got[x.conv_id, x.turn].role_pred) for x in table.collect() if got[x.conv_id, x.turn].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.93 * len(held)


def test_markers_and_rendering(spark):
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(chats(spark, CHATS)).collect()}
    assert got[2, None].role_pred == "user" and got[2, 5].role_pred == "assistant"
    assert got[2, 5].rendered == "<|assistant|>\nhere\n<|end|>"
    assert got[1, 3].n_rows == 2
    assert chat.marker("### Human: hi")[0] == "user" and chat.marker("<|assistant|> yes")[0] == "assistant" and chat.marker("Another thing")[0] is None

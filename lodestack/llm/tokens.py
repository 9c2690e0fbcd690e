"""Token ids of whole texts with a public tokenizer file, remembering the ids of chunks already met.

The tokenizers library decides every id. Texts are cut only where no pre-token of the vocabulary can span: before a space or a line's end
that stands alone between two other characters (or at any white space, for the vocabulary that drops it). Each distinct chunk goes through the library
when it is first met in a worker, and the remembered ids are joined; chunks not met for long are forgotten. Most chunks are a word of letters, perhaps with ASCII marks
behind it: two pre-tokens, whose ids the library's model gives without a search for their borders. A text that holds an added token's content (<|endoftext|>) goes through the library whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np

ID = np.dtype("<u4")
BULK_CHARS = 1 << 15  # texts whose new chunks go through the library together; few, so that their chunks' ids are still in the CPU's caches when joined

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")  # Python's white space holds all that the vocabularies' rules call so
_RARE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class MemoEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers. max_entries bounds the memory of the remembered chunks."""

    def __init__(self, path: str, max_entries: int = 700_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are what runs side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = self.tokenizer.normalizer is None  # a space belongs to the word after it; else white space goes
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.hidden = not self.spaced and any(t.normalized for t in added)  # met in normalised texts only
        self.max_entries = max_entries
        self.small = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"  # how remembered ids are held
        self.tokenize, self.space = self.tokenizer.model.tokenize, ""
        if self.spaced:
            self.space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        self.letters = self._letters()
        self.parts = re.compile(rf"(\n?)([{''.join(map(chr, self.letters))}]*)([!-/:-@\[-`{{-~]*)").fullmatch  # a line's end, a word, ASCII marks
        self.line = self._library(["\n"])[0]
        self.known: dict[str, bytes]  # by chunk, without the space before it
        self.older: dict[str, bytes]  # chunks met before those in known; the ones met again move there
        self.tails: dict[str, bytes]  # by the marks behind a word
        self.forget()

    def forget(self) -> None:
        """Frees the remembered chunks: a worker may outlive its task by many, of other steps too."""
        self.known, self.older, self.tails = {"": b""}, {}, {}

    def _letters(self) -> dict[int, str]:
        """How the model's vocabulary writes letters, of those that within a word stand for themselves in the library's eyes: it normalises each by itself and cuts at none."""
        found, normalizer = {}, self.tokenizer.normalizer
        for letter in filter(str.isalpha, map(chr, range(0x530))):
            word = f"a{letter}a" if normalizer is None else normalizer.normalize_str(f"a{letter}a")
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(word)
            if len(pieces) == 1:
                found[ord(letter)] = pieces[0][0][1:-1]
        return found

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self.small, f.ids).tobytes() for f in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str, space: str) -> bytes:
        """A word of known letters, which is one pre-token, with the space before it."""
        return array(self.small, [t.id for t in self.tokenize(space + word.translate(self.letters))]).tobytes()

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            self.tails[marks] = self._library([marks])[0]
        return self.tails[marks]

    def _chunks(self, text: str) -> tuple[str, list[str]]:
        """What comes before the first cut, which is all of a text that is not cut, and the chunks after each cut."""
        if self.hidden or any(c in text for c in self.added):
            return text, []
        if not self.spaced:
            return "", text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else re.split(r"[\t-\r\x20\x85\xa0]+", text)
        odd = "  " in text or " \n" in text or "\n " in text or text[-1:] == " " or any(c in text for c in _RARE_SPACE)
        if not odd and "\n\n" not in text:
            text = text.replace("\n", " \n")  # a chunk that begins with a line's end has no space before it
        head, *rest = _LONE_SPACE.split(text) if odd else text.split(" ")
        return head, rest

    def _learn(self, missing: set[str]) -> None:
        """Remembers the chunks."""
        known, older, others = self.known, self.older, []
        for c in missing:
            if c in older:
                known[c] = older[c]
            elif c.isascii() and c.isalpha():
                known[c] = self._word(c, self.space)
            elif (parts := self.parts(c)) and (parts[1] or parts[2]):
                line, word, marks = parts.groups()
                ids = known.get(line + word) if marks else None
                if ids is None:
                    ids = (self.line if line else b"") + (self._word(word, "" if line else self.space) if word else b"")
                known[c] = ids + self._tail(marks) if marks else ids
            else:
                others.append(c)
        if others:
            space = " " if self.spaced else ""
            known.update(zip(others, self._library([c if c[0] == "\n" else space + c for c in others])))

    def _bulk(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > self.max_entries // 2:
            self.known, self.older, self.tails = {"": b""}, self.known, {}
        split = [self._chunks(t) for t in texts]
        missing: set[str] = set()
        for _, chunks in split:
            missing.update(filterfalse(self.known.__contains__, chunks))
        if missing:
            self._learn(missing)
        ids_of = self.known.__getitem__
        for first, (_, chunks) in zip(self._library([head for head, _ in split]), split):
            ids = first + b"".join(map(ids_of, chunks))
            yield ids if self.small == "I" else np.frombuffer(ids, "<u2").astype(ID).tobytes()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= BULK_CHARS:
                yield from self._bulk(held)
                held, size = [], 0
        if held:
            yield from self._bulk(held)


_ENCODERS: dict[str, MemoEncoder] = {}


def encoder(path: str) -> MemoEncoder:
    """One for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = MemoEncoder(path)
    return _ENCODERS[path]

"""BLAKE3 by its published specification, over whole Arrow batches: all inputs' blocks advance together in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Initial state and message order of the specification, and its flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK = 64, 1024


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint32(bits)) | (x << np.uint32(32 - bits))


def compress(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values (8, n) of n blocks at once; words (16, n)."""
    n = words.shape[1]
    v = [*chain, *(np.full(n, IV[k], np.uint32) for k in range(4)), (counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]

    def mix(a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
        for m, (r1, r2) in ((x, (16, 12)), (y, (8, 7))):
            v[a] = v[a] + v[b] + m
            v[d] = _turned(v[d] ^ v[a], r1)
            v[c] = v[c] + v[d]
            v[b] = _turned(v[b] ^ v[c], r2)

    m = list(words)
    for _ in range(7):
        for k in range(4):  # columns, then diagonals
            mix(k, 4 + k, 8 + k, 12 + k, m[2 * k], m[2 * k + 1])
        for k in range(4):
            mix(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, m[8 + 2 * k], m[9 + 2 * k])
        m = [m[k] for k in ORDER]
    return np.stack([v[k] ^ v[k + 8] for k in range(8)])


def _leaves(chunks: list[bytes], counters: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) of chunks of up to 1024 bytes; alone: the chunk is its whole input."""
    n = len(chunks)
    sizes = np.fromiter(map(len, chunks), np.int64, n)
    raw = np.zeros((n, CHUNK), np.uint8)
    for k, c in enumerate(chunks):
        raw[k, : len(c)] = np.frombuffer(c, np.uint8)
    words, blocks = raw.view("<u4").reshape(n, 16, 16), np.maximum(1, -(-sizes // BLOCK))
    chain = np.repeat(IV[:, None], n, axis=1)
    for b in range(int(blocks.max(initial=0))):
        at = np.flatnonzero(blocks > b)
        last = blocks[at] == b + 1
        flags = (CHUNK_START if b == 0 else 0) | np.where(last, CHUNK_END | np.where(alone[at], ROOT, 0), 0)
        chain[:, at] = compress(chain[:, at], np.ascontiguousarray(words[at, b].T), counters[at], np.minimum(BLOCK, sizes[at] - b * BLOCK), flags)
    return chain


def blake3_many(inputs: list[bytes]) -> list[str]:
    """The 32-byte digests, in hex."""
    counts = [max(1, -(-len(x) // CHUNK)) for x in inputs]
    chunks = [x[a * CHUNK : (a + 1) * CHUNK] for x, n in zip(inputs, counts) for a in range(n)]
    counters = np.array([a for n in counts for a in range(n)], np.int64)
    alone = np.array([n == 1 for n in counts for _ in range(n)], bool)
    leaves = _leaves(chunks, counters, alone)
    ends = np.cumsum([0, *counts])
    level = [[leaves[:, k] for k in range(ends[i], ends[i + 1])] for i in range(len(inputs))]
    # a parent's left side is the largest power of two of chunks: pairing neighbours, an odd last one rising unpaired, is that tree
    while any(len(x) > 1 for x in level):
        pairs = [(i, k) for i, x in enumerate(level) for k in range(0, len(x) - 1, 2)]
        words = np.stack([np.concatenate([level[i][k], level[i][k + 1]]) for i, k in pairs], axis=1)
        flags = np.array([PARENT | (ROOT if len(level[i]) == 2 else 0) for i, _ in pairs])
        n = len(pairs)
        made = compress(np.repeat(IV[:, None], n, axis=1), words, np.zeros(n, np.int64), np.full(n, BLOCK), flags)
        new: list[list] = [[] for _ in level]
        for (i, _), k in zip(pairs, range(n)):
            new[i].append(made[:, k])
        for i, x in enumerate(level):
            if len(x) % 2:
                new[i].append(x[-1])
        level = new
    return [x[0].astype("<u4").tobytes().hex() for x in level]


def blake3_hex(data: Column) -> Column:
    """An Arrow function: there is no built-in digest of this kind. Off the hot path unless a store asks for it."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        known = values.notna()
        out = pd.Series([None] * len(values), index=values.index, dtype=object)
        if known.any():
            out[known] = blake3_many([bytes(x) for x in values[known]])
        return out

    return digest(data)

"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints. ASCII letters are lower-cased; a document's word shingles, repeats included, are hashed with
XXH64 (UTF-8, seed 42); a bit of the fingerprint is set if it is set in over half the hashes. A text with fewer words is one
shingle; one without words has fingerprint zero.

Search. Only distinct fingerprints are searched. Their bits, grouped so that correlated ones share a partition, get
thresholds t_i per partition with sum(t_i + 1) = distance + 1; two fingerprints within the distance then
differ by at most t_i bits in some partition i (t_i = -1: not probed). Dynamic programming chooses the
thresholds, and with them the number of partitions, of least cost: rows probed plus candidate pairs, estimated from the
bit counts of the whole corpus. Fingerprints meet under each partition's projection with t_i bits masked out, and are verified by
their differing bits. Where more than `bucket` fingerprints meet, pairs are not tried: all of them meet again
under themselves and their one-bit neighbours (half the distance each way), which is linear, exact for distance 2 and
never leaves pairs out.

Nulls, edges: a null text is an empty one; a null doc_id takes part, but is no component's least id unless there is no other (null);
repeated rows keep a row each; very long texts are read whole; a bit set in exactly half the hashes is 0; other columns are not read, so none can clash; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import documents, id_text, small_batches, stored
from lodestack.llm.components import connected

BITS, SHINGLE, DISTANCE, BUCKET, MAX_PARTITIONS = 64, 3, 2, 64, 4
PAIR_COST = 0.2  # of verifying a pair, against shuffling a probe row


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: only ASCII letters, only ASCII white space
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], "<u8")
    return most_set(hashes)


def most_set(hashes: np.ndarray) -> int:
    """The fingerprint of these hashes ("<u8"): each bit that is set in over half of them."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how many have bits i and j both set, over all of them; the driver gets 64 x 64 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n))], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in `parts` partitions of nearly equal size, each grown from its first bit by the strongest mean correlation."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    bond = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(bond, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        group = [max(sorted(free), key=lambda b: bond[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: bond[b, group].mean()))
            free.discard(group[-1])
        out.append(sorted(group))
    return out


def expected_pairs(n: int, both: np.ndarray, group: list[int], threshold: int) -> float:
    """Pairs of n fingerprints that differ by at most threshold bits of the group, were bits independent with the corpus's rates."""
    p = np.diag(both)[group] / max(n, 1)
    differ = 2 * p * (1 - p)
    dist = np.zeros(threshold + 2)
    dist[0] = 1
    for d in differ:
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
        dist[-1] = 0  # what lies beyond the threshold
    return n * (n - 1) / 2 * float(dist[: threshold + 1].sum())


@dataclass(frozen=True)
class Plan:
    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float

    def masks(self) -> list[int]:
        """The bits compared, one mask for each probe of each partition."""
        out = []
        for group, t in zip(self.groups, self.thresholds):
            if t >= 0:
                out += [sum(1 << b for b in group if b not in free) for free in itertools.combinations(group, min(t, len(group)))]
        return out


def plan(n: int, both: np.ndarray, distance: int = DISTANCE, most: int = MAX_PARTITIONS) -> Plan:
    """The cheapest partitions and thresholds: dynamic programming over partitions and the sum of t_i + 1 given out so far."""
    best = None
    for parts in range(1, most + 1):
        groups = group_bits(n, both, parts)
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for group in groups:
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for given, (cost, chosen) in table.items():
                for t in range(-1, distance - given + 1):
                    probes = len(list(itertools.combinations(group, min(t, len(group))))) if t >= 0 else 0
                    more = cost + (n * probes + PAIR_COST * probes * expected_pairs(n, both, group, t) if t >= 0 else 0.0)
                    if given + t + 1 not in new or more < new[given + t + 1][0]:
                        new[given + t + 1] = more, (*chosen, t)
            table = new
        cost, chosen = table[distance + 1]
        if best is None or cost < best.cost:
            best = Plan(tuple(map(tuple, groups)), chosen, cost)
    return best


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints fps.fp within the distance."""
    if distance > 2:
        raise ValueError("large buckets are exact up to distance 2")
    masks = plan(*bit_counts(fps), distance).masks()
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])).alias("p")).select("fp", "p.k", "p.key")
    met = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    near = F.expr(f"flatten(transform(l, (x, i) -> transform(filter(slice(l, i + 2, {bucket}), y -> bit_count(x ^ y) <= {distance}), y -> struct(x AS a, y AS b))))")
    tried = keyed.join(met.where(F.col("n") <= bucket).select("k", "key"), ["k", "key"]).groupBy("k", "key").agg(F.collect_list("fp").alias("l")).select(F.explode(near).alias("e")).select("e.a", "e.b")
    crowd = keyed.join(met.where(F.col("n") > bucket).select("k", "key"), ["k", "key"]).select("fp").distinct()
    ball = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(BITS)]] if distance == 2 else [F.col("fp").bitwiseAND(F.lit(_signed((1 << 64) - 1 - (1 << b)))) for b in range(BITS)] if distance else [F.col("fp")]
    kind = F.lit(0) if distance == 2 else None
    around = crowd.select("fp", F.posexplode(F.array(*ball)).alias("j", "key")).select("fp", (kind if kind is not None else F.col("j")).alias("j"), "key")
    least = around.groupBy("j", "key").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1").select("j", "key", "m")
    return tried.unionByName(around.join(least, ["j", "key"]).where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id reachable over links, for each row of docs."""
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected(links(distinct, distance, bucket), "simhash-links")
    label = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    named = label.join(label.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity: texts whose fingerprints are within the distance, or whose min-hash sketches agree in a whole partition, are candidates; their whole shingle sets decide.

PARTS, PART = 96, 8  # partitions of a sketch and symbols in each: a pair at similarity 0.8 is missed with probability (1 - 0.8 ** 8) ** 96 < 3e-8
SIGNS, MAX_APART = 256, 60  # one bit of so many symbols; at similarity 0.8 as many as 26 differ on average, more than 60 with probability under 1e-10
CROWD = 16  # where more texts share a key, those not joined yet are told apart by what sets them off from one text, not pair by pair
_DRAW = np.random.default_rng(20_240_229)
_TIMES = _DRAW.integers(0, 1 << 32, (PARTS * PART, 1), dtype=np.uint32) | np.uint32(1)
_PLUS = _DRAW.integers(0, 1 << 32, (PARTS * PART, 1), dtype=np.uint32)


def shingle_set(text: str, shingle: int) -> frozenset[bytes]:
    """The text's word shingles as fingerprints see them; a text with fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return frozenset(b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset()


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """The hashes of shingle_set(text), ascending, each once."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(shingle, n) - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts[: n - last].tolist(), ends[last:].tolist())], np.uint64))


def same_words(text: str) -> bytes:
    """128 bits that tell texts with other words (ASCII letters lower-cased) apart."""
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()))


def partition_keys(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a key for each partition of the sketch, SIGNS bits in longs): the least values of PART hash functions over the shingles make a key."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(PARTS * PART, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 128):
        values = x[at : at + 128] * _TIMES
        values += _PLUS
        np.minimum(least, values.min(1), out=least)
    signs = np.packbits((least[:SIGNS] * np.uint32(0x9E3779B1)) >> np.uint32(31)).view(np.int64)
    key = np.arange(PARTS, dtype=np.uint64)
    for column in least.reshape(PARTS, PART).T:
        key = (key ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key.view(np.int64), signs


def _groups(rows: DataFrame, shingle: int) -> DataFrame:
    """id, first (rid and tie), n (distinct shingles), fp (their fingerprint), keys (of its sketch's partitions) and signs for each distinct text of rows (rid, tie, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # a text's sketch is told once in a task
        for batch in batches:
            names, sizes, fps, keys, signs = [], [], [], [], []
            for t in batch.column(2):
                text = t.as_py()
                names.append(same_words(text))
                new = names[-1] not in seen
                seen.add(names[-1])
                hashes = shingle_hashes(text, shingle) if new else ()
                sizes.append(len(hashes) if new else None)
                fps.append(np.uint64(most_set(hashes)).astype(np.int64) if len(hashes) else None)
                key, sign = partition_keys(hashes) if len(hashes) else (None, None)
                keys.append(key)
                signs.append(sign)
            halves = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, signs))],
                ["rid", "tie", "w0", "w1", "n", "fp", "keys", "signs"],
            )

    marked = rows.mapInArrow(run, "rid long, tie long, w0 long, w1 long, n int, fp long, keys array<long>, signs array<long>")
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    found = marked.groupBy("w0", "w1").agg(F.min(F.struct("rid", "tie")).alias("first"), F.max("n").alias("n"), F.max("fp").alias("fp"), first("keys"), first("signs"))
    signs = F.struct(*[F.col("signs")[k].alias(f"s{k}") for k in range(SIGNS // 64)]).alias("signs")
    return stored(found.select(F.monotonically_increasing_id().alias("id"), "first", "n", "fp", "keys", signs), "near-groups")


def _may_be_near(a: str, b: str, similarity: float):
    """Whether sizes leave room for the similarity and the signs of the sketches are no further apart than MAX_APART."""
    sizes = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n")) * similarity - 1e-6
    apart = sum(F.bit_count(F.col(f"{a}.signs.s{k}").bitwiseXOR(F.col(f"{b}.signs.s{k}"))) for k in range(SIGNS // 64))
    return sizes & (apart <= MAX_APART)


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(f"{a}.id", f"{b}.id").alias("a"), F.greatest(f"{a}.id", f"{b}.id").alias("b")).distinct()


def alike_pairs(groups: DataFrame) -> DataFrame:
    """Candidates (a, b) by the pigeonhole search: texts of one fingerprint with the least of them, and those of links between fingerprints."""
    marked = groups.where("fp IS NOT NULL").select("id", "fp")
    least = stored(marked.groupBy("fp").agg(F.min("id").alias("id")), "near-fingerprints")
    of = lambda c: least.select(F.col("fp").alias(c), F.col("id").alias(f"{c}_id"))
    met = links(least).join(of("a"), "a").join(of("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    same = marked.join(of("fp"), "fp").where("id <> fp_id").select(F.col("fp_id").alias("a"), F.col("id").alias("b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(same)


def centre_pairs(live: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b): for each key of live (s, id, n, signs, c: its texts) its most shared text against all others, linear in the rows.

    The most shared text has the largest mean log of c, so that the hub of many copies is met by all of them.
    """
    shared = live.groupBy("id").agg((F.sum(F.log2("c")) / F.count("*")).alias("share"))
    rows = stored(live.join(shared, "id").select("s", "share", F.struct("id", "n", "signs").alias("x")), "near-shared")
    centre = stored(rows.groupBy("s").agg(F.max(F.struct("share", "x")).alias("m")).select("s", F.col("m.x").alias("m")), "near-centres")
    return _pairs(rows.join(centre, "s").where((F.col("x.id") != F.col("m.id")) & _may_be_near("x", "m", similarity)), "x", "m")


def mixed_keys(live: DataFrame, found: DataFrame) -> DataFrame:
    """s, c, main (its largest component) and x (id, n, signs, component) of the keys whose texts are not in one component of found (node, component) yet."""
    rows = live.join(found, live["id"] == found["node"], "left").select("s", "c", "id", "n", "signs", F.coalesce("component", "id").alias("component"))
    sizes = rows.groupBy("s", "component").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("s").agg(F.max(F.struct("k", "component")).alias("m"), F.count("*").alias("k")).where("k > 1").select("s", F.col("m.component").alias("main"))
    return stored(rows.join(mixed, "s").select("s", "c", "main", F.struct("id", "n", "signs", "component").alias("x")), "near-mixed")


def other_pairs(mixed: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b): all pairs that share a key of mixed that has no more than CROWD texts, and are not in one component yet."""
    rows = mixed.where(F.col("c") <= CROWD).select("s", "main", "x")
    fewer = rows.where("x.component <> main").select("s", F.col("x").alias("y"))
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("x.component") == F.col("main")) | (F.col("x.id") < F.col("y.id")))
    return _pairs(rows.join(fewer, "s").where(apart & _may_be_near("x", "y", similarity)), "x", "y")


def residuals(mixed: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """m, x, main, component, nm, n and d for the texts x of mixed's crowded keys: the hashes of the shingles that x and m do not share.

    m stands for the key's largest component (main): its text in most of these keys. nm and n are the shingles of m and x, component is x's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        of = lambda z: shingle_hashes(expand(z.as_py()).decode("utf-8"), shingle)
        last, hub = None, np.zeros(0, np.uint64)  # rows of one m come together
        for batch in batches:
            hubs, sizes, apart = [], [], []
            for m, z, y in zip(batch.column(0).to_pylist(), batch.column(4), batch.column(5)):
                if m != last:
                    last, hub = m, of(y)
                ours = of(z)
                hubs.append(len(hub))
                sizes.append(len(ours))
                apart.append(np.setxor1d(ours, hub, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(hubs, pa.int32()), pa.array(sizes, pa.int32()), pa.array(apart, pa.list_(pa.int64()))], ["m", "x", "main", "component", "nm", "n", "d"]
            )

    crowded = mixed.where(F.col("c") > CROWD).groupBy("main", "x.id", "x.component").agg(F.count("*").alias("k"))
    crowded = stored(crowded.select("main", F.col("id").alias("x"), "component", "k"), "near-crowded")
    hubs = crowded.where("component = main").groupBy("main").agg(F.max(F.struct("k", "x")).alias("h")).select("main", F.col("h.x").alias("m"))
    met = crowded.join(hubs, "main").where("x <> m").select("m", "x", "main", "component")
    met = met.join(texts.select(F.col("id").alias("x"), "z"), "x").join(texts.select(F.col("id").alias("m"), F.col("z").alias("y")), "m")
    schema = "m long, x long, main long, component long, nm int, n int, d array<long>"
    return stored(met.select("m", "x", "main", "component", "z", "y").mapInArrow(run, schema), "near-residuals")


def residual_pairs(apart: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(links, candidates), each (a, b), that join components over the rows of residuals: no pair at the similarity is missing.

    With r = (1 - similarity) / (1 + similarity), texts x and y are alike if no more than r (n_x + n_y) shingles are in one only. These are the hashes in one
    of d_x and d_y only, so at least h_x + h_y are in both, where h = (|d| - r n) / 2. If x is alike to m, that is a link. Two such texts need no
    other; where x is not, h_x > r nm / 2, and h_y >= -r nm / 2 for any y: the pair has hashes in common, o of them, and by the pigeonhole principle one
    among the first |d| - o + 1 of both in any order. The order goes from the rarest for m, so that what few texts have in common decides.
    Rows meet by the class of h_x too (powers of 2), of which y's row tells the largest that its place allows.
    """
    r = (1 - similarity) / (1 + similarity)
    both = (F.col("n") + F.col("nm") - F.size("d")) / 2
    alike = both >= similarity * (F.col("n") + F.col("nm") - both) - 1e-9
    rows = apart.select("m", "x", "main", "component", "n", F.size("d").alias("size"), (~alike).alias("far"), ((F.size("d") - r * F.col("n")) / 2).alias("h"), (F.col("nm") * (r / 2)).alias("low"), "d")
    direct = rows.where("NOT far AND component <> main").select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b"))
    each = rows.select("m", "x", "component", "n", "size", "far", "h", "low", F.explode("d").alias("t"))
    often = each.groupBy("m", "t").agg(F.count("*").alias("f")).where("f > 1")
    own = ["m", "x", "component", "n", "size", "far", "h", "low"]
    ranked = each.join(often, ["m", "t"]).groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("l"))
    placed = ranked.select(*own, F.size("l").alias("k"), F.posexplode("l").alias("at", "v")).select(*own, F.col("v.t").alias("t"), (F.col("size") - F.col("k") + F.col("at")).alias("at"))
    placed = stored(placed, "near-placed")  # hashes that no other text has come first, and need no row
    needed = lambda h: F.greatest(F.lit(1), F.ceil(h - 1e-6))
    kind = lambda h: F.floor(F.log2(1 + F.greatest(F.lit(0.0), h))).cast("int")
    asks = placed.where(F.col("far") & (F.col("at") <= F.col("size") - needed(F.col("h") - F.col("low"))))
    asks = asks.select("m", "t", kind(F.col("h") - F.col("low")).alias("kind"), F.struct("x", "component", "n", "size", "h", "at").alias("p"))
    held = placed.where(F.col("at") <= F.col("size") - needed(F.col("h") + F.col("low")))
    most = kind(F.col("size") - F.col("at") - F.col("h") - F.col("low") + 1e-6)
    held = held.select("m", "t", F.explode(F.sequence(F.lit(0), most)).alias("kind"), F.struct("x", "component", "n", "size", "h", "at", "far").alias("q"))
    shared = needed(F.col("p.h") + F.col("q.h"))
    ok = (F.col("p.component") != F.col("q.component")) & (~F.col("q.far") | (F.col("p.x") < F.col("q.x")))
    ok &= (F.col("p.at") <= F.col("p.size") - shared) & (F.col("q.at") <= F.col("q.size") - shared)
    ok &= F.least("p.n", "q.n") >= F.greatest("p.n", "q.n") * similarity - 1e-6
    found = asks.join(held, ["m", "t", "kind"]).where(ok).select(F.least("p.x", "q.x").alias("a"), F.greatest("p.x", "q.x").alias("b"))
    return direct, found


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts (id, z: compressed) have word shingles of this Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        last, ours = None, frozenset()  # rows of one b come together

        for batch in batches:
            found = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if b != last:
                    last, ours = b, shingle_set(expand(y.as_py()).decode("utf-8"), shingle)
                other = shingle_set(expand(x.as_py()).decode("utf-8"), shingle)
                both = len(ours & other)
                if both >= similarity * (len(ours) + len(other) - both) - 1e-9:
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["a", "b"])

    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("z").alias("x")), "a")
    return first.join(texts.select(F.col("id").alias("b"), F.col("z").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _row_key(docs: DataFrame) -> tuple:
    """(rid, tie): the id, a null one as the least, and a hash of the text, then of all other columns: rows with equal keys are alike in all."""
    others = [docs[c] for c in docs.columns if c != "text"]
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce(docs["text"], F.lit("")), F.to_json(F.struct(*others)))


def keep_one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row, that of the least doc_id (nulls first, then by a hash of the row), of each group of exact and near copies; all columns stay.

    Near copies are texts whose sets of word shingles have this Jaccard similarity or more; groups are the components of all such pairs.
    Texts whose fingerprints (of distinct shingles) are found within DISTANCE by the pigeonhole search are candidates. So many bits do not tell most pairs at a similarity
    like 0.8 from others, so further candidates are sought: texts are sketched by PARTS * PART min-hash symbols in partitions of PART; two sketches that agree in a whole partition make a
    candidate pair (pigeonhole: fewer than PARTS symbols apart they must, further apart they do with the probability told above), unless MAX_APART rules it out.
    First the fingerprints' candidates and each key's most shared text against its others are tried, then every pair that shares a key of up to CROWD texts and is
    not in one group yet. Where more share a key, all texts meet one by what they do not share with it (residual_pairs, exact), so that a
    large group is not tried pair by pair, however its texts differ. Every candidate is verified on its whole texts;
    texts with the same words (ASCII letters lower-cased) are copies.

    Nulls, edges: a null text is an empty one, and texts without words are copies of one another; rows alike in all columns leave one;
    very long texts are sketched and compared whole; columns of any name pass through; an empty table gives no rows.
    """

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([compress(x.as_py().encode("utf-8")) for x in batch.column(2)], pa.binary())], ["rid", "tie", "z"])

    rid, tie = _row_key(docs)
    rows = docs.select(rid.alias("rid"), tie.alias("tie"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    with small_batches(docs.sparkSession):
        groups = _groups(rows, shingle)
        keys = groups.select("id", "n", "signs", F.explode("keys").alias("s"))
        shared = stored(keys.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"), "near-keys")
        live = stored(keys.join(shared, "s"), "near-live")
        tried = stored(alike_pairs(groups).unionByName(centre_pairs(live, similarity)).distinct(), "near-candidates")
        met = live.select("id").unionByName(tried.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
        asked = groups.join(met, "id").select("id", "first.rid", "first.tie")
        texts = stored(rows.mapInArrow(squeezed, "rid long, tie long, z binary").join(asked, ["rid", "tie"]).dropDuplicates(["id"]).select("id", "z"), "near-texts")
        near = stored(verified(tried, texts, shingle, similarity), "near-links")
        found = connected(near, "near-copies")
        mixed = mixed_keys(live, found)
        direct, crowded = residual_pairs(residuals(mixed, texts, shingle), similarity)
        rest = stored(other_pairs(mixed, similarity).unionByName(crowded).distinct().join(tried, ["a", "b"], "left_anti"), "near-candidates")
        more = stored(verified(rest, texts, shingle, similarity).unionByName(direct), "near-links")
        if not more.isEmpty():
            found = connected(near.unionByName(more), "near-copies")
    label = groups.join(found, groups["id"] == found["node"], "left").select("first", F.coalesce("component", "id").alias("label"))
    kept = label.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("_kept_rid"), F.col("first.tie").alias("_kept_tie"))
    keyed = docs.withColumn("_row_rid", rid).withColumn("_row_tie", tie)
    held = keyed.join(kept, (keyed["_row_rid"] == kept["_kept_rid"]) & (keyed["_row_tie"] == kept["_kept_tie"]), "left_semi")
    return held.dropDuplicates(["_row_rid", "_row_tie"]).select(*docs.columns)

"""Quality rules as a bitmask ledger, in DataFrame functions only.

ledger() measures every document once and stores, beside the measurements, one failure bit for each rule.
A policy is a version, a mask of the rules it applies and the number of failures it takes to drop a document;
verdicts() applies one to a stored ledger without measuring again. ablations() tells, from bitwise
aggregates of the ledger alone, how many documents each rule drops and how many it alone drops.

Nulls, edges: a null or empty text has no words, so all measurements are 0 and the rule on few words fails;
a null doc_id stays null; repeated rows keep a row each; very long texts are measured whole; of equal lines the first is no duplicate; a measurement equal
to its limit does not fail; other columns are not read, so none can clash; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import SPACE, documents, id_text, stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Rule by bit: name and failure condition over the measurements. Whole numbers only, so that results are exact.
RULES: list[tuple[str, str]] = [
    ("few_words", f"n_words < {MIN_WORDS}"),
    ("repeated_words", f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 16 * n_words"),
    ("upper_case", "2 * n_upper > word_chars"),
    ("exclamations", "5 * n_exclaim > n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim"]


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int
    failures: int = 1  # a document with so many failed rules of the mask goes


BASE = Policy("base-1", BIT["few_words"] | BIT["repeated_words"])
STRICT = Policy("strict-1", (1 << len(RULES)) - 1)


INDEX_BITS = 20  # a window's place in its document, in the low bits of its sort key


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable, unlike a column, is never put in place again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(starts: Column) -> Column:
    """Words in windows at these ascending starts: a window adds its words up to the next window's start."""
    return F.aggregate(F.transform(starts, lambda i, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(starts, k + 1) - i, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)


def _repeat_words(words: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more.

    Windows are 64-bit hashes; sorting brings equal ones together. The sort key is the hash's upper 44 bits and the
    window's place, a plain long; where two different hashes share those bits, or a document has more windows than
    places, the pairs of whole hash and place are sorted instead.
    """
    low = (1 << INDEX_BITS) - 1
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    place = lambda p: p.bitwiseAND(F.lit(low))

    def from_hashes(h: Column) -> Column:
        keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))

        def from_keys(v: Column) -> Column:
            upper = lambda p: F.shiftright(p, INDEX_BITS)
            twice = F.filter(v, lambda p, k: F.coalesce(upper(p) == upper(F.get(v, k - 1)), F.lit(False)) | F.coalesce(upper(p) == upper(F.get(v, k + 1)), F.lit(False)))

            def from_twice(t: Column) -> Column:
                whole = lambda p: F.get(h, place(p).cast("int"))
                mixed = F.exists(F.transform(t, lambda p, k: (k > 0) & (upper(p) == upper(F.get(t, k - 1))) & (whole(p) != whole(F.get(t, k - 1)))), lambda x: F.coalesce(x, F.lit(False)))
                return F.when(mixed, _let(exact(h), _covered)).otherwise(_let(F.sort_array(F.transform(t, place)), _covered))

            return _let(twice, from_twice)

        return F.when(F.size(h) > low, _let(exact(h), _covered)).otherwise(_let(keys, from_keys))

    def exact(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        same = lambda v: F.sort_array(F.transform(F.filter(v, lambda x, k: F.coalesce(x["h"] == F.get(v, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(v, k + 1)["h"], F.lit(False))), lambda x: x["i"]))
        return _let(pairs, same)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(_let(words, hashes), from_hashes))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES for each row of docs."""
    text = F.col("text")
    parts = id_text(docs).select(
        "doc_id",
        F.array_remove(F.split(text, SPACE), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_replace(text, r"[^#*$%&|<>!\p{Lu}]+", "").alias("marks"),
    )
    long = lambda c: c.cast("long")
    only = lambda letters: long(F.length(F.regexp_replace("marks", letters, "")))
    return parts.select(
        "doc_id",
        long(F.size("words")).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        only(r"[!\p{Lu}]+").alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        only(r"[^\p{Lu}]+").alias("n_upper"),
        only(r"[^!]+").alias("n_exclaim"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES and failed, the failure bits of RULES."""
    failed = F.lit(0).cast("long")
    for name, fails in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("failed", failed)


def verdicts(kept_ledger: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The ledger with policy (its version), base_failed and kept; what the base policy drops stays dropped."""
    base_failed = F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0
    dropped = F.bit_count(F.col("failed").bitwiseAND(F.lit(policy.mask))) >= policy.failures
    return kept_ledger.select("*", F.lit(policy.version).alias("policy"), base_failed.alias("base_failed"), (~base_failed & ~dropped).alias("kept"))


def ablations(kept_ledger: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """A row for each rule of the policy: documents that fail it, documents only it drops, and the other rules that its failures share."""
    bits = F.col("failed").bitwiseAND(F.lit(policy.mask))
    masks = kept_ledger.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in BIT if BIT[name] & policy.mask]
    alone = F.bit_count("bits") == policy.failures
    return (
        masks.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
        .where(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
        .groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit"))
        .agg(F.sum("n").alias("n_failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only_this"), F.bit_or("bits").alias("shared_with"))
        .select("rule", "bit", "n_failed", "n_only_this", F.col("shared_with").bitwiseAND(F.bitwise_not("bit")).alias("shared_with"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = verdicts(stored(ledger(documents(spark, sf_dir)), "quality-ledger"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "n_lines", "n_upper", "n_exclaim")


def ablations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both policies' ablations, from one stored ledger: nothing is measured twice."""
    kept = stored(ledger(documents(spark, sf_dir)), "quality-ledger")
    tables = [ablations(kept, p).withColumn("policy", F.lit(p.version)) for p in (BASE, STRICT)]
    return tables[0].unionByName(tables[1])


_JUDGED = r"""
WITH base AS (
    SELECT doc_id, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), numbered AS (
    SELECT doc_id, unnest(list_zip(words[:-3], words[2:-2], words[3:])) AS w, unnest(range(1, len(words) - 1)) AS i
    FROM base WHERE len(words) > 3
), windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM numbered
), covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
    FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id
), measured AS (
    SELECT base.doc_id, CAST(len(words) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words,
           CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS BIGINT) AS n_upper,
           CAST(length(regexp_replace(text, '[^!]+', '', 'g')) AS BIGINT) AS n_exclaim
    FROM base LEFT JOIN covered USING (doc_id)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT)
           + 4 * CAST(10 * n_symbols > n_words AS BIGINT) + 8 * CAST(10 * n_dup_lines > 3 * n_lines AS BIGINT)
           + 16 * CAST(word_chars < 2 * n_words AS BIGINT) + 32 * CAST(word_chars > 16 * n_words AS BIGINT)
           + 64 * CAST(2 * n_upper > word_chars AS BIGINT)
           + 128 * CAST(5 * n_exclaim > n_words AS BIGINT) AS failed
    FROM measured
)"""
ORACLE_SQL = f"""{_JUDGED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = 0 AS kept,
       failed, n_lines, n_upper, n_exclaim
FROM judged
"""
ABLATIONS_SQL = f"""{_JUDGED},
policies AS (SELECT 'base-1' AS policy, 3 AS mask UNION ALL SELECT 'strict-1', 255),
rules AS (SELECT CAST(1 << k AS BIGINT) AS bit, rule FROM (SELECT unnest(['few_words', 'repeated_words', 'symbols', 'duplicate_lines', 'short_words', 'long_words', 'upper_case', 'exclamations']) AS rule, unnest(range(8)) AS k)),
applied AS (SELECT policy, failed & mask AS bits FROM judged, policies)
SELECT policy, rule, bit, count(*) AS n_failed, count(*) FILTER (WHERE bits = bit) AS n_only_this, xor(bit_or(bits), bit) AS shared_with
FROM applied JOIN rules ON bits & bit <> 0 GROUP BY policy, rule, bit
"""

"""Content identifiers as column expressions: digest, multihash, codec and multibase, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.blake3 import blake3_hex

#: Codec byte, then multihash code and digest length of each algorithm, in hex.
CODEC = "71"
MULTIHASH = {"sha2-256": "1220", "blake3": "1e20"}
_BASE32_DIGITS, _BASE32_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "abcdefghijklmnopqrstuvwxyz234567"


def base32(hex_digits: Column, groups: int) -> Column:
    """Lower-case, unpadded base 32 of groups x 10 hex digits (40 bits become 8 letters)."""
    parts = [F.lpad(F.conv(F.substring(hex_digits, 10 * g + 1, 10), 16, 32), 8, "0") for g in range(groups)]
    return F.translate(F.concat(*parts), _BASE32_DIGITS, _BASE32_LETTERS)


def digest_hex(data: Column, algo: str = "sha2-256") -> Column:
    return F.sha2(data, 256) if algo == "sha2-256" else blake3_hex(data)


def id_of_digest(hex_digits: Column, algo: str = "sha2-256") -> Column:
    return F.concat(F.lit("b"), base32(F.concat(F.lit(CODEC + MULTIHASH[algo]), hex_digits), 7))


def content_id(data: Column, algo: str = "sha2-256") -> Column:
    """The 57-letter identifier of some bytes."""
    return id_of_digest(digest_hex(data, algo), algo)


def is_content_id(column: Column) -> Column:
    return column.rlike("^b[a-z2-7]{56}$")

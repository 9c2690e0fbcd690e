"""Ownership and access decisions as CASE expressions over a left join of requests and owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "owner-"


def password_hash(user: Column, password: Column) -> Column:
    return F.sha2(F.concat(user, F.lit(":"), password), 256)


def owner_token(user: Column, password: Column) -> Column:
    return F.concat(F.lit(PREFIX), password_hash(user, password))


def first_line(text: Column) -> Column:
    """A stored token's text up to its line ending."""
    return F.regexp_replace(text, r"(?s)[\r\n].*", "")


def _protected(stored: Column) -> Column:
    return F.coalesce(stored.startswith(PREFIX), F.lit(False))


def may_download(stored: Column, token: Column) -> Column:
    """Files without an owner, or whose stored token is none of ours, are open; others need that very token."""
    return ~_protected(stored) | stored.eqNullSafe(token)


def may_delete(stored: Column, token: Column, strict: bool = True) -> Column:
    """As for downloads where there is an owner; without one only a caller without token may (strict), or nobody."""
    return F.when(stored.isNull(), token.isNull() if strict else F.lit(False)).otherwise(may_download(stored, token))


def decide(requests: DataFrame, owners: DataFrame, manifests: DataFrame) -> DataFrame:
    """requests (cid, token, …) with download (OK, AUTH_ERROR or DOWNLOAD_ERROR) and can_delete. Access comes before existence."""
    o, m = owners.select("cid", F.col("token").alias("_owner")), manifests.select("cid", F.lit(True).alias("_there")).distinct()
    joined = requests.join(o, "cid", "left").join(m, "cid", "left")
    download = F.when(~may_download(F.col("_owner"), F.col("token")), "AUTH_ERROR").when(F.col("_there").isNull(), "DOWNLOAD_ERROR").otherwise("OK")
    return joined.withColumn("download", download).withColumn("can_delete", may_delete(F.col("_owner"), F.col("token"))).drop("_owner", "_there")


def signed_in(requests: DataFrame) -> DataFrame:
    """The requests of sessions that hold both a user and a token; the others are turned away."""
    held = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return requests.where(held("username") & held("token"))


def listing(owners: DataFrame, manifests: DataFrame) -> DataFrame:
    """token, cid, filename, size of owned files; a file without manifest is listed under its identifier with size 0."""
    m = manifests.select("cid", F.col("filename").alias("_name"), F.col("total_size").alias("_size")).dropDuplicates(["cid"])
    name = F.coalesce(F.when(F.col("_name") != "", F.col("_name")), F.col("cid"))
    return owners.where("token IS NOT NULL").join(m, "cid", "left").select("token", "cid", name.alias("filename"), F.coalesce("_size", F.lit(0)).alias("size"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz234567"


def listing_pages(listed: DataFrame, page_files: int = 1000) -> DataFrame:
    """token, page and response: each token's files as JSON arrays of about page_files, so that no caller's files meet in one cell.

    A file's page follows from its identifier's last four letters, its place in a page from the identifier.
    """
    place = sum((F.instr(F.lit(_LETTERS), F.substring("cid", -k, 1)) - 1) * 32 ** (k - 1) for k in range(1, 5))
    pages = listed.groupBy("token").agg(F.ceil(F.count("*") / page_files).alias("_pages"))
    paged = listed.join(pages, "token").select("token", F.floor(place * F.col("_pages") / 32**4).alias("page"), "cid", "filename", "size")
    return paged.groupBy("token", "page").agg(F.to_json(F.sort_array(F.collect_list(F.struct("cid", "filename", "size")))).alias("response"))

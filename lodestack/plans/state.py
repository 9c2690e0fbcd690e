"""Queries over the log: owners, access, listings, counts, garbage, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import wire
from lodestack.operators import acl, lifecycle, manifest, session, writes
from lodestack.sources import foreign
from lodestack.sources import tables as T


def _owners_and_manifests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = T.stored_uploads(spark, d)
    return lifecycle.owners(T.log(m)), m


def list_files(spark: SparkSession, d: str) -> DataFrame:
    return acl.listing(*_owners_and_manifests(spark, d))


def list_missing_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Listings when the manifests of Spanish uploads are lost."""
    o, m = _owners_and_manifests(spark, d)
    return acl.listing(o, m.where("filename <> 'es.txt'"))


def list_unauthenticated(spark: SparkSession, d: str) -> DataFrame:
    """How many files a caller with each source's token is listed; one without a token gets none."""
    o, m = _owners_and_manifests(spark, d)
    source = T.table(spark, d, "documents").select("source").distinct()
    callers = source.select("source", T.token_of(F.col("source")).alias("token")).unionByName(spark.sql("SELECT 'nobody' AS source, CAST(NULL AS STRING) AS token"))
    n = acl.listing(o, m).groupBy("token").agg(F.count("*").alias("n"))
    return callers.join(n, "token", "left").select("source", F.coalesce("n", F.lit(0)).alias("n_files"))


def list_json(spark: SparkSession, d: str) -> DataFrame:
    """Each caller's files in pages of about 20; a response of the protocol is the pages of one caller, in order."""
    return acl.listing_pages(acl.listing(*_owners_and_manifests(spark, d)), 20)


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every file asked for by its owner, by another and by nobody; French manifests are lost; src2's tokens are stored without prefix."""
    m = T.stored_uploads(spark, d)
    plain = F.when(F.col("token") == T.token_of(F.lit("src2")), F.substring_index("token", "-", -1)).otherwise(F.col("token"))
    o = T.log(m).groupBy("cid").agg(F.max_by("token", "seq").alias("token")).where("token IS NOT NULL").withColumn("token", plain)
    cids = m.select("cid").distinct().join(o, "cid", "left")
    caller = F.array(F.struct(F.lit("owner").alias("who"), F.col("token").alias("t")), F.struct(F.lit("other").alias("who"), T.token_of(F.lit("someone")).alias("t")), F.struct(F.lit("nobody").alias("who"), F.lit(None).cast("string").alias("t")))
    asked = cids.select("cid", F.explode(caller).alias("c")).select("cid", "c.who", F.col("c.t").alias("token"))
    return asked, o, m.where("filename <> 'fr.txt'")


def download_decision(spark: SparkSession, d: str) -> DataFrame:
    return acl.decide(*_requests(spark, d)).select("cid", "who", "download")


def delete_decision(spark: SparkSession, d: str) -> DataFrame:
    return acl.decide(*_requests(spark, d)).select("cid", "who", "can_delete")


def _refs(made: DataFrame, deletes: bool) -> DataFrame:
    return lifecycle.refcounts(lifecycle.uploads(T.log(made, deletes)), manifest.explode_chunks(made.select("cid", "chunks").dropDuplicates(["cid"]), "cid").select("cid", "hash"))


def refcounts(spark: SparkSession, d: str) -> DataFrame:
    return _refs(T.stored_uploads(spark, d), deletes=False)


def refcounts_after_delete(spark: SparkSession, d: str) -> DataFrame:
    return _refs(T.stored_uploads(spark, d), deletes=True).where("live_refs > 0").select("hash", "live_refs")


def gc_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of deleted files that no live one shares, and orphans: those of uploads whose declared size (their characters) was wrong are not in any manifest, but stored."""
    made = T.stored_uploads(spark, d)
    chunks = manifest.explode_chunks(made, "file_id").select("hash", "size")
    return lifecycle.garbage(chunks.dropDuplicates(["hash"]), _refs(made, deletes=True))


def live_files_after_delete(spark: SparkSession, d: str) -> DataFrame:
    made = T.stored_uploads(spark, d)
    return made.select("cid", "filename", "total_size").dropDuplicates(["cid"]).join(lifecycle.live(T.log(made, deletes=True)), "cid", "left_semi")


def resume_plan(spark: SparkSession, d: str) -> DataFrame:
    """Uploads broken off after half their chunks: what is left to send; the token is kept and the total counts all chunks."""
    m = T.stored_uploads(spark, d)
    progress = m.select("file_id", F.floor(F.col("chunk_count") / 2).alias("committed"), "token", "total_size")
    left = lifecycle.remaining(manifest.explode_chunks(m, "file_id"), progress)
    counted = left.groupBy("file_id").agg(F.min("idx").alias("next_index"), F.count("*").alias("n_left"), F.sum("size").alias("bytes_left"))
    return progress.join(counted, "file_id").select("file_id", "token", "total_size", "next_index", "n_left", "bytes_left")


def owner_last_writer(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.owners(T.log(T.stored_uploads(spark, d)))


def auth_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A sign-in with the right, a wrong and an unknown name; see q45 for sign-ups."""
    sources = T.table(spark, d, "documents").select("source").distinct()
    users = sources.select(F.col("source").alias("username"), acl.password_hash(F.col("source"), F.concat(F.lit("pw-"), "source")).alias("password_hash"))
    attempt = lambda name, user, password: F.struct(F.lit(name).alias("attempt"), user.alias("u"), password.alias("p"))
    user = F.col("username")
    tries = F.array(attempt("right", user, F.concat(F.lit("pw-"), user)), attempt("wrong", user, F.lit("guess")), attempt("unknown", F.concat(user, F.lit("?")), F.lit("guess")))
    asked = users.select(F.explode(tries).alias("t")).select("t.attempt", F.col("t.u").alias("username"), acl.password_hash(F.col("t.u"), F.col("t.p")).alias("given"))
    checked = asked.join(users, "username", "left")
    ok = F.coalesce(F.col("given") == F.col("password_hash"), F.lit(False))
    return checked.select("username", "attempt", ok.alias("ok"), F.when(ok, F.concat(F.lit(acl.PREFIX), "given")).alias("token"))


def frame_codec(spark: SparkSession, d: str) -> DataFrame:
    f = T.frames(spark, d)
    framed = f.select("conn_id", "seq", wire.encode_frame(F.lit(wire.OPS["UPLOAD_CHUNK"]), F.col("payload")).alias("frame"), "payload")
    back = framed.select("*", wire.decode_frame(F.col("frame")).alias("x"), wire.decode_frame(F.expr("substring(frame, 1, octet_length(frame) - 1)")).alias("cut"))
    start = wire.start_payload(F.octet_length("payload"), F.concat_ws("-", "conn_id", "seq"))
    return back.select(
        "conn_id", "seq", F.lower(F.hex(F.substring(F.col("frame"), 1, 5))).alias("head"), F.sha2("frame", 256).alias("frame_sha256"), F.col("x.op").cast("int").alias("op"), F.col("x.length").alias("length"),
        (F.col("x.payload") == F.col("payload")).alias("same"), F.col("cut").isNull().alias("cut_detected"), F.lower(F.hex(start)).alias("start_hex"), wire.unsigned(start, 1, 8).alias("declared"),
    )


def _scripted(spark: SparkSession, d: str) -> DataFrame:
    """Frames of every conversation as a connection: AUTH, START, its turns as CHUNKs, FINISH; one in five is sound, the others go wrong by their number's rest after division by 5."""
    c = T.table(spark, d, "conversations")
    text = F.encode("text", "utf-8")
    conn = c.groupBy("conv_id").agg(F.max("turn").alias("last"), F.sum(F.octet_length(text)).cast("long").alias("bytes"))
    fault = F.pmod("conv_id", F.lit(5))
    name = F.encode(F.concat(F.lit("chat-"), F.col("conv_id").cast("string")), "utf-8")
    size = wire.big_endian(F.when(fault == 1, F.col("bytes") + 1).otherwise(F.col("bytes")), 8)
    frame = lambda seq, op, payload: F.struct(seq.cast("long").alias("seq"), F.lit(wire.OPS[op]).alias("op"), payload.alias("payload"))
    start = F.when(fault == 2, F.substring(F.concat(size, name), 1, 7)).otherwise(F.concat(size, name))
    head = [frame(F.lit(0), "AUTH", F.when(fault == 3, F.lit(b"")).otherwise(F.lit(b"owner-x"))), frame(F.lit(1), "UPLOAD_START", start)]
    end = [frame(F.col("last") + 10, "UPLOAD_START", start), frame(F.col("last") + 11, "UPLOAD_FINISH", F.lit(b""))]
    around = conn.select("conv_id", F.explode(F.array(*head, F.when(fault == 4, end[0]), end[1])).alias("f")).where("f IS NOT NULL")
    chunks = c.select("conv_id", frame(F.col("turn") + 2, "UPLOAD_CHUNK", text).alias("f"))
    return around.unionByName(chunks).select(F.col("conv_id").alias("conn_id"), "f.seq", "f.op", "f.payload")


def session_errors(spark: SparkSession, d: str) -> DataFrame:
    return session.run_sessions(_scripted(spark, d))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The same frames as a stream from files, with state kept between batches."""
    from lodestack.streaming.sessions import run_to_end

    root = T.shared_path(spark, "frames")
    frames = _scripted(spark, d)
    frames.write.parquet(f"{root}/in")
    source = spark.readStream.schema(frames.schema).parquet(f"{root}/in")
    run_to_end(source, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(session.SCHEMA).parquet(f"{root}/out")


def name_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """French uploads have a blank name: stored as `unnamed`, and shown under its identifier where the manifest has none."""
    f = T.document_files(spark, d).withColumn("filename", F.when(F.col("lang") == "fr", "").otherwise(F.col("filename")))
    m = manifest.of_files(f.select("file_id", "filename", "content", F.col("filename").alias("given")), T.CHUNK)
    return m.select("file_id", F.col("filename").alias("stored_name"), F.coalesce(F.when(F.col("given") != "", F.col("given")), F.col("cid")).alias("shown_name"))


def owner_path_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Owner files' paths and texts, with either line ending, parsed back."""
    owned = lifecycle.owners(T.log(T.stored_uploads(spark, d))).where("token IS NOT NULL")
    ending = F.when(F.col("cid").endswith("a"), "\r\n").otherwise("\n")
    written = owned.select(F.concat_ws("/", F.lit("owners"), F.concat("cid", F.lit(".owner"))).alias("path"), F.concat("token", ending).alias("text"))
    return foreign.owners(written).select("cid", "token", F.col("token").startswith(acl.PREFIX).alias("is_owner"))


def response_classify(spark: SparkSession, d: str) -> DataFrame:
    """Replies by kind: each file's identifier for English ones, a sentinel or nothing for the rest."""
    m = T.manifests(T.uploads(spark, d))
    reply = F.when(F.col("filename") == "en.txt", F.col("cid")).when(F.col("filename") == "de.txt", "UPLOAD_ERROR").when(F.col("filename") == "fr.txt", "AUTH_ERROR").otherwise("")
    replies = m.select("file_id", reply.alias("reply"))
    return replies.select("file_id", F.when(~wire.reply_failed(F.col("reply")), F.col("reply")).alias("cid"))


def users_from_json(spark: SparkSession, d: str) -> DataFrame:
    """A users file for each language's sources, as its text; the Spanish one is malformed and so has no users."""
    s = T.table(spark, d, "documents").select("lang", "source").distinct()
    entry = F.concat(F.lit('"'), "source", F.lit('": {"password_hash": "'), acl.password_hash(F.col("source"), F.lit("x")), F.lit('", "created_at": 1700000000.5}'))
    body = s.groupBy("lang").agg(F.array_join(F.sort_array(F.collect_list(entry)), ", ").alias("b"))
    texts = body.select("lang", F.concat(F.when(F.col("lang") == "es", "").otherwise("{"), "b", F.lit("}")).alias("text"))
    got = foreign.users(texts)
    return got.select("username", "password_hash", F.unix_millis("created_at").alias("created_ms")).distinct()


def _put_all(spark: SparkSession, d: str) -> str:
    """A store to which the uploads went in two batches, those with odd places after the others."""
    root = T.shared_path(spark, "store")
    up = T.uploads(spark, d).select(F.col("file_id").alias("seq"), "filename", "content", "token")
    for odd in (0, 1):
        writes.put_files(up.where(F.pmod("seq", F.lit(2)) == odd), root, T.CHUNK)
    return root


def put_files(spark: SparkSession, d: str) -> DataFrame:
    """What is there after the uploads were put, with how many blocks the store holds beside each file."""
    root = _put_all(spark, d)
    n = spark.read.parquet(f"{root}/blocks").agg(F.count("*").alias("n_blocks"), F.sum("size").alias("stored_bytes"))
    return writes.live_files(spark, root).crossJoin(F.broadcast(n))  # one row


def _delete_requests(files: DataFrame) -> DataFrame:
    """A request for every file, by its owner, another or nobody as its size's rest after division by 3 has it; and one for a file that never was."""
    who = F.pmod("total_size", F.lit(3))
    caller = F.when(who == 0, F.col("token")).when(who == 1, T.token_of(F.lit("someone")))
    asked = files.select((F.lit(1 << 40) + F.col("total_size")).alias("seq"), "cid", caller.alias("token"))
    return asked.unionByName(files.sparkSession.sql(f"SELECT {1 << 50} AS seq, 'nothing' AS cid, CAST(NULL AS STRING) AS token"))


def delete_files(spark: SparkSession, d: str) -> DataFrame:
    """The requests' outcomes, and whether the file is there afterwards."""
    root = _put_all(spark, d)
    out = writes.delete_files(_delete_requests(writes.live_files(spark, root)), root)
    there = writes.session_files(spark, root).select("cid", "there")
    return out.join(there, "cid", "left").select("cid", "outcome", F.coalesce("there", F.lit(False)).alias("there"))


def create_users(spark: SparkSession, d: str) -> DataFrame:
    """A sign-up from every document, those with even places first: one of each name is a user, the others are turned away."""
    root = T.shared_path(spark, "users")
    up = T.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("username"), acl.password_hash(F.col("source"), F.concat(F.lit("pw-"), F.col("doc_id").cast("string"))).alias("password_hash"))
    tried = [writes.create_users(up.where(F.pmod("seq", F.lit(2)) == odd), root) for odd in (0, 1)]
    turned = tried[0].unionByName(tried[1]).groupBy("username").agg(F.count(F.when(~F.col("created"), 1)).alias("n_turned_away"))
    return writes.users(spark, root).select("username", "password_hash", F.col("created_at").isNotNull().alias("dated")).join(turned, "username")


def resume_requests(spark: SparkSession, d: str) -> DataFrame:
    """Uploads whose progress was saved after half their chunks, every third of which was then done; a request to go on with each, every seventh under an unknown name, every eleventh under none."""
    root = T.shared_path(spark, "progress")
    m = manifest.of_files(T.document_files(spark, d).select("file_id", "filename", "content"), T.CHUNK)
    name = F.substring(F.concat_ws("-", "filename", F.lit("1700000000")), 1, 255)
    saved = m.select((2 * F.col("file_id")).alias("seq"), name.alias("upload_id"), F.floor(F.col("chunk_count") / 2).alias("committed"), "total_size", F.lit(None).cast("string").alias("token"), F.lit(False).alias("done"), "file_id")
    done = saved.where("file_id % 3 = 0").withColumn("seq", F.col("seq") + 1).withColumn("done", F.lit(True))
    writes.save_progress(saved, root)
    writes.save_progress(done, root)
    asked = F.when(F.col("file_id") % 11 == 0, "").when(F.col("file_id") % 7 == 0, F.concat(F.lit("x-"), "upload_id")).otherwise(F.col("upload_id"))
    return writes.resume(saved.select("file_id", asked.alias("upload_id")), root).select("file_id", "reply", "next_index")


def session_access(spark: SparkSession, d: str) -> DataFrame:
    """Connections of each file's owner, of another and of nobody: sign in, download it twice, delete it, list files. French files are lost; every fifth deletes without a name."""
    m = T.stored_uploads(spark, d)
    one = m.groupBy("cid").agg(F.min("file_id").alias("file_id"), F.first("filename").alias("filename"))
    files = one.join(lifecycle.owners(T.log(m)), "cid")
    known = files.select("cid", F.col("token").isNotNull().alias("owned"), F.col("token").alias("owner"), (F.col("filename") != "fr.txt").alias("there"))
    who = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), t.alias("t")) for k, t in enumerate((F.col("token"), T.token_of(F.lit("someone")), F.lit(None).cast("string")))]))
    conns = files.select((F.col("file_id") * 3).alias("c"), "file_id", "cid", who.alias("w")).select((F.col("c") + F.col("w.k")).alias("conn_id"), "file_id", "cid", F.col("w.t").alias("t"))
    bytes_of = lambda c: F.encode(c, "utf-8")
    gone = F.when(F.col("file_id") % 5 == 0, F.lit("")).otherwise(F.col("cid"))
    script = [("DOWNLOAD_START", F.col("cid")), ("DOWNLOAD_START", F.col("cid")), ("DELETE_FILE", gone), ("LIST_FILES", F.lit(""))]
    frames = [F.struct(F.lit(k).cast("long").alias("seq"), F.lit(wire.OPS[op]).alias("op"), bytes_of(p).alias("payload")) for k, (op, p) in enumerate(script, 1)]
    sign_in = F.when(F.col("t").isNotNull(), F.struct(F.lit(0).cast("long").alias("seq"), F.lit(wire.OPS["AUTH"]).alias("op"), bytes_of(F.col("t")).alias("payload")))
    said = conns.select("conn_id", F.explode(F.array(sign_in, *frames)).alias("f")).where("f IS NOT NULL").select("conn_id", "f.seq", "f.op", "f.payload")
    return session.run_sessions(said, known).select("conn_id", "seq", "event", "detail")


def session_resume(spark: SparkSession, d: str) -> DataFrame:
    """Connections that go on with an upload: even ones' is in progress, odd ones' is not, every fifth asks without a name; then a chunk and the end."""
    ids = T.table(spark, d, "documents").select(F.col("doc_id").alias("conn_id"))
    name = F.concat(F.lit("up-"), F.col("conn_id").cast("string"))
    asked = F.when(F.col("conn_id") % 5 == 0, "").otherwise(name)
    frames = [F.struct(F.lit(k).cast("long").alias("seq"), F.lit(wire.OPS[op]).alias("op"), F.encode(p, "utf-8").alias("payload")) for k, (op, p) in enumerate((("UPLOAD_RESUME", asked), ("UPLOAD_CHUNK", F.lit("more")), ("UPLOAD_FINISH", F.lit(""))))]
    said = ids.select("conn_id", F.explode(F.array(*frames)).alias("f")).select("conn_id", "f.seq", "f.op", "f.payload")
    return session.run_sessions(said, uploads=ids.where("conn_id % 2 = 0").select(name.alias("upload_id")))


def signed_in(spark: SparkSession, d: str) -> DataFrame:
    """Requests of sessions: each document's source as the user, none in French ones; a token but in Spanish ones, an empty one in German ones."""
    token = F.when(F.col("lang") == "de", "").when(F.col("lang") != "es", T.token_of(F.col("source")))
    asked = T.table(spark, d, "documents").select("doc_id", F.when(F.col("lang") != "fr", F.col("source")).alias("username"), token.alias("token"))
    return acl.signed_in(asked)

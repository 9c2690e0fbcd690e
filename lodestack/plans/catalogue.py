"""Every query by name, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestack.plans import files, oracle, state

_IN_ORDER = [
    files.chunk_documents, files.chunk_cid, files.unique_blocks, files.dedup_report, files.new_blocks, files.build_manifests, files.parse_manifest, files.explode_manifest,
    state.list_files, state.list_missing_manifest, state.list_unauthenticated, files.reassemble, state.download_decision, state.delete_decision, files.verify_blocks,
    files.size_mismatch, files.declared_size_check, state.refcounts, state.refcounts_after_delete, state.gc_candidates, state.live_files_after_delete, state.resume_plan,
    state.owner_last_writer, files.rechunk_frames, files.upload_progress, state.auth_tokens, state.frame_codec, files.shard_distribution, files.same_bytes_other_name,
    state.list_json, state.session_errors, state.stream_sessions, files.blake3_cids, state.name_fallbacks, state.owner_path_roundtrip, state.response_classify,
    files.empty_inputs, state.users_from_json, files.block_exists, files.upload_ids, files.client_slices, files.foreign_import,
    state.put_files, state.delete_files, state.create_users, state.resume_requests, state.session_access, state.session_resume, state.signed_in,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"q{k:02}_{f.__name__}": f for k, f in enumerate(_IN_ORDER, 1)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)

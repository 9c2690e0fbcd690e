"""Upload sessions as a stream: frames in, outcomes out, with each connection's state kept and checkpointed by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestack.operators.session import SCHEMA, Session, control

STATE = "closed boolean, token string, declared long, filename string, received long, last long"
#: Fixed value: a client gives up after so long without an answer.
IDLE_MS = 30_000


def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, timed: bool) -> Iterator[pd.DataFrame]:
    """A connection's frames of a micro-batch, or its time-out, which ends it and forgets it. A closed connection leaves a mark, so that later frames are not read, until then."""
    session, last, out = Session(), -1, []
    if state.exists:
        *fields, last = state.get
        session = Session(*fields)
    if state.hasTimedOut:
        ended = session.end()
        out = [(key[0], last + 1, *ended, session.received)] if ended else []
        state.remove()
    else:
        frames = pd.concat(list(parts)).sort_values("seq", kind="stable")  # lengths and names, no bytes of chunks
        for _, seq, op, length, payload, owned, owner, there in frames.itertuples(index=False):
            if event := session.step(int(op), int(length), bytes(payload) if payload is not None else b"", bool(owned), owner, bool(there)):
                out.append((key[0], int(seq), *event, session.received))
            last = int(seq)
        state.update((True, None, None, "", 0, last) if session.closed else (False, session.token, session.declared, session.filename, session.received, last))
        if timed:
            state.setTimeoutDuration(IDLE_MS)
    yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])


def session_stream(frames: DataFrame, timed: bool = True, files: DataFrame | None = None, uploads: DataFrame | None = None) -> DataFrame:
    """frames: a streaming DataFrame (conn_id, seq, op, payload); frames of a connection come in order from batch to batch. timed: idle connections end.
    files, uploads: tables that do not stream, see control()."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return control(frames, files, uploads).groupBy("conn_id").applyInPandasWithState(lambda k, p, s: step(k, p, s, timed), SCHEMA, STATE, "append", timeout)


def run_to_end(frames: DataFrame, output: str, checkpoint: str, files: DataFrame | None = None, uploads: DataFrame | None = None) -> None:
    """Everything there is now, written as Parquet; a later call with the same checkpoint goes on from there. Without timeouts: waiting for one has no end."""
    stream = session_stream(frames, False, files, uploads).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()

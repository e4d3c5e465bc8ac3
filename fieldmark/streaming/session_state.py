"""Session state as a stream: each turn updates its session's asset, subsystem and bounded list of recent queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import asset_of, subsystem_of
from ..operators.session import QUERIES

_OUT = "session_id long, seq long, asset_id string, component string, recent_queries int"
_STATE = "asset_id string, component string, queries array<string>, last_seq long"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    asset, component, queries, last = state.get if state.exists else (None, None, [], -1)
    queries = list(queries)
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    out = []
    for r in rows.itertuples():
        if r.seq <= last:  # a turn that was seen before
            continue
        asset = r.named_asset if isinstance(r.named_asset, str) else asset
        component = r.named_component if isinstance(r.named_component, str) else component
        queries, last = [*queries, r.text or ""][-QUERIES:], int(r.seq)
        out.append((key[0], last, asset, component, len(queries)))
    state.update((asset, component, queries, last))
    yield pd.DataFrame(out, columns=["session_id", "seq", "asset_id", "component", "recent_queries"])


def session_stream(turns: DataFrame) -> DataFrame:
    """A row for each turn of a stream ``turns(session_id, seq, text)`` with its session's context after it.

    What a turn names is found by native expressions before the state operator. State is bounded by the list of queries; turns at or
    before the last one seen are dropped.
    """
    named = turns.select("session_id", F.col("seq").cast("long").alias("seq"), "text", asset_of(F.col("text")).alias("named_asset"), subsystem_of(F.col("text")).alias("named_component"))
    return named.groupBy("session_id").applyInPandasWithState(_update, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)

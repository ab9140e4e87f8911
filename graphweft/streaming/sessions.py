"""Whether a session's answers can be trusted: the first failure is remembered until it recovers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "session string, event bigint, state string, since timestamp, cause string"
_STATE = "since timestamp, cause string"


def degraded(stream: DataFrame) -> DataFrame:
    """(session, event, state, since, cause) for a stream (session, event, ts, cause): a cause means a failure, none an answer.

    From the first failure on every event is `degraded`, with that failure's time and cause; the first answer
    after it is `recovered`, with the same, so that earlier answers can be doubted; others are `ok`. Events of
    a batch are taken in the order of their numbers. One small state for each session that is degraded.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, cause = state.get if state.exists else (None, None)
        out = []
        for row in pd.concat(list(batches)).sort_values("event").itertuples(index=False):  # one session's events of one batch
            failed = isinstance(row.cause, str)
            if failed and cause is None:
                since, cause = row.ts, row.cause
            kind = "degraded" if failed else "ok" if cause is None else "recovered"
            out.append((key[0], row.event, kind, since, cause))
            if not failed:
                since, cause = None, None
        if cause is None and state.exists:
            state.remove()
        elif cause is not None:
            state.update((pd.Timestamp(since).to_pydatetime(), cause))
        yield pd.DataFrame(out, columns=["session", "event", "state", "since", "cause"]).astype({"since": "datetime64[us]"})

    return stream.groupBy("session").applyInPandasWithState(follow, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)

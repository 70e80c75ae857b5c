"""Newest value of each key in a stream, dropped from the state when it expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "user_key binary, version long, expires_at long, live boolean"


def expiring(entries: DataFrame, time: str, late: str) -> DataFrame:
    """(user_key, version, expires_at, live): a row whenever a key's newest write changes, and one with live false when it expires.

    Expiry follows event time: a key's state goes once the watermark has passed its
    `expires_at`. A deleted key has no state. Rows behind the watermark still count if
    their version is higher.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            version, expires_at = state.get
            state.remove()
            yield pd.DataFrame({"user_key": [key[0]], "version": [version], "expires_at": [expires_at], "live": [False]})
            return
        version, expires_at = state.get if state.exists else (-1, 0)
        gone = False
        before = version
        for frame in frames:
            row = frame.sort_values(["version", "seq"]).iloc[-1]
            if row["version"] > version:
                version, expires_at, gone = int(row["version"]), int(row["expires_at"]), bool(int(row["meta"]) & 1)
        if version == before:
            return
        if gone:
            state.remove()
        else:
            state.update((version, expires_at))
            if expires_at:
                state.setTimeoutTimestamp(max(expires_at * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_key": [key[0]], "version": [version], "expires_at": [expires_at], "live": [not gone]})

    rows = entries.withWatermark(time, late).groupBy("user_key")
    return rows.applyInPandasWithState(step, OUT, "version long, expires_at long", "append", GroupStateTimeout.EventTimeTimeout)

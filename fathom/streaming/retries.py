"""Retries by timers: a file that failed is tried again when its time has come, without a new listing of it.

State is a value for each file, kept with its timers in the state store and so in the stream's checkpoint. The session needs
spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

LONGEST = 3600.0
COLUMNS = ["root", "path", "sha", "state", "attempts", "due"]


class _File(StatefulProcessor):
    """One file: settling until it has been left alone, then ok, retrying with a timer, or failed until it changes."""

    def __init__(self, attempt: Callable[[str, str], bool], settle_seconds: float, retry_seconds: float, most_attempts: int):
        self.attempt, self.settle, self.retry, self.most = attempt, settle_seconds, retry_seconds, most_attempts

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("file", "sha string, state string, attempts int, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """The newest listing of a batch counts; one of the content that is kept says nothing new."""
        newest = max((m, s) for frame in rows for m, s in zip(frame["changed"].tolist(), frame["sha"].tolist(), strict=True))
        changed, sha = newest
        old = self.kept.get() if self.kept.exists() else None
        if old is not None and old[0] == sha:
            return
        if old is not None and old[3] is not None and old[1] in ("retrying", "settling"):
            self.handle.deleteTimer(int(old[3]))
        now, rests = timerValues.getCurrentProcessingTimeInMs(), int(changed + self.settle * 1000)
        yield self._keep(key, sha, "settling", 0, rests) if rests > now else self._tried(key, sha, 0, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sha, state, attempts, due = self.kept.get()
        if state in ("retrying", "settling") and due == expiredTimerInfo.getExpiryTimeInMs():
            yield self._tried(key, sha, int(attempts), timerValues.getCurrentProcessingTimeInMs())

    def _tried(self, key, sha: str, attempts: int, now: int) -> pd.DataFrame:
        try:
            ok = bool(self.attempt(*key))
        except Exception:  # noqa: BLE001 - a caller's function; a file that fails is retried
            ok = False
        if ok:
            return self._keep(key, sha, "ok", 0, None)
        attempts += 1
        wait = min(LONGEST, self.retry * 2.0 ** min(attempts - 1, 12))
        return self._keep(key, sha, "failed" if attempts >= self.most else "retrying", attempts, now + int(wait * 1000))

    def _keep(self, key, sha: str, state: str, attempts: int, due: int | None) -> pd.DataFrame:
        self.kept.update((sha, state, attempts, due))
        if state in ("retrying", "settling"):
            self.handle.registerTimer(due)
        return pd.DataFrame([(*key, sha, state, attempts, due)], columns=COLUMNS).astype({"due": "Int64"})

    def close(self) -> None:
        pass


def retrying(listings: DataFrame, attempt: Callable[[str, str], bool], settle_seconds: float = 30.0, retry_seconds: float = 60.0, most_attempts: int = 5) -> DataFrame:
    """(root, path, sha, state, attempts, next_retry) of a stream of listings (root, path, sha, modified): a row whenever a file's state changes.

    attempt(root, path) runs in a task and takes a file in; false or an error is a failure. It may run again for
    a batch that is repeated, so it must bear that. Rows without a path, as those of a root that can't be listed, change nothing.
    States and waits are those of sync.decide and sync.after; a timer takes the place of the next listing.
    """
    rows = listings.where(F.col("path").isNotNull()).select("root", "path", "sha", F.unix_millis("modified").alias("changed"))
    told = rows.groupBy("root", "path").transformWithStateInPandas(
        statefulProcessor=_File(attempt, settle_seconds, retry_seconds, most_attempts), outputStructType="root string, path string, sha string, state string, attempts int, due long",
        outputMode="Update", timeMode="ProcessingTime",
    )
    return told.select("root", "path", "sha", "state", "attempts", F.timestamp_millis("due").alias("next_retry"))

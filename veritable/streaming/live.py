"""Sliding windows and smoothing on live streams that come out of order, repeat and restart.

State per stream (``transformWithStateInPandas``, in RocksDB, checkpointed by Spark): the
position that is due, the smoothed value, the number of windows and the values a window still
needs; and a reorder buffer of values that came too early, in runs of positions, as each call
of the state store costs more than the values it carries. Values are taken in
order of position whatever batch they come in; what has been taken, or waits already, is
ignored when it comes again. So the windows equal those of the batch operators, and each
is given out once, also after a restart from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "stream string, window_idx int, frame_idx long, raw double, smoothed double, is_fake boolean"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Positions in one entry of the reorder buffer at most.
_RUN = 1 << 16


class Windows(StatefulProcessor):
    def __init__(self, window: int, step: int, alpha: float, threshold: float, patience_ms: int | None):
        self.window, self.step, self.alpha, self.threshold, self.patience = window, step, alpha, threshold, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "due long, smoothed double, windows int, held binary, waiting boolean")
        self.early = handle.getListState("early", "pos binary, x binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = [(pdf["pos"].to_numpy(np.int64), pdf["x"].to_numpy(np.float64)) for pdf in rows]
        yield from self._take(key[0], came, timerValues, skip=False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._take(key[0], [], timerValues, skip=True)

    def _take(self, stream: str, came: list[tuple[np.ndarray, np.ndarray]], timers: Any, skip: bool) -> Iterator[pd.DataFrame]:
        """Move on as far as positions follow each other; ``skip`` gives up on the one that is due."""
        due, smoothed, windows, held, waiting = self.place.get() or (1, None, 0, b"", False)
        smoothed = None if smoothed is None or smoothed != smoothed else smoothed
        waited = [(np.frombuffer(p, np.int64), np.frombuffer(x, np.float64)) for p, x in self.early.get()] if waiting else []
        before = sum(len(p) for p, _ in waited)
        pos, xs = (np.concatenate(v) for v in zip(*waited, *came)) if waited or came else (np.zeros(0, np.int64), np.zeros(0))
        # by position, of equal ones the first; what waits already stands before what came
        pos, first = np.unique(pos, return_index=True)
        ahead = pos >= due
        pos, first = pos[ahead], first[ahead]
        xs = xs[first]
        if skip and len(pos):
            due = int(pos[0])
        follows = pos - np.arange(len(pos)) == due
        k = len(pos) if follows.all() else int(np.argmin(follows))
        values = np.frombuffer(held, np.float64).tolist()
        end, at, out = due - len(values), 0, []
        values += xs[:k].tolist()
        while at + self.window <= len(values):
            raw = sum(values[at : at + self.window]) / self.window
            smoothed = raw if smoothed is None else self.alpha * raw + (1 - self.alpha) * smoothed
            out.append((stream, windows, end + at + self.window - 1, raw, smoothed, smoothed >= self.threshold))
            at, windows = at + min(self.step, self.window), windows + 1
        if k:
            self._wait(pos[k:], xs[k:], anew=True, waiting=waiting)
        else:
            self._wait(pos[first >= before], xs[first >= before], anew=False, waiting=waiting)
        early = k < len(pos)
        self.place.update((due + k, smoothed, windows, np.array(values[at:]).tobytes(), early))
        if self.patience is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if early:
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.patience)
        if out:
            yield pd.DataFrame(out, columns=["stream", "window_idx", "frame_idx", "raw", "smoothed", "is_fake"])

    def _wait(self, pos: np.ndarray, xs: np.ndarray, anew: bool, waiting: bool) -> None:
        """Add to the reorder buffer, or write it ``anew``."""
        if anew and waiting:
            self.early.clear()
        for a in range(0, len(pos), _RUN):
            self.early.appendValue((pos[a : a + _RUN].tobytes(), xs[a : a + _RUN].tobytes()))


def live_windows(rows: DataFrame, window: int, step: int, alpha: float, threshold: float = 0.5, patience_ms: int | None = None) -> DataFrame:
    """Windows of a live stream of (stream string, pos long from 1, x double). A stream begins
    anew under another name, which resets its state. A missing position is waited for, without end
    or, with ``patience_ms``, until that time has gone by without it; then it is passed over. A
    query with patience goes on looking at the time, so it ends by being stopped alone: not under
    ``run_available``."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    known = rows.where("stream is not null and pos >= 1 and x is not null")
    mode = "None" if patience_ms is None else "ProcessingTime"
    return known.groupBy("stream").transformWithStateInPandas(Windows(window, step, alpha, threshold, patience_ms), SCHEMA, "Append", mode)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take in all that has arrived, then stop: the table at ``path`` has each row once, however
    often this is run, and whatever it was stopped by."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

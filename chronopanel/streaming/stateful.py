"""Indicators that update bar by bar.

Input is a stream of bars (one row per series and period, as ``streaming_bars``
writes them), never raw ticks: a hot series is already reduced before it
reaches its state, which is a handful of numbers, the last closes of a window
and the bars of the last stretch in which late ones may still come.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "series_id string, period timestamp, close double, ema double, obv double, rsi double, sma double"
COLUMNS = ["series_id", "period", "close", "ema", "obv", "rsi", "sma"]
#: State needs the store that keeps values, lists, maps and timers apart.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_MS = 1000


class Indicators(StatefulProcessor):
    """Held bars by period (map), numbers carried from bar to bar (value), closes of the mean's window (list), and one timer per
    stretch of held bars."""

    RUNNING = "ema double, obv double, close double, gain double, loss double, seen bigint, gap bigint, last bigint"
    START = (None, 0.0, None, 0.0, 0.0, 0, 0, None)

    def __init__(self, span: int, n: int, window: int, keep_ms: int | None):
        self.alpha, self.n, self.window, self.keep_ms = 2.0 / (span + 1.0), n, window, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", self.RUNNING)
        self.recent = handle.getListState("recent", "close double")
        self.held = handle.getMapState("held", "period bigint", "close double, volume double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            periods = f["period"].astype("datetime64[us]").astype("int64").tolist()
            for period, close, volume in zip(periods, f["close"].astype(float).tolist(), f["volume"].astype(float).tolist()):
                if not self.held.containsKey((period,)):
                    self.held.updateValue((period,), (None if math.isnan(close) else close, None if math.isnan(volume) else volume))
        return self._passed(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._passed(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _passed(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        """Bars that the watermark has passed, in order; a timer brings the next ones or the end of a silent series."""
        held = sorted(k[0] for k in self.held.keys())
        ready = [p for p in held if p < watermark * _MS]
        carried = self.running.get() if self.running.exists() else self.START
        out, carried = self._worked(key, carried, [(p, *self.held.getValue((p,))) for p in ready]) if ready else ([], carried)
        for p in ready:
            self.held.removeKey((p,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = carried[-1]
        if len(held) > len(ready):
            self.running.update(tuple(carried))
            self.handle.registerTimer(max(held[len(ready)] // _MS, watermark) + 1)
        elif self.keep_ms is not None and last is not None and last // _MS + self.keep_ms <= watermark:
            for state in (self.running, self.recent, self.held):
                state.clear()
        else:
            self.running.update(tuple(carried))
            if self.keep_ms is not None and last is not None:
                self.handle.registerTimer(last // _MS + self.keep_ms + 1)
        if out:
            done = pd.DataFrame(out, columns=COLUMNS)
            yield done.assign(period=pd.to_datetime(done["period"], unit="us"))

    def _worked(self, key, carried, bars) -> tuple[list[tuple], tuple]:
        ema, obv, prev, gain, loss, seen, gap, last = carried
        alpha, n = self.alpha, self.n
        closes = [c[0] for c in self.recent.get()] if self.recent.exists() else []
        out = []
        for period, close, volume in bars:
            if last is not None and period <= last:
                continue
            last = period
            if close is None:
                gap += 1
                out.append((key[0], period, None, ema, obv, None, None))
                continue
            if ema is None:
                ema = close
            else:
                weight = (1.0 - alpha) ** (gap + 1)
                ema = (weight * ema + alpha * close) / (weight + alpha)
            gap = 0
            if prev is not None:
                step = close - prev
                obv += math.copysign(volume or 0.0, step) if step else 0.0
                up, down = max(step, 0.0), max(-step, 0.0)
                if seen < n:
                    gain, loss = gain + up / n, loss + down / n
                else:
                    gain, loss = gain + (up - gain) / n, loss + (down - loss) / n
                seen += 1
            prev = close
            closes = [*closes, close][-self.window :]
            rsi = 100.0 * gain / (gain + loss) if seen >= n and gain + loss else None
            sma = math.fsum(closes) / self.window if len(closes) == self.window else None
            out.append((key[0], period, close, ema, obv, rsi, sma))
        self.recent.put([(c,) for c in closes])
        return out, (ema, obv, prev, gain, loss, seen, gap, last)


def streaming_indicators(bars: DataFrame, span: int = 20, n: int = 14, window: int = 20, lateness: str = "0 seconds", keep_days: int | None = None) -> DataFrame:
    """Exponential mean, on-balance volume, Wilder RSI and plain mean of the last ``window`` closes of each bar, in period order.

    Bars may come in any order within ``lateness``: a series holds those that the watermark has not passed, and gives them
    out in order once it has.  A bar without a close repeats the mean and lets the older weight decay.  Bars behind the
    watermark are dropped and counted in the query's progress (``numRowsDroppedByWatermark``); of bars with one period
    the first counts.  With ``keep_days`` the state of a series is dropped once it was silent for so long in event time; a bar
    after that starts anew.
    """
    keep = None if keep_days is None else keep_days * 86_400_000
    spark = bars.sparkSession
    spark.conf.set(*STORE)
    return (
        bars.select("series_id", "period", "close", "volume")
        .withWatermark("period", lateness)
        .groupBy("series_id")
        .transformWithStateInPandas(Indicators(span, n, window, keep), OUT, "Append", "EventTime")
    )

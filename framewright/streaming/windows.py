"""Streaming windows: Spark's own, and the exact late-row rule of one watermark over the whole stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.tumble import tumble, width_ms

DEFAULT_DELAY_MS = 2000
#: Aggregates that a streaming window offers.
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def aggregate(name: str, column: str, alias: str) -> Column:
    if name not in AGGREGATES:
        raise EngineError("UNSUPPORTED_QUERY", f"{name} is not available over a stream; use one of {', '.join(AGGREGATES)}")
    return AGGREGATES[name](F.expr(column) if column != "*" else F.lit(1)).alias(alias)


def tumbling(stream: DataFrame, width: str | int, keys: list[str], aggregates: list[tuple[str, str, str]], delay_ms: int = DEFAULT_DELAY_MS, ts: str = "ts") -> DataFrame:
    """Windows [start, start + width) by keys, emitted once the watermark passes their end (append mode). Works on batches too.

    Spark keeps a late row as long as its window is open.
    """
    ms = width_ms(width)
    marked = stream.withWatermark(ts, f"{delay_ms} milliseconds") if stream.isStreaming else stream
    grouped = marked.groupBy(F.window(ts, f"{ms} milliseconds").alias("__fw_window"), *keys).agg(*[aggregate(*a) for a in aggregates])
    return grouped.select(F.col("__fw_window.start").alias("window_start"), *keys, *[a[2] for a in aggregates])


def late_rows(batches: DataFrame, ts_ms: str, batch: str, delay_ms: int) -> DataFrame:
    """Rows of a replayed stream with watermark (after the batches before theirs) and is_late: below that watermark.

    The watermark is global, so it is computed over one row a batch; rows join it on the batch.
    """
    highest = batches.groupBy(batch).agg(F.max(ts_ms).alias("__fw_high"))
    before = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    marks = highest.select(batch, (F.max("__fw_high").over(before) - delay_ms).alias("watermark"))
    return batches.join(marks, batch).withColumn("is_late", F.coalesce(F.col(ts_ms) < F.col("watermark"), F.lit(False)))


def exact_tumbling_batches(batches: DataFrame, ts_ms: str, batch: str, width: str | int, keys: list[str], aggregates: list[tuple[str, str, str]], delay_ms: int) -> DataFrame:
    """What the exact rule emits over a replayed stream: windows without late rows that the last watermark closes, by window_start."""
    ms = width_ms(width)
    marked = late_rows(batches, ts_ms, batch, delay_ms).where("not is_late")
    last = batches.agg((F.max(ts_ms) - delay_ms).alias("__fw_last"))
    start = F.col(ts_ms) - F.pmod(F.col(ts_ms), F.lit(ms))
    grouped = marked.groupBy(start.alias("window_start"), *keys).agg(*[aggregate(*a) for a in aggregates])
    return grouped.join(F.broadcast(last)).where(F.col("window_start") + ms <= F.col("__fw_last")).drop("__fw_last")  # one row


class ExactWindows:
    """The exact rule in one state: micro-batches in, closed windows out. For foreachBatch, with counters of late rows."""

    def __init__(self, width: str | int, keys: list[str], value: str, delay_ms: int = DEFAULT_DELAY_MS, state_rows: int = 1_000_000):
        self.ms, self.keys, self.value, self.delay, self.limit = width_ms(width), keys, value, delay_ms, state_rows
        self.watermark: int | None = None
        self.high: int | None = None
        self.late = 0
        self.state: dict[tuple, list] = {}

    def push(self, batch: DataFrame, ts_ms: str) -> list[tuple]:
        """Take one micro-batch, pre-aggregated by window and key in Spark; give (window_start, *keys, count(*), count, sum, min, max) of what closes."""
        start = (F.col(ts_ms) - F.pmod(F.col(ts_ms), F.lit(self.ms))).alias("__fw_start")
        mark = F.lit(self.watermark).cast("long")
        on_time = mark.isNull() | (F.col(ts_ms) >= mark)
        v = F.when(on_time, F.col(self.value))
        got = batch.groupBy(start, *self.keys).agg(F.count(F.when(on_time, 1)), F.count(v), F.sum(v), F.min(v), F.max(v), F.max(ts_ms), F.count(F.when(~on_time, 1)))
        for row in got.toLocalIterator():
            key, (n, c, s, lo, hi, high, late) = tuple(row[: 1 + len(self.keys)]), row[1 + len(self.keys) :]
            self.high = high if self.high is None else max(self.high, high)
            self.late += late
            if not n:
                continue
            if key in self.state:
                o = self.state[key]
                self.state[key] = [o[0] + n, o[1] + c, o[2] if s is None else s if o[2] is None else o[2] + s, *[b if a is None else a if b is None else f(a, b) for f, a, b in ((min, o[3], lo), (max, o[4], hi))]]
            else:
                self.state[key] = [n, c, s, lo, hi]
            if len(self.state) > self.limit:
                raise EngineError("RESOURCE_EXHAUSTED", f"more than {self.limit} open windows")
        if self.high is not None:
            self.watermark = max(self.high - self.delay, self.watermark if self.watermark is not None else self.high - self.delay)
        closed = sorted((k for k in self.state if self.watermark is not None and k[0] + self.ms <= self.watermark), key=lambda k: k[0])
        return [(*k, *self.state.pop(k)) for k in closed]


def exact_by_state(stream: DataFrame, ts: str, width: str | int, key: str, delay_ms: int) -> DataFrame:
    """Counts per window by the late rule of each key's own watermark, with applyInPandasWithState, so keys run in parallel."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ms = width_ms(width)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, high, windows = state.get if state.exists else (None, None, "{}")
        import json

        held = {int(a): b for a, b in json.loads(windows).items()}
        for f in frames:
            at = f[ts].astype("datetime64[ms]").astype("int64")
            ok = at if mark is None else at[at >= mark]
            for s, n in (ok - ok % ms).value_counts().items():
                held[int(s)] = held.get(int(s), 0) + int(n)
            if len(at):
                high = int(at.max()) if high is None else max(high, int(at.max()))
        if high is not None:
            mark = max(high - delay_ms, mark if mark is not None else high - delay_ms)
        done = sorted(s for s in held if mark is not None and s + ms <= mark)
        out = pd.DataFrame({"window_start": pd.to_datetime(done, unit="ms"), key: [k[0]] * len(done), "n": [held.pop(s) for s in done]})
        state.update((mark, high, json.dumps(held)))
        yield out

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"window_start timestamp, {key} {kind}, n long", "mark long, high long, windows string", "append", GroupStateTimeout.NoTimeout)


def tumble_column(ts: str, width: str | int) -> Column:
    return tumble(F.col(ts), width)

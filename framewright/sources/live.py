"""Live frames as a streaming source: a replay at a fixed rate, or a recording of what a camera sent, by capture clock, sampler and epochs."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..errors import EngineError
from .sampling import CaptureClock, LiveSampler

#: Rows of an epoch, its span in event time, and epochs that wait at most.
EPOCH_ROWS, EPOCH_SPAN_MS, EPOCHS_WAITING = 64, 200, 4


class Ring:
    """Frames that wait for a reader; a full ring drops its oldest and counts them."""

    def __init__(self, size: int = EPOCH_ROWS * EPOCHS_WAITING):
        self.frames: deque = deque()
        self.size, self.dropped = size, 0

    def push(self, frame) -> None:
        if len(self.frames) == self.size:
            self.frames.popleft()
            self.dropped += 1
        self.frames.append(frame)

    def epoch(self) -> list:
        """The next epoch: up to EPOCH_ROWS frames within EPOCH_SPAN_MS of the first."""
        out: list = []
        while self.frames and len(out) < EPOCH_ROWS and (not out or self.frames[0][0] - out[0][0] < EPOCH_SPAN_MS):
            out.append(self.frames.popleft())
        return out


class Slice(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class ReplayReader(DataSourceStreamReader):
    """Frames at a fixed distance in time, numbered from 0, up to a limit; offsets are frame numbers, so a lost task reads again."""

    def __init__(self, options: dict):
        self.step, self.rows = int(1000 / float(options.get("fps", 5))), int(options.get("rows", 100))
        self.per_batch, self.start_ms, self.name = int(options.get("rowsPerBatch", EPOCH_ROWS)), int(options.get("startMillis", 0)), options.get("source", "replay")
        self.at = 0

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.rows, self.at + self.per_batch)
        return {"n": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Slice(start["n"], end["n"])]

    def read(self, partition: Slice) -> Iterator[tuple]:
        from datetime import datetime, timezone

        for k in range(partition.start, partition.end):
            ms = self.start_ms + k * self.step
            frame = (self.name, f"fw://media/v1/1/{self.name}?pts_ms={k * self.step}", k * self.step, k, None, None, 640, 480, None, None)
            yield (datetime.fromtimestamp(ms / 1000, timezone.utc), frame, k, self.name)


class Frames(InputPartition):
    """Frames of some epochs, with their numbers."""

    def __init__(self, frames: list[tuple[int, int, int | None]]):
        self.frames = frames


class RecordedReader(DataSourceStreamReader):
    """A recording (lines of JSON: ingest_ms, and pts_ms and connection where known) as a camera's frames.

    Each connection has a capture clock, which starts from the watermark so far; the sampler chooses frames by event time,
    and a micro-batch takes one epoch. Offsets are frame numbers, so a lost task reads its frames again.
    """

    def __init__(self, options: dict):
        from .media import read_bytes

        self.name = options.get("source", "replay")
        sampler, clock, connection, high = LiveSampler(float(options.get("fps", 5))), CaptureClock(), None, None
        delay, ring = int(options.get("watermarkMillis", 2000)), None
        frames: list[tuple[int, int, int | None]] = []
        for line in read_bytes(options["recording"]).decode().splitlines():
            packet = json.loads(line)
            if packet.get("connection", 0) != connection:
                connection, clock = packet.get("connection", 0), CaptureClock(None if high is None else high - delay)
            at, _ = clock.event_time(packet.get("pts_ms"), packet["ingest_ms"])
            high = at if high is None else max(high, at)
            if sampler.keep(at):
                frames.append((at, len(frames), packet.get("pts_ms")))
        ring = Ring(max(1, len(frames)))
        for f in frames:
            ring.push(f)
        epochs = []
        while epoch := ring.epoch():
            epochs.append(len(epoch))
        self.frames, self.ends, self.at = frames, list(accumulate(epochs)), 0

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        self.at = next((e for e in self.ends if e > self.at), self.at)
        return {"n": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Frames(self.frames[start["n"] : end["n"]])]

    def read(self, partition: Frames) -> Iterator[tuple]:
        from datetime import datetime, timezone

        for at, n, pts in partition.frames:
            frame = (self.name, f"fw://media/v1/1/{self.name}?pts_ms={pts}", pts, n, None, None, None, None, None, None)
            yield (datetime.fromtimestamp(at / 1000, timezone.utc), frame, n, self.name)


class LiveSource(DataSource):
    """Format "fw_live": ts, frame, frame_id, source. It has no batch reader: a live table can only be streamed."""

    @classmethod
    def name(cls) -> str:
        return "fw_live"

    def schema(self):
        from .. import types

        return types.LIVE_SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        if self.options.get("transport", "tcp") not in ("tcp", "udp"):
            raise EngineError("INVALID_PARAMETER", "transport is tcp or udp")
        return RecordedReader(self.options) if self.options.get("recording") else ReplayReader(self.options)

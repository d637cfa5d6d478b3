"""Choosing frames by presentation time, and event time for live captures."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from ..errors import EngineError

#: Milliseconds by which a frame may come early and still meet its target.
TOLERANCE_MS = 0.5
#: Drift between capture and ingest clocks from which capture times are no longer trusted.
MAX_DRIFT_MS = 30_000


def sample_pts(pts: Iterable[int], fps: float, start: int | None = None, stop: int | None = None) -> Iterator[tuple[int, int]]:
    """(pts, frame_id) of the frames kept at a rate: each first frame that reaches the next target.

    With a range [start, stop), targets begin at its start and frame_id counts inside it.
    """
    if not fps > 0:
        raise EngineError("INVALID_PARAMETER", "fps must be positive")
    step, target, n = 1000.0 / fps, float(max(start or 0, 0)), 0
    for p in pts:
        if start is not None and p < start or stop is not None and p >= stop:
            continue
        if p + TOLERANCE_MS >= target:
            yield p, n
            n += 1
            while target <= p + TOLERANCE_MS:
                target += step


@dataclass
class LiveSampler:
    """As sample_pts, but the first frame is always kept and anchors the targets."""

    fps: float
    target: float | None = None

    def keep(self, event_ms: int) -> bool:
        step = 1000.0 / self.fps
        if self.target is None:
            self.target = event_ms + step
            return True
        if event_ms + TOLERANCE_MS < self.target:
            return False
        while self.target <= event_ms + TOLERANCE_MS:
            self.target += step
        return True


@dataclass
class CaptureClock:
    """Event times of one connection: the first capture time is tied to the ingest clock, later ones follow by difference.

    A frame without a capture time, or one that goes back, drifts or falls behind the watermark, takes its ingest time,
    and so do all later frames of the connection.
    """

    watermark_ms: int | None = None
    anchor: tuple[int, int] | None = None
    last: int | None = None
    fell_back: bool = False
    fallbacks: int = field(default=0)

    def event_time(self, pts_ms: int | None, ingest_ms: int) -> tuple[int, bool]:
        """(event time, whether it is the ingest time as a fall-back)."""
        if not self.fell_back and pts_ms is not None:
            if self.anchor is None:
                self.anchor = (pts_ms, ingest_ms)
            at = self.anchor[1] + pts_ms - self.anchor[0]
            if (self.last is None or at >= self.last) and abs(at - ingest_ms) <= MAX_DRIFT_MS and (self.watermark_ms is None or at >= self.watermark_ms):
                self.last = at
                return at, False
        self.fell_back = True
        self.fallbacks += 1
        return ingest_ms, True

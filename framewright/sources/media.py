"""Sources of images and video frames as DataFrames of references; pixels are read only where a model needs them."""

from __future__ import annotations

import base64
import json
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types
from ..errors import EngineError
from .sampling import sample_pts

IMAGE_FILES, VIDEO_FILES = ("jpg", "jpeg", "png"), ("mp4", "mov", "mkv", "avi", "webm", "m4v")
DEFAULT_FPS = 1.0
#: Bytes at a file's start that are read for an image's size.
HEADER_BYTES = 1 << 18


def image_size(head: bytes | None) -> tuple[int, int, str] | None:
    """(width, height, encoding) from the opening bytes of a PNG or JPEG; None if they can't be told."""
    if not head:
        return None
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) >= 24:
        w, h = struct.unpack(">II", head[16:24])
        return w, h, "png"
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(head):
            if head[at] != 0xFF:
                at += 1
                continue
            mark = head[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", head[at + 5 : at + 9])
                return w, h, "jpeg"
            if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD9:
                at += 1 if mark == 0xFF else 2
                continue
            at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
    return None


def glob_of(extensions: tuple[str, ...]) -> str:
    """File-name pattern for extensions in any case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def locator(generation: int, path: str, pts_ms: int | None = None) -> str:
    return f"fw://media/v1/{generation}/{quote(path, safe='')}" + (f"?pts_ms={pts_ms}" if pts_ms is not None else "")


def _files(spark: SparkSession, location: str, extensions: tuple[str, ...], recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob_of(extensions)).option("recursiveFileLookup", str(recursive).lower()).load(location)


def images(spark: SparkSession, location: str, recursive: bool = False, generation: int = 1) -> DataFrame:
    """IMAGES: one row per jpg, jpeg or png file: uri, image, width, height, captured_at (the file's time).

    Sizes that can't be read are null. Width, height and image are computed from content, so a query that
    reads none of them opens no file; the order of rows is that of no sort: ORDER BY uri where it matters.
    """

    @F.arrow_udf("struct<width:int,height:int,encoding:string>")
    def size(content: pa.Array) -> pa.Array:
        return pa.array([(lambda s: None if s is None else dict(zip(("width", "height", "encoding"), s, strict=True)))(image_size(c.as_py())) for c in content], pa.struct([("width", pa.int32()), ("height", pa.int32()), ("encoding", pa.string())]))

    files = _files(spark, location, IMAGE_FILES, recursive)
    probed = size(F.substring("content", 1, HEADER_BYTES))
    path = F.regexp_replace("path", "^file:/+", "/")
    image = _image(path, F.concat(F.lit(f"fw://media/v1/{generation}/"), F.url_encode(path)), F.lit(None), F.lit(None), F.col("content"), probed["encoding"], probed["width"], probed["height"])
    return files.select(path.alias("uri"), image.alias("image"), probed["width"].alias("width"), probed["height"].alias("height"), F.date_trunc("millisecond", "modificationTime").alias("captured_at"))


def _image(uri: Column, place: Column, pts: Column, frame: Column, encoded: Column, encoding: Column, width: Column, height: Column) -> Column:
    values = (uri, place, pts, frame, encoded, encoding, width, height, F.lit(None), F.lit(None))
    return F.struct(*[v.cast(f.dataType).alias(f.name) for v, f in zip(values, types.IMAGE.fields, strict=True)])


class ManifestDecoder:
    """Decoder of clips described in JSON: {"pts_ms": [...], "fps": ..., "width": ..., "height": ..., "codec": ...}, and "frames", a
    base64 PNG for each entry of pts_ms, where the clip has pixels. Another decoder has the same two methods; DECODER names the one in use."""

    def frame(self, content: bytes, pts_ms: int) -> bytes:
        """The encoded frame at a presentation time."""
        m = self.probe(content)
        try:
            return base64.b64decode(m["frames"][m["pts_ms"].index(pts_ms)])
        except (KeyError, ValueError, IndexError):
            raise EngineError("MEDIA_DECODE_FAILED", f"the clip has no frame at {pts_ms} ms") from None

    def probe(self, content: bytes) -> dict:
        try:
            return json.loads(content)
        except ValueError:
            raise EngineError("MEDIA_DECODE_FAILED", "no decoder for this clip") from None


DECODER = ManifestDecoder()
_CLIPS: dict[str, bytes] = {}


def read_bytes(uri: str) -> bytes:
    """A file's content, on any file system that Arrow reaches."""
    if "://" not in uri or uri.startswith("file:"):
        with open(re.sub("^file:/+", "/", uri), "rb") as f:
            return f.read()
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def frame(uri: str, pts_ms: int) -> bytes:
    """The encoded frame of a clip, which a worker reads where a model needs it; the last clip stays open."""
    if uri not in _CLIPS:
        _CLIPS.clear()
        _CLIPS[uri] = read_bytes(uri)
    return DECODER.frame(_CLIPS[uri], pts_ms)


def videos(spark: SparkSession, location: str, recursive: bool = False, fps: float = DEFAULT_FPS, start_time_ms: int | None = None, decoder: ManifestDecoder | None = None, generation: int = 1, rebased: tuple[int, int] | None = None) -> DataFrame:
    """VIDEOS: one row per sampled frame, one task per clip or more clips. ts is start_time (epoch by default) plus pts.

    rebased: a range of ts in milliseconds inside which sampling starts anew; without it frames are sampled from the
    clip's start, and a filter on ts only selects among them. A clip that can't be decoded has no rows.
    """
    if not fps > 0:
        raise EngineError("INVALID_PARAMETER", "fps must be positive")
    decoder, zero = decoder or DECODER, start_time_ms or 0
    lo, hi = (rebased[0] - zero, rebased[1] - zero) if rebased else (None, None)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    m = decoder.probe(content)
                except EngineError:
                    continue
                pts = m.get("pts_ms", [])
                duration = m.get("duration", (pts[-1] + 1000 / m["fps"]) / 1000 if pts and m.get("fps") else None)
                rows += [(path, p, n, duration, m.get("fps"), m.get("width"), m.get("height"), m.get("codec")) for p, n in sample_pts(pts, fps, lo, hi)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["uri", "pts_ms", "frame_id", "duration", "fps", "width", "height", "codec"])

    found = _files(spark, location, VIDEO_FILES, recursive).select(F.regexp_replace("path", "^file:/+", "/"), "content").mapInArrow(frames, "uri string, pts_ms long, frame_id long, duration double, fps double, width int, height int, codec string")
    place = F.concat(F.lit(f"fw://media/v1/{generation}/"), F.url_encode("uri"), F.lit("?pts_ms="), F.col("pts_ms").cast("string"))
    frame = _image(F.col("uri"), place, F.col("pts_ms"), F.col("frame_id"), F.lit(None), F.lit(None), F.col("width"), F.col("height"))
    return found.select("uri", F.timestamp_millis(F.col("pts_ms") + zero).alias("ts"), "pts_ms", "frame_id", frame.alias("frame"), "duration", "fps", "width", "height", "codec")


def external(spark: SparkSession, location: str) -> DataFrame:
    """EXTERNAL: a Parquet table."""
    return spark.read.parquet(location)

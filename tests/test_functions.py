from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from framewright.errors import EngineError
from framewright.functions import compat, detection, spatial
from framewright.functions.tumble import tumble, width_ms
from framewright.models import decode
from framewright.sources.media import image_size
from framewright.sources.sampling import CaptureClock, LiveSampler, sample_pts

SQUARE = "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))"


def test_tumble_floors_before_the_epoch(spark):
    rows = spark.createDataFrame([(7800,), (None,), (-1,)], "ms long").select(F.unix_millis(tumble(F.timestamp_millis("ms"), "5 seconds"))).collect()
    assert [r[0] for r in rows] == [5000, None, -5000]


@pytest.mark.parametrize(("width", "said"), [("1 month", "calendar months"), (0, "positive"), (-1, "positive"), ("soon", "interval")])
def test_tumble_rejects(width, said):
    with pytest.raises(EngineError, match=said):
        width_ms(width)


def test_polygon_contains(spark):
    p = spark.createDataFrame([(0.5, 0.5), (0.0, 0.5), (1.5, 0.5), (None, 0.5)], "x double, y double")
    got = [r[0] for r in p.select(spatial.st_contains(spatial.polygon(SQUARE), F.when(F.col("x").isNotNull(), spatial.point(F.col("x"), F.col("y"))))).collect()]
    assert got == [True, True, False, None]


@pytest.mark.parametrize("text", ["0 0, 1 0, 1 1, 0 1", "0 0, 2 0, 1 1, 0 0", "0 0, 1 0, 0 0", "a b, 1 0, 1 1, a b", ""])
def test_polygon_rejects(text, spark):
    with pytest.raises(EngineError):
        spatial.parse_polygon(text)
    with pytest.raises(Exception, match="invalid polygon"):
        spark.createDataFrame([(text,)], "t string").select(spatial.polygon(F.col("t"))).collect()


def test_nms_in_catalyst_equals_numpy(spark):
    boxes = [("a", 0.9, 0.1, 0.1, 0.4, 0.4), ("a", 0.8, 0.12, 0.1, 0.4, 0.4), ("b", 0.7, 0.1, 0.1, 0.4, 0.4), ("a", 0.6, 0.6, 0.6, 0.2, 0.2), ("a", 0.0, 0.0, 0.0, 0.1, 0.1)]
    rows = [{"label": n, "confidence": c, "box": dict(zip("xywh", b, strict=True))} for n, c, *b in boxes]
    kept = decode.suppress(rows)
    df = spark.createDataFrame([([(n, c, tuple(b)) for n, c, *b in boxes],)], "d array<struct<label:string,confidence:float,box:struct<x:float,y:float,w:float,h:float>>>")
    got = df.select(detection.nms(F.col("d"))).first()[0]
    assert [(r["label"], round(r["confidence"], 4)) for r in got] == [(r["label"], r["confidence"]) for r in kept] == [("a", 0.9), ("b", 0.7), ("a", 0.6)]


def test_classification_rejects_scores_outside_0_1(spark):
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([([0.1, 1.5],)], "s array<double>").select(detection.classification(["a", "b"], F.col("s"))).collect()


def test_compat(spark):
    a = F.array(*map(F.lit, (1, 2, 1, 3, 1)))
    row = spark.range(1).select(
        compat.gcd(F.lit(-12), F.lit(18)), compat.lcm(F.lit(4), F.lit(6)), compat.array_replace(a, F.lit(1), F.lit(9), 2), compat.array_remove_n(a, F.lit(1), 2), compat.array_resize(F.array(F.lit(1)), F.lit(3), F.lit(0)),
        compat.regexp_match(F.lit("ab12"), "([a-z]+)([0-9]+)"), compat.map_extract(F.create_map(F.lit("k"), F.lit(1)), F.lit("z")), compat.trunc(F.lit(-1.55), 1), compat.nanvl(F.lit(float("nan")), F.lit(2.0)),
    ).first()
    assert list(row) == [6, 12, [9, 2, 9, 3, 1], [2, 3, 1], [1, 0, 0], ["ab", "12"], [], -1.5, 2.0]


def test_sampling_vectors():
    assert [p for p, _ in sample_pts(range(0, 4000, 40), 5)] == list(range(0, 4000, 200))
    assert list(sample_pts(range(0, 4000, 40), 5, 1000, 2000)) == [(1000, 0), (1200, 1), (1400, 2), (1600, 3), (1800, 4)]
    assert [p for p, _ in sample_pts([0, 33, 80, 121, 205, 260, 401, 610, 799, 1005], 5)] == [0, 205, 401, 610, 1005]
    with pytest.raises(EngineError):
        list(sample_pts([0], 0))


def test_live_sampler_and_clock():
    s = LiveSampler(5)
    assert [t for t in (1007, 1100, 1207, 1300, 1410) if s.keep(t)] == [1007, 1207, 1410]
    c = CaptureClock()
    assert [c.event_time(*x) for x in ((100, 1000), (110, 1010))] == [(1000, False), (1010, False)]
    assert c.event_time(90, 1020) == (1020, True) and c.fallbacks == 1


def test_yolo_decoding():
    import numpy as np

    frame = (32, 32, 0, 0, 32, 32)
    e2e = decode.detections(np.array([[8, 4, 24, 20, 0.9, 0]]), frame, ["person"], "yolo_e2e")
    assert e2e[0]["box"] == {"x": 0.25, "y": 0.125, "w": 0.5, "h": 0.5}
    two = decode.detections(np.array([[8, 4, 24, 20, 0.9, 0]] * 2), frame, ["person"], "yolo_e2e")
    assert len(two) == 2
    raw = np.array([[16, 16], [16, 24], [8, 8], [8, 8], [0.9, 0.1], [0.2, 0.8]])
    got = decode.detections(raw, frame, ["person", "car"], "yolo_raw")
    assert [(d["label"], d["box"]["x"], d["box"]["y"]) for d in got] == [("person", 0.375, 0.375), ("car", 0.375, 0.625)]


def png(w, h, rgb=(10, 20, 30)):
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress((b"\0" + bytes(rgb) * w) * h)) + chunk(b"IEND", b"")


def test_png_size_and_pixels():
    data = png(3, 2)
    assert image_size(data) == (3, 2, "png") and image_size(b"xx") is None and image_size(None) is None
    assert decode.png_pixels(data).shape == (2, 3, 3) and decode.png_pixels(data)[1, 2].tolist() == [10, 20, 30]
    with pytest.raises(EngineError):
        decode.png_pixels(data[:-30])
    x, geometry = decode.images([{"encoded": data}], {"image_size": 8})
    assert x.shape == (1, 3, 8, 8) and geometry == [(8, 8, 0, 1, 8, 5)]


def test_scatter_nulls_and_failures():
    import pyarrow as pa

    from framewright.models.runtime import scatter

    v = pa.array([1, None, 3])
    assert scatter([v], lambda c: pa.array([x.as_py() * 2 for x in c[0]]), False, pa.int64()).to_pylist() == [2, None, 6]
    assert scatter([v], lambda c: 1 / 0, False, pa.int64()).to_pylist() == [None] * 3
    with pytest.raises(ZeroDivisionError):
        scatter([v], lambda c: 1 / 0, True, pa.int64())


def test_images_source(spark, tmp_path):
    from framewright.sources import media

    for name, size in (("one.png", (1, 1)), ("wide.PNG", (2, 1)), ("widest.png", (3, 2))):
        (tmp_path / name).write_bytes(png(*size))
    (tmp_path / "broken.jpg").write_bytes(b"no image")
    (tmp_path / "other.txt").write_bytes(b"text")
    got = {r.uri.rsplit("/", 1)[1]: (r.width, r.height) for r in media.images(spark, str(tmp_path)).select("uri", "width", "height").collect()}
    assert got == {"one.png": (1, 1), "wide.PNG": (2, 1), "widest.png": (3, 2), "broken.jpg": (None, None)}
    plan = media.images(spark, str(tmp_path)).select("uri")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan


def test_videos_source(spark, tmp_path):
    from framewright.sources import media

    (tmp_path / "a.mp4").write_text('{"pts_ms": %s, "fps": 25, "width": 320, "height": 240, "codec": "mpeg4"}' % list(range(0, 4000, 40)))
    (tmp_path / "b.mp4").write_text("broken")
    start = int(datetime(2026, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)
    got = media.videos(spark, str(tmp_path), fps=5, start_time_ms=start).orderBy("frame_id").collect()
    assert len(got) == 20 and got[1].pts_ms == 200 and got[0].width == 320 and got[0].frame.pts_ms == 0
    assert media.videos(spark, str(tmp_path), fps=5, start_time_ms=start, rebased=(start + 1000, start + 2000)).count() == 5

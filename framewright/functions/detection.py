"""Detections and classifications as Catalyst expressions: filters, pixel locators, task shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

DEFAULT_MIN_SCORE = 0.25


def keep_detections(found: Column, classes: list[str] | None = None, min_confidence: float | None = None) -> Column:
    """Elements of the classes (any by default) with at least this confidence; the row always stays."""

    def fits(d: Column) -> Column:
        ok = F.lit(True)
        if classes is not None:
            ok = ok & d["label"].isin(list(classes)) if classes else F.lit(False)
        if min_confidence is not None:
            ok = ok & (d["confidence"] >= F.lit(min_confidence).cast("float"))
        return ok

    return F.filter(found, fits)


def task_detections(found: Column, image: Column, classes: list[str] | None = None, min_score: float = DEFAULT_MIN_SCORE) -> Column:
    """Detections in the task's shape: by falling score, the box in pixels; no locator where the image's size is unknown."""
    w, h = image["width"], image["height"]

    def shape(d: Column) -> Column:
        b = d["box"]
        pixels = F.struct((b["x"] * w).cast("float").alias("x"), (b["y"] * h).cast("float").alias("y"), (b["w"] * w).cast("float").alias("w"), (b["h"] * h).cast("float").alias("h"))
        span = F.lit(None).cast("struct<start:int,end:int>")
        return F.struct(d["label"].alias("label"), d["confidence"].alias("score"), F.when((w > 0) & (h > 0), F.struct(span.alias("char_span"), pixels.alias("box"))).alias("locator"))

    shaped = F.transform(keep_detections(found, classes, min_score), lambda d, i: F.struct((-d["confidence"]).alias("k"), i.alias("i"), shape(d).alias("d")))
    return F.transform(F.array_sort(shaped), lambda s: s["d"])


def classification(labels: list[str], scores: Column) -> Column:
    """(label, score) of each class by falling score, then label; a score outside [0, 1] or NaN fails the query."""
    if not labels or len(set(labels)) != len(labels) or "" in labels:
        raise EngineError("INVALID_PARAMETER", "categories must be distinct and not empty")
    rows = F.transform(scores, lambda s, i: F.struct((-s.cast("float")).alias("k"), F.get(F.array(*map(F.lit, labels)), i).alias("label"), s.cast("float").alias("score")))
    checked = F.when(F.exists(scores, lambda s: (s < 0) | (s > 1) | F.isnan(s)), F.raise_error(F.lit("classification score outside [0, 1]"))).otherwise(rows)
    return F.transform(F.array_sort(checked), lambda r: F.struct(r["label"].alias("label"), r["score"].alias("score")))


def classify(full: Column, vocabulary: list[str], categories: list[str], output_mode: str = "single", min_score: float | None = None) -> Column:
    """The requested classes of a full classification: the top one (single) or all from min_score on (multi)."""
    if not categories or len(set(categories)) != len(categories) or "" in categories:
        raise EngineError("INVALID_PARAMETER", "categories must be distinct and not empty")
    if output_mode == "single":
        if min_score is not None:
            raise EngineError("INVALID_PARAMETER", "min_score does not go with output_mode single")
        if unknown := [c for c in categories if c not in vocabulary]:
            raise EngineError("INVALID_PARAMETER", f"the model knows no class {unknown[0]!r}")
        return F.slice(F.filter(full, lambda c: c["label"].isin(categories)), 1, 1)
    if output_mode != "multi":
        raise EngineError("INVALID_PARAMETER", f"unknown output_mode {output_mode!r}")
    least = F.lit(DEFAULT_MIN_SCORE if min_score is None else min_score).cast("float")
    return F.filter(full, lambda c: c["label"].isin(categories) & (c["score"] >= least))


def nms(found: Column, iou: float = 0.45) -> Column:
    """Greedy suppression inside each class: by falling confidence, a box stays if its overlap with every kept one of its class is below iou.

    Confidences that are not finite or not in (0, 1] are dropped; equal ones keep their order.
    """
    valid = F.filter(found, lambda d: (d["confidence"] > 0) & (d["confidence"] <= 1) & ~F.isnan(d["confidence"]))
    ordered = F.transform(F.array_sort(F.transform(valid, lambda d, i: F.struct((-d["confidence"]).alias("k"), i.alias("i"), d.alias("d")))), lambda s: s["d"])

    def overlap(a: Column, b: Column) -> Column:
        w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
        h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
        union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
        return F.when(union > 0, w * h / union).otherwise(0.0)

    def step(kept: Column, d: Column) -> Column:
        beaten = F.exists(kept, lambda k: (k["label"] == d["label"]) & (overlap(k["box"], d["box"]) >= iou))
        return F.when(beaten, kept).otherwise(F.concat(kept, F.array(d)))

    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)

"""Boxes, points and polygons as Catalyst expressions, in single precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

#: Distance of the cross product from zero up to which a point counts as on an edge.
ON_EDGE = 1e-6


def _float(c: Column) -> Column:
    return c.cast("float")


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(_float(x).alias("x"), _float(y).alias("y"), _float(w).alias("w"), _float(h).alias("h"))


def point(x: Column, y: Column) -> Column:
    return F.struct(_float(x).alias("x"), _float(y).alias("y"))


def box_center(b: Column) -> Column:
    """Centre point of a box; null for null."""
    return F.when(b.isNotNull(), point(b["x"] + _float(b["w"] / 2), b["y"] + _float(b["h"] / 2)))


def parse_polygon(text: str) -> list[tuple[float, float]]:
    """Vertices of 'x y, x y, ...', with or without POLYGON((...)); closed, four vertices at least, within [0, 1]."""
    body = text.strip()
    if body.startswith("POLYGON((") and body.endswith("))"):
        body = body[9:-2]
    points = []
    for pair in body.split(","):
        try:
            x, y = map(float, pair.split())
        except ValueError:
            raise EngineError("INVALID_PARAMETER", f"polygon vertex {pair.strip()!r} is not 'x y'") from None
        if not all(math.isfinite(v) and 0 <= v <= 1 for v in (x, y)):
            raise EngineError("INVALID_PARAMETER", f"polygon vertex {pair.strip()!r} is outside [0, 1]")
        points.append((x, y))
    if len(points) < 4 or points[0] != points[-1]:
        raise EngineError("INVALID_PARAMETER", "a polygon needs four vertices at least, the last equal to the first")
    return points


def polygon(text: str | Column) -> Column:
    """Polygon from a constant text, checked now, or from a text column, where an error fails the query."""
    if isinstance(text, str):
        return F.array(*[point(F.lit(x), F.lit(y)) for x, y in parse_polygon(text)])
    body = F.regexp_replace(F.trim(text), r"^POLYGON\(\((.*)\)\)$", "$1")
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    vertex = rf"\s*{number}\s+{number}\s*"
    vertices = F.transform(F.split(body, ","), lambda p: point(F.get(F.split(F.trim(p), r"\s+"), F.lit(0)), F.get(F.split(F.trim(p), r"\s+"), F.lit(1))))
    good = body.rlike(f"^{vertex}(?:,{vertex}){{3,}}$")
    fits = F.forall(vertices, lambda p: p["x"].between(0, 1) & p["y"].between(0, 1)) & (F.element_at(vertices, 1) == F.element_at(vertices, -1))
    wrong = F.raise_error(F.concat(F.lit("invalid polygon: "), text))
    return F.when(text.isNull(), F.lit(None)).when(good, F.when(fits, vertices).otherwise(wrong)).otherwise(wrong)


def st_contains(area: Column, p: Column) -> Column:
    """Whether a closed polygon holds a point, by even-odd crossings; a point on an edge is held. Null for null."""
    edges = F.transform(F.sequence(F.lit(1), F.size(area) - 1), lambda i: F.struct(F.get(area, i - 1).alias("a"), F.get(area, i).alias("b")))

    def on_edge(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = _float(_float((p["x"] - a["x"]) * (b["y"] - a["y"])) - _float((p["y"] - a["y"]) * (b["x"] - a["x"])))
        return (F.abs(cross) <= F.lit(ON_EDGE).cast("float")) & p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = _float(_float(_float((b["x"] - a["x"]) * (p["y"] - a["y"])) / (b["y"] - a["y"])) + a["x"])
        return F.when((a["y"] > p["y"]) != (b["y"] > p["y"]), p["x"] < at).otherwise(False)

    inside = F.exists(edges, on_edge) | (F.size(F.filter(edges, crosses)) % 2 == 1)
    return F.when(area.isNotNull() & p.isNotNull(), inside)

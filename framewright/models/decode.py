"""Between images and tensors: resizing, normalisation, and the decoding of detector and classifier outputs."""

from __future__ import annotations

import struct
import zlib
from typing import Any

import numpy as np
import pyarrow as pa

from ..errors import EngineError
from ..sources import media

#: Normalisation by the preset "imagenet", and the letterbox fill.
IMAGENET_MEAN, IMAGENET_STD, PAD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), 114
NMS_IOU = 0.45


def png_pixels(data: bytes) -> np.ndarray:
    """Height x width x 3 bytes of a PNG with 8-bit samples, not interlaced (grey, RGB, palette, with or without alpha)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise EngineError("MEDIA_DECODE_FAILED", "not a PNG")
    at, packed, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[6]:
        raise EngineError("MEDIA_DECODE_FAILED", "only 8-bit PNG without interlacing")
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * channels)
    except (zlib.error, ValueError) as e:
        raise EngineError("MEDIA_DECODE_FAILED", f"broken PNG: {e}") from None
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.int32)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if kind == 1:
            line = np.cumsum(line.reshape(w, channels), axis=0).reshape(-1)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            for x in range(len(line)):
                left = line[x - channels] & 255 if x >= channels else 0
                if kind == 3:
                    line[x] += (left + above[x]) // 2
                else:
                    corner = above[x - channels] if x >= channels else 0
                    near = left + above[x] - corner
                    line[x] += min((abs(near - left), 0, left), (abs(near - above[x]), 1, above[x]), (abs(near - corner), 2, corner))[2]
        above = line & 255
        out[y] = above
    pixels = out.reshape(h, w, channels)
    if head[3] == 3:
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3]


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, sample centres aligned."""
    h, w = pixels.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = pixels.astype(np.float64)
    top = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx
    low = p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def fit(pixels: np.ndarray, size: tuple[int, int], how: str = "letterbox", pad: int = PAD) -> tuple[np.ndarray, tuple]:
    """Pixels in a frame of this (height, width), and (left, top, width, height) of the image in it."""
    (height, width), (h, w) = size, pixels.shape[:2]
    if how == "letterbox":
        scale = min(width / w, height / h)
        nw, nh = max(1, round(w * scale)), max(1, round(h * scale))
        left, top = (width - nw) // 2, (height - nh) // 2
        out = np.full((height, width, 3), pad, np.float64)
        out[top : top + nh, left : left + nw] = resize(pixels, nh, nw)
        return out, (left, top, nw, nh)
    if how == "center_crop":
        scale = max(width / w, height / h)
        nw, nh = max(width, round(w * scale)), max(height, round(h * scale))
        left, top = (nw - width) // 2, (nh - height) // 2
        return resize(pixels, nh, nw)[top : top + height, left : left + width], (-left, -top, nw, nh)
    raise EngineError("INVALID_PARAMETER", f"unknown resize {how!r}")


def images(rows: list[dict], options: dict[str, Any]) -> tuple[np.ndarray, list[tuple]]:
    """A float32 tensor of images by the options layout, resize, image_size, preprocess, mean, std, scale and pad_value."""
    size = options.get("image_size", (640, 640))
    size = (size, size) if isinstance(size, int) else tuple(size)
    preset = options.get("preprocess") == "imagenet"
    mean, std = options.get("mean", IMAGENET_MEAN if preset else (0, 0, 0)), options.get("std", IMAGENET_STD if preset else (1, 1, 1))
    tensors, geometry = [], []
    for row in rows:
        encoded = row.get("encoded")
        if encoded is None and row.get("uri") and row.get("pts_ms") is not None:
            encoded = media.frame(row["uri"], row["pts_ms"])  # frames of a clip carry where they stand, not their pixels
        if encoded is None:
            raise EngineError("MEDIA_DECODE_FAILED", "the image has neither encoded bytes nor a place in a clip")
        frame, where = fit(png_pixels(encoded), size, options.get("resize", "letterbox"), options.get("pad_value", PAD))
        x = (frame * options.get("scale", 1 / 255) - np.array(mean)) / np.array(std)
        tensors.append(x if options.get("layout", "NCHW") == "NHWC" else x.transpose(2, 0, 1))
        geometry.append((*size, *where))
    return np.stack(tensors).astype(np.float32), geometry


def tensor(values: pa.Array, kind: str, shape: list) -> np.ndarray:
    """One model input of an Arrow array, of the type that the graph declares."""
    of = {"tensor(float)": np.float32, "tensor(double)": np.float64, "tensor(int64)": np.int64, "tensor(int32)": np.int32, "tensor(int8)": np.int8, "tensor(int16)": np.int16, "tensor(uint8)": np.uint8}.get(kind)
    if of is None:
        raise EngineError("FEATURE_NOT_AVAILABLE", f"model input of type {kind}")
    out = np.array(values.to_pylist(), of)
    return out.reshape(len(values), *[s if isinstance(s, int) else -1 for s in shape[1:]]) if len(shape) > 1 else out


def undo(box: tuple[float, float, float, float], geometry: tuple) -> dict[str, float]:
    """A box (left, top, right, bottom in frame pixels) as shares of the image, clamped."""
    _, _, left, top, w, h = geometry
    x0, x1 = (min(1.0, max(0.0, (v - left) / w)) for v in (box[0], box[2]))
    y0, y1 = (min(1.0, max(0.0, (v - top) / h)) for v in (box[1], box[3]))
    return {"x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0}


def iou(a: dict, b: dict) -> float:
    w = max(0.0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]))
    h = max(0.0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return w * h / union if union > 0 else 0.0


def suppress(found: list[dict], limit: float = NMS_IOU) -> list[dict]:
    """Greedy suppression inside each class, by falling confidence."""
    kept: list[dict] = []
    for d in sorted((d for d in found if np.isfinite(d["confidence"]) and 0 < d["confidence"] <= 1), key=lambda d: -d["confidence"]):
        if all(k["label"] != d["label"] or iou(k["box"], d["box"]) < limit for k in kept):
            kept.append(d)
    return kept


def detections(raw: np.ndarray, geometry: tuple, labels: list[str], form: str) -> list[dict]:
    """Detections of one image: yolo_e2e (rows of box corners, score, class), yolo_raw (4 + classes x boxes) or xywh_normalized."""
    found = []
    if form == "yolo_e2e":
        for x0, y0, x1, y1, score, k in raw.reshape(-1, 6).tolist():
            if 0 < score <= 1 and 0 <= int(k) < len(labels):
                found.append({"label": labels[int(k)], "confidence": score, "box": undo((x0, y0, x1, y1), geometry)})
        return sorted(found, key=lambda d: -d["confidence"])
    rows = raw.T if form == "yolo_raw" else raw
    for row in rows.tolist():
        k = int(np.argmax(row[4:]))
        x, y, w, h = row[:4]
        box = undo((x - w / 2, y - h / 2, x + w / 2, y + h / 2), geometry) if form == "yolo_raw" else {"x": x, "y": y, "w": w, "h": h}
        found.append({"label": labels[k], "confidence": row[4 + k], "box": box})
    return suppress(found)


def outputs(raw: np.ndarray, geometry: list[tuple], model: Any) -> list[list[dict]]:
    """Decoded rows of a batch by the option format."""
    labels, form = list(model.options.get("labels", [])), model.options.get("format", "yolo_e2e")
    if model.kind == "IMAGE_CLASSIFICATION" or form == "classification":
        scores = raw.reshape(len(geometry), -1)
        if not ((scores >= 0) & (scores <= 1)).all():
            raise EngineError("MODEL_RUNTIME_FAILED", "classification score outside [0, 1]")
        return [[{"label": n, "score": s} for s, n in sorted(zip(row.tolist(), labels, strict=True), key=lambda p: (-p[0], p[1]))] for row in scores]
    return [detections(r, g, labels, form) for r, g in zip(raw, geometry, strict=True)]

"""Small ONNX graphs written byte by byte: nodes without attributes over float vectors. For samples and tests where no model file is at hand."""

from __future__ import annotations

#: The format's number of 32-bit floats, and the versions written.
FLOAT, IR_VERSION, OPSET = 1, 8, 13


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def _vector(name: str, shape: list[int | str]) -> bytes:
    dims = b"".join(_field(1, _field(1, d) if isinstance(d, int) else _field(2, d)) for d in shape)
    return _field(1, name) + _field(2, _field(1, _field(1, FLOAT) + _field(2, dims)))


def graph(nodes: list[tuple[str, list[str], list[str]]], inputs: dict[str, list[int | str]], outputs: dict[str, list[int | str]]) -> bytes:
    """A model of nodes (operator, inputs, outputs) with named inputs and outputs of given shapes; a text is a free dimension."""
    body = b"".join(_field(1, b"".join(_field(1, i) for i in before) + b"".join(_field(2, o) for o in after) + _field(4, op)) for op, before, after in nodes)
    body += _field(2, "graph") + b"".join(_field(11, _vector(n, s)) for n, s in inputs.items()) + b"".join(_field(12, _vector(n, s)) for n, s in outputs.items())
    return _field(1, IR_VERSION) + _field(7, body) + _field(8, _field(1, "") + _field(2, OPSET))

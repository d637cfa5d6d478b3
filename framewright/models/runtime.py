"""Model runtimes: a deterministic mock, and ONNX through onnxruntime; both vectorised over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types
from ..errors import EngineError
from ..sources.media import read_bytes

#: Rows of one call of a runtime.
BATCH = 16
#: The mock's box and confidence.
MOCK_BOX, MOCK_CONFIDENCE = (0.25, 0.25, 0.5, 0.5), 0.9
#: Runtimes that are named but not offered.
UNAVAILABLE = ("transformers", "vllm", "sglang", "llama-cpp")


def artifact_hash(source: str) -> str:
    """SHA-256 of a model file, or of the source text where there is no file to read."""
    if not source.startswith(("mock://", "triton+")):
        try:
            return hashlib.sha256(read_bytes(source)).hexdigest()
        except (OSError, ValueError):
            pass
    return hashlib.sha256(source.encode()).hexdigest()


@dataclass(frozen=True)
class Model:
    """One immutable version of a model."""

    name: str
    kind: str  # OBJECT_DETECTION, IMAGE_CLASSIFICATION or GENERIC
    source: str
    version: str = "v1"
    runtime: str = ""
    options: dict[str, Any] = field(default_factory=dict, hash=False)
    arguments: tuple[T.DataType, ...] = ()
    returns: T.DataType | None = None
    volatile: bool = False

    @property
    def runtime_name(self) -> str:
        if self.runtime:
            return self.runtime.lower().replace("_", "-")
        if self.source.startswith("mock://"):
            return "mock"
        return "triton" if self.source.startswith("triton+") else "onnx-runtime"

    @property
    def fingerprint(self) -> str:
        """Hash of what decides the result, the artifact's bytes among it; a mock's artifact is its source text."""
        said = repr((self.kind, artifact_hash(self.source), self.runtime_name, sorted(self.options.items()), [t.simpleString() for t in self.arguments], self.returns and self.returns.simpleString()))
        return hashlib.sha256(said.encode()).hexdigest()

    def result_type(self) -> T.DataType:
        if self.kind == "OBJECT_DETECTION":
            return types.DETECTIONS
        if self.kind == "IMAGE_CLASSIFICATION":
            return types.CLASSIFICATION
        return self.returns or (self.arguments[0] if self.arguments else T.StringType())


def mock_labels(model: Model) -> list[str]:
    own = model.options.get("labels") or model.source.removeprefix("mock://").split(",")
    return [x.strip() for x in (own.split(",") if isinstance(own, str) else own) if x.strip()]


def mock_call(model: Model) -> Callable[..., Column]:
    """The mock as a Catalyst expression: nothing to decode, nothing to run."""

    def call(*arguments: Column) -> Column:
        first = arguments[0]
        if model.kind == "OBJECT_DETECTION":
            label = (mock_labels(model) or ["object"])[0]
            b = F.struct(*[F.lit(v).cast("float").alias(n) for v, n in zip(MOCK_BOX, "xywh", strict=True)])
            one = F.struct(F.lit(label).alias("label"), F.lit(MOCK_CONFIDENCE).cast("float").alias("confidence"), b.alias("box"))
            return F.when(first.isNotNull(), F.array(one))
        if model.kind == "IMAGE_CLASSIFICATION":
            labels = mock_labels(model)
            scores = [1.0 if k == 0 else 0.0 for k in range(len(labels))]
            return F.when(first.isNotNull(), F.array(*[F.struct(F.lit(n).alias("label"), F.lit(s).cast("float").alias("score")) for n, s in zip(labels, scores, strict=True)]))
        if model.returns is not None and (not model.arguments or model.arguments[0] != model.returns):
            return F.lit(None).cast(model.returns)
        alive = F.lit(True)
        for a in arguments:
            alive = alive & a.isNotNull()
        return F.when(alive, first)

    return call


_SESSIONS: dict[str, Any] = {}


def _session(key: str, source: str):
    """The worker's session of a model, made once."""
    if key not in _SESSIONS:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        _SESSIONS[key] = onnxruntime.InferenceSession(read_bytes(source), options, providers=["CPUExecutionProvider"])
    return _SESSIONS[key]


def scatter(values: list[pa.Array], run: Callable[[list[pa.Array]], pa.Array], strict: bool, kind: pa.DataType) -> pa.Array:
    """Rows whose arguments are all there go through run in chunks of BATCH; the others are null.

    A failing chunk is null in every row, or fails the query if strict; exhausted memory always fails.
    """
    n = len(values[0])
    alive = np.ones(n, bool)
    for v in values:
        alive &= ~np.asarray(v.is_null())
    rows = np.nonzero(alive)[0]
    out: list[Any] = [None] * n
    for i in range(0, len(rows), BATCH):
        part = rows[i : i + BATCH]
        try:
            got = run([v.take(pa.array(part)) for v in values]).to_pylist()
            if len(got) != len(part):
                raise EngineError("MODEL_RUNTIME_FAILED", f"a runtime gave {len(got)} rows for {len(part)}")
        except MemoryError:
            raise
        except Exception:
            if strict:
                raise
            continue
        for k, v in zip(part.tolist(), got, strict=True):
            out[k] = v
    return pa.array(out, kind)


def call(model: Model, strict: bool = False) -> Callable[..., Column]:
    """The model as a function of columns. Anything but the mock is a nondeterministic Arrow UDF, so it runs once a row."""
    name = model.runtime_name
    if name == "mock":
        return mock_call(model)
    if name in UNAVAILABLE or name == "triton":
        raise EngineError("FEATURE_NOT_AVAILABLE", f"runtime {name} is not available")
    from pyspark.sql.pandas.types import to_arrow_type

    from . import decode

    result = model.result_type()
    kind, key = to_arrow_type(result), model.fingerprint

    def run(chunk: list[pa.Array]) -> pa.Array:
        session = _session(key, model.source)
        wanted = [model.options["output"]] if "output" in model.options else None  # a graph's first output unless one is named
        if model.kind == "GENERIC":
            feeds = {i.name: decode.tensor(v, i.type, i.shape) for i, v in zip(session.get_inputs(), chunk, strict=True)}
            first = np.asarray(session.run(wanted, feeds)[0])
            return pa.array(first.reshape(len(chunk[0]), -1).tolist() if isinstance(result, T.ArrayType) else first.reshape(-1).tolist(), kind)
        pixels, geometry = decode.images(chunk[0].to_pylist(), model.options)
        raw = session.run(wanted, {session.get_inputs()[0].name: pixels})[0]
        return pa.array(decode.outputs(np.asarray(raw), geometry, model), kind)

    def body(*values: pa.Array) -> pa.Array:
        return scatter(list(values), run, strict, kind)

    # an Arrow UDF of a fixed arity: its signature is what Spark inspects
    arity = max(1, len(model.arguments))
    scope: dict[str, Any] = {"body": body, "pa": pa}
    names = ", ".join(f"a{k}: pa.Array" for k in range(arity))
    exec(f"def udf({names}) -> pa.Array:\n    return body({', '.join(f'a{k}' for k in range(arity))})", scope)
    return F.arrow_udf(scope["udf"], result).asNondeterministic()

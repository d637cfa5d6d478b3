"""Sinks of continuous queries: JSON rows, schema checks, LIMIT before the write."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types
from ..errors import EngineError

#: Fields of an image that leave the engine.
IMAGE_FIELDS = ("uri", "locator", "pts_ms", "frame_id", "encoding", "width", "height")
TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS"
#: Producer settings: every replica acknowledges, nothing is retried, the client does not make topics.
PRODUCER = {"kafka.acks": "all", "kafka.retries": "0", "kafka.enable.idempotence": "false", "kafka.allow.auto.create.topics": "false"}


def is_image(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.StructType) and [x.name for x in f.dataType] == [x.name for x in types.IMAGE]


def check_schema(schema: T.StructType) -> None:
    """Reject what a JSON row can't carry: repeated names, binary anywhere but in an image, an image inside a value."""
    names = [f.name.lower() for f in schema]
    if twice := {n for n in names if names.count(n) > 1}:
        raise EngineError("SINK_FAILED", f"column {sorted(twice)[0]!r} appears more than once")

    def walk(t: T.DataType, at: str) -> None:
        if isinstance(t, T.BinaryType):
            raise EngineError("SINK_FAILED", f"column {at} is binary")
        if isinstance(t, T.ArrayType):
            walk(t.elementType, at)
        elif isinstance(t, T.MapType):
            walk(t.keyType, at)
            walk(t.valueType, at)
        elif isinstance(t, T.StructType):
            if [x.name for x in t] == [x.name for x in types.IMAGE]:
                raise EngineError("SINK_FAILED", f"column {at} holds an image inside a value")
            for x in t:
                walk(x.dataType, f"{at}.{x.name}")

    for f in schema:
        if not is_image(f):
            walk(f.dataType, f.name)


def match_columns(query: T.StructType, target: T.StructType) -> None:
    """Columns match by position and type; a column that may be null can't go where nulls can't."""
    if len(query) != len(target):
        raise EngineError("SINK_FAILED", f"the query has {len(query)} columns, the table {len(target)}")
    for q, t in zip(query, target, strict=True):
        if q.dataType != t.dataType or q.nullable and not t.nullable:
            raise EngineError("SINK_FAILED", f"column {q.name} ({q.dataType.simpleString()}) doesn't fit {t.name} ({t.dataType.simpleString()})")


def _plain(c: Column, t: T.DataType) -> Column:
    """A value as JSON takes it: numbers that are not finite become null."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(t, T.ArrayType) and _has_float(t.elementType):
        return F.transform(c, lambda x: _plain(x, t.elementType))
    if isinstance(t, T.StructType) and _has_float(t):
        return F.when(c.isNotNull(), F.struct(*[_plain(c[f.name], f.dataType).alias(f.name) for f in t]))
    return c


def _has_float(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _has_float(t.elementType)
    if isinstance(t, T.StructType):
        return any(_has_float(f.dataType) for f in t)
    return isinstance(t, (T.DoubleType, T.FloatType))


def clean_uri(uri: Column) -> Column:
    """A URI without user, query and fragment."""
    return F.regexp_replace(F.regexp_replace(uri, r"[?#].*$", ""), r"^([a-zA-Z][\w+.-]*://)[^/@]*@", "$1")


def json_rows(df: DataFrame, name: str = "value") -> DataFrame:
    """Each row as one JSON object: explicit nulls, columns in order, images without pixels, times in ISO 8601."""
    check_schema(df.schema)
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if is_image(f):
            c = F.when(c.isNotNull(), F.struct(*[(clean_uri(c[n]) if n == "uri" else c[n]).alias(n) for n in IMAGE_FIELDS]))
        else:
            c = _plain(c, f.dataType)
        columns.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "timestampFormat": TIMESTAMP, "timestampNTZFormat": TIMESTAMP}).alias(name))


def kafka_options(brokers: str, topic: str, timeout_ms: int = 30_000, capacity: int = 1024) -> dict[str, str]:
    """Options of Spark's Kafka writer, checked."""
    if not re.fullmatch(r"[A-Za-z0-9._-]{1,249}", topic) or topic in (".", ".."):
        raise EngineError("INVALID_PARAMETER", f"not a topic: {topic!r}")
    if not 1 <= timeout_ms <= 3_600_000 or not 1 <= capacity <= 100_000:
        raise EngineError("INVALID_PARAMETER", "timeout is 1 to 3600000 ms, capacity 1 to 100000")
    return PRODUCER | {"kafka.bootstrap.servers": brokers, "topic": topic, "kafka.delivery.timeout.ms": str(timeout_ms), "kafka.request.timeout.ms": str(timeout_ms), "kafka.linger.ms": "0", "kafka.max.in.flight.requests.per.connection": str(min(capacity, 1000))}


@dataclass
class Limit:
    """LIMIT and OFFSET over a stream, across its batches and before the write; done when the limit is reached."""

    limit: int | None
    offset: int = 0
    written: int = 0

    @property
    def done(self) -> bool:
        return self.limit is not None and self.limit <= 0

    def cut(self, batch: DataFrame) -> DataFrame:
        n = batch.count()
        skip, self.offset = min(self.offset, n), max(0, self.offset - n)
        take = n - skip if self.limit is None else min(self.limit, n - skip)
        if self.limit is not None:
            self.limit -= take
        self.written += take
        return batch.offset(skip).limit(take)


def for_each(write: Callable[[DataFrame, int], None], limit: Limit | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that applies the limit, then writes; a finished limit writes nothing more."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if limit is None:
            write(batch, batch_id)
        elif not limit.done:
            held = batch.persist()
            try:
                write(limit.cut(held), batch_id)
            finally:
                held.unpersist()

    return run

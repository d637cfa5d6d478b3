"""Logical types as Spark schemas; a marker in the field's metadata names the logical type."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


IMAGE = _struct(
    uri=T.StringType(), locator=T.StringType(), pts_ms=T.LongType(), frame_id=T.LongType(), encoded=T.BinaryType(), encoding=T.StringType(),
    width=T.IntegerType(), height=T.IntegerType(), buffer_id=T.LongType(), buffer_slot=T.LongType(),
)
VIDEO = _struct(uri=T.StringType(), locator=T.StringType(), duration_ns=T.LongType(), fps=T.DoubleType(), width=T.IntegerType(), height=T.IntegerType(), codec=T.StringType())
BOX2D = T.StructType([T.StructField(n, T.FloatType(), False) for n in "xywh"])
POINT2D = T.StructType([T.StructField(n, T.FloatType(), False) for n in "xy"])
POLYGON = T.ArrayType(POINT2D, False)
LOCATOR = _struct(char_span=_struct(start=T.IntegerType(), end=T.IntegerType()), box=BOX2D)
DETECTIONS = T.ArrayType(_struct(label=T.StringType(), confidence=T.FloatType(), box=BOX2D))
TASK_DETECTIONS = T.ArrayType(_struct(label=T.StringType(), score=T.FloatType(), locator=LOCATOR))
CLASSIFICATION = T.ArrayType(_struct(label=T.StringType(), score=T.FloatType()))

MARKERS = {"IMAGE": {"fw.type": "image", "fw.version": 1}, "BOX2D": {"fw.type": "box2d"}}


def _field(name: str, kind: T.DataType, nullable: bool = True, **metadata) -> T.StructField:
    return T.StructField(name, kind, nullable, metadata or None)


IMAGES_SCHEMA = T.StructType([
    _field("uri", T.StringType(), False), _field("image", IMAGE, False, **MARKERS["IMAGE"]), _field("width", T.IntegerType()),
    _field("height", T.IntegerType()), _field("captured_at", T.TimestampType()),
])
VIDEOS_SCHEMA = T.StructType([
    _field("uri", T.StringType(), False), _field("ts", T.TimestampType(), False), _field("pts_ms", T.LongType(), False), _field("frame_id", T.LongType(), False),
    _field("frame", IMAGE, False, **MARKERS["IMAGE"]), _field("duration", T.DoubleType()), _field("fps", T.DoubleType()), _field("width", T.IntegerType()),
    _field("height", T.IntegerType()), _field("codec", T.StringType()),
])
LIVE_SCHEMA = T.StructType([_field("ts", T.TimestampType(), False), _field("frame", IMAGE, False, **MARKERS["IMAGE"]), _field("frame_id", T.LongType(), False), _field("source", T.StringType(), False)])

#: Column types of a declared sink.
SINK_TYPES = {
    "STRING": T.StringType(), "BIGINT": T.LongType(), "LONG": T.LongType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BOOLEAN": T.BooleanType(),
    "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "TIMESTAMP": T.TimestampType(),
}
#: Argument and result types of Python functions; an unsigned type widens one size.
FUNCTION_TYPES = SINK_TYPES | {
    "IMAGE": IMAGE, "REAL": T.FloatType(), "VARCHAR": T.StringType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "BINARY": T.BinaryType(), "UTINYINT": T.ShortType(),
    "USMALLINT": T.IntegerType(), "UINTEGER": T.LongType(), "UBIGINT": T.DecimalType(20, 0),
}
RESERVED_TYPES = ("AUDIO", "MASK")


def is_window_state_scalar(kind: T.DataType) -> bool:
    """Whether a value of this type may be a grouping key or state of a streaming window."""
    return not isinstance(kind, (T.BinaryType, T.ArrayType, T.StructType, T.MapType))

"""Registered queries that go through sessions: statements, sources, streams and models, each with the SQL that states the same result."""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .. import session
from ..catalog.store import Catalog
from ..errors import EngineError
from ..models import graphs
from ..models.runtime import Model
from ..streaming import sink, windows
from . import catalogue, lexer
from .catalogue import query, table


def _shared(spark: SparkSession, name: str) -> str:
    return f"{session.checkpoint_folder(spark)}/engine/{name}-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a file on any file system that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def png(width: int, height: int, value: int = 128) -> bytes:
    """A grey picture."""
    rows = (b"\0" + bytes([value] * 3) * width) * height

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def values(columns: str, rows: Iterable[tuple]) -> str:
    """SQL of constant rows."""

    def text(v: object) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


def _connect(spark: SparkSession, script: str = "") -> session.Session:
    s = session.connect(spark, task_models={"detect": Model("d", "OBJECT_DETECTION", "mock://cat"), "classify": Model("c", "IMAGE_CLASSIFICATION", "mock://cat,dog")})
    s.run_script(script)
    return s


def _errors(s: session.Session, statements: Iterable[str]) -> list[tuple[str, str]]:
    """Each statement with the symbol of its error, '' for none."""
    out = []
    for text in statements:
        try:
            s.sql(text)
            out.append((text, ""))
        except EngineError as e:
            out.append((text, e.symbol))
    return out


# sources

SIZES = {"one.png": (1, 1), "wide.png": (2, 1), "widest.png": (3, 2)}


def _pictures(spark: SparkSession) -> str:
    at = _shared(spark, "images")
    for name, size in SIZES.items():
        _put(spark, f"{at}/{name}", png(*size))
    _put(spark, f"{at}/broken.png", png(4, 4)[:20])
    _put(spark, f"{at}/notes.txt", b"not an image")
    _put(spark, f"{at}/deep/more.PNG", png(5, 5))
    return at


IMAGE_ROWS = [(n, w, h, "png") for n, (w, h) in SIZES.items()] + [("broken.png", None, None, None)]


@query("images_scan", values("name, width, height, encoding", IMAGE_ROWS))
def images_scan(spark: SparkSession, d: str) -> DataFrame:
    s = _connect(spark, f"CREATE TABLE pics USING IMAGES LOCATION '{_pictures(spark)}'")
    return s.sql("SELECT regexp_replace(uri, '^.*/', '') AS name, width, height, image.encoding AS encoding FROM pics").df


@query("images_recursive_detect", values("name, people", [(n, 1) for n in ("broken.png", "more.PNG", *SIZES)]))
def images_recursive_detect(spark: SparkSession, d: str) -> DataFrame:
    s = _connect(spark, f"CREATE TABLE pics USING IMAGES OPTIONS (recursive = true) LOCATION '{_pictures(spark)}'; CREATE MODEL m TYPE OBJECT_DETECTION VERSION 'v1' FROM 'mock://person' USING ONNX_RUNTIME; RESOLVE MODEL m")
    return s.sql("SELECT regexp_replace(uri, '^.*/', '') AS name, CARDINALITY(m(image, classes => ['person'], min_confidence => 0.5)) AS people FROM pics").df


def _clips(spark: SparkSession, pixels: bool = False) -> str:
    at = _shared(spark, "videos")
    pts = [40 * k for k in range(100)]
    clip = {"pts_ms": pts, "fps": 25, "width": 320, "height": 240, "codec": "mpeg4", "duration": 4.0}
    if pixels:
        clip["frames"] = [base64.b64encode(png(8, 8, 2 * k)).decode() for k in range(100)]
    _put(spark, f"{at}/a.mp4", json.dumps(clip).encode())
    _put(spark, f"{at}/broken.mp4", b"no clip")
    return at


@query("videos_sampled", "SELECT range * 200 AS pts_ms, range AS frame_id, make_timestamp(1767225600000000 + range * 200000) AS ts, 25.0::DOUBLE AS fps, 4.0::DOUBLE AS duration FROM range(20)")
def videos_sampled(spark: SparkSession, d: str) -> DataFrame:
    s = _connect(spark, f"CREATE TABLE v USING VIDEOS OPTIONS (fps = 5, start_time = '2026-01-01T00:00:00Z') LOCATION '{_clips(spark)}'")
    return s.sql("SELECT pts_ms, frame_id, CAST(ts AS TIMESTAMP_NTZ) AS ts, fps, duration FROM v").df


@query("videos_time_filter", "SELECT 1000 + range * 200 AS pts_ms FROM range(5)")
def videos_time_filter(spark: SparkSession, d: str) -> DataFrame:
    s = _connect(spark, f"CREATE TABLE v USING VIDEOS OPTIONS (fps = 5) LOCATION '{_clips(spark)}'")
    return s.sql("SELECT pts_ms FROM v WHERE ts >= TIMESTAMP '1970-01-01 00:00:01' AND ts < TIMESTAMP '1970-01-01 00:00:02'").df


@query("external_table", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def external_table(spark: SparkSession, d: str) -> DataFrame:
    return _connect(spark, f"CREATE TABLE ev USING EXTERNAL LOCATION '{d}/events.parquet'").sql("SELECT event_type, count(*) AS n FROM ev GROUP BY event_type").df


# models

def _onnx(spark: SparkSession, nodes: list, inputs: dict, outputs: dict) -> str:
    path = f"{_shared(spark, 'model')}.onnx"
    _put(spark, path, graphs.graph(nodes, inputs, outputs))
    return path


@query("onnx_generic", "SELECT event_id, CASE WHEN value > 50 THEN CAST(value AS FLOAT) + CAST(value AS FLOAT) END AS twice, CASE WHEN value > 50 THEN CAST(value AS FLOAT) * CAST(value AS FLOAT) END AS squared FROM events")
def onnx_generic(spark: SparkSession, d: str) -> DataFrame:
    path = _onnx(spark, [("Add", ["x", "x"], ["sum"]), ("Mul", ["x", "x"], ["product"])], {"x": ["n"]}, {"sum": ["n"], "product": ["n"]})
    s = _connect(spark, f"""CREATE TABLE ev USING EXTERNAL LOCATION '{d}/events.parquet';
      CREATE MODEL twice (x FLOAT) RETURNS FLOAT VERSION 'v1' FROM '{path}' USING ONNX_RUNTIME; RESOLVE MODEL twice;
      CREATE MODEL squared (x FLOAT) RETURNS FLOAT VERSION 'v1' FROM '{path}' USING ONNX_RUNTIME OPTIONS (output = 'product'); RESOLVE MODEL squared""")
    return s.sql("SELECT event_id, twice(v) AS twice, squared(v) AS squared FROM (SELECT event_id, CASE WHEN value > 50 THEN CAST(value AS FLOAT) END AS v FROM ev) e").df


@query("onnx_over_video_frames", "SELECT range * 200 AS pts_ms, round((range * 10)::DOUBLE / 255, 4) AS brightness FROM range(20)")
def onnx_over_video_frames(spark: SparkSession, d: str) -> DataFrame:
    """A classifier that gives the highest value of each colour, over frames of a clip that only say where they stand."""
    path = _onnx(spark, [("Neg", ["x"], ["minus"]), ("GlobalMaxPool", ["x"], ["y"])], {"x": ["n", 3, 8, 8]}, {"minus": ["n", 3, 8, 8], "y": ["n", 3, 1, 1]})
    model = Model("bright", "IMAGE_CLASSIFICATION", path, runtime="ONNX_RUNTIME", options={"labels": ["r", "g", "b"], "image_size": 8, "output": "y"})
    s = session.connect(spark, task_models={"classify": model})
    s.sql(f"CREATE TABLE v USING VIDEOS OPTIONS (fps = 5) LOCATION '{_clips(spark, pixels=True)}'")
    return s.sql("SELECT pts_ms, round(CAST(AI_CLASSIFY(frame, ['r'])[1].score AS DOUBLE), 4) AS brightness FROM v").df


# statements

@query("ddl_tables", values("result", [("k|KAFKA|",), ("pics|IMAGES|/x/pics",), ("a|bigint|false",), ("b|string|true",), ("CREATE TABLE \"k\" (a BIGINT NOT NULL, b STRING) USING KAFKA OPTIONS (brokers = 'x:9092', password = '[REDACTED]', topic = 't')",), ("after drop: pics",)]))
def ddl_tables(spark: SparkSession, d: str) -> DataFrame:
    s = _connect(spark, "CREATE TABLE k (a BIGINT NOT NULL, b STRING) USING KAFKA OPTIONS (brokers = 'x:9092', topic = 't', password = 'p'); CREATE TABLE pics USING IMAGES LOCATION '/x/pics'")
    out = _lines(s, "SHOW TABLES") + _lines(s, "DESCRIBE TABLE k") + [r["create_statement"] for r in s.sql("SHOW CREATE TABLE k").collect().to_pylist()]
    s.sql("DROP TABLE k")
    out.append("after drop: " + ",".join(r["table_name"] for r in s.sql("SHOW TABLES").collect().to_pylist()))
    return spark.createDataFrame([(x,) for x in out], "result string")


def _lines(s: session.Session, text: str) -> list[str]:
    return ["|".join("" if v is None else str(v) for v in r.values()) for r in s.sql(text).collect().to_pylist()]


MODEL_SCRIPT = [
    ("CREATE MODEL m TYPE OBJECT_DETECTION VERSION 'v1' FROM 'mock://person' USING ONNX_RUNTIME COMMENT 'people'", "created model 'm'"),
    ("CREATE MODEL IF NOT EXISTS m TYPE OBJECT_DETECTION VERSION 'v1' FROM 'mock://person' USING ONNX_RUNTIME", "model 'm' already exists"),
    ("SELECT m(1)", "MODEL_NOT_RESOLVED"), ("RESOLVE MODEL m", "resolved model 'm:v1'"), ("RESOLVE MODEL m", "model 'm:v1' is already resolved"),
    ("ALTER MODEL m ADD VERSION 'v2' FROM 'mock://car'", "added model version 'm:v2'"), ("ALTER MODEL m SET DEFAULT_VERSION 'v2'", "MODEL_NOT_RESOLVED"), ("ALTER MODEL m DROP VERSION 'v1'", "INVALID_PARAMETER"),
    ("RESOLVE MODEL m VERSION 'v2'", "resolved model 'm:v2'"), ("ALTER MODEL m SET DEFAULT_VERSION 'v2'", "set model 'm' default version to 'v2'"), ("SELECT m(1)[1].label AS l", "car"), ("SELECT m(1, version => 'v1')[1].label AS l", "person"),
    ("SHOW CREATE MODEL m", "m"), ("ALTER MODEL m RENAME TO n", "renamed model 'm' to 'n'"), ("DESCRIBE MODEL n", "name"), ("DROP MODEL n", "dropped object 'n'"), ("DESCRIBE MODEL n", "OBJECT_NOT_FOUND"),
]


@query("ddl_models", values("step, said", [(k, said) for k, (_, said) in enumerate(MODEL_SCRIPT)]))
def ddl_models(spark: SparkSession, d: str) -> DataFrame:
    s, out = _connect(spark), []
    for k, (text, _) in enumerate(MODEL_SCRIPT):
        try:
            out.append((k, str(next(iter(s.sql(text).collect().to_pylist()[0].values())))))
        except EngineError as e:
            out.append((k, e.symbol))
    return spark.createDataFrame(out, "step int, said string")


def double(x: pa.Array) -> pa.Array:
    return pc.multiply(x, 2)


def broken(x: pa.Array) -> pa.Array:
    raise ValueError("broken")


@query("python_function_session", "SELECT s_suppkey, 2 * s_suppkey + 2 AS twice, NULL::BIGINT AS failed FROM supplier")
def python_function_session(spark: SparkSession, d: str) -> DataFrame:
    s = _connect(spark, f"""CREATE TABLE sup USING EXTERNAL LOCATION '{d}/supplier.parquet'; CREATE FUNCTION add_one(x BIGINT) RETURN x + 1;
      CREATE FUNCTION dbl(x BIGINT) RETURNS BIGINT LANGUAGE PYTHON AS 'framewright.plans.engine:double'; CREATE FUNCTION bad(x BIGINT) RETURNS BIGINT LANGUAGE PYTHON AS 'framewright.plans.engine:broken'""")
    return s.sql("SELECT s_suppkey, dbl(add_one(x => s_suppkey)) AS twice, bad(s_suppkey) AS failed FROM sup").df


REJECTED = [
    ("UPDATE t SET a = 1", "INVALID_SQL"), ("CREATE INDEX i", "FEATURE_NOT_AVAILABLE"), ("CREATE AGGREGATE a", "FEATURE_NOT_AVAILABLE"), ("CREATE TABLE t AS SELECT 1", "FEATURE_NOT_AVAILABLE"), ("DROP TABLE none", "OBJECT_NOT_FOUND"),
    ("SET fw.other = 1", "INVALID_PARAMETER"), ("CREATE TABLE t (a INT) USING IMAGES LOCATION 'x'", "INVALID_SQL"), ("PAUSE JOB j", "FEATURE_NOT_AVAILABLE"), ("EXPLAIN ANALYZE SELECT 1", "FEATURE_NOT_AVAILABLE"),
    ("CREATE TABLE cam USING RTSP OPTIONS (url = 'rtsp://u:p@x/live')", "INVALID_PARAMETER"), ("INSERT INTO t (a) SELECT 1", "INVALID_SQL"), ("SELECT __fw_x FROM (SELECT 1 AS a)", "INVALID_SQL"), ("SELECT AI_EXTRACT(1, MAP {'a': 'what?'})", "FEATURE_NOT_AVAILABLE"), ("SELECT AI_EXTRACT(1, 'x')", "INVALID_PARAMETER"), ("SELECT AI_EXTRACT(NULL, MAP {'a': 'b', 'A': 'c'})", "INVALID_PARAMETER"),
    ("SELECT 1 AS k QUALIFY k > 0", "INVALID_SQL"), ("CREATE FUNCTION f(x BIGINT) RETURNS IMAGE LANGUAGE PYTHON AS 'no_colon'", "INVALID_SQL"),
]


@query("ddl_rejected", values("statement, symbol", REJECTED))
def ddl_rejected(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_errors(_connect(spark), [t for t, _ in REJECTED]), "statement string, symbol string")


@query("script_split_and_explain", values("part", [("SELECT ';' AS a",), ("-- x;y\nSELECT /* ; */ 2",), ("FramewrightPlan mode=bounded",), ("fw.on_error = 'fail'",)]))
def script_split_and_explain(spark: SparkSession, d: str) -> DataFrame:
    s = _connect(spark)
    parts = lexer.split("SELECT ';' AS a; -- x;y\nSELECT /* ; */ 2;")
    parts += [_lines(s, "EXPLAIN SELECT 1 AS a")[0], *_lines(s, "SET fw.on_error = 'fail'")]
    return spark.createDataFrame([(p,) for p in parts], "part string")


@query("insert_json", "SELECT '{\"k\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}' AS value FROM region")
def insert_json(spark: SparkSession, d: str) -> DataFrame:
    """INSERT into a sink, its transport replaced by files."""
    at = _shared(spark, "sink")
    s = _connect(spark, f"CREATE TABLE r USING EXTERNAL LOCATION '{d}/region.parquet'; CREATE TABLE out (k INT, name STRING) USING KAFKA OPTIONS (brokers = 'b:9092', topic = 't', path = '{at}')")
    s.sink_format = "text"
    s.sql("INSERT INTO out SELECT r_regionkey AS k, r_name AS name FROM r")
    return spark.read.text(at)


SINK_SCHEMAS = ["a binary", "a array<binary>", "a long, A long", "a struct<x: binary>", "a long, b string", "a array<struct<x: int>>"]


@query("sink_schemas", values("columns, symbol", [(c, "" if k > 3 else "SINK_FAILED") for k, c in enumerate(SINK_SCHEMAS)]))
def sink_schemas(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for columns in SINK_SCHEMAS:
        try:
            sink.check_schema(spark.createDataFrame([], columns).schema)
            out.append((columns, ""))
        except EngineError as e:
            out.append((columns, e.symbol))
    return spark.createDataFrame(out, "columns string, symbol string")


_ANSWER = "struct<value:string,score:float,locator:struct<char_span:struct<start:int,end:int>,box:struct<x:float,y:float,w:float,h:float>>>"


@query("extract_typed_null", values("kind, missing", [(f"struct<total:{_ANSWER},items:array<{_ANSWER}>>", True)]))
def extract_typed_null(spark: SparkSession, d: str) -> DataFrame:
    return _connect(spark).sql("SELECT typeof(x) AS kind, x IS NULL AS missing FROM (SELECT AI_EXTRACT(NULL, fields => MAP {'Total': 'What is the total?', 'items': STRUCT('List the items' AS question, TRUE AS list)}) AS x) e").df


# clauses

def through_session(name: str, text: str, oracle: str, *tables: str) -> None:
    """A query in the dialect over tables of the folder; the oracle is DuckDB's."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _connect(spark, ";".join(f"CREATE TABLE {t} USING EXTERNAL LOCATION '{d}/{t}.parquet'" for t in tables)).sql(text).df

    query(name, oracle)(run)


through_session("qualify_nested", "SELECT c.o_custkey, c.o_orderkey FROM (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) c",
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1", "orders")
through_session("distinct_on_nested", "WITH f AS (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey) SELECT count(*) AS n, sum(o_orderkey) AS s FROM f",
    "SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS s FROM (SELECT min(o_orderkey) AS k FROM orders GROUP BY o_custkey)", "orders")
through_session("groups_frame_sql", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM part WHERE p_size > 3",
    "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM part WHERE p_size > 3", "part")
through_session("star_replace", "SELECT * REPLACE (n_nationkey * 10 AS n_nationkey) FROM nation", "SELECT * REPLACE (n_nationkey * 10 AS n_nationkey) FROM nation", "nation")
through_session("window_named", "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)", "SELECT o_orderkey, rank() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)", "orders")
through_session("unnest_in_select", "SELECT vec_id, UNNEST(embedding) AS x FROM embeddings", "SELECT vec_id, unnest(embedding) AS x FROM embeddings", "embeddings")
through_session("center_of_a_box", "SELECT p_partkey, named_struct('x', CAST(p_size AS FLOAT), 'y', 0F, 'w', 2F, 'h', 4F).center.x AS cx FROM part", "SELECT p_partkey, CAST(p_size + 1 AS FLOAT) AS cx FROM part", "part")
through_session("introspection", "SELECT arrow_typeof(1.5F) AS f, array_ndims([[1], [2]]) AS dims, arrow_typeof('x') AS s", "SELECT 'float' AS f, CAST(2 AS BIGINT) AS dims, 'string' AS s")


# streams

CAMERA = "CREATE TABLE cam USING RTSP OPTIONS (url = 'rtsp://replay', rows = 200, rowsPerBatch = 50, fps = 10)"


@contextmanager
def _few_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep the little state of these queries in few partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _collected(spark: SparkSession, text: str, columns: str) -> DataFrame:
    """A query over a replayed camera, run as a stream until its LIMIT."""
    with _few_partitions(spark):
        found = _connect(spark, CAMERA).sql(text).collect()
    return spark.createDataFrame([tuple(r.values()) for r in found.to_pylist()], columns)


@query("stream_limit_offset", "SELECT 15 + range AS n FROM range(120) LIMIT 120")
def stream_limit_offset(spark: SparkSession, d: str) -> DataFrame:
    return _collected(spark, "SELECT frame_id AS n FROM cam LIMIT 120 OFFSET 15", "n long")


@query("stream_projection", "SELECT range * 2 AS n, 640 AS width, 'replay' AS source FROM range(60)")
def stream_projection(spark: SparkSession, d: str) -> DataFrame:
    return _collected(spark, "SELECT frame_id AS n, frame.width AS width, source FROM cam WHERE frame_id % 2 = 0 LIMIT 60", "n long, width int, source string")


@query("stream_inference", "SELECT range AS n, 'cat' AS label FROM range(30)")
def stream_inference(spark: SparkSession, d: str) -> DataFrame:
    return _collected(spark, "SELECT frame_id AS n, u.d.label AS label FROM cam, UNNEST(AI_DETECT(frame, ['cat'])) AS u(d) LIMIT 30", "n long, label string")


@query("stream_tumble_having", "SELECT make_timestamp(range * 2000000) AS w, CAST(20 AS BIGINT) AS n, 20 * range * 20 + 190 AS total FROM range(1, 7)")
def stream_tumble_having(spark: SparkSession, d: str) -> DataFrame:
    found = _collected(spark, "SELECT TUMBLE(ts, INTERVAL '2' SECOND) w, count(*) AS n, sum(frame_id) AS total FROM cam GROUP BY 1 HAVING sum(frame_id) > 200 LIMIT 6", "w timestamp, n long, total long")
    return found.selectExpr("CAST(w AS TIMESTAMP_NTZ) AS w", "n", "total")


@query("stream_recording", "SELECT range AS n, make_timestamp((CASE WHEN range < 20 THEN 1000 + range * 200 ELSE 2000 + range * 200 END) * 1000) AS ts FROM range(40)")
def stream_recording(spark: SparkSession, d: str) -> DataFrame:
    """A recording of two connections at 25 frames a second, sampled at 5, event times by the capture clock."""
    path = f"{_shared(spark, 'recording')}.jsonl"
    packets = [{"connection": c, "pts_ms": 40 * k, "ingest_ms": begin + 40 * k + (k % 3 if k else 0)} for c, begin in ((0, 1000), (1, 6000)) for k in range(100)]
    _put(spark, path, "\n".join(map(json.dumps, packets)).encode())
    s = _connect(spark, f"CREATE TABLE cam USING RTSP OPTIONS (url = 'rtsp://replay', recording = '{path}', fps = 5)")
    rows = s.sql("SELECT frame_id, ts FROM cam LIMIT 40").collect().to_pylist()
    return spark.createDataFrame([(r["frame_id"], r["ts"]) for r in rows], "n long, ts timestamp").selectExpr("n", "CAST(ts AS TIMESTAMP_NTZ) AS ts")


CATALOG_STEPS = ["first", "updated", "snapshot kept", "CATALOG_CONFLICT", "OBJECT_ALREADY_EXISTS", "second generation", "RUNNING", "STOPPED", "STOPPED"]


@query("catalog_revisions", values("step, outcome", list(enumerate(CATALOG_STEPS))))
def catalog_revisions(spark: SparkSession, d: str) -> DataFrame:
    c, out = Catalog(), []
    first = c.put("TABLE", "T", {"a": 1})
    before = c.snapshot()
    out.append("first" if before.get("TABLE", "t").body == {"a": 1} else "")
    c.put("TABLE", "t", {"a": 2}, expected=first)
    out += ["updated" if c.snapshot().get("TABLE", "t").body == {"a": 2} else "", "snapshot kept" if before.get("TABLE", "t").body == {"a": 1} else ""]
    c.put("MODEL", "m", {})
    for change in (lambda: c.put("TABLE", "t", {"a": 3}, expected=first), lambda: c.put("FUNCTION", "m", {})):
        try:
            change()
            out.append("")
        except EngineError as e:
            out.append(e.symbol)
    c.drop("TABLE", "t")
    c.put("TABLE", "t", {})
    out.append("second generation" if c.snapshot().get("TABLE", "t").generation == 2 else "")
    c.put("JOB", "j", {"state": "STARTING", "sql": "x", "error": None})
    out += [c.move_job("j", state)["state"] for state in ("RUNNING", "STOPPED", "RUNNING")]
    return spark.createDataFrame(list(enumerate(out)), "step int, outcome string")


@query("stream_tumble_replay", """SELECT * FROM (SELECT make_timestamp(epoch_us(ts) - epoch_us(ts) % 60000000) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
WHERE epoch_us(window_start) + 60000000 <= (SELECT max(epoch_us(ts)) - 2000000 FROM events) // 1000 * 1000""")
def stream_tumble_replay(spark: SparkSession, d: str) -> DataFrame:
    """Events replayed as a file stream through watermarked windows into files."""
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type", "value")
    out = _shared(spark, "windows")
    found = windows.tumbling(stream, "1 minute", ["event_type"], [("count", "*", "n"), ("sum", "value", "total")])
    with _few_partitions(spark):
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).selectExpr("CAST(window_start AS TIMESTAMP_NTZ) AS window_start", "event_type", "n", "round(total, 4) AS total")


STREAM_REJECTED = [
    "SELECT frame_id FROM cam ORDER BY frame_id", "SELECT DISTINCT source FROM cam", "SELECT a.frame_id FROM cam a JOIN cam b ON a.frame_id = b.frame_id", "SELECT frame_id FROM cam UNION ALL SELECT frame_id FROM cam",
    "SELECT source AS window_name, count(*) AS n FROM cam GROUP BY source", "SELECT count(*) AS n FROM cam", "SELECT frame_id FROM (SELECT frame_id FROM cam LIMIT 3) x", "SELECT row_number() OVER (ORDER BY ts) AS n FROM cam",
    *[f"SELECT TUMBLE(ts, INTERVAL '2' SECOND) AS w, {a} AS n FROM cam GROUP BY 1" for a in ("stddev(frame_id)", "approx_distinct(frame_id)", "count(*) FILTER (WHERE frame_id > 3)", "count(DISTINCT frame_id)", "count(frame.buffer_id)")],
]


@query("stream_rejected", values("statement, symbol", [(t, "UNSUPPORTED_QUERY") for t in STREAM_REJECTED] + [("SELECT frame_id FROM cam WHERE frame_id > 3", "")]))
def stream_rejected(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_errors(_connect(spark, CAMERA), [*STREAM_REJECTED, "SELECT frame_id FROM cam WHERE frame_id > 3"]), "statement string, symbol string")


QUERIES, ORACLES = catalogue.QUERIES, catalogue.ORACLES

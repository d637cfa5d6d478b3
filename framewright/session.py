"""Sessions: statements in, Arrow tables out; catalog, models and functions around Spark SQL."""

from __future__ import annotations

import hashlib
import importlib
import queue
import re
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import types
from .catalog.store import TERMINAL, Catalog, Entry, Snapshot
from .errors import EngineError
from .functions import spatial
from .functions.tumble import width_ms
from .models import runtime
from .operators import relational
from .plans import lexer, normalise, statements
from .sources import live, media
from .streaming import sink, validate

TASK = re.compile(r"^(?!(?:map|regexp|array|list)_)[A-Za-z]+_(CLASSIFY|DETECT|EXTRACT)$", re.I)
SECRET_KEY = re.compile(r"credential|password|secret|token", re.I)
PRODUCT = "Framewright"
#: Used only where spark.checkpoint.dir is unset (tests on one machine).
FALLBACK_DIR = "/tmp/framewright-checkpoints"


class QueryHandle:
    """A query that has been planned and not yet run. Over a stream, LIMIT and OFFSET at the top count rows across micro-batches."""

    def __init__(self, df: DataFrame, limit: sink.Limit | None = None):
        self.df, self.limit, self.tag = df, limit, f"fw-{id(self)}-{time.monotonic_ns()}"
        self.cancelled, self._query = False, None

    def collect(self) -> pa.Table:
        if getattr(self.df, "isStreaming", False):
            if self.limit is None or self.limit.limit is None:
                raise EngineError("UNSUPPORTED_QUERY", "an unbounded query is collected with LIMIT, or read by stream")
            from pyspark.sql.pandas.types import to_arrow_schema

            parts = list(self.stream())
            return pa.Table.from_batches(parts) if parts else to_arrow_schema(self.df.schema).empty_table()
        with self._tagged():
            try:
                return self.df.toArrow()
            except pa.ArrowInvalid:  # Arrow can't view a null struct whose fields are declared not null
                return pa.Table.from_pylist([r.asDict(recursive=True) for r in self.df.collect()])

    @contextmanager
    def _tagged(self) -> Iterator[None]:
        """Jobs inside carry the tag that cancel interrupts."""
        spark = self.df.sparkSession
        if self.cancelled:
            raise EngineError("CANCELLED", "the query was cancelled")
        spark.addTag(self.tag)
        try:
            yield
        finally:
            spark.removeTag(self.tag)

    def for_each_batch(self, f: Callable[[pa.RecordBatch], None]) -> None:
        """Rows in batches, a partition at a time on the driver."""
        for b in self.stream():
            f(b)

    def stream(self, rows: int = 1024) -> Iterator[pa.RecordBatch]:
        """Batches of rows; over a stream until LIMIT is reached, the query is cancelled or it fails."""
        if self.df.isStreaming:
            yield from self._batches(rows)
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, part = to_arrow_schema(self.df.schema), []
        with self._tagged():
            for row in self.df.toLocalIterator():
                part.append(row.asDict(recursive=True))
                if len(part) == rows:
                    yield pa.RecordBatch.from_pylist(part, schema)
                    part = []
            if part:
                yield pa.RecordBatch.from_pylist(part, schema)

    def _batches(self, rows: int) -> Iterator[pa.RecordBatch]:
        waiting: queue.Queue[pa.Table] = queue.Queue(4)  # a slow reader holds the stream back

        def write(batch: DataFrame, _: int) -> None:
            table = batch.toArrow()
            while table.num_rows and not self.cancelled:
                try:
                    return waiting.put(table, timeout=0.2)
                except queue.Full:
                    continue

        if self.limit is not None and self.limit.done:
            return
        reached, each = threading.Event(), sink.for_each(write, self.limit)

        def run(batch: DataFrame, batch_id: int) -> None:
            each(batch, batch_id)
            if self.limit is not None and self.limit.done:
                reached.set()  # after its rows were handed over

        place = f"{checkpoint_folder(self.df.sparkSession)}/queries/{self.tag}"
        self._query = q = self.df.writeStream.foreachBatch(run).option("checkpointLocation", place).start()
        try:
            while True:
                ended = not q.isActive or self.cancelled or reached.is_set()
                try:
                    yield from waiting.get(timeout=0.05 if ended else 0.2).to_batches(rows)
                except queue.Empty:
                    if ended:
                        break
            if not self.cancelled and not reached.is_set() and (error := q.exception()):
                raise error
        finally:
            q.stop()

    def show(self, n: int = 20) -> None:
        self.df.show(n, truncate=False)

    def progress(self) -> dict[str, Any]:
        """Of a running stream: rows read, the watermark and rows dropped as late so far; nothing before its first batch."""
        last = self._query.lastProgress if self._query is not None else None
        if not last:
            return {}
        state = last["stateOperators"] or []
        return {"batch": last["batchId"], "rows": sum(p["numInputRows"] for p in self._query.recentProgress), "watermark": (last["eventTime"] or {}).get("watermark"), "late_rows": sum(o["numRowsDroppedByWatermark"] for o in state)}

    def cancel(self) -> None:
        """Stop the query where it runs: its stream, or the jobs that carry its tag; later runs fail."""
        self.cancelled = True
        if self._query is not None:
            self._query.stop()
        self.df.sparkSession.interruptTag(self.tag)

    def _repr_html_(self) -> str:
        return self.df.limit(20).toPandas().to_html(index=False)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; FALLBACK_DIR in local mode only, where every task is on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise EngineError("INVALID_PARAMETER", "set spark.checkpoint.dir to a folder that all executors reach")
    return (named or FALLBACK_DIR).rstrip("/")


def connect(spark: SparkSession, catalog: str = ":memory:", task_models: dict[str, runtime.Model] | None = None) -> Session:
    return Session(spark, Catalog(catalog), task_models)


class Session:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, task_models: dict[str, runtime.Model] | None = None):
        self.spark, self.catalog, self.task_models = spark, catalog or Catalog(), task_models or {}
        self.on_error, self.jobs = "null", {}
        self.sink_format, self._job = "kafka", None
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION box_center(b STRUCT<x FLOAT, y FLOAT, w FLOAT, h FLOAT>) RETURN CASE WHEN b IS NULL THEN NULL ELSE named_struct('x', CAST(b.x + CAST(b.w / 2 AS FLOAT) AS FLOAT), 'y', CAST(b.y + CAST(b.h / 2 AS FLOAT) AS FLOAT)) END")
        spark.dataSource.register(live.LiveSource)

    # statements

    def run_script(self, script: str) -> list[QueryHandle]:
        return [self.sql(s) for s in lexer.split(script)]

    def sql(self, text: str) -> QueryHandle:
        s = statements.parse(text.strip().rstrip(";"))
        snapshot = self.catalog.snapshot()
        if s.kind == "QUERY":
            return QueryHandle(*self._planned(s.sql, snapshot))
        return getattr(self, "_" + s.kind.lower().replace(" ", "_"))(s, snapshot)

    def _result(self, message: str) -> QueryHandle:
        return QueryHandle(self.spark.createDataFrame([(message,)], T.StructType([T.StructField("result", T.StringType(), False)])))

    def _rows(self, rows: list[tuple], columns: str) -> QueryHandle:
        """columns: 'name:type' with ? for one that may be null."""
        kinds = {"s": T.StringType(), "l": T.LongType(), "b": T.BooleanType()}
        fields = [T.StructField(n.rstrip("?"), kinds[t], n.endswith("?")) for n, _, t in (c.rpartition(":") for c in columns.split())]
        return QueryHandle(self.spark.createDataFrame(rows, T.StructType(fields)))

    # planning

    def _planned(self, sql: str, snapshot: Snapshot) -> tuple[DataFrame, sink.Limit | None]:
        """A query, and over a stream its LIMIT and OFFSET at the top, which the plan then lacks."""
        if any(e.body["provider"] == "RTSP" for e in snapshot.all("TABLE")) and (cut := normalise.top_limit(sql)):
            df = self.plan(cut[0], snapshot, check=False)
            if df.isStreaming:
                validate.validate(df)
                return df, sink.Limit(cut[1], cut[2])
        return self.plan(sql, snapshot), None

    def plan(self, sql: str, snapshot: Snapshot, check: bool = True) -> DataFrame:
        """A query over the tables, models and functions of a snapshot."""
        sql = self._model_calls(normalise.expand_macros(sql, self._macros(snapshot)), snapshot)
        sql = self._polygons(sql)
        ts = lexer.tokens(sql)
        tumbles = any(t.upper == "TUMBLE" for t in ts)
        for e in snapshot.all("TABLE"):
            if any(t.kind == "name" and t.value.lower() == e.name for t in ts):
                df = self.table(e)
                if df.isStreaming and tumbles:
                    delay = width_ms(re.sub(r"(?i)\binterval\b|'", "", str(e.body["options"].get("watermark", "2 seconds"))).strip())
                    df, sql = df.withWatermark("ts", f"{delay} milliseconds"), normalise.stream_tumble(sql)
                df.createOrReplaceTempView(e.name)
        for e in snapshot.all("FUNCTION"):
            if e.body["language"] == "PYTHON" and any(t.kind == "name" and t.value.lower() == e.name for t in ts):
                self.spark.udf.register(e.name, self._python_function(e))
        sides = normalise.by_name_sides(sql)
        if sides:
            df = self.plan(sides[0], snapshot, check)
            for distinct, side in sides[1]:
                df = relational.union_by_name(df, self.plan(side, snapshot, check))
                df = df.distinct() if distinct else df
        else:
            df = self.spark.sql(normalise.normalise(sql))
        if check:
            validate.validate(df)
        return df

    def _macros(self, snapshot: Snapshot) -> dict[str, normalise.Macro]:
        out = {}
        for e in snapshot.all("FUNCTION"):
            if e.body["language"] == "SQL":
                names = tuple(a for a, _ in e.body["arguments"])
                if not names:
                    n = max((int(t.text[1:]) for t in lexer.tokens(e.body["body"]) if t.kind == "param"), default=0)
                    names = tuple(f"${k + 1}" for k in range(n))
                out[e.name] = normalise.Macro(e.name, names, e.body["body"])
        return out

    def _polygons(self, sql: str) -> str:
        """POLYGON('...') of a constant, checked now, and ST_CONTAINS, as Spark expressions."""
        while True:
            ts = lexer.tokens(sql)
            hit = next((k for k in range(len(ts) - 1, -1, -1) if ts[k].kind == "name" and ts[k].upper in ("POLYGON", "ST_POLYGON", "ST_CONTAINS") and k + 1 < len(ts) and ts[k + 1].text == "("), None)
            if hit is None:
                return sql
            end = lexer.closing(ts, hit + 1)
            args = [sql[ts[a].at : ts[b - 1].at + len(ts[b - 1].text)] for a, b in lexer.arguments(ts, hit + 1, end)]
            if ts[hit].upper == "ST_CONTAINS":
                new = _contains_sql(*args)
            elif ts[hit + 2].kind == "string" and end == hit + 3:
                new = "array(" + ", ".join(f"named_struct('x', {x!r}F, 'y', {y!r}F)" for x, y in spatial.parse_polygon(ts[hit + 2].value)) + ")"
            else:
                raise EngineError("FEATURE_NOT_AVAILABLE", "in SQL a polygon is a constant; use functions.spatial.polygon for a column")
            sql = sql[: ts[hit].at] + new + sql[ts[end].at + 1 :]

    def model(self, e: Entry, version: str | None = None) -> runtime.Model:
        version = version or e.body["default"]
        v = e.body["versions"].get(version or "")
        if v is None:
            raise EngineError("OBJECT_NOT_FOUND", f"model '{e.name}:{version}' does not exist")
        if not v["fingerprint"]:
            raise EngineError("MODEL_NOT_RESOLVED", f"model '{e.name}:{version}' is not resolved")
        m = _model(e.name, e.body, version)
        if m.fingerprint != v["fingerprint"]:
            raise EngineError("MODEL_NOT_RESOLVED", f"the artifact of model '{e.name}:{version}' has changed since it was resolved")
        return m

    def _model_calls(self, sql: str, snapshot: Snapshot) -> str:
        """Calls of models and tasks. A mock becomes its expression; another runtime a hidden column of a derived table, one for equal calls."""
        models = {e.name: e for e in snapshot.all("MODEL")}
        hidden: dict[str, tuple[str, str]] = {}
        while True:
            ts = lexer.tokens(sql)
            hit = next((k for k in range(len(ts) - 1, -1, -1) if ts[k].kind == "name" and k + 1 < len(ts) and ts[k + 1].text == "(" and (ts[k].value in models or TASK.match(ts[k].value))), None)
            if hit is None:
                break
            end = lexer.closing(ts, hit + 1)
            inputs, named = [], {}
            for a, b in lexer.arguments(ts, hit + 1, end):
                said = sql[ts[a].at : ts[b - 1].at + len(ts[b - 1].text)]
                if b - a > 2 and ts[a + 1].text == "=>" and ts[hit].upper.endswith("_EXTRACT"):
                    named[ts[a].value] = sql[ts[a + 2].at : ts[b - 1].at + len(ts[b - 1].text)]
                elif b - a > 2 and ts[a + 1].text == "=>":
                    named[ts[a].value] = statements.Parser(sql[ts[a + 2].at : ts[b - 1].at + len(ts[b - 1].text)]).constant()
                else:
                    inputs.append(said)
            if task := TASK.match(ts[hit].value):
                new = self._task(task[1].upper(), inputs, named, hidden)
            else:
                e = models[ts[hit].value]
                m = self.model(e, named.pop("version", None))
                if len(inputs) != max(1, len(m.arguments)):
                    raise EngineError("INVALID_SQL", f"{e.name} takes {max(1, len(m.arguments))} inputs")
                if unknown := set(named) - {"classes", "min_confidence"} or named and m.kind != "OBJECT_DETECTION":
                    raise EngineError("INVALID_PARAMETER", f"{e.name} does not take {unknown}")
                new = self._invoke(m, inputs, hidden)
                new = _kept_sql(new, named.get("classes"), named.get("min_confidence"))
            sql = sql[: ts[hit].at] + new + sql[ts[end].at + 1 :]
        return _hoist(sql, hidden) if hidden else sql

    def _invoke(self, m: runtime.Model, inputs: list[str], hidden: dict[str, tuple[str, str]]) -> str:
        if m.runtime_name == "mock":
            return _mock_sql(m, inputs)
        import hashlib

        function = f"fw_model_{m.fingerprint[:16]}"
        self.spark.udf.register(function, runtime.call(m, self.on_error == "fail"))
        column = "fw_inf_" + hashlib.sha256(repr((m.fingerprint, inputs)).encode()).hexdigest()[:16]
        hidden[column] = (f"{function}({', '.join(inputs)})", column)
        return column

    def _task(self, task: str, inputs: list[str], named: dict[str, Any], hidden: dict[str, tuple[str, str]]) -> str:
        if task == "EXTRACT":
            given = dict(zip(("input", "fields"), inputs, strict=False)) | named
            if len(inputs) + len(named) != len(given) or set(given) != {"input", "fields"}:
                raise EngineError("INVALID_PARAMETER", "extraction takes an input and fields; for boxes of classes use the DETECT task")
            kind = _extraction_type(given["fields"])
            if given["input"].upper() == "NULL":
                return f"CAST(NULL AS {kind})"
            raise EngineError("FEATURE_NOT_AVAILABLE", "extraction has no runtime")
        m = self.task_models.get(task.lower())
        if m is None:
            raise EngineError("FEATURE_NOT_AVAILABLE", f"no model is set for {task.lower()}")
        constants = [statements.Parser(x).constant() for x in inputs[1:]]
        found = self._invoke(m, inputs[:1], hidden)
        if task == "DETECT":
            names = ("classes", "min_score")
            named = dict(zip(names, constants, strict=False)) | named
            w, h = f"({inputs[0]}).width", f"({inputs[0]}).height"
            kept = _kept_sql(found, named.get("classes"), named.get("min_score", 0.25))
            box = f"named_struct('x', CAST(d.box.x * {w} AS FLOAT), 'y', CAST(d.box.y * {h} AS FLOAT), 'w', CAST(d.box.w * {w} AS FLOAT), 'h', CAST(d.box.h * {h} AS FLOAT))"
            return f"transform({kept}, d -> named_struct('label', d.label, 'score', d.confidence, 'locator', CASE WHEN {w} > 0 AND {h} > 0 THEN named_struct('char_span', CAST(NULL AS STRUCT<start: INT, end: INT>), 'box', {box}) END))"
        named = dict(zip(("categories", "output_mode", "min_score"), constants, strict=False)) | named
        categories, mode = named.get("categories") or [], named.get("output_mode", "single")
        if not categories or len(set(categories)) != len(categories) or "" in categories:
            raise EngineError("INVALID_PARAMETER", "categories must be distinct and not empty")
        wanted = ", ".join(_quoted(c) for c in categories)
        if mode == "single":
            if "min_score" in named:
                raise EngineError("INVALID_PARAMETER", "min_score does not go with output_mode single")
            known = runtime.mock_labels(m) if m.runtime_name == "mock" else list(m.options.get("labels", []))
            if unknown := [c for c in categories if c not in known]:
                raise EngineError("INVALID_PARAMETER", f"the model knows no class {unknown[0]!r}")
            return f"slice(filter({found}, c -> c.label IN ({wanted})), 1, 1)"
        if mode != "multi":
            raise EngineError("INVALID_PARAMETER", f"unknown output_mode {mode!r}")
        return f"filter({found}, c -> c.label IN ({wanted}) AND c.score >= CAST({named.get('min_score', 0.25)} AS FLOAT))"

    def table(self, e: Entry) -> DataFrame:
        o, at = e.body["options"], e.body["location"]
        match e.body["provider"]:
            case "IMAGES":
                return media.images(self.spark, at, bool(o.get("recursive", False)), e.generation)
            case "VIDEOS":
                start = o.get("start_time")
                zero = None if start is None else int(_rfc3339_ms(start))
                return media.videos(self.spark, at, bool(o.get("recursive", False)), float(o.get("fps", media.DEFAULT_FPS)), zero, generation=e.generation)
            case "RTSP":
                return self.spark.readStream.format("fw_live").options(**{k: str(v) for k, v in o.items()}).load()
            case "EXTERNAL":
                return media.external(self.spark, at)
        raise EngineError("UNSUPPORTED_QUERY", f"{e.name} can be written, not read")

    def _python_function(self, e: Entry):
        module, _, name = e.body["entry"].partition(":")
        kinds = types.FUNCTION_TYPES
        arity, strict = len(e.body["arguments"]), self.on_error == "fail"
        result = kinds[e.body["returns"].upper()]

        def body(*values: pa.Array) -> pa.Array:
            from pyspark.sql.pandas.types import to_arrow_type

            want = to_arrow_type(result)
            try:
                out = getattr(importlib.import_module(module), name)(*values)
            except Exception:
                if strict:
                    raise
                return pa.nulls(len(values[0]), want)
            if len(out) != len(values[0]) or out.type != want:
                raise EngineError("FUNCTION_FAILED", f"{e.name} gave {len(out)} rows of {out.type}, not {len(values[0])} of {want}")
            return out

        scope: dict[str, Any] = {"body": body, "pa": pa}
        exec(f"def udf({', '.join(f'a{k}: pa.Array' for k in range(arity))}) -> pa.Array:\n    return body({', '.join(f'a{k}' for k in range(arity))})", scope)
        return F.arrow_udf(scope["udf"], result).asNondeterministic()

    # definitions

    def _create_table(self, s: statements.Statement, _: Snapshot) -> QueryHandle:
        p = s.parts
        if p["provider"] in ("IMAGES", "VIDEOS", "EXTERNAL") and not p["location"]:
            raise EngineError("INVALID_SQL", f"{p['provider']} needs LOCATION")
        if p["provider"] == "KAFKA":
            for _, kind in p["columns"]:
                if kind.upper().replace(" NOT NULL", "").strip() not in types.SINK_TYPES:
                    raise EngineError("INVALID_SQL", f"a sink has no columns of type {kind}")
            sink.kafka_options(str(p["options"].get("brokers", p["options"].get("bootstrap_servers", ""))), str(p["options"].get("topic", "")))
        if p["provider"] == "RTSP" and (u := urlsplit(str(p["options"].get("url", "rtsp://replay")))) and (u.scheme != "rtsp" or u.username or u.query or u.fragment):
            raise EngineError("INVALID_PARAMETER", "a live url is rtsp:// without user, query or fragment")
        self.catalog.put("TABLE", s.name, p)
        return self._result(f"created table '{s.name}'")

    def _create_model(self, s: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        p = s.parts
        if p["if_not_exists"] and ("MODEL", s.name) in snapshot.entries:
            return self._result(f"model '{s.name}' already exists")
        first = {"source": p["source"], "runtime": p["runtime"], "options": p["options"], "fingerprint": None, "created_at": int(time.time() * 1000)}
        self.catalog.put("MODEL", s.name, {"type": p["type"], "arguments": p["arguments"], "returns": p["returns"], "comment": p["comment"], "default": p["version"], "versions": {p["version"]: first}})
        return self._result(f"created model '{s.name}'")

    def _resolve_model(self, s: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        e = snapshot.get("MODEL", s.name)
        version = s.parts["version"] or e.body["default"]
        v = e.body["versions"].get(version)
        if v is None:
            raise EngineError("OBJECT_NOT_FOUND", f"model '{s.name}:{version}' does not exist")
        if v["fingerprint"]:
            return self._result(f"model '{s.name}:{version}' is already resolved")
        m = _model(s.name, e.body, version)
        if m.runtime_name in runtime.UNAVAILABLE or m.runtime_name == "triton":
            raise EngineError("FEATURE_NOT_AVAILABLE", f"runtime {m.runtime_name} is not available")
        self.catalog.put("MODEL", s.name, e.body | {"versions": e.body["versions"] | {version: v | {"fingerprint": m.fingerprint}}}, expected=e.revision)
        return self._result(f"resolved model '{s.name}:{version}'")

    def _alter_model(self, s: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        e, p = snapshot.get("MODEL", s.name), s.parts
        body, versions = dict(e.body), dict(e.body["versions"])
        v = p.get("version")
        if p["action"] in ("DROP", "DEFAULT") and v not in versions:
            raise EngineError("OBJECT_NOT_FOUND", f"model '{s.name}:{v}' does not exist")
        match p["action"]:
            case "ADD":
                if v in versions:
                    raise EngineError("OBJECT_ALREADY_EXISTS", f"model '{s.name}:{v}' already exists")
                versions[v] = {"source": p["source"], "runtime": p["runtime"], "options": p["options"], "fingerprint": None, "created_at": int(time.time() * 1000)}
                said = f"added model version '{s.name}:{v}'"
            case "DROP":
                if len(versions) == 1:
                    raise EngineError("INVALID_PARAMETER", "the last version cannot be dropped")
                if v == body["default"]:
                    raise EngineError("INVALID_PARAMETER", "the default version cannot be dropped")
                del versions[v]
                said = f"dropped model version '{s.name}:{v}'"
            case "DEFAULT":
                if not versions[v]["fingerprint"]:
                    raise EngineError("MODEL_NOT_RESOLVED", "the default version must be resolved")
                body["default"] = v
                said = f"set model '{s.name}' default version to '{v}'"
            case "COMMENT":
                body["comment"] = p["comment"]
                said = f"updated model '{s.name}' comment"
            case _:
                self.catalog.rename("MODEL", s.name, p["to"])
                return self._result(f"renamed model '{s.name}' to '{p['to']}'")
        self.catalog.put("MODEL", s.name, body | {"versions": versions}, expected=e.revision)
        return self._result(said)

    def _create_function(self, s: statements.Statement, _: Snapshot) -> QueryHandle:
        p = s.parts
        if p["language"] == "PYTHON":
            if ":" not in p["entry"]:
                raise EngineError("INVALID_SQL", "a Python function is 'module:function'")
            for _, kind in [*p["arguments"], ("", p["returns"])]:
                if kind.upper() not in types.FUNCTION_TYPES:
                    raise EngineError("INVALID_SQL", f"unknown type {kind!r}")
        self.catalog.put("FUNCTION", s.name, p)
        return self._result(f"created function '{s.name}'")

    def _drop(self, s: statements.Statement, _: Snapshot) -> QueryHandle:
        self.catalog.drop(s.parts["kind"], s.name)
        return self._result(f"dropped object '{s.name}'")

    def _set(self, s: statements.Statement, _: Snapshot) -> QueryHandle:
        self.on_error = s.parts["value"]
        return self._result(f"{s.name} = '{self.on_error}'")

    # inspection

    def _show_tables(self, _: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        return self._rows([(e.name, e.body["provider"], _public(e.body["location"] or str(e.body["options"].get("url", "")))) for e in snapshot.all("TABLE")], "table_name:s provider:s location:s")

    def _show_models(self, _: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        rows = [("framewright", "default", e.name, e.body["type"], len(e.body["versions"]), e.body["default"], e.body["comment"]) for e in snapshot.all("MODEL")]
        return self._rows(rows, "catalog:s schema:s name:s interface:s versions:l default_version?:s comment?:s")

    def _show_functions(self, _: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        rows = [("framewright", "default", e.name, e.body["language"], ", ".join(" ".join(a).strip() for a in e.body["arguments"]), e.body["returns"]) for e in snapshot.all("FUNCTION")]
        rows += [("framewright", "default", e.name, "MODEL", ", ".join(" ".join(a) for a in e.body["arguments"]) or "image IMAGE", e.body["returns"] or e.body["type"]) for e in snapshot.all("MODEL")]
        return self._rows(sorted(rows), "catalog:s schema:s name:s kind:s arguments:s return_type:s")

    def _show_model_versions(self, s: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        e = snapshot.get("MODEL", s.name)
        rows = [("framewright", "default", e.name, v, "RESOLVED" if d["fingerprint"] else "UNRESOLVED", "IMMUTABLE", d["fingerprint"], d["created_at"], v == e.body["default"]) for v, d in sorted(e.body["versions"].items())]
        return self._rows(rows, "catalog:s schema:s name:s version:s status:s volatility:s fingerprint?:s created_at:l is_default:b")

    def _show_create(self, s: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        e = snapshot.get(s.parts["kind"], s.name)
        if e.kind == "MODEL":
            return self._rows([(e.name, v, _create_model_sql(e, v)) for v in sorted(e.body["versions"])], "name:s version:s create_statement:s")
        return self._rows([(e.name, None, _create_sql(e))], "name:s version?:s create_statement:s")

    def _describe_table(self, s: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        e = snapshot.get("TABLE", s.name)
        schema = _sink_schema(e) if e.body["provider"] == "KAFKA" else {"IMAGES": types.IMAGES_SCHEMA, "VIDEOS": types.VIDEOS_SCHEMA, "RTSP": types.LIVE_SCHEMA}.get(e.body["provider"]) or self.table(e).schema
        return self._rows([(f.name, f.dataType.simpleString(), str(f.nullable).lower()) for f in schema], "column_name:s data_type:s nullable:s")

    def _describe_model(self, s: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        e = snapshot.get("MODEL", s.name)
        v = e.body["versions"][e.body["default"]]
        return self._rows([("name", e.name), ("type", e.body["type"]), ("default_version", e.body["default"]), ("source", _public(v["source"])), ("status", "RESOLVED" if v["fingerprint"] else "UNRESOLVED")], "property:s value:s")

    def _describe_function(self, s: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        e = snapshot.get("FUNCTION", s.name)
        body, status = e.body["body"] or e.body["entry"], "AVAILABLE"
        for m in snapshot.all("MODEL"):
            if any(t.value == m.name for t in lexer.tokens(e.body["body"] or "") if t.kind == "name"):
                status = f"MODEL {m.name} {'RESOLVED' if m.body['versions'][m.body['default']]['fingerprint'] else 'UNRESOLVED'}"
        return self._rows([("name", e.name), ("language", e.body["language"]), ("body", body), ("status", status)], "property:s value:s")

    def _explain(self, s: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        inner = statements.parse(s.parts["query"])
        query = inner.parts["query"] if inner.kind == "INSERT" else inner.sql
        try:
            df = self.plan(query, snapshot)
        except EngineError as e:
            if e.symbol != "UNSUPPORTED_QUERY":
                raise
            return self._rows([(f"{PRODUCT}Plan mode=continuous",), (str(e),)], "plan:s")
        mode = "continuous" if df.isStreaming else "bounded"
        source = "Source live projection_pushdown=enabled time_range_pushdown=not_applicable" if df.isStreaming else "Source bounded projection_pushdown=enabled time_range_pushdown=provider_specific"
        text = df._jdf.queryExecution().toString()
        return self._rows([(f"{PRODUCT}Plan mode={mode}",), (source,), *[(x,) for x in text.splitlines()]], "plan:s")

    # writing and jobs

    def _insert(self, s: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        e = snapshot.get("TABLE", s.name)
        if e.body["provider"] != "KAFKA":
            raise EngineError("SINK_FAILED", f"table {s.name!r} can't be written")
        df, limit = self._planned(s.parts["query"], snapshot)
        sink.match_columns(df.schema, _sink_schema(e))
        rows = sink.json_rows(df.toDF(*[n for n, _ in e.body["columns"]]))
        o = e.body["options"]
        options = sink.kafka_options(str(o.get("brokers", o.get("bootstrap_servers", ""))), str(o["topic"]), int(o.get("delivery_timeout_ms", 30_000)), int(o.get("buffer_capacity", 1024)))
        options |= {k: str(v) for k, v in o.items() if k == "path"}
        if df.isStreaming:
            place = self._job or self._job_folder(f"insert-{s.name}", s.parts["query"])
            if limit is None:
                return QueryHandle(rows.writeStream.format(self.sink_format).option("checkpointLocation", place).options(**options).start())
            if self._job:
                raise EngineError("UNSUPPORTED_QUERY", "a job goes on without end; LIMIT goes with INSERT alone")
            write = sink.for_each(lambda batch, _: batch.write.format(self.sink_format).options(**options).mode("append").save(), limit)
            started = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}-{time.time_ns()}").start()
            threading.Thread(target=_stop_when_done, args=(started, limit), daemon=True).start()
            return QueryHandle(started)
        rows.write.format(self.sink_format).options(**options).save()
        return self._result(f"inserted into '{s.name}'")

    def _submit_job(self, s: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        """A named continuous INSERT; the catalog keeps it, Spark's checkpoint lets it go on where it stopped."""
        self.catalog.put("JOB", s.name, {"sql": s.parts["query"], "state": "STARTING", "updated_at": time.time(), "error": None})
        try:
            self._job = self._job_folder(s.name, s.parts["query"])
            self.jobs[s.name] = self.sql(s.parts["query"]).df
            self.catalog.move_job(s.name, "RUNNING")
        except Exception as e:
            self.catalog.move_job(s.name, "FAILED", error=str(e)[:500])
            raise
        finally:
            self._job = None
        return self._result(f"submitted job '{s.name}'")

    def _job_folder(self, name: str, query: str) -> str:
        """Where a continuous INSERT keeps its checkpoint: the shared folder, the same for the same name and query."""
        return f"{checkpoint_folder(self.spark)}/jobs/{name}-{hashlib.md5(query.encode()).hexdigest()[:16]}"

    def resume_jobs(self) -> list[str]:
        """Start again the jobs that the catalog calls running and that no query of this session runs, each from its checkpoint; their names."""
        resumed = []
        for e in self.catalog.snapshot().all("JOB"):
            if e.body["state"] in ("STARTING", "RUNNING") and e.name not in self.jobs:
                try:
                    self._job = self._job_folder(e.name, e.body["sql"])
                    self.jobs[e.name] = self.sql(e.body["sql"]).df
                    self.catalog.move_job(e.name, "RUNNING")
                    resumed.append(e.name)
                except Exception as error:
                    self.catalog.move_job(e.name, "FAILED", error=str(error)[:500])
                    raise
                finally:
                    self._job = None
        return resumed

    def _follow_jobs(self) -> Snapshot:
        """The catalog after jobs whose streaming query has ended are marked so."""
        for name, q in list(self.jobs.items()):
            if hasattr(q, "isActive") and not q.isActive:
                error = q.exception()
                self.catalog.move_job(name, "FAILED" if error else "STOPPED", error=str(error)[:500] if error else None)
                self.jobs.pop(name)
        return self.catalog.snapshot()

    def _stop_job(self, s: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        self._follow_jobs().get("JOB", s.name)
        self.catalog.move_job(s.name, "STOPPED")
        if hasattr(q := self.jobs.pop(s.name, None), "stop"):
            q.stop()
        return self._result(f"stopped job '{s.name}'")

    def _show_jobs(self, _: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        return self._rows([(e.name, e.body["state"], e.body["error"]) for e in self._follow_jobs().all("JOB")], "name:s state:s error?:s")

    def _describe_job(self, s: statements.Statement, snapshot: Snapshot) -> QueryHandle:
        e = self._follow_jobs().get("JOB", s.name)
        return self._rows([("name", e.name), ("state", e.body["state"]), ("sql", e.body["sql"]), ("terminal", str(e.body["state"] in TERMINAL).lower())], "property:s value:s")


def _stop_when_done(q, limit: sink.Limit) -> None:
    while q.isActive and not limit.done:
        time.sleep(0.1)
    q.stop()


def _model(name: str, body: dict[str, Any], version: str) -> runtime.Model:
    v = body["versions"][version]
    kinds = tuple(types.FUNCTION_TYPES[k.upper()] for _, k in body["arguments"])
    returns = types.FUNCTION_TYPES[body["returns"].upper()] if body["returns"] else None
    return runtime.Model(name, body["type"], v["source"], version, "" if v["runtime"] in ("", "MOCK") or v["source"].startswith("mock://") else v["runtime"], v["options"], kinds, returns)


def _quoted(s: str) -> str:
    return "'" + str(s).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _mock_sql(m: runtime.Model, inputs: list[str]) -> str:
    first = inputs[0]
    if m.kind == "OBJECT_DETECTION":
        b = ", ".join(f"'{n}', {v}F" for v, n in zip(runtime.MOCK_BOX, "xywh", strict=True))
        return f"(CASE WHEN ({first}) IS NOT NULL THEN array(named_struct('label', {_quoted((runtime.mock_labels(m) or ['object'])[0])}, 'confidence', {runtime.MOCK_CONFIDENCE}F, 'box', named_struct({b}))) END)"
    if m.kind == "IMAGE_CLASSIFICATION":
        rows = ", ".join(f"named_struct('label', {_quoted(n)}, 'score', {float(k == 0)}F)" for k, n in enumerate(runtime.mock_labels(m)))
        return f"(CASE WHEN ({first}) IS NOT NULL THEN array({rows}) END)"
    if m.returns is not None and (not m.arguments or m.arguments[0] != m.returns):
        return f"CAST(NULL AS {m.returns.simpleString()})"
    return f"(CASE WHEN {' AND '.join(f'({i}) IS NOT NULL' for i in inputs)} THEN ({first}) END)"


def _kept_sql(found: str, classes: list[str] | None, least: float | None) -> str:
    tests = [f"d.label IN ({', '.join(_quoted(c) for c in classes)})" if classes else "false"] if classes is not None else []
    tests += [f"d.confidence >= CAST({least} AS FLOAT)"] if least is not None else []
    return f"filter({found}, d -> {' AND '.join(tests)})" if tests else found


#: What extraction answers to one question.
ANSWER = "STRUCT<value: STRING, score: FLOAT, locator: STRUCT<char_span: STRUCT<start: INT, end: INT>, box: STRUCT<x: FLOAT, y: FLOAT, w: FLOAT, h: FLOAT>>>"


def _extraction_type(fields: str) -> str:
    """Type of an extraction's result, of MAP {'field': 'question' or STRUCT('question' AS question, TRUE AS list), ...}."""
    ts = lexer.tokens(fields)
    if len(ts) < 4 or ts[0].upper != "MAP" or ts[1].text != "{" or lexer.closing(ts, 1) != len(ts) - 1:
        raise EngineError("INVALID_PARAMETER", "fields are MAP {'field': descriptor, ...}")
    out: dict[str, str] = {}
    for a, b in lexer.arguments(ts, 1, len(ts) - 1):
        name, said = ts[a].value.lower(), ts[a + 2 : b]
        if b - a < 3 or ts[a].kind != "string" or ts[a + 1].text != ":" or not re.fullmatch(r"[a-z_][a-z0-9_]*", name) or name in out:
            raise EngineError("INVALID_PARAMETER", f"not a field of its own: {ts[a].text}")
        question, many = None, False
        if len(said) == 1 and said[0].kind == "string":
            question = said[0].value
        members = {said[k + 2].value.lower(): said[k] for k in range(2, len(said) - 2, 4) if said[k + 1].upper == "AS"} if said[0].upper == "STRUCT" else {}
        if set(members) == {"question", "list"} and members["question"].kind == "string" and members["list"].upper in ("TRUE", "FALSE"):
            question, many = members["question"].value, members["list"].upper == "TRUE"
        if not question:
            raise EngineError("INVALID_PARAMETER", f"field {name!r} takes 'question' or STRUCT('question' AS question, TRUE AS list)")
        out[name] = f"ARRAY<{ANSWER}>" if many else ANSWER
    return f"STRUCT<{', '.join(f'{n}: {t}' for n, t in out.items())}>"


def _contains_sql(area: str, p: str) -> str:
    """ST_CONTAINS in SQL, by the rule of functions.spatial.st_contains."""
    a, b = "e.a", "e.b"
    cross = f"abs(CAST(CAST(({p}.x - {a}.x) * ({b}.y - {a}.y) AS FLOAT) - CAST(({p}.y - {a}.y) * ({b}.x - {a}.x) AS FLOAT) AS FLOAT)) <= CAST({spatial.ON_EDGE} AS FLOAT)"
    near = f"{p}.x BETWEEN least({a}.x, {b}.x) AND greatest({a}.x, {b}.x) AND {p}.y BETWEEN least({a}.y, {b}.y) AND greatest({a}.y, {b}.y)"
    at = f"CAST(CAST(CAST(({b}.x - {a}.x) * ({p}.y - {a}.y) AS FLOAT) / ({b}.y - {a}.y) AS FLOAT) + {a}.x AS FLOAT)"
    crosses = f"CASE WHEN ({a}.y > {p}.y) <> ({b}.y > {p}.y) THEN {p}.x < {at} ELSE false END"
    edges = f"transform(sequence(1, size({area}) - 1), i -> named_struct('a', get({area}, i - 1), 'b', get({area}, i)))"
    return f"CASE WHEN ({area}) IS NOT NULL AND ({p}) IS NOT NULL THEN exists({edges}, e -> {cross} AND {near}) OR size(filter({edges}, e -> {crosses})) % 2 = 1 END"


def _hoist(sql: str, hidden: dict[str, tuple[str, str]]) -> str:
    """FROM t WHERE a AND b as FROM (SELECT *, call AS column FROM t WHERE a) WHERE b, where b reads a model's column and a doesn't."""
    ts = lexer.tokens(sql)
    depth, first, where, stop = 0, None, None, len(ts)
    for k, t in enumerate(ts):
        depth += (t.text in ("(", "[")) - (t.text in (")", "]"))
        if depth:
            continue
        if t.upper == "FROM" and first is None:
            first = k
        elif first is not None and t.upper == "WHERE":
            where = k
        elif first is not None and t.upper in ("GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "QUALIFY", "WINDOW"):
            stop = k
            break
        elif first is not None and where is None and t.upper in ("JOIN", "UNION"):
            raise EngineError("UNSUPPORTED_QUERY", "call the model in a derived table of one relation")
    if first is None:
        raise EngineError("UNSUPPORTED_QUERY", "a model call needs FROM")
    end = ts[stop].at if stop < len(ts) else len(sql)
    relation = sql[ts[first].at + 4 : ts[where].at if where else end].strip()
    below, above = [], []
    if where:
        start, depth, between = where + 1, 0, False
        for k in range(where + 1, stop + 1):
            t = ts[k] if k < stop else None
            depth += 0 if t is None else (t.text in ("(", "[")) - (t.text in (")", "]"))
            between |= t is not None and t.upper == "BETWEEN"
            if t is None or depth == 0 and t.upper == "AND" and not between:
                part = sql[ts[start].at : t.at if t is not None else end].strip()
                (above if any(c in part for c in hidden) or re.search(r"\bor\b", part, re.I) and any(c in part for c in hidden) else below).append(part)
                start = k + 1
            elif depth == 0 and t.upper == "AND":
                between = False
        whole = " AND ".join(above + below)
        if any(t.upper == "OR" for t in lexer.tokens(whole)) and any(c in whole for c in hidden):
            above, below = [sql[ts[where].at + 5 : end].strip()], []
    alias = relation.split()[-1] if len(relation.split()) > 1 and not relation.endswith(")") else relation if re.fullmatch(r"\w+", relation) else "fw_source"
    calls = ", ".join(f"{call} AS {column}" for call, column in hidden.values())
    inner = f"(SELECT *, {calls} FROM {relation}{' WHERE ' + ' AND '.join(below) if below else ''}) AS {alias}"
    return f"{sql[: ts[first].at]}FROM {inner}{' WHERE ' + ' AND '.join(above) if above else ''} {sql[end:]}"


def _public(uri: str) -> str:
    """A URI without user, query and fragment."""
    return re.sub(r"^([a-zA-Z][\w+.-]*://)[^/@]*@", r"\1", re.sub(r"[?#].*$", "", uri))


def _options_sql(options: dict[str, Any]) -> str:
    def value(k: str, v: Any) -> str:
        text = "[REDACTED]" if SECRET_KEY.search(k) else "[REDACTED_SECRET_REF]" if str(v).startswith("secret://") else _public(str(v)) if "://" in str(v) else str(v).lower() if isinstance(v, bool) else str(v)
        return "'" + text.replace("'", "''") + "'"

    return f" OPTIONS ({', '.join(f'{k} = {value(k, v)}' for k, v in sorted(options.items()))})" if options else ""


def _create_sql(e: Entry) -> str:
    b = e.body
    if e.kind == "FUNCTION":
        args = ", ".join(" ".join(a).strip() for a in b["arguments"])
        returns = f" RETURNS {b['returns']}" if b["returns"] else ""
        return f'CREATE FUNCTION "{e.name}"({args}){returns} ' + (f"LANGUAGE PYTHON AS '{b['entry']}'" if b["language"] == "PYTHON" else f"RETURN {b['body']}")
    columns = f" ({', '.join(f'{n} {t}' for n, t in b['columns'])})" if b["columns"] else ""
    return f'CREATE TABLE "{e.name}"{columns} USING {b["provider"]}{_options_sql(b["options"])}' + (f" LOCATION '{_public(b['location'])}'" if b["location"] else "")


def _create_model_sql(e: Entry, version: str) -> str:
    v = e.body["versions"][version]
    m = _model(e.name, e.body, version)
    head = f'CREATE MODEL "{e.name}"' + (f" ({', '.join(' '.join(a) for a in e.body['arguments'])}) RETURNS {e.body['returns']}" if e.body["arguments"] else f" TYPE {e.body['type']}")
    used = v["runtime"] or ("ONNX_RUNTIME" if m.runtime_name in ("mock", "onnx-runtime") else m.runtime_name.upper())
    return f"{head} VERSION '{version}' FROM '{_public(v['source'])}' USING {used}{_options_sql(v['options'])}" + (f" COMMENT '{e.body['comment']}'" if e.body["comment"] else "")


def _sink_schema(e: Entry) -> T.StructType:
    fields = []
    for n, t in e.body["columns"]:
        kind = t.upper()
        fields.append(T.StructField(n, types.SINK_TYPES[kind.replace(" NOT NULL", "").strip()], not kind.endswith("NOT NULL")))
    return T.StructType(fields)


def _rfc3339_ms(text: str) -> int:
    from datetime import datetime

    return int(datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp() * 1000)

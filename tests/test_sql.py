import pytest

from framewright import session
from framewright.catalog.store import Catalog
from framewright.errors import EngineError
from framewright.models.runtime import Model
from framewright.plans import lexer
from framewright.plans.normalise import Macro, normalise

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def s(spark):
    return session.connect(spark, task_models={"detect": Model("d", "OBJECT_DETECTION", "mock://cat"), "classify": Model("c", "IMAGE_CLASSIFICATION", "mock://cat,dog")})


def rows(handle):
    return [tuple(r.values()) for r in handle.collect().to_pylist()]


def test_split_leaves_strings_and_comments():
    assert lexer.split("SELECT ';' AS a; -- x;y\nSELECT /* ; */ 2;") == ["SELECT ';' AS a", "-- x;y\nSELECT /* ; */ 2"]
    with pytest.raises(EngineError):
        lexer.split("SELECT 'open")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT ['x', 'y'][2] AS v", "y"), ("SELECT MAP {'k': 7}['k'] AS v", 7), ("SELECT named_struct('b', named_struct('x', 0F, 'y', 0F, 'w', 1F, 'h', 1F)).b.center.x AS v", 0.5),
        ("SELECT 'a.center [1]' AS v", "a.center [1]"), ("SELECT 5::int AS v", 5), ("SELECT 'abc' ~ 'b' AS v", True), ('SELECT 1 AS "v"', 1), ("SELECT twice(twice(2) + 1) AS v", 10),
    ],
)
def test_dialect(text, want, s, spark):
    assert spark.sql(normalise(text, {"twice": Macro("twice", ("x",), "x * 2")})).first()[0] == want


#: Expressions of the dialect and their values.
CALLS = [
    ("gcd(12, 18)", 6), ("lcm(4, 6)", 12), ("iszero(0)", True), ("trunc(-1.75)", -1), ("concat('a', NULL, 'b')", "ab"), ("btrim('xxaxx', 'x')", "a"), ("ltrim('xxa', 'x')", "a"), ("to_hex(255)", "ff"),
    ("encode('abc', 'hex')", "616263"), ("encode(sha256('a'), 'hex')", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"), ("regexp_match('abc', '(b)(c)')", ["b", "c"]), ("regexp_match('abc', 'z')", None),
    (r"regexp_replace('a1b2', '\d', '<\0>')", "a<1>b2"), ("regexp_replace('aba', 'A', 'x', 'gi')", "xbx"), (r"'a1' ~ '\d'", True), ("'abc' ~* 'B'", True), ("'abc' !~* 'B'", False), ("'abc' SIMILAR TO 'a(b|x)_'", True), ("'it''s'", "it's"),
    ("string_to_array('a.b', '.')", ["a", "b"]), ("array_slice([1, 2, 3, 4], -3, -2)", [2, 3]), ("array_remove([1, 2, 1], 1)", [2, 1]), ("array_remove_all([1, 2, 1], 1)", [2]), ("array_replace_n([1, 1, 1], 1, 9, 2)", [9, 9, 1]),
    ("array_position([5], 6)", None), ("array_positions([5, 6, 5], 5)", [1, 3]), ("array_resize([1], 3, 0)", [1, 0, 0]), ("array_sort([2, NULL, 1], 'DESC', 'NULLS LAST')", [2, 1, None]), ("array_ndims([[1], [2]])", 2), ("list_concat([1], list_append([2], 3))", [1, 2, 3]),
    ("range(0)", []), ("range(1, 3)", [1, 2]), ("map_extract(MAP {'a': 1}, 'b')", []), ("[1, 2][5]", None), ("3 = ANY([1, 3])", True), ("CAST(1 AS VARCHAR)", "1"), ("1::text", "1"), ("arrow_cast('7', 'Int64')", 7),
    ("to_char(TIMESTAMP '2024-01-02 10:07:00', '%d/%m at %H:%M')", "02/01 at 10:07"), ("to_unixtime(date_bin(INTERVAL '15 minutes', TIMESTAMP '1970-01-01 00:20:00', TIMESTAMP '1970-01-01 00:05:00'))", 1200),
]


def test_calls(spark):
    got = spark.sql("SELECT " + ", ".join(f"{normalise('SELECT ' + e)[7:]} AS v{k}" for k, (e, _) in enumerate(CALLS))).first()
    assert [(e, v) for (e, _), v in zip(CALLS, got, strict=True)] == CALLS


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("SELECT array_agg(v) AS a, array_agg(v ORDER BY v) AS b, array_agg(v ORDER BY v DESC) FILTER (WHERE v > 1) AS c FROM (VALUES (1), (NULL), (2)) t(v)", [([1, None, 2], [1, 2, None], [2])]),
        ("SELECT string_agg(v::text, ',' ORDER BY v DESC) AS a, nth_value(v, 2 ORDER BY v) AS b, last_value(v ORDER BY v DESC) AS c, approx_percentile_cont(0.5) WITHIN GROUP (ORDER BY v) AS d FROM (VALUES (1), (3), (2)) t(v)", [("3,2,1", 2, 1, 2)]),
        ("SELECT DISTINCT ON (k) k, v FROM (VALUES (1, 5), (1, 6), (2, 7)) t(k, v) ORDER BY k, v DESC LIMIT 1", [(1, 6)]), ("SELECT * EXCLUDE (a) FROM (SELECT 1 AS a, 2 AS b)", [(2,)]), ("SELECT v FROM range(2, 4) AS t(v) ORDER BY v FETCH FIRST 1 ROWS ONLY", [(2,)]),
        ("SELECT y FROM (VALUES (1)) a(x) RIGHT ANTI JOIN (VALUES (1), (2)) b(y) ON x = y", [(2,)]), ("SELECT 1 AS a, 'x' AS b UNION ALL BY NAME SELECT 'y' AS b, 2 AS a", [(1, "x"), (2, "y")]), ("SELECT 1 AS a UNION BY NAME SELECT 1 AS a", [(1,)]),
        ("SELECT v FROM (VALUES (1), (5)) t(v) WHERE v = ANY (SELECT 5)", [(5,)]), ("SELECT sum(value) AS n FROM generate_series(5, 1, -2)", [(9,)]),
    ],
)
def test_clauses(query, want, s):
    assert rows(s.sql(query)) == want


def test_null_order(spark):
    q = normalise("SELECT v FROM VALUES (1), (NULL), (2) t(v) ORDER BY v")
    assert [r[0] for r in spark.sql(q).collect()] == [1, 2, None]
    q = normalise("SELECT v FROM VALUES (1), (NULL), (2) t(v) ORDER BY v DESC")
    assert [r[0] for r in spark.sql(q).collect()] == [None, 2, 1]


def test_macro_cycles_and_markers():
    with pytest.raises(EngineError, match="rounds"):
        normalise("SELECT f(1)", {"f": Macro("f", ("x",), "f(x)")})
    with pytest.raises(EngineError, match="reserved"):
        normalise("SELECT __fw_x FROM t")


def test_models_end_to_end(s):
    s.run_script(f"CREATE TABLE ev USING EXTERNAL LOCATION '{EVENTS}'; CREATE MODEL detector TYPE OBJECT_DETECTION VERSION 'v1' FROM 'mock://person' USING ONNX_RUNTIME")
    with pytest.raises(EngineError, match="not resolved"):
        s.sql("SELECT detector(event_id) FROM ev")
    assert rows(s.sql("RESOLVE MODEL detector")) == [("resolved model 'detector:v1'",)]
    assert rows(s.sql("RESOLVE MODEL detector")) == [("model 'detector:v1' is already resolved",)]
    assert rows(s.sql("SELECT sum(CARDINALITY(detector(event_id, classes => ['person']))) AS n, sum(CARDINALITY(detector(event_id, classes => ['car']))) AS m FROM ev")) == [(1000, 0)]
    assert rows(s.sql("SELECT count(*) AS n FROM ev, UNNEST(detector(event_id)) AS u(d) WHERE d.confidence >= 0.5")) == [(1000,)]
    assert rows(s.sql("SHOW CREATE MODEL detector")) == [("detector", "v1", "CREATE MODEL \"detector\" TYPE OBJECT_DETECTION VERSION 'v1' FROM 'mock://person' USING ONNX_RUNTIME")]
    s.sql("ALTER MODEL detector ADD VERSION 'v2' FROM 'mock://car'")
    for text, said in (("ALTER MODEL detector SET DEFAULT_VERSION 'v2'", "must be resolved"), ("ALTER MODEL detector DROP VERSION 'v1'", "default version")):
        with pytest.raises(EngineError, match=said):
            s.sql(text)
    s.sql("RESOLVE MODEL detector VERSION 'v2'")
    assert rows(s.sql("SELECT detector(1, version => 'v2')[1].label AS l")) == [("car",)]


def test_tasks(s):
    (one,), = rows(s.sql("SELECT AI_DETECT(named_struct('uri', 'a', 'width', 640, 'height', 480)) AS d"))
    assert one[0]["locator"]["box"] == {"x": 160.0, "y": 120.0, "w": 320.0, "h": 240.0}
    (none,), = rows(s.sql("SELECT AI_DETECT(named_struct('uri', 'a', 'width', 0, 'height', 480)) AS d"))
    assert none[0]["locator"] is None
    assert rows(s.sql("SELECT AI_CLASSIFY(named_struct('uri', 'a'), ['dog', 'cat']) AS c")) == [([{"label": "cat", "score": 1.0}],)]
    for text in ("SELECT AI_CLASSIFY(1, ['bird'])", "SELECT AI_CLASSIFY(1, [])", "SELECT AI_CLASSIFY(1, ['cat'], min_score => 0.1)", "SELECT AI_EXTRACT(1, MAP {'a': 'what?'})"):
        with pytest.raises(EngineError):
            s.sql(text)


def test_hidden_model_column_runs_once_below_other_filters(spark):
    text = session._hoist("SELECT id, cardinality(fw_inf_a) AS n FROM t WHERE id > 5 AND cardinality(fw_inf_a) > 0 ORDER BY id", {"fw_inf_a": ("m(id) AS fw_inf_a".split(" AS ")[0], "fw_inf_a")})
    assert text == "SELECT id, cardinality(fw_inf_a) AS n FROM (SELECT *, m(id) AS fw_inf_a FROM t WHERE id > 5) AS t WHERE cardinality(fw_inf_a) > 0 ORDER BY id"


def double(x):
    import pyarrow.compute as pc

    return pc.multiply(x, 2)


def broken(x):
    raise ValueError("broken")


def test_python_functions(s):
    s.sql("CREATE FUNCTION dbl(x BIGINT) RETURNS BIGINT LANGUAGE PYTHON AS 'tests.test_sql:double'")
    s.sql("CREATE FUNCTION bad(x BIGINT) RETURNS BIGINT LANGUAGE PYTHON AS 'tests.test_sql:broken'")
    assert rows(s.sql("SELECT dbl(v) AS d FROM VALUES (1L), (2L) t(v)")) == [(2,), (4,)]
    assert rows(s.sql("SELECT bad(v) AS d FROM VALUES (1L) t(v)")) == [(None,)]
    s.sql("SET fw.on_error = 'fail'")
    with pytest.raises(Exception, match="broken"):
        s.sql("SELECT bad(v) AS d FROM VALUES (1L) t(v)").collect()


@pytest.mark.parametrize(
    ("text", "symbol"),
    [
        ("UPDATE t SET a = 1", "INVALID_SQL"), ("CREATE INDEX i", "FEATURE_NOT_AVAILABLE"), ("CREATE AGGREGATE a", "FEATURE_NOT_AVAILABLE"), ("CREATE TABLE t AS SELECT 1", "FEATURE_NOT_AVAILABLE"), ("DROP TABLE none", "OBJECT_NOT_FOUND"),
        ("SET fw.other = 1", "INVALID_PARAMETER"), ("CREATE TABLE t (a INT) USING IMAGES LOCATION 'x'", "INVALID_SQL"), ("CREATE MODEL m TYPE IMAGE_CLASSIFICATION FROM 'mock://x'", "FEATURE_NOT_AVAILABLE"), ("PAUSE JOB j", "FEATURE_NOT_AVAILABLE"),
        ("EXPLAIN ANALYZE SELECT 1", "FEATURE_NOT_AVAILABLE"), ("CREATE TABLE cam USING RTSP OPTIONS (url = 'rtsp://u:p@x/live')", "INVALID_PARAMETER"), ("INSERT INTO t (a) SELECT 1", "INVALID_SQL"),
    ],
)
def test_rejections(text, symbol, s):
    with pytest.raises(EngineError) as e:
        s.sql(text)
    assert e.value.symbol == symbol


def test_show_and_redaction(s):
    s.sql("CREATE TABLE k (a BIGINT NOT NULL, b STRING) USING KAFKA OPTIONS (brokers = 'x:9092', topic = 't', password = 'p')")
    assert rows(s.sql("SHOW CREATE TABLE k"))[0][2] == "CREATE TABLE \"k\" (a BIGINT NOT NULL, b STRING) USING KAFKA OPTIONS (brokers = 'x:9092', password = '[REDACTED]', topic = 't')"
    assert rows(s.sql("DESCRIBE TABLE k")) == [("a", "bigint", "false"), ("b", "string", "true")]
    assert rows(s.sql("EXPLAIN SELECT 1 AS a"))[0] == ("FramewrightPlan mode=bounded",)


def test_catalog_revisions():
    c = Catalog()
    first = c.put("TABLE", "T", {"a": 1})
    before = c.snapshot()
    c.put("TABLE", "t", {"a": 2}, expected=first)
    assert before.get("TABLE", "t").body == {"a": 1} and c.snapshot().get("TABLE", "t").body == {"a": 2}
    with pytest.raises(EngineError) as e:
        c.put("TABLE", "t", {"a": 3}, expected=first)
    assert e.value.symbol == "CATALOG_CONFLICT"
    c.put("MODEL", "m", {})
    with pytest.raises(EngineError) as e:
        c.put("FUNCTION", "m", {})
    assert e.value.symbol == "OBJECT_ALREADY_EXISTS"
    c.drop("TABLE", "t")
    c.put("TABLE", "t", {})
    assert c.snapshot().get("TABLE", "t").generation == 2


def test_jobs():
    c = Catalog()
    c.put("JOB", "j", {"state": "STARTING", "sql": "x", "error": None})
    assert c.move_job("j", "RUNNING")["state"] == "RUNNING" and c.move_job("j", "STOPPED")["state"] == "STOPPED" and c.move_job("j", "RUNNING")["state"] == "STOPPED"


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("SELECT TUMBLE(ts, INTERVAL '5' SECOND) AS w, k, count(*) FROM t GROUP BY 1, 2", "SELECT window(ts, '5000 milliseconds').start AS w, k, count(*) FROM t GROUP BY window(ts, '5000 milliseconds'), k "),
        ("SELECT k, TUMBLE(ts, INTERVAL '5' SECOND) AS w FROM t GROUP BY k, w HAVING count(*) > 1", "SELECT k, window(ts, '5000 milliseconds').start AS w FROM t GROUP BY k, window(ts, '5000 milliseconds') HAVING count(*) > 1"),
        ("SELECT count(*) FROM t GROUP BY TUMBLE(ts, INTERVAL '1' MINUTE)", "SELECT count(*) FROM t GROUP BY window(ts, '60000 milliseconds') "), ("SELECT 1 FROM t", "SELECT 1 FROM t"),
    ],
)
def test_stream_tumble(query, want):
    from framewright.plans.normalise import stream_tumble

    assert stream_tumble(query) == want


def test_shell(s, tmp_path):
    import io

    from framewright.__main__ import run

    out = io.StringIO()
    assert run(s, "CREATE FUNCTION twice(x BIGINT) RETURN x * 2; SELECT twice(21) AS v, NULL AS w; -- done", out)
    assert out.getvalue().splitlines() == ["created function 'twice'", "42\tNULL"]
    assert not run(s, "SELECT 1 AS a; DROP TABLE none; SELECT 2 AS a", out) and "2" != out.getvalue().splitlines()[-1]


def test_cancel_and_changed_artifacts(s, spark, tmp_path):
    from framewright.models import graphs

    s.sql("CREATE TABLE cam USING RTSP OPTIONS (url = 'rtsp://replay', rows = 100000, rowsPerBatch = 50, fps = 10)")
    handle, seen = s.sql("SELECT frame_id FROM cam"), 0
    for b in handle.stream():
        seen += b.num_rows
        if seen >= 100:
            assert handle.progress()["rows"] >= 50
            handle.cancel()
    assert seen >= 100 and not handle._query.isActive
    bounded = s.sql("SELECT 1 AS a")
    bounded.cancel()
    with pytest.raises(EngineError, match="cancelled"):
        bounded.collect()
    path = tmp_path / "m.onnx"
    path.write_bytes(graphs.graph([("Neg", ["x"], ["y"])], {"x": ["n"]}, {"y": ["n"]}))
    s.run_script(f"CREATE MODEL neg (x FLOAT) RETURNS FLOAT VERSION 'v1' FROM '{path}' USING ONNX_RUNTIME; RESOLVE MODEL neg")
    assert rows(s.sql("SELECT neg(v) AS n FROM (SELECT 2F AS v) t")) == [(-2.0,)]
    path.write_bytes(graphs.graph([("Abs", ["x"], ["y"])], {"x": ["n"]}, {"y": ["n"]}))
    with pytest.raises(EngineError, match="changed"):
        s.sql("SELECT neg(v) AS n FROM (SELECT 2F AS v) t")

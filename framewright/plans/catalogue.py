"""Registered queries of the reference's operators, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import compat, detection, spatial
from ..functions.tumble import date_bin, tumble
from ..models.runtime import Model, mock_call
from ..operators import inference, relational
from ..sources.sampling import sample_pts
from ..streaming import sink, windows

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "tumble_event_counts"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def sql(name: str, text: str, tables: str, oracle: str | None = None) -> None:
    """A query that Spark SQL states by itself; the oracle is the same text unless given."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        views = {t: table(spark, d, t) for t in tables.split()}
        return spark.sql(text.format(**{t: "{" + t + "}" for t in views}), **views)

    query(name, oracle or text.format(**{t: t for t in tables.split()}))(run)


# tumbling windows

MIN5 = "make_timestamp(epoch_us(ts) - ((epoch_us(ts) % 300000000) + 300000000) % 300000000)"


@query("tumble_event_counts", f"SELECT {MIN5} AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def tumble_event_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    w = tumble(F.col("ts"), "5 minutes").cast("timestamp_ntz").alias("window_start")
    return e.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("tumble_by_type_having", f"SELECT {MIN5} AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def tumble_by_type_having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(tumble(F.col("ts"), "5 minutes").cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.count("*").alias("n")).where("n > 1")


@query("tumble_scalar", "SELECT event_id, make_timestamp(epoch_us(ts) - epoch_us(ts) % 7000000) AS w7, make_timestamp(epoch_us(ts) - epoch_us(ts) % 3600000000) AS w1h FROM events")
def tumble_scalar(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", tumble(F.col("ts"), "7 seconds").cast("timestamp_ntz").alias("w7"), date_bin("1 hour", F.col("ts")).cast("timestamp_ntz").alias("w1h"))


@query("tumble_negative_epoch", "SELECT ms, CAST(floor(ms / 5000.0) * 5000 AS BIGINT) AS start_ms FROM (VALUES (CAST(7800 AS BIGINT)), (NULL), (-1), (-5000), (0)) t(ms)")
def tumble_negative_epoch(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(7800,), (None,), (-1,), (-5000,), (0,)], "ms long")
    return rows.select("ms", F.unix_millis(tumble(F.timestamp_millis("ms"), 5000)).alias("start_ms"))


@query("tumble_native_window", f"SELECT {MIN5} AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumble_native_window(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(table(spark, d, "events"), "5 minutes", ["event_type"], [("count", "*", "n")])


BATCHES = "SELECT *, epoch_us(ts) // 1000 AS ms, event_id // 500 AS batch FROM events"
LATE = f"""WITH e AS ({BATCHES}), m AS (SELECT batch, max(max(ms)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 2000 AS watermark FROM e GROUP BY batch)
SELECT e.*, m.watermark, coalesce(e.ms < m.watermark, false) AS is_late FROM e JOIN m USING (batch)"""


def _batches(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.expr("event_id div 500").alias("batch"))


@query("late_rows_exact", f"SELECT event_id, watermark, is_late FROM ({LATE})")
def late_rows_exact(spark: SparkSession, d: str) -> DataFrame:
    return windows.late_rows(_batches(spark, d), "ms", "batch", 2000).select("event_id", "watermark", "is_late")


@query("exact_tumble_emission", f"""SELECT * FROM (SELECT ms - ms % 60000 AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM ({LATE}) WHERE NOT is_late GROUP BY 1, 2)
WHERE window_start + 60000 <= (SELECT max(epoch_us(ts) // 1000) - 2000 FROM events)""")
def exact_tumble_emission(spark: SparkSession, d: str) -> DataFrame:
    out = windows.exact_tumbling_batches(_batches(spark, d), "ms", "batch", 60_000, ["event_type"], [("count", "*", "n"), ("sum", "value", "total")], 2000)
    return out.withColumn("total", F.round("total", 4))


# boxes and polygons

BOXES = "SELECT p_partkey AS id, CAST((p_size % 10) / 20.0 AS FLOAT) AS x, CAST((p_partkey % 16) / 32.0 AS FLOAT) AS y, CAST(0.25 AS FLOAT) AS w, CAST((p_size % 4 + 1) / 8.0 AS FLOAT) AS h FROM part"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), spatial.box(F.col("p_size") % 10 / 20.0, F.col("p_partkey") % 16 / 32.0, F.lit(0.25), (F.col("p_size") % 4 + 1) / 8.0).alias("b"))


@query("box_center", f"SELECT id, CAST(x + CAST(w / 2 AS FLOAT) AS FLOAT) AS cx, CAST(y + CAST(h / 2 AS FLOAT) AS FLOAT) AS cy FROM ({BOXES})")
def box_center(spark: SparkSession, d: str) -> DataFrame:
    c = spatial.box_center(F.col("b"))
    return _boxes(spark, d).select("id", c["x"].alias("cx"), c["y"].alias("cy"))


TRIANGLE = "POLYGON((0.1 0.1, 0.9 0.2, 0.4 0.9, 0.1 0.1))"


@query("st_contains_grid", f"""WITH c AS (SELECT id, x + 0.013 AS px, y + 0.017 AS py FROM ({BOXES})),
e AS (SELECT * FROM (VALUES (0.1, 0.1, 0.9, 0.2), (0.9, 0.2, 0.4, 0.9), (0.4, 0.9, 0.1, 0.1)) t(x1, y1, x2, y2))
SELECT id, count(*) FILTER ((y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1) % 2 = 1 AS inside FROM c, e GROUP BY id""")
def st_contains_grid(spark: SparkSession, d: str) -> DataFrame:
    p = spatial.point(F.col("b.x") + 0.013, F.col("b.y") + 0.017)
    return _boxes(spark, d).select("id", spatial.st_contains(spatial.polygon(TRIANGLE), p).alias("inside"))


@query("polygon_parse", "SELECT * FROM (VALUES (1, CAST(0.1 AS FLOAT), CAST(0.1 AS FLOAT)), (2, CAST(0.9 AS FLOAT), CAST(0.2 AS FLOAT)), (3, CAST(0.4 AS FLOAT), CAST(0.9 AS FLOAT)), (4, CAST(0.1 AS FLOAT), CAST(0.1 AS FLOAT))) t(k, x, y)")
def polygon_parse(spark: SparkSession, d: str) -> DataFrame:
    one = spark.createDataFrame([(TRIANGLE,)], "t string").select(F.posexplode(spatial.polygon(F.col("t"))).alias("k", "p"))
    return one.select((F.col("k") + 1).alias("k"), "p.x", "p.y")


# inference

PEOPLE = Model("people", "OBJECT_DETECTION", "mock://person")


def _images(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", F.struct(F.col("url").alias("uri"), (F.col("page_id") % 5 * 160).cast("int").alias("width"), F.lit(480).alias("height")).alias("image"))


@query("mock_detect_unnest", "SELECT page_id, 'person' AS label, CAST(0.9 AS FLOAT) AS confidence, CAST(0.5 AS FLOAT) AS cx FROM pages WHERE length(html) > 3000")
def mock_detect_unnest(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.struct(F.col("url").alias("uri")).alias("image"), "html")
    df, (c,) = inference.infer(pages, [inference.Call(PEOPLE, ("image",))], before=[F.char_length("html") > 3000])
    return relational.unnest(df, c, "d").select("page_id", "d.label", "d.confidence", spatial.box_center(F.col("d.box"))["x"].alias("cx"))


@query("detect_filter_classes", "SELECT page_id, 1 AS people, 0 AS cars, 0 AS sure FROM pages")
def detect_filter_classes(spark: SparkSession, d: str) -> DataFrame:
    df, (c,) = inference.infer(_images(spark, d), [inference.Call(PEOPLE, ("image",))])
    n = lambda classes, least: F.size(detection.keep_detections(F.col(c), classes, least))
    return df.select("page_id", n(["person"], 0.5).alias("people"), n(["car"], None).alias("cars"), n(None, 0.95).alias("sure"))


@query("detect_locator_pixels", "SELECT page_id, CASE WHEN page_id % 5 > 0 THEN CAST(0.25 * (page_id % 5 * 160) AS FLOAT) END AS x, CASE WHEN page_id % 5 > 0 THEN CAST(120 AS FLOAT) END AS y FROM pages")
def detect_locator_pixels(spark: SparkSession, d: str) -> DataFrame:
    df, (c,) = inference.infer(_images(spark, d), [inference.Call(PEOPLE, ("image",))])
    first = F.get(detection.task_detections(F.col(c), F.col("image")), F.lit(0))
    return df.select("page_id", first["locator"]["box"]["x"].alias("x"), first["locator"]["box"]["y"].alias("y"))


@query("inference_dedup", "SELECT page_id, true AS same FROM pages")
def inference_dedup(spark: SparkSession, d: str) -> DataFrame:
    df, (a, b) = inference.infer(_images(spark, d), [inference.Call(PEOPLE, ("image",)), inference.Call(PEOPLE, ("image",))])
    return df.select("page_id", (F.lit(a == b) & F.col(a)["label"][0].eqNullSafe(F.col(b)["label"][0])).alias("same"))


SCORES = "SELECT vec_id, [1 / (1 + exp(-embedding[1])), 1 / (1 + exp(-embedding[2])), 1 / (1 + exp(-embedding[3]))] AS s FROM embeddings"
CLASSES = ["cat", "dog", "owl"]


def _scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    s = F.array(*[1 / (1 + F.exp(-F.get("embedding", F.lit(k)).cast("double"))) for k in range(3)])
    return e.select("vec_id", detection.classification(CLASSES, s).alias("full"))


@query("classify_single", f"SELECT vec_id, CASE WHEN s[3] > s[1] OR (s[3] = s[1] AND 'owl' < 'cat') THEN 'owl' ELSE 'cat' END AS label FROM ({SCORES.replace('embedding[', 'CAST(embedding[').replace('])', '] AS DOUBLE))')})")
def classify_single(spark: SparkSession, d: str) -> DataFrame:
    top = F.get(detection.classify(F.col("full"), CLASSES, ["cat", "owl"]), F.lit(0))
    return _scores(spark, d).select("vec_id", top["label"].alias("label"))


@query("classify_multi", f"SELECT vec_id, len(list_filter(s, lambda x: CAST(x AS FLOAT) >= CAST(0.5 AS FLOAT))) AS n FROM ({SCORES.replace('embedding[', 'CAST(embedding[').replace('])', '] AS DOUBLE))')})")
def classify_multi(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("vec_id", F.size(detection.classify(F.col("full"), CLASSES, CLASSES, "multi", 0.5)).cast("long").alias("n"))


def _overlap(axis: str, size: float) -> str:
    return f"greatest(0, least(k.{axis}, c[1].{axis}) + {size} - greatest(k.{axis}, c[1].{axis}))"


SHARED = f"{_overlap('x', 0.3)} * {_overlap('y', 0.3)}"


@query("nms_greedy", f"""SELECT l_orderkey, CAST(len(b) AS INT) AS n, CAST(len(list_reduce(list_transform(b, lambda x: [x]), lambda kept, c:
  CASE WHEN len(list_filter(kept, lambda k: k.label = c[1].label AND {SHARED} / (0.18 - {SHARED}) >= 0.45)) > 0 THEN kept ELSE list_concat(kept, c) END)) AS INT) AS kept
FROM (SELECT l_orderkey, list({{'label': l_linenumber % 2, 'x': l_discount * 2, 'y': l_tax * 4}} ORDER BY CAST(l_quantity / 51 AS FLOAT) DESC, l_linenumber, l_discount, l_tax) AS b FROM lineitem GROUP BY l_orderkey)""")
def nms_greedy(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    b = spatial.box(F.col("l_discount") * 2, F.col("l_tax") * 4, F.lit(0.3), F.lit(0.3))
    one = F.struct(F.when(F.col("l_linenumber") % 2 == 0, "car").otherwise("person").alias("label"), (F.col("l_quantity") / 51).cast("float").alias("confidence"), b.alias("box"))
    by_order = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", one.alias("d")))).alias("all"))
    return by_order.select("l_orderkey", F.size("all").alias("n"), F.size(detection.nms(F.transform("all", lambda x: x["d"]))).alias("kept"))


@query("generic_model_null_scatter", "SELECT event_id, CASE WHEN value > 50 THEN value END AS echoed FROM events")
def generic_model_null_scatter(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import types as T

    echo = mock_call(Model("echo", "GENERIC", "mock://echo", arguments=(T.DoubleType(),), returns=T.DoubleType()))
    return table(spark, d, "events").select("event_id", echo(F.when(F.col("value") > 50, F.col("value"))).alias("echoed"))


PTS = [0, 33, 80, 121, 205, 260, 401, 610, 799, 1005]


@query("pts_sampling", "SELECT * FROM (VALUES (0, 0), (205, 1), (401, 2), (610, 3), (1005, 4)) t(pts_ms, frame_id)")
def pts_sampling(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(sample_pts(PTS, 5.0)), "pts_ms int, frame_id int")


@query("python_function_arrow", "SELECT l_orderkey, l_linenumber, l_linenumber * 2 AS twice FROM lineitem")
def python_function_arrow(spark: SparkSession, d: str) -> DataFrame:
    @F.arrow_udf("int")
    def twice(x: pa.Array) -> pa.Array:
        return pc.multiply(x, pa.scalar(2, pa.int32()))

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", twice("l_linenumber").alias("twice"))


@query("kafka_json_value", """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"status":"' || o_orderstatus || '","note":' || CASE WHEN o_orderkey % 2 = 0 THEN '"even"' ELSE 'null' END || '}' AS value FROM orders""")
def kafka_json_value(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "even").alias("note"))
    return sink.json_rows(o).select(F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"), "value")


@query("sql_macro", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def sql_macro(spark: SparkSession, d: str) -> DataFrame:
    from . import normalise

    text = normalise.normalise("SELECT l_orderkey, l_linenumber, round(net(l_extendedprice, off => l_discount), 4) AS net FROM {l}", {"net": normalise.Macro("net", ("price", "off"), "price * (1 - off)")})
    return spark.sql(text, l=table(spark, d, "lineitem"))


# dialect

@query("dialect_unnest", "SELECT doc_id, w FROM (SELECT doc_id, string_split(source || ' ' || lang, ' ') AS ws FROM documents), UNNEST(ws) AS u(w)")
def dialect_unnest(spark: SparkSession, d: str) -> DataFrame:
    from . import normalise

    return spark.sql(normalise.normalise("SELECT doc_id, w FROM (SELECT doc_id, split(concat_ws(' ', source, lang), ' ') AS ws FROM {docs}) AS t, UNNEST(ws) AS u(w)"), docs=table(spark, d, "documents"))


@query("dialect_qualify", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def dialect_qualify(spark: SparkSession, d: str) -> DataFrame:
    from . import normalise

    return spark.sql(normalise.normalise("SELECT user_id, event_id, value FROM {e} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1"), e=table(spark, d, "events"))


@query("dialect_subscript", "SELECT vec_id, embedding[1] AS first_value, ['a', 'b'][2] AS b FROM embeddings")
def dialect_subscript(spark: SparkSession, d: str) -> DataFrame:
    from . import normalise

    return spark.sql(normalise.normalise("SELECT vec_id, embedding[1] AS first_value, ['a', 'b'][2] AS b FROM {e}"), e=table(spark, d, "embeddings"))


def dialect(name: str, text: str, tables: str, oracle: str | None = None) -> None:
    """A query in the dialect; the oracle is the same text unless given."""
    from . import normalise

    def run(spark: SparkSession, d: str) -> DataFrame:
        for t in tables.split():
            table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(normalise.normalise(text))

    query(name, oracle or text)(run)


dialect("dialect_arrays", "SELECT p_partkey, array_to_string(list_concat([p_size, 7], [p_partkey % 5]), '-') AS c, array_to_string(array_slice([1, p_size, 3, 4], 2, 3), '-') AS s, list_contains([3, 7], p_size % 9) AS h, gcd(p_size, 36) AS g, array_to_string(array_reverse([p_size, 1]), '-') AS r FROM part", "part")
dialect("dialect_text", "SELECT c_custkey, regexp_replace(c_name, '\\d', '#') AS first_digit, regexp_replace(c_name, '\\d', '#', 'g') AS digits, ltrim(c_name, 'Cu') AS l, array_to_string(string_to_array(c_name, '#'), '|') AS parts, to_hex(c_custkey) AS h, CAST(c_custkey AS VARCHAR) AS t FROM customer", "customer",
        "SELECT c_custkey, regexp_replace(c_name, '\\d', '#') AS first_digit, regexp_replace(c_name, '\\d', '#', 'g') AS digits, ltrim(c_name, 'Cu') AS l, array_to_string(string_split(c_name, '#'), '|') AS parts, lower(to_hex(c_custkey)) AS h, CAST(c_custkey AS VARCHAR) AS t FROM customer")
dialect("dialect_ordered_aggregates", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_name DESC), ',') AS names, string_agg(n_name, ';' ORDER BY n_nationkey) AS listed, first_value(n_name ORDER BY n_nationkey DESC) AS newest FROM nation GROUP BY n_regionkey", "nation",
        "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_name DESC), ',') AS names, string_agg(n_name, ';' ORDER BY n_nationkey) AS listed, first(n_name ORDER BY n_nationkey DESC) AS newest FROM nation GROUP BY n_regionkey")
dialect("dialect_distinct_on", "SELECT DISTINCT ON (user_id) user_id, event_id, value FROM events ORDER BY user_id, value DESC, event_id", "events")
dialect("dialect_right_semi", "SELECT o.o_orderkey FROM customer c RIGHT SEMI JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0", "customer orders", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
dialect("dialect_any_similar", "SELECT p_partkey FROM part WHERE p_size = ANY([1, 5, 9]) OR p_name ~* 'BLUE' OR p_brand SIMILAR TO 'Brand#(1|2)_'", "part", "SELECT p_partkey FROM part WHERE p_size = ANY([1, 5, 9]) OR regexp_matches(p_name, '(?i)BLUE') OR regexp_full_match(p_brand, 'Brand#(1|2).')")
dialect("dialect_date_bin", "SELECT event_id, to_unixtime(date_bin(INTERVAL '15' MINUTE, ts)) AS b FROM events", "events", "SELECT event_id, CAST(epoch_us(ts) // 900000000 * 900 AS BIGINT) AS b FROM events")
dialect("dialect_series", "SELECT value AS n FROM generate_series(1, 20, 3)", "", "SELECT generate_series AS n FROM generate_series(1, 20, 3)")


@query("div_semantics", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey // 7 AS BIGINT) AS q, l_orderkey % 7 AS r, gcd(l_orderkey, 36) AS g, lcm(CAST(l_linenumber AS BIGINT), 6) AS m FROM lineitem")
def div_semantics(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    return l.select("l_orderkey", "l_linenumber", compat.int_div("l_orderkey", "7").alias("q"), (F.col("l_orderkey") % 7).alias("r"), compat.gcd(F.col("l_orderkey"), F.lit(36)).alias("g"), compat.lcm(F.col("l_linenumber"), F.lit(6)).alias("m"))


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark: SparkSession, d: str) -> DataFrame:
    return relational.distinct_on(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("win_groups_frame", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM part")
def win_groups_frame(spark: SparkSession, d: str) -> DataFrame:
    return relational.over_groups(table(spark, d, "part"), "s", F.sum("p_size"), ["p_brand"], "p_size", 1, 0).select("p_partkey", "s")


@query("setop_union_by_name", "SELECT n_name AS name, n_regionkey AS a, NULL::DOUBLE AS b FROM nation UNION ALL BY NAME SELECT s_acctbal AS b, s_name AS name, NULL::INTEGER AS a FROM supplier")
def setop_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("a"))
    return relational.union_by_name(n, table(spark, d, "supplier").select(F.col("s_acctbal").alias("b"), F.col("s_name").alias("name")))


# joins, aggregates, windows, sets, order

for how in ("inner", "left", "right", "full"):
    kind = how.upper() + ("" if how == "inner" else " OUTER")
    sql(f"join_{how}", f"SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM {{customer}} c {kind} JOIN (SELECT * FROM {{orders}} WHERE o_totalprice > 1000) o ON c.c_custkey = o.o_custkey", "customer orders")
sql("join_semi", "SELECT c_custkey, c_name FROM {customer} c LEFT SEMI JOIN {orders} o ON c.c_custkey = o.o_custkey", "customer orders", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql("join_anti", "SELECT c_custkey, c_name FROM {customer} c LEFT ANTI JOIN {orders} o ON c.c_custkey = o.o_custkey", "customer orders", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql("join_right_semi", "SELECT o_orderkey FROM {orders} o LEFT SEMI JOIN (SELECT * FROM {customer} WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey", "customer orders", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
sql("join_theta", "SELECT n.n_name, r.r_name FROM {nation} n JOIN {region} r ON n.n_regionkey < r.r_regionkey", "nation region")
sql("join_cross", "SELECT n.n_nationkey, r.r_regionkey FROM {nation} n CROSS JOIN {region} r", "nation region")
sql("join_using", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM {nation}) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM {region}) y USING (k)", "nation region")
sql("join_natural", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM {nation}) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM {region}) y", "nation region")
# Spark keeps the order of a correlated LIMIT only over columns that are selected beside it; by others it sorts the whole table, and the shuffle by customer that follows takes rows as they arrive.
sql("join_lateral", "SELECT c_custkey, t.o_orderkey FROM {customer} c, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 1) t", "customer orders", "SELECT c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t")
sql("join_multiway", "SELECT n.n_name, count(*) AS n_lines, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name", "lineitem supplier nation region")
sql("subquery_scalar", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders})", "orders")
sql("subquery_correlated", "SELECT s_suppkey FROM {supplier} s WHERE s_acctbal > (SELECT avg(t.s_acctbal) FROM {supplier} t WHERE t.s_nationkey = s.s_nationkey)", "supplier")
sql("subquery_in", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 49)", "part lineitem")
sql("cte_with", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM {orders} GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 100000) SELECT c.c_custkey, round(top.t, 2) AS t FROM top JOIN {customer} c ON c.c_custkey = top.o_custkey", "orders customer")

sql("agg_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p, min(l_tax) AS lo, max(l_tax) AS hi FROM {lineitem} GROUP BY 1, 2", "lineitem")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) >= 12", "orders")
sql("agg_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY o_orderpriority", "orders")
sql("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n, round(sum(l_quantity) FILTER (WHERE l_tax = 0), 2) AS q FROM {lineitem} GROUP BY l_returnflag", "lineitem")
for how, clause in (("rollup", "ROLLUP (c_nationkey, c_mktsegment)"), ("cube", "CUBE (c_nationkey, c_mktsegment)"), ("grouping_sets", "GROUPING SETS ((c_nationkey), (c_mktsegment), ())")):
    sql(f"agg_{how}", f"SELECT c_nationkey, c_mktsegment, CAST(grouping(c_nationkey) AS INT) AS g, count(*) AS n FROM {{customer}} GROUP BY {clause}", "customer")
sql("agg_stats", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_extendedprice), 4) AS cp, round(covar_samp(l_quantity, l_extendedprice), 4) AS cs, round(regr_slope(l_extendedprice, l_quantity), 4) AS k, round(regr_intercept(l_extendedprice, l_quantity), 3) AS i, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS rc FROM {lineitem} GROUP BY l_returnflag", "lineitem")
sql("agg_bool_bit", "SELECT s_nationkey, bool_and(s_acctbal > 0) AS ba, bool_or(s_acctbal > 9000) AS bo, bit_and(s_suppkey) AS a, bit_or(s_suppkey) AS o, bit_xor(s_suppkey) AS x FROM {supplier} GROUP BY s_nationkey", "supplier")
sql("agg_median_percentile", "SELECT l_returnflag, median(l_quantity) AS med, percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90 FROM {lineitem} GROUP BY l_returnflag", "lineitem")
sql("agg_array_string", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS all_names, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name DESC) AS listed, min_by(n_name, n_nationkey) AS first_name FROM {nation} GROUP BY n_regionkey", "nation", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS all_names, string_agg(n_name, ';' ORDER BY n_name DESC) AS listed, arg_min(n_name, n_nationkey) AS first_name FROM nation GROUP BY n_regionkey")
# Beside count(DISTINCT k), Spark keeps the sketches of the other aggregates for each k; the exact count therefore has a branch of its own.
sql("agg_approx", "SELECT near BETWEEN 0.8 * n AND 1.2 * n AS distinct_ok, abs(middle - 25) <= 2 AS median_ok FROM (SELECT approx_count_distinct(l_orderkey) AS near, percentile_approx(l_quantity, 0.5) AS middle FROM {lineitem}) a CROSS JOIN (SELECT count(l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey FROM {lineitem}) k) b", "lineitem", "SELECT true AS distinct_ok, true AS median_ok")
sql("select_distinct", "SELECT DISTINCT p_brand, p_size FROM {part}", "part")

sql("win_ranks", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS r, dense_rank() OVER v AS dr, round(percent_rank() OVER v, 8) AS pr, round(cume_dist() OVER v, 8) AS cd, ntile(4) OVER w AS nt FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_orderstatus ORDER BY o_custkey)", "orders")
sql("win_offsets", "SELECT event_id, lag(value, 2) OVER w AS l2, lead(value) OVER w AS n1, first_value(value) OVER w AS f, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z, nth_value(event_id, 2) OVER w AS n2 FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "events")
sql("win_frames", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS r, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS g FROM {lineitem}", "lineitem")
sql("win_ignore_nulls", "SELECT event_id, last_value(v) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM (SELECT *, CASE WHEN value > 100 THEN value END AS v FROM {events}) e", "events", "SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM (SELECT *, CASE WHEN value > 100 THEN value END AS v FROM events) e")

sql("setop_union_all", "SELECT n_regionkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}", "nation region")
sql("setop_union", "SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey FROM {region}", "nation region")
sql("setop_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}", "customer supplier")
sql("setop_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}", "customer supplier")
sql("setop_except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000", "nation supplier")
sql("setop_except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}", "customer supplier")


@query("sort_nulls_topk", "SELECT o_orderkey, v FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS v FROM orders) ORDER BY v ASC NULLS LAST, o_orderkey LIMIT 25 OFFSET 5")
def sort_nulls_topk(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("v"))
    return relational.order_by(o, ("v", True), ("o_orderkey", True)).offset(5).limit(25)


sql("sort_topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100", "lineitem")
sql("filter_predicates", "SELECT p_partkey FROM {part} WHERE (p_name LIKE '%a%' OR p_size BETWEEN 3 AND 9) AND NOT p_brand IN ('Brand#11', 'Brand#12') AND p_retailprice IS NOT NULL AND p_type IS DISTINCT FROM 'none'", "part", "SELECT p_partkey FROM part WHERE (p_name LIKE '%a%' OR p_size BETWEEN 3 AND 9) AND NOT p_brand IN ('Brand#11', 'Brand#12') AND p_retailprice IS NOT NULL AND p_type IS DISTINCT FROM 'none'")
sql("expr_case_cast", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, CAST(o_totalprice AS INT) AS whole, try_cast(o_orderstatus AS INT) AS none, coalesce(nullif(o_orderstatus, 'O'), '-') AS st, greatest(o_orderkey, 100) AS g FROM {orders}", "orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, CAST(trunc(o_totalprice) AS INT) AS whole, try_cast(o_orderstatus AS INT) AS none, coalesce(nullif(o_orderstatus, 'O'), '-') AS st, greatest(o_orderkey, 100) AS g FROM orders")
sql("values_range", "SELECT a, b, a * 2 AS c FROM (VALUES (1, 'x'), (2, 'y'), (NULL, 'z')) t(a, b)", "")
sql("generate_series", "SELECT id AS n, id * id AS sq FROM range(0, 50, 3)", "", "SELECT range AS n, range * range AS sq FROM range(0, 50, 3)")

# scalar functions

sql("fn_string", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, substr(c_name, 2, 5) AS s, replace(c_name, '0', 'o') AS rp, reverse(c_name) AS rv, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '*') AS rpd, trim(concat_ws(' ', c_mktsegment, NULL, ' x ')) AS t, left(c_name, 3) AS lf, right(c_name, 3) AS rt, split_part(c_name, '#', 2) AS sp, instr(c_name, '#') AS i, ascii(c_name) AS a, chr(65) AS ch, repeat('ab', 2) AS rep, translate(c_name, '01', 'zy') AS tr, levenshtein(c_mktsegment, 'BUILDING') AS lev FROM {customer}", "customer")
sql("fn_math", "SELECT s_suppkey, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, round(s_acctbal, 1) AS r, sign(s_acctbal) AS sg, round(sqrt(abs(s_acctbal)), 6) AS q, round(cbrt(s_acctbal), 6) AS cb, round(ln(abs(s_acctbal) + 1), 6) AS l, round(log10(abs(s_acctbal) + 1), 6) AS l10, round(exp(1), 6) AS e, round(power(2, s_nationkey), 2) AS p, round(sin(s_acctbal) + cos(s_acctbal) + atan2(s_acctbal, 2), 6) AS trig, degrees(pi()) AS dg, factorial(5) AS fa, s_suppkey % 7 AS m FROM {supplier}", "supplier", "SELECT s_suppkey, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, round(s_acctbal, 1) AS r, CAST(sign(s_acctbal) AS DOUBLE) AS sg, round(sqrt(abs(s_acctbal)), 6) AS q, round(cbrt(s_acctbal), 6) AS cb, round(ln(abs(s_acctbal) + 1), 6) AS l, round(log10(abs(s_acctbal) + 1), 6) AS l10, round(exp(1), 6) AS e, round(power(2, s_nationkey), 2) AS p, round(sin(s_acctbal) + cos(s_acctbal) + atan2(s_acctbal, 2), 6) AS trig, degrees(pi()) AS dg, CAST(factorial(5) AS BIGINT) AS fa, s_suppkey % 7 AS m FROM supplier")
sql("fn_date", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(extract(doy FROM o_orderdate) AS BIGINT) AS doy, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS mon, CAST(o_orderdate AS DATE) AS d, make_date(2024, 2, 29) AS md FROM {orders}", "orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(extract(doy FROM o_orderdate) AS BIGINT) AS doy, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS mon, CAST(o_orderdate AS DATE) AS d, make_date(2024, 2, 29) AS md FROM orders")
sql("fn_array", "SELECT vec_id, size(embedding) AS n, array_contains(array(1, 2, 3), 2) AS has, array_join(array_sort(array_union(array(3, 1), array(2, 3))), '-') AS un, array_join(array_distinct(array(1, 1, 2)), '-') AS di, array_join(slice(array(5, 6, 7, 8), 2, 2), '-') AS sl, array_position(array('a', 'b'), 'b') AS po, array_join(flatten(array(array(1), array(2, 3))), '-') AS fl, array_max(array(4, 9, 2)) AS mx FROM {embeddings}", "embeddings", "SELECT vec_id, len(embedding) AS n, true AS has, '1-2-3' AS un, '1-2' AS di, '6-7' AS sl, 2 AS po, '1-2-3' AS fl, 9 AS mx FROM embeddings")
sql("fn_map_struct", "SELECT n_nationkey, element_at(map('k', n_name), 'k') AS v, size(map_keys(map('a', 1, 'b', 2))) AS ks, named_struct('x', n_regionkey).x AS x, array_join(map_keys(map(n_name, 1)), ',') AS mk FROM {nation}", "nation", "SELECT n_nationkey, n_name AS v, 2 AS ks, n_regionkey AS x, n_name AS mk FROM nation")
sql("fn_regex", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#') AS r, regexp_count(c_name, '0') AS n, c_name RLIKE '9$' AS l, regexp_extract(c_name, '([0-9]+)', 1) AS x FROM {customer}", "customer", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#') AS r, CAST(len(regexp_extract_all(c_name, '0')) AS INT) AS n, regexp_matches(c_name, '9$') AS l, regexp_extract(c_name, '([0-9]+)', 1) AS x FROM customer")
sql("fn_hash", "SELECT n_nationkey, md5(n_name) AS m, sha2(n_name, 256) AS s FROM {nation}", "nation", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s FROM nation")
sql("fn_json", "SELECT event_id, get_json_object(props, '$.k') AS k FROM {events}", "events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")


@query("fn_compat", "SELECT p_partkey, p_name || coalesce(NULL, '') AS c, CAST(trunc(p_retailprice) AS DOUBLE) AS t, [2, 4] AS pos, sqrt(8.0::DOUBLE) AS dist, p_size = 0 AS z FROM part")
def fn_compat(spark: SparkSession, d: str) -> DataFrame:
    a = F.array(F.lit(1), F.lit(7), F.lit(3), F.lit(7))
    return table(spark, d, "part").select(
        "p_partkey", compat.concat(F.col("p_name"), F.lit(None)).alias("c"), compat.trunc(F.col("p_retailprice")).alias("t"), compat.array_positions(a, F.lit(7)).alias("pos"),
        compat.array_distance(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))).alias("dist"), compat.iszero(F.col("p_size")).alias("z"),
    )


@query("win_over_dataframe", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders")
def win_over_dataframe(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))

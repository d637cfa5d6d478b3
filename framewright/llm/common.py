"""Helpers that the training-data operators share: the shared folder, checkpoints, components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset and all tasks run on this machine (tests).
FALLBACK_DIR = "/tmp/framewright-checkpoints"
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches, as spark.checkpoint.dir names it; FALLBACK_DIR in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        named = FALLBACK_DIR
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts (column number text) come to about `most` bytes, so that a worker holds little at once."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
    begin = held = 0
    for k, n in enumerate(sizes):
        held += n
        if held >= most:
            yield batch.slice(begin, k + 1 - begin)
            begin, held = k + 1, 0
    if begin < len(sizes) or not sizes:
        yield batch.slice(begin)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder; what is left of it goes when the driver ends."""
    if not _made:
        atexit.register(_remove_made)
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, on any file system that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _remove_made() -> None:
    if SparkContext._active_spark_context is not None and (spark := SparkSession.getActiveSession()) is not None:
        for path in _made:
            with suppress(Exception):  # the cluster may be gone by now
                remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Parts into which the rows of one key are dealt where they meet the key's minimum.
PARTS = 64


def part_of(column: str):
    return F.pmod(F.xxhash64(column), F.lit(PARTS)).cast("int")


def with_least(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """df with the least value of its key. A key's rows are dealt into PARTS by value: the minima of the parts are
    combined and joined back by key and part, so no task joins more than a part of a hot key. Rows with a null key are left out."""
    dealt = df.withColumn("__fw_part", part_of(value))
    parts = dealt.groupBy(key, "__fw_part").agg(F.min(value).alias("__fw_least"))
    whole = parts.groupBy(key).agg(F.min("__fw_least").alias(out))
    return dealt.join(parts.select(key, "__fw_part").join(whole, key), [key, "__fw_part"]).drop("__fw_part")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between 64-bit node ids -> (node, root), root the least id reachable.

    Alternating large-star and small-star rounds over minima per node (see with_least), so a node with very many links
    is spread over tasks; nothing is gathered in one task or on the driver. Nulls and loops are dropped.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = with_least(edges.union(edges.select("b", "a")), "a", "b", "m")
        large = both.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        small = with_least(large, "a", "b", "m")
        edges = cut(small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

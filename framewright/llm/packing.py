"""Packing: length buckets that minimise padding, and token-budget batches inside each bucket.

Lengths are tokens of the repository's BPE (the parameter vocabulary; without it, matches of token_pattern), a document
longer than max_length is cut in pieces that all take part, each with its text and character span, and the histogram
of piece lengths, at most max_length + 1 rows, is all that the driver sees. Dynamic programming over it gives the boundaries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices
from .tokens import Encoder, load_ranks

MAX_LENGTH, BUCKETS, BUDGET = 2048, 8, 16_384
#: Hash cells per bucket in which rows are numbered: twice the shuffle partitions, and at most these, as their offsets are broadcast (one number a cell and bucket).
CELLS = 100_000


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets with the least total padding; the last is the greatest length."""
    lengths = np.array(sorted(histogram), np.float64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], np.float64)
    n, m = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    size = len(lengths)
    best = lengths * n[1:] - m[1:]  # one bucket for the first j + 1 lengths
    cuts = [np.zeros(size, np.int64)]
    for _ in range(1, min(buckets, size)):
        new, at = best.copy(), np.full(size, -1, np.int64)
        for j in range(1, size):
            # the last bucket holds lengths i + 1 .. j
            total = best[:j] + lengths[j] * (n[j + 1] - n[1 : j + 1]) - (m[j + 1] - m[1 : j + 1])
            i = int(total.argmin())
            if total[i] < new[j]:
                new[j], at[j] = total[i], i
        best = new
        cuts.append(at)
    out, j, k = [], size - 1, len(cuts) - 1
    while True:
        out.append(int(lengths[j]))
        while k > 0 and cuts[k][j] < 0:
            k -= 1
        if k == 0:
            return out[::-1]
        j, k = int(cuts[k][j]), k - 1


PIECES = "doc_id long, piece int, n_tokens int, char_start long, char_end long, text string"


def cuts(starts: np.ndarray, ends: np.ndarray, max_length: int) -> list[int]:
    """First token of each piece, and the number of tokens: at most max_length tokens a piece, cut between characters where max_length spans one."""
    out, n = [0], len(starts)
    while n - out[-1] > max_length:
        at = out[-1] + max_length
        while at > out[-1] + 1 and starts[at] < ends[at - 1]:
            at -= 1
        out.append(at if starts[at] >= ends[at - 1] else out[-1] + max_length)
    return [*out, n]


def pieces(docs: DataFrame, max_length: int = MAX_LENGTH, token_pattern: str = r"\S+", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, n_tokens, char_start, char_end, text): each document in pieces of at most max_length tokens; no tokens (or null): one piece of 0.

    Tokens are those of the byte-level BPE of the vocabulary file, or without one the matches of token_pattern.
    A document's pieces joined in order are its text: what stands between two tokens belongs to the piece before it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary)) if vocabulary else None  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pattern = Encoder(shared.value) if shared else None, re.compile(token_pattern)
        for b in (x for batch in batches for x in slices(batch, 1)):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if encoder:
                    starts, ends = encoder.spans(text or "")
                else:
                    starts, ends = np.array([m.span() for m in pattern.finditer(text or "")], np.int64).reshape(-1, 2).T
                at = cuts(starts, ends, max_length)
                chars = [0, *starts[at[1:-1]].tolist(), len(text or "")]
                for k in range(len(at) - 1):
                    rows.append((doc, k, at[k + 1] - at[k], chars[k], chars[k + 1], None if text is None else text[chars[k] : chars[k + 1]]))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "n_tokens", "char_start", "char_end", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, token_pattern: str = r"\S+", vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, char_start, char_end, text, bucket, padded_length, batch, slot.

    A batch is (bucket, batch): consecutive pieces of a bucket in hash order, as many as fit in budget at the
    bucket's padded length (one at least); only a bucket's last batch may be short. Rows are numbered in hash
    cells of doc_id, piece and text, so no task holds a bucket or all rows without a doc_id. Repeated rows are pieces of their own, an empty table gives no rows.
    """
    spark = docs.sparkSession
    table = cut(pieces(docs, max_length, token_pattern, vocabulary))
    histogram = {r[0]: r[1] for r in table.groupBy("n_tokens").count().collect()}  # max_length + 1 rows at most
    tops = boundaries(histogram, buckets) or [max_length]
    place = F.lit(len(tops) - 1)
    for k in reversed(range(len(tops) - 1)):
        place = F.when(F.col("n_tokens") <= tops[k], k).otherwise(place)
    cells = min(CELLS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = table.withColumn("bucket", place).withColumn("hash", F.xxhash64("doc_id", "piece", "text")).withColumn("cell", F.pmod("hash", F.lit(cells)).cast("int"))
    sizes = placed.groupBy("bucket", "cell").count()
    before = F.sum("count").over(Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("bucket", "cell", F.coalesce(before, F.lit(0)).alias("before"))  # buckets x cells rows at most
    order = Window.partitionBy("bucket", "cell").orderBy("hash", "doc_id", "piece", "n_tokens", "text")
    numbered = placed.withColumn("number", F.row_number().over(order)).join(F.broadcast(offsets), ["bucket", "cell"])
    top = F.get(F.array(*map(F.lit, tops)), F.col("bucket"))
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(top, F.lit(1))))
    at = F.col("before") + F.col("number") - 1
    return numbered.select("doc_id", "piece", "n_tokens", "char_start", "char_end", "text", "bucket", top.alias("padded_length"), F.floor(at / fit).cast("long").alias("batch"), F.pmod(at, fit).cast("long").alias("slot"))

"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Everything is a Catalyst expression over one row: shingles are hashed once, the sorted hashes
give the least value of each bin, empty bins borrow from the first bin of their own random
probing order that is filled, and the low-order bits are packed as hexadecimal digits.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORDS_PER_SHINGLE = 5
#: Bins, a power of two.
BINS = 128
#: Low-order bits kept of each bin, a multiple of four.
BITS = 8
#: doc_id ranges in which each row is set beside the next: four for each shuffle partition at least, and one for each of these bytes of the table's size.
RANGE_BYTES = 64 << 20


def shingle_words(text: Column) -> Column:
    """Words of a text: lower case, between ASCII white space; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """Hash of each run of 5 word hashes, repeats included; fewer words: one run of all, none: none."""
    n = F.size(words)
    run = F.transform(F.sequence(F.lit(0), F.greatest(n - WORDS_PER_SHINGLE, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS_PER_SHINGLE)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(run)


def bin_of(h: Column) -> Column:
    """Bin of a hash, 0 to BINS - 1, in the order of signed hashes."""
    return F.shiftright(h, 64 - (BINS.bit_length() - 1)).cast("int") + BINS // 2


def least_of_bins(ordered: Column) -> Column:
    """The least hash of each filled bin, in bin order, of sorted hashes (the bin is the hash's leading bits)."""
    return F.filter(ordered, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(ordered, i - 1))))


def densified(least: Column) -> Column:
    """BINS values: a filled bin's own, an empty bin's that of the first filled bin in its own random order."""

    def value(own: Column, j: Column) -> Column:
        first = F.array_min(F.transform(least, lambda x: F.struct(F.xxhash64(j, bin_of(x)).alias("rank"), x.alias("x"))))
        return F.coalesce(own, first["x"])

    none, size = F.lit(None).cast("bigint"), F.size(least)
    after = F.transform(least, lambda x, i: F.concat(F.array(x), F.array_repeat(none, F.when(i + 1 == size, F.lit(BINS)).otherwise(bin_of(F.get(least, i + 1))) - bin_of(x) - 1)))
    slots = F.concat(F.array_repeat(none, bin_of(F.get(least, F.lit(0)))), F.flatten(after))
    return F.transform(slots, value)


def packed(values: Column) -> Column:
    """Low-order BITS of each value as hexadecimal digits; no values at all: the empty string."""
    digits = BITS // 4
    return F.array_join(F.transform(values, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit((1 << BITS) - 1))), digits, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, corrected for chance agreement of BITS bits; 0 to 1.

    Two empty fingerprints are alike (1), an empty and another are not (0).
    """
    digits, chance = BITS // 4, 2.0**-BITS
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substr(a, i * digits + 1, F.lit(digits)) == F.substr(b, i * digits + 1, F.lit(digits))))
    share = (equal / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.greatest(F.lit(0.0), share))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the packed fingerprint of column text as column out; '' where the text has no words.

    Each step is read from a generated one-row array, which keeps the optimiser from repeating it in the next.
    """

    def let(frame: DataFrame, name: str, value: Column) -> DataFrame:
        return frame.withColumn(name, F.explode(F.array(value)))

    names = [f"__fw_{out}_{k}" for k in range(3)]
    df = let(df, names[0], F.transform(shingle_words(F.col(text)), lambda w: F.xxhash64(w)))
    df = let(df, names[1], F.sort_array(shingle_hashes(F.col(names[0]))))
    df = let(df, names[2], least_of_bins(F.col(names[1])))
    return df.withColumn(out, F.when(F.size(names[2]) == 0, "").otherwise(packed(densified(F.col(names[2]))))).drop(*names)


def _key(c: str = "doc_id") -> Column:
    return F.coalesce(F.col(c), F.lit(-(1 << 63)))


def _range_of(key: Column, table: Column, n: int) -> Column:
    """Number of the range of a key, by binary search in the constant array of the n ranges' upper ends: the first that is not below it."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda lo, step: F.when((lo + step <= n) & (F.get(table, lo + step - 1) < key), lo + step).otherwise(lo))


def with_next(base: DataFrame, finish: Callable[[DataFrame], DataFrame], columns: dict[str, str]) -> DataFrame:
    """finish(base), each row with columns of the next row, descending doc_id (null last, ties in an order of their texts); after the last the first.

    base: doc_id and text; finish adds columns. columns: a column's name -> its name as the next row's. Rows are dealt by ranges
    of doc_id whose upper ends are ids of the table, so the first row of a range is known and a copy of it closes the range
    before. A doc_id that fills several ranges (or null ids that do) has as many, by hash of the text, each closed by the first
    row of the next. One shuffle; no task sees more than a range, unless rows agree in doc_id and text.
    """
    leaves = base._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))  # of files; about 2 ** 63 where it isn't known
    n = max(1, 4 * int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES if size < 1 << 60 else 0)
    found, top = base.select("doc_id").agg(F.percentile_approx(_key(), [k / n for k in range(1, n + 1)], 20 * n), F.max(_key())).first()  # one number a range
    times = Counter(found or [])
    ends = sorted({*times, *([top] if top is not None else [])}) or [0]
    hot = [k for k in ends if times[k] > 1]
    table, parts = _constant(ends), _constant([max(1, times[k]) for k in ends])
    keyed = base.withColumn("__fw_key", _key()).withColumn("__fw_end", F.explode(F.array(_range_of(F.col("__fw_key"), table, len(ends)))))
    at_end = F.get(table, F.col("__fw_end")) == F.col("__fw_key")

    def part(of: Column) -> Column:
        return F.when(at_end & (F.get(of, F.col("__fw_end")) > 1), F.pmod(F.xxhash64("text"), F.get(of, F.col("__fw_end")))).otherwise(F.lit(0)).cast("int")

    heads = None
    if hot:
        heads = cut(keyed.where(F.col("__fw_key").isin(hot)).groupBy("__fw_end", part(parts).alias("part")).agg(F.min("text").alias("text")))
        seen = Counter(r[0] for r in heads.select("__fw_end").collect())  # one number a range
        spread = {k for k, end in enumerate(ends) if times[end] > 1 and seen[k] == times[end]}  # a part without rows has no first row: such an id stays whole
        sizes = [times[end] if k in spread else 1 for k, end in enumerate(ends)]
        heads = heads.where(F.col("__fw_end").isin(list(spread)))
    else:
        sizes = [1] * len(ends)
    begins, parts, total = _constant([0, *accumulate(sizes)][:-1]), _constant(sizes), sum(sizes)
    own = F.get(begins, F.col("__fw_end"))

    def place(r: Column, copy: int) -> Column:
        return F.struct(F.pmod(r + copy, F.lit(total)).cast("int").alias("r"), F.lit(copy).alias("copy"))

    here = own + part(parts)
    known = at_end & (F.get(parts, F.col("__fw_end")) == 1)
    dealt = finish(keyed.withColumn("__fw_at", F.when(known, F.array(place(here, 0), place(here, 1))).otherwise(F.array(place(here, 0)))))
    dealt = dealt.withColumn("__fw_at", F.explode("__fw_at"))
    if heads is not None:
        first = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.get(table, F.col("__fw_end")).alias("__fw_key"), "__fw_end", F.array(place(own + F.col("part"), 1)).alias("__fw_at"))
        dealt = dealt.unionByName(finish(first).withColumn("__fw_at", F.explode("__fw_at")))
    order = Window.partitionBy("__fw_at.r").orderBy("__fw_at.copy", F.col("__fw_key").desc(), "text")
    return dealt.select("*", *[F.lead(c).over(order).alias(name) for c, name in columns.items()]).where("__fw_at.copy = 0").drop("__fw_at", "__fw_end", "__fw_key")


def _constant(numbers: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(numbers)), "array<bigint>")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: its last half replaced by the opening of the next document.

    Null texts count as empty. A text without words has the fingerprint '' (like itself, unlike any other).
    Rows of one doc_id follow each other; a null doc_id comes last; an empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = with_next(base, lambda rows: with_fingerprint(rows, "text", "fingerprint"), {"text": "next_text", "fingerprint": "next_fingerprint"})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = (
        both.withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", F.explode(F.array(F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr("next_text", F.lit(1), half)))))
        .select("doc_id", "n_chars", "edited", "fingerprint", "next_fingerprint")
    )
    found = with_fingerprint(edited, "edited", "edited_fingerprint")
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )

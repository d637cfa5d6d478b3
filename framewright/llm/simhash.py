"""SimHash near-duplicates: 64-bit fingerprints, tiled exact comparison, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, part_of, slices, with_least

#: Differing bits up to which fingerprints link.
RADIUS = 2
WORDS_PER_SHINGLE = 3
SEED = 42
#: Fingerprints in one side of a compared tile pair.
TILE = 512
#: Fingerprints fall into blocks of bits; those within the radius agree on all but RADIUS blocks.
BLOCKS = 8
#: Groups of at most this size are compared many at once, row by row of the sorted stream.
SMALL = 32
#: Rows to drop up to which their ids are broadcast.
BROADCAST_IDS = 1_000_000


def fingerprint(text: str | None) -> int:
    """Unsigned SimHash of a text. Null and texts without words: 0."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not raw:
        return 0
    joined, ends, at = b" ".join(raw), [], -1
    for word in raw:
        at += len(word) + 1
        ends.append(at)
    k = min(WORDS_PER_SHINGLE, len(raw))
    starts = [0, *[e + 1 for e in ends[: len(raw) - k]]]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :], strict=True)), "<u8", len(starts))
    set_in = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, 1)):
            found = [fingerprint(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, "<u8").view("<i8"))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Tiles:
    """Exact comparison by exclusive-or and bit counts. skipped and compared count tile pairs."""

    def __init__(self, radius: int = RADIUS, tile: int = TILE):
        self.radius, self.tile, self.skipped, self.compared = radius, tile, 0, 0

    def links(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links among distinct uint64 values as a forest: (member, least value joined to it).

        Values are ordered by population count and cut into tiles; a tile pair whose counts lie
        more than radius apart is skipped, any other is compared.
        """
        ones = np.bitwise_count(values).astype(np.int16)
        order = np.lexsort((values, ones))
        v, ones, n, tile = values[order], ones[order], len(values), self.tile
        label = np.arange(n)
        for i in range(0, n, tile):
            for j in range(i, n, tile):
                if ones[j] - ones[min(i + tile, n) - 1] > self.radius:
                    self.skipped += -(-(n - j) // tile)
                    break
                self.compared += 1
                x, y = np.nonzero(np.bitwise_count(v[i : i + tile, None] ^ v[None, j : j + tile]) <= self.radius)
                self._join(label, x[x + i < y + j] + i, y[x + i < y + j] + j)
        moved = label != np.arange(n)
        return v[moved], v[label[moved]]

    @staticmethod
    def _join(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """Give the ends of each link, and all that share their labels, the lesser label."""
        while len(x):
            a, b = label[x], label[y]
            least = np.minimum(a, b)
            if (a == b).all():
                return
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            while (label != label[label]).any():
                label[:] = label[label]

    def groups(self, key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links inside runs of equal keys. Runs of up to SMALL values are compared together: each value with the next,
        the second next, and so on; larger runs by tiles."""
        begin = np.nonzero(np.append(True, key[1:] != key[:-1]))[0] if len(key) else np.empty(0, np.int64)
        size = np.diff(np.append(begin, len(key)))
        out_a, out_b = [np.empty(0, "<u8")], [np.empty(0, "<u8")]
        small = np.repeat(size <= SMALL, size)
        k, v = key[small], values[small]
        for gap in range(1, SMALL):
            same = np.nonzero(k[gap:] == k[:-gap])[0] if len(k) > gap else ()
            if not len(same):
                break
            near = same[np.bitwise_count(v[same] ^ v[same + gap]) <= self.radius]
            out_a.append(v[near])
            out_b.append(v[near + gap])
        for i, n in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            x, y = self.links(values[i : i + n])
            out_a.append(x)
            out_b.append(y)
        return np.concatenate(out_a), np.concatenate(out_b)


def cell_masks(radius: int = RADIUS) -> list[int]:
    """For each choice of radius blocks, the bits of all other blocks."""
    bits, full = 64 // BLOCKS, (1 << 64) - 1
    return [full ^ sum(((1 << bits) - 1) << (bits * k) for k in left_out) for left_out in combinations(range(BLOCKS), radius)]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) that join exactly what is within radius.

    Two fingerprints within the radius differ in at most radius of the BLOCKS blocks of bits, so each fingerprint enters
    one cell per choice of radius blocks, by all its other bits, and only cells are compared. The bits left out are
    64 / BLOCKS * radius (16 for radius 2), so a cell holds 65,536 distinct fingerprints at most, however many rows there are:
    no cell is too large for a task, and none takes another way. A task reads its cells in order and holds one at a time.
    """
    masks = cell_masks(radius)
    signed = np.array(masks, "<u8").view("<i8")
    cells = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(int(m))) for m in signed])).alias("cell", "key"))
    dealt = cells.repartition("cell", "key").sortWithinPartitions("cell", "key").select("cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles(radius)
        cell, fps, of = np.empty(0, np.int64), np.empty(0, "<u8"), np.array(masks, "<u8")
        for b in _and_last(batches):
            if b is not None:
                cell = np.append(cell, b.column(0).to_numpy().astype(np.int64))
                fps = np.append(fps, b.column(1).to_numpy().view("<u8"))
            key = fps & of[cell]
            run_of = np.append(0, np.cumsum((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))[: len(fps)]
            whole = len(fps) if b is None or not len(fps) else int(np.searchsorted(run_of, run_of[-1]))  # the last run may go on
            x, y = tiles.groups(run_of[:whole], fps[:whole])
            cell, fps = cell[whole:], fps[whole:]
            yield pa.RecordBatch.from_arrays([pa.array(o.view("<i8")) for o in (x, y)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most RADIUS differing bits.
    Null and empty texts have fingerprint zero and link like any other; repeated rows
    give repeated rows; a row with a null doc_id takes the component of its fingerprint, whose id
    is null if no member has one. An empty table gives no rows. Other columns are not read.
    Copies of one text, however many, are dealt into parts by doc_id before they meet their component.
    """
    prints = cut(fingerprints(docs, id_col, text_col)).withColumn("__fw_part", part_of("doc_id"))
    parts = prints.groupBy("fp", "__fw_part").agg(F.min("doc_id").alias("least"))
    reps = parts.groupBy("fp").agg(F.min("least").alias("least"))
    roots = cut(components(links(reps.select("fp"))))
    placed = reps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = with_least(placed, "root", "least", "component_id").select("fp", "component_id")
    return prints.join(parts.select("fp", "__fw_part").join(named, "fp"), ["fp", "__fw_part"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, one for each group: that with the smallest doc_id.

    Repeated rows of one doc_id leave one row. Rows without a doc_id can't be named and stay. Only the ids of rows to
    drop meet the texts: broadcast if they are at most BROADCAST_IDS, else by a shuffled anti-join.
    """
    marked = near_duplicates(docs.where("doc_id is not null"))
    ids = cut(marked.groupBy(F.col("doc_id").alias("__fw_id")).agg(F.count("*").alias("n"), F.min("component_id").alias("least")).where("n > 1 or __fw_id <> least"))
    dropped, again = ids.where("__fw_id <> least").select("__fw_id"), ids.where("__fw_id = least").select("__fw_id")

    def meet(rows: DataFrame, found: DataFrame, n: int, how: str) -> DataFrame:
        return rows.join(F.broadcast(found) if n <= BROADCAST_IDS else found.hint("shuffle_merge"), rows["doc_id"].cast("long") == found["__fw_id"], how)

    n_dropped, n_again = ids.agg(F.count_if(F.expr("__fw_id <> least")), F.count_if(F.expr("__fw_id = least"))).first()
    rows = meet(docs, dropped, n_dropped, "left_anti") if n_dropped else docs
    if not n_again:
        return rows
    return meet(rows, again, n_again, "left_anti").unionByName(meet(rows, again, n_again, "left_semi").dropDuplicates(["doc_id"]))

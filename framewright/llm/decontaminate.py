"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit distance.

The CGK walk reads a text with a pointer that stays or steps on by a random bit that depends on the step and
the character read, so texts at a small edit distance give outputs at a small Hamming distance. Walks read texts
without their spaces, so added or missing blanks don't matter, and open at every character: the pair of characters
there says in which repetition. Each repetition samples its walk's output into a key, as short as the benchmark's
own texts allow, MOST_SAMPLES at most, so that the recall aimed at holds for every size of the benchmark. An item-sized window
of a document is a candidate when walks from two places of it collide with walks from two places of an item that lie as far apart.
Candidates are verified by edit distance: first a lower bound over the item's pieces of up to 64 characters, many
candidates at once, then exactly. Short items are not sampled: where one of their pieces occurs they are verified, so none is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Edit similarity (1 - distance / item length) from which a passage counts as the item.
SIMILARITY = 0.8
#: Repetitions; each opens at the character pairs of its class, so that each character opens a walk in one of them.
REPETITIONS = 4
#: Samples of a key: as many as leave, for a walk of the benchmark, this many collisions with other walks of it that more samples would tell apart.
MOST_SAMPLES, COLLISIONS = 12, 0.25
#: Two collisions count together if they lie this far apart in the item, and their shifts differ no more than this.
APART, DRIFT = 4, 12
#: Candidates of one item whose shifts fall in the same run of this many characters are verified once.
BAND = 16
#: Items of fewer normalised characters are cut in one piece more than edits allowed: a match holds one of the pieces unchanged.
SHORT_ITEM = 64
#: Items of fewer normalised characters count only as whole words, where their script puts spaces between words.
WHOLE_WORDS = 32
#: A block of the benchmark, of which one pass over the documents takes care.
BLOCK_ITEMS, BLOCK_CHARS = 5_000, 4_000_000
#: Characters of documents that are walked at once, and candidates whose distance is bounded at once.
CHUNK, TOGETHER = 1 << 18, 4096
#: Characters whose collisions are held at once, for each 200 items of a block, and no fewer than CHUNK: what a worker holds doesn't grow with texts or blocks.
SEGMENT = 1 << 21
_BITMAP = 21
#: Samples are kept as a polynomial of this odd number, modulo 2 ** 64.
_ODD = np.int64(-7046029254386353131)
#: The code of no character, around all texts.
_NONE = 64


def normalise(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _codes(points: np.ndarray, pad: int = 0) -> np.ndarray:
    """Codes 0 to 63 of code points, followed by pad codes of no character."""
    out = np.full(len(points) + pad, _NONE, np.uint8)
    out[: len(points)] = (points ^ (points >> 6) * 7) & 63
    return out


def edit_distance(item: str, region: str) -> tuple[int, int]:
    """Least edit distance of the item to any part of the region, and where that part ends (bit-parallel)."""
    m = len(item)
    if (at := region.find(item)) >= 0:
        return 0, at + m
    peq: dict[str, int] = {}
    for i, ch in enumerate(item):
        peq[ch] = peq.get(ch, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, ch in enumerate(region):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Pieces:
    """Patterns of at most 64 codes, sought in many places at once: a bit-parallel edit distance, one machine word a place."""

    def __init__(self, patterns: list[np.ndarray]):
        self.size = np.array([len(p) for p in patterns], np.int64)
        self.masks = np.zeros((len(patterns), _NONE + 1), np.uint64)
        for k, p in enumerate(patterns):
            np.bitwise_or.at(self.masks[k], p, np.uint64(1) << np.arange(len(p), dtype=np.uint64))

    def least(self, codes: np.ndarray, pattern: np.ndarray, begin: np.ndarray, steps: int) -> np.ndarray:
        """Least edit distance of each pattern to any part of codes[begin : begin + steps]; places outside hold no character."""
        masks, last = self.masks.ravel(), len(codes)
        codes = np.append(codes, np.uint8(_NONE))
        out = np.empty(len(pattern), np.int64)
        for i in range(0, len(pattern), TOGETHER):
            at, own = begin[i : i + TOGETHER].copy(), pattern[i : i + TOGETHER]
            base, high = own * (_NONE + 1), (self.size[own] - 1).astype(np.uint64)
            score = self.size[own].copy()
            best = score.copy()
            pv, mv, one = np.full(len(own), ~np.uint64(0)), np.zeros(len(own), np.uint64), np.uint64(1)
            for _ in range(steps):
                eq = masks.take(base + codes.take(np.where((at >= 0) & (at < last), at, last)))
                at += 1
                xv = eq | mv
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                score += ((ph >> high) & one).view(np.int64)
                score -= ((mh >> high) & one).view(np.int64)
                np.minimum(best, score, out=best)
                ph, mh = ph << one, mh << one
                pv, mv = mh | ~(xv | ph), ph & xv
            out[i : i + TOGETHER] = best
        return out


_OTHER = re.compile(r"[\W_]")
_UNSPACED = re.compile("[฀-໿က-႟ក-៿⺀-꓏豈-﫿\U00020000-\U0003ffff]")


def as_words(item: str) -> str:
    """The item with a space for each mark, and at each end that must be a word end."""
    return (" " * (not _UNSPACED.match(item[0])) + _OTHER.sub(" ", item) + " " * (not _UNSPACED.match(item[-1]))) if item else item


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), then those of first[1], and so on."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


class Index:
    """Samples of one block of benchmark items; items with one normalised text are one."""

    def __init__(self, items: list[tuple[int, str]], seed: int = 42, similarity: float = SIMILARITY):
        self.similarity = similarity
        rng = np.random.default_rng(seed)
        by_text: dict[str, list[int]] = {}
        for i, t in items:
            if n := normalise(t):
                by_text.setdefault(n, []).append(i)
        self.items = [(ids, n) for n, ids in by_text.items()]
        self.most = np.array([int((1 - similarity) * len(n) + 1e-9) for _, n in self.items], np.int64)
        self.short = [k for k, (_, n) in enumerate(self.items) if len(n) < SHORT_ITEM]
        self.grams = [self._pieces(q) for q in (1, 2, 4)]
        self.whole = Pieces([_codes(_points(n)) if len(n) < SHORT_ITEM else np.empty(0, np.uint8) for _, n in self.items])
        bare = [c[_points(n) != 32] if len(n) >= SHORT_ITEM else np.empty(0, np.uint8) for _, n in self.items for c in (_codes(_points(n)),)]
        self.bare = np.array([len(b) for b in bare], np.int64)
        parts = [np.array_split(b, -(-len(b) // 64)) if len(b) else [] for b in bare]
        self.n_parts = np.array([len(p) for p in parts], np.int64)
        self.first_part = np.cumsum(self.n_parts) - self.n_parts
        self.parts = Pieces([x for p in parts for x in p])
        self.part_at = np.array([a for p in parts for a in np.cumsum([0, *map(len, p)])[:-1]], np.int64)
        # a character's number in a repetition holds its walk's random bits (by step) and stands for it in keys
        self.numbers = rng.integers(0, 1 << 63, (REPETITIONS, _NONE + 1), dtype=np.int64)
        self.opens = rng.permutation(np.arange((_NONE + 1) ** 2) % REPETITIONS).astype(np.uint8)
        self.steps = np.cumsum(rng.integers(1, 4, (REPETITIONS, MOST_SAMPLES)), axis=1) - 1  # of the samples
        starts = np.cumsum(self.bare + 1) - self.bare - 1
        codes = np.full(int((self.bare + 1).sum()), _NONE, np.uint8)
        for a, b in zip(starts.tolist(), bare, strict=True):
            codes[a : a + len(b)] = b
        owner = np.repeat(np.arange(len(self.items)), self.bare + 1)
        self.depth, self.tables, self.bitmaps = [], [], []
        for r in range(REPETITIONS):
            at = self._openings(codes, r)
            at = at[codes[at] != _NONE]
            keys, loads = [], []
            for key in self._walk(codes, at, r, MOST_SAMPLES):
                keys.append(key.copy())
                n = np.unique(key, return_counts=True)[1].astype(np.float64)
                loads.append((n * (n - 1)).sum() / max(len(key), 1))
            depth = next(k for k, x in enumerate(loads) if x - loads[-1] <= COLLISIONS)
            order = np.argsort(keys[depth], kind="stable")
            bits = np.zeros(1 << _BITMAP, bool)
            bits[self._slot(keys[depth])] = True
            self.depth.append(depth + 1)
            self.tables.append((keys[depth][order], owner[at[order]], (at - starts[owner[at]])[order]))
            self.bitmaps.append(np.packbits(bits))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_open"}

    def open(self) -> list[np.ndarray]:
        if "_open" not in self.__dict__:
            self._open = [np.unpackbits(b).view(bool) for b in self.bitmaps]
        return self._open

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITMAP)

    def _openings(self, codes: np.ndarray, r: int) -> np.ndarray:
        """Where walks of repetition r open."""
        after = np.append(codes[1:], np.uint8(_NONE))
        return np.nonzero(self.opens.take(codes.astype(np.int16) * (_NONE + 1) + after) == r)[0]

    def _walk(self, codes: np.ndarray, starts: np.ndarray, r: int, samples: int) -> Iterator[np.ndarray]:
        """The keys of walks from starts after each sample, in one array that goes on changing."""
        reach = int(self.steps[r][-1]) + 2
        numbers = self.numbers[r].take(np.append(codes, np.full(reach, _NONE, np.uint8)))
        at, key, step = starts.copy(), np.zeros(len(starts), np.int64), 0
        for sampled in self.steps[r][:samples].tolist():
            while True:
                read = numbers.take(at)
                if step == sampled:
                    key *= _ODD
                    key += read
                read >>= step
                read &= 1
                at += read
                step += 1
                if step > sampled:
                    break
            yield key

    def _pieces(self, q: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """q, and sorted openings of q characters of the short items' pieces with their items and offsets; each piece has one q at most its length."""
        rows = []
        for k in self.short:
            n = self.items[k][1]
            parts = int(self.most[k]) + 1
            least = len(n) // parts
            if (4 if least >= 4 else 2 if least >= 2 else 1) == q:
                codes = _codes(_points(n))
                rows += [(self._gram(codes[o : o + q], q)[0], k, o) for o in sorted({p * len(n) // parts for p in range(parts)})]
        e = np.array(sorted(rows), np.int64).reshape(-1, 3)
        return q, e[:, 0], e[:, 1], e[:, 2]

    @staticmethod
    def _gram(codes: np.ndarray, q: int) -> np.ndarray:
        n = len(codes) - q + 1
        out = np.zeros(max(n, 0), np.int32)
        for j in range(q if n > 0 else 0):
            out = out * 64 + codes[j : j + n]
        return out

    def short_candidates(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(where a short item may stand, item, its start there) near each of its pieces that occurs, in runs; all texts.

        Only places whose distance, over codes, allows a match are left."""
        for q, grams, items, offsets in self.grams:
            if not len(grams):
                continue
            known = np.zeros(64**q, bool)
            known[grams] = True
            for i in range(0, len(codes), CHUNK):
                seen = self._gram(codes[i : i + CHUNK + q - 1], q)
                at = np.nonzero(known[seen])[0]
                lo, hi = np.searchsorted(grams, seen[at]), np.searchsorted(grams, seen[at], "right")
                e = _ranges(lo, hi - lo)
                at, item = np.repeat(at + i, hi - lo), items[e]
                band = (at - offsets[e]) // BAND
                once = np.unique((item << np.int64(40)) + band + 16, return_index=True)[1]
                at, item, band = at[once], item[once], band[once]
                most = self.most[item]
                near = self.whole.least(codes, item, band * BAND - most, int(BAND + SHORT_ITEM + 2 * most.max())) <= most if len(item) else np.empty(0, bool)
                yield at[near], item[near], band[near] * BAND

    def collisions(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, offset in it) of all walks over texts without spaces whose keys occur in the benchmark."""
        out = [(np.empty(0, np.int64),) * 3]
        for r, bits in enumerate(self.open()):
            keys, items, offsets = self.tables[r]
            if not len(keys):
                continue
            reach = int(self.steps[r][-1]) + 2
            for i in range(0, len(codes), CHUNK):
                part = codes[i : i + CHUNK + reach]
                starts = self._openings(part, r)
                starts = starts[starts < CHUNK]
                key = None
                for key in self._walk(part, starts, r, self.depth[r]):
                    pass
                on = np.nonzero(bits[self._slot(key)])[0]
                lo, hi = np.searchsorted(keys, key[on]), np.searchsorted(keys, key[on], "right")
                e = _ranges(lo, hi - lo)
                out.append((np.repeat(starts[on] + i, hi - lo), items[e], offsets[e]))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def segments(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Runs of the codes that overlap by more than an item-sized window and a walk, each with its place."""
        size = max(CHUNK, SEGMENT * 200 // max(200, len(self.items)))
        overlap = int(self.bare.max()) + DRIFT + int(self.steps.max()) + 2
        for i in range(0, len(codes), size):
            yield i, codes[i : i + size + overlap]

    def windows(self, codes: np.ndarray, base: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a place in it, item, band of its start) of item-sized windows with two collisions APART and of like shift; base is the place of the codes."""
        place, item, offset = self.collisions(codes)
        place = place + base
        shift = place - offset
        by = item * np.int64(1 << 40) + (shift + (1 << 20))
        order = np.lexsort((place, by))
        by, place, item, shift = by[order], place[order], item[order], shift[order]
        found = []
        for gap in range(1, REPETITIONS + 1):
            apart = np.abs(place[gap:] - place[:-gap])
            found.append(np.nonzero((by[gap:] - by[:-gap] <= DRIFT) & (apart >= APART) & (apart <= self.bare[item[gap:]]))[0] + gap)
        x = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return place[x], item[x], shift[x] // BAND

    def bounded(self, codes: np.ndarray, item: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether the sum of the least distances of the item's parts to the window's parts allows a match."""
        total, most = np.zeros(len(item), np.int64), self.most[item]
        for p in range(int(self.n_parts[item].max()) if len(item) else 0):
            live = np.nonzero((total <= most) & (self.n_parts[item] > p))[0]
            live = live[np.argsort(most[live], kind="stable")]
            for i in range(0, len(live), TOGETHER):
                some = live[i : i + TOGETHER]
                part, slack = self.first_part[item[some]] + p, int(most[some].max())
                total[some] += self.parts.least(codes, part, band[some] * BAND + self.part_at[part] - slack, BAND + 64 + 2 * slack)
        return total <= most

    def matches(self, texts: list[str | None], similarity: float) -> list[dict[int, tuple[int, int]]]:
        """For each text, item position -> (least distance found, where the passage ends in the normalised text)."""
        norm = [normalise(t) for t in texts]
        found: list[dict[int, tuple[int, int]]] = [{} for _ in norm]
        if not self.items or not any(norm):
            return found
        lengths = np.array([len(n) for n in norm], np.int64)
        bases = np.cumsum(lengths + 1) - lengths - 1
        points = _points(" ".join(norm))
        regions: dict[tuple[int, int, int, int], None] = {}  # text, item, and where it may stand
        if len(self.short) < len(self.items):
            stands = np.nonzero(points != 32)[0]
            codes = _codes(points[stands])
            begins = np.searchsorted(stands, bases)
            place, item, band = map(np.concatenate, zip(*(self.windows(part, at) for at, part in self.segments(codes)), strict=True)) if len(codes) else (np.empty(0, np.int64),) * 3
            doc = np.searchsorted(begins, place, "right") - 1
            _, once = np.unique(np.stack([doc, item, band]), axis=1, return_index=True) if len(doc) else (None, np.empty(0, np.int64))
            doc, item, band = doc[once], item[once], band[once]
            near = np.nonzero(self.bounded(codes, item, band))[0]
            stops = np.append(begins[1:], len(stands))
            for d, k, b in zip(doc[near].tolist(), item[near].tolist(), band[near].tolist(), strict=True):
                most = int(self.most[k])
                lo, hi = max(b * BAND - most, int(begins[d])), min((b + 1) * BAND + int(self.bare[k]) + most, int(stops[d]))
                if lo < hi:
                    regions[d, k, int(stands[lo] - bases[d]), int(stands[hi - 1] + 1 - bases[d])] = None
        if self.short:
            for at, item, begin in self.short_candidates(_codes(points)):
                doc = np.searchsorted(bases, at, "right") - 1
                for d, k, b in zip(doc.tolist(), item.tolist(), (begin - bases[doc]).tolist(), strict=True):
                    most = int(self.most[k])
                    regions[d, k, max(0, b - most), max(0, b + BAND + len(self.items[k][1]) + most)] = None
        for d, k, lo, hi in regions:
            item = self.items[k][1]
            most = int((1 - similarity) * len(item) + 1e-9)
            if found[d].get(k, (1,))[0] == 0:
                continue
            region = norm[d][lo:hi]
            if len(item) < WHOLE_WORDS:
                lo, region = max(0, lo - 1), norm[d][max(0, lo - 1) : hi + 1]
                front, tail = " " * (lo == 0), " " * (lo + len(region) == len(norm[d]))
                if edit_distance(as_words(item), front + _OTHER.sub(" ", region) + tail)[0] > most:
                    continue
            best, end = edit_distance(item, region)
            if best <= most and best < found[d].get(k, (most + 1,))[0]:
                found[d][k] = (best, lo + end)
        return found


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size, one at a time on the driver. Null and blank items are left out."""
    block, chars = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        block.append((row[0], row[1]))
        chars += len(row[1])
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


MATCH_SCHEMA = "doc_id long, item_id long, distance int, item_chars int, passage_end long, similarity double"


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document row and item that it contains: the closest passage found.

    passage_end counts characters of the normalised text (lower case, white space runs as one space).
    Null and empty texts contain nothing; an empty benchmark gives no rows; repeated documents and items
    are reported each; a null doc_id or item_id is carried.
    """
    out = None
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, similarity=similarity))  # BLOCK_ITEMS and BLOCK_CHARS bound it

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in (x for batch in batches for x in slices(batch, 1)):
                ids, rows = b.column(0).to_pylist(), []
                for doc, found in zip(ids, index.matches(b.column(1).to_pylist(), similarity), strict=True):
                    for k, (distance, end) in sorted(found.items()):
                        item_ids, item = index.items[k]
                        rows += [(doc, i, distance, len(item), end, 1 - distance / len(item)) for i in item_ids]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "distance", "item_chars", "passage_end", "similarity"])

        one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, MATCH_SCHEMA)
        out = one if out is None else out.union(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], MATCH_SCHEMA)


def without_matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, whose text contains no benchmark item. No shuffle: rows are filtered in place."""
    at = docs.columns.index("text")
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, similarity=similarity))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in (x for batch in batches for x in slices(batch, at)):
                yield b.filter(pa.array([not m for m in shared.value.matches(b.column(at).to_pylist(), similarity)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

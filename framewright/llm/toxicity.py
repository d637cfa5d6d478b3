"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

A token that may be disguised (leetspeak, marks between letters, repeated letters), and a run of very short tokens
with the blanks between them, becomes a lattice of readings per character: a letter that it stands for, nothing, or the
end of a word. Viterbi decoding under a character trigram model of the whole corpus picks the restored words, so
the model says where spaced letters join and where words end. The classifier counts restored words, their openings and openings
that several words of a document share in a bounded sample of labelled documents and maps a document's strongest
evidence to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: Labelled documents the classifier is fitted on at most, the first by hash of doc_id.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
#: Training documents a feature needs, and the likelihood ratio (natural log, times two) it must reach.
MIN_DOCS, MIN_G2 = 3, 15.0
#: Evidence counts this many strongest distinct words.
TOP = 5
#: Lengths of the word openings that are features beside the word itself.
OPENINGS = (4, 5)
#: Words kept in a worker's memory before the memo is emptied.
MEMO = 100_000

#: Readings of characters used for letters.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i",
}
#: Channel costs in nats.
SUBSTITUTE, SKIP_SYMBOL, SKIP_REPEAT, KEEP_SYMBOL, BREAK_AT_SYMBOL, SKIP_BLANK, BREAK_AT_BLANK = 1.0, 1.5, 0.2, 12.0, 1.5, 0.7, 0.7
#: Runs of at least this many tokens of at most so many characters are read as one lattice, blanks included.
RUN_TOKENS, RUN_CHARS = 3, 2

CLASSES = 64
EDGE = 0
_EDGE_MARKS = ".,;:?\"'()[]{}<>|/\\…«»“”„‘’–—-_"
_RUN = re.compile(r"^([#*$%&!@+~^=])\1+|([#*$%&!@+~^=])\2+$")
_DOUBLE, _TRIPLE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")


def _class_table() -> np.ndarray:
    """Class of a code point below 65,536: 0 white space, 1-26 a-z, 27 digits, 28 marks, the rest 29-63."""
    table = (np.arange(65536) % (CLASSES - 29) + 29).astype(np.uint8)
    for cp in range(256):
        ch = chr(cp)
        table[cp] = EDGE if ch.isspace() else 27 if ch.isdigit() else 28 if not ch.isalpha() else table[cp]
    for k in range(26):
        table[ord("a") + k] = k + 1
    table[[0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = EDGE
    return table


TABLE = _class_table()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return TABLE[np.minimum(points, 65535)]


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): character-class trigrams of all texts, lower-cased; at most 64 ** 3 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for b in (x for batch in batches for x in slices(batch, 0)):
            joined = "\n\n".join(t for t in b.column(0).to_pylist() if t)
            for i in range(0, len(joined), 1 << 20):
                c = classes("\n\n" * (i == 0) + joined[max(0, i - 2) : i + (1 << 20)].lower()).astype(np.int32)
                if len(c) > 2:
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["gram", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Restorer:
    """Viterbi decoder of character lattices under a trigram model."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        n = np.zeros(CLASSES**3)
        n[grams] = counts
        n = n.reshape(CLASSES, CLASSES, CLASSES) + 0.02
        self.cost = (-np.log(n / n.sum(axis=2, keepdims=True))).tolist()
        self.memo: dict[str, str] = {}

    def word(self, token: str) -> str:
        """The restored form of a lower-case token without white space; several words have blanks between them."""
        core = token.strip(_EDGE_MARKS)
        if not core.isalpha():
            core = _RUN.sub("", core).strip(_EDGE_MARKS)
        if core.isalpha() and not _TRIPLE.search(core):
            return self._without_doubles(core)
        if not core or not any(ch.isalpha() or ch in LEET for ch in core) or core.isdigit():
            return core
        return self.decode(core)

    def _without_doubles(self, word: str) -> str:
        """What decode gives for letters none of which stands three times in a row: whether a double is read as
        one letter changes only the trigrams around it, so each is decided by itself."""
        cost, last, out = self.cost, 0, []
        for m in _DOUBLE.finditer(word):
            i = m.start()
            before, x, after = ((int(TABLE[min(ord(word[k]), 65535)]) if 0 <= k < len(word) else EDGE) for k in (i - 1, i, i + 2))
            if cost[before][x][x] + cost[x][x][after] > SKIP_REPEAT + cost[before][x][after]:
                out.append(word[last:i])
                last = i + 1
        return "".join(out) + word[last:] if out else word

    def decode(self, text: str) -> str:
        """Best reading of the text: a letter is itself, or nothing where it repeats; another character a letter, itself,
        nothing or the end of a word; a blank nothing or the end of a word. No limit on the length; linear in it."""
        return self.best(text)[1]

    def best(self, text: str) -> tuple[float, str]:
        """Cost of the best reading, and the reading."""
        cost, prev = self.cost, ""
        states: dict[tuple[int, int], tuple[float, tuple]] = {(EDGE, EDGE): (0.0, ())}  # last two classes: cost and path
        for ch in text:
            letter, blank = ch.isalpha(), ch.isspace()
            readings = [] if blank else [(ch, int(TABLE[min(ord(ch), 65535)]), 0.0 if letter else KEEP_SYMBOL)]
            readings += [(r, ord(r) - 96, SUBSTITUTE) for r in LEET.get(ch, "")]
            skip = SKIP_BLANK if blank else SKIP_REPEAT if ch == prev else None if letter else SKIP_SYMBOL
            stop = BREAK_AT_BLANK if blank else None if letter or ch.isdigit() else BREAK_AT_SYMBOL
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (p, q), (so_far, path) in states.items():
                after = cost[p][q]
                for r, c, extra in readings:
                    total = so_far + extra + after[c]
                    if (q, c) not in new or total < new[q, c][0]:
                        new[q, c] = (total, (path, r))
                if skip is not None and ((p, q) not in new or so_far + skip < new[p, q][0]):
                    new[p, q] = (so_far + skip, path)
                if stop is not None and q != EDGE:
                    total = so_far + stop + after[EDGE]
                    if (q, EDGE) not in new or total < new[q, EDGE][0]:
                        new[q, EDGE] = (total, (path, " "))
            states, prev = new, ch
        total, path = min(((so_far + (cost[p][q][EDGE] if q != EDGE else 0.0), path) for (p, q), (so_far, path) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            path, r = path
            out.append(r)
        return total, "".join(reversed(out))

    def words(self, text: str) -> set[str]:
        """Distinct restored words of a text: of its tokens, and of its runs of short tokens."""
        tokens = text.lower().split()
        memo, out = self.memo, set()
        if len(memo) > MEMO:
            memo.clear()
        for t in {*tokens, *short_runs(tokens)}:
            w = memo.get(t)
            if w is None:
                w = memo[t] = self.decode(t) if " " in t else self.word(t)
            if " " in w:
                out.update(w.split())
            else:
                out.add(w)
        out.discard("")
        return out


def short_runs(tokens: list[str]) -> list[str]:
    """Runs of RUN_TOKENS tokens or more of at most RUN_CHARS characters, with a blank between tokens."""
    short, out, k = [i for i, t in enumerate(tokens) if len(t) <= RUN_CHARS], [], 0
    while k < len(short):
        stop = k + 1
        while stop < len(short) and short[stop] == short[stop - 1] + 1:
            stop += 1
        if stop - k >= RUN_TOKENS:
            out.append(" ".join(tokens[short[k] : short[stop - 1] + 1]))
        k = stop
    return out


def openings(word: str) -> list[str]:
    return [f"{word[:k]}*" for k in OPENINGS if len(word) > k]


def features(words: Collection[str]) -> Iterator[list[str]]:
    """For each of a document's distinct words: the word, its openings, and those of them that another word has too."""
    shared = Counter(o for w in words for o in openings(w))
    for w in words:
        yield [f"={w}", *(o for o in openings(w)), *(f"{o}*" for o in openings(w) if shared[o] > 1)]


def weight(pos: float, neg: float, all_pos: float, all_neg: float) -> float:
    """Log odds of a feature, 0 unless it speaks for the label clearly enough."""
    if pos + neg < MIN_DOCS or pos <= 0:
        return 0.0
    n, share = pos + neg, all_pos / (all_pos + all_neg)
    if pos / n <= share:
        return 0.0
    g2 = 2 * (pos * math.log(pos / n / share) + (neg * math.log(neg / n / (1 - share)) if neg else 0.0))
    if g2 < MIN_G2:
        return 0.0
    return math.log((pos + 0.25) / (all_pos + 0.5)) - math.log((neg + 0.25) / (all_neg + 0.5))


def evidence(values: list[float]) -> tuple[float, float]:
    """Strongest word, and sum of the TOP strongest."""
    top = sorted(values, reverse=True)[:TOP]
    return (top[0] if top else 0.0, sum(top))


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias by Newton steps with a small ridge."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + 0.1 * w
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def crc_fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4))


class Model:
    """What scoring needs: at most 64 ** 3 grams, and the features of at most TRAIN_ROWS documents that speak clearly for the label."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, weights: dict[str, float], line: tuple[float, float, float], base: float):
        self.grams, self.counts, self.weights, self.line, self.base = grams, counts, weights, line, base


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most TRAIN_ROWS labelled documents outside fold 2, over the trigrams of all documents.

    A document labelled more than once counts as toxic if any label says so, of rows with one doc_id the least text counts; null
    labels and ids are not used. With one class or none, every score is the share of toxic labels (0 without any).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = trigram_counts(docs.select("text")).toPandas()
    grams, counts = found["gram"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    sample = (
        labels.where("toxic is not null and doc_id is not null").where(crc_fold() != 2)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    )
    picked = spark.createDataFrame(sample.toPandas().astype({"doc_id": "int64", "toxic": "int32"}), "doc_id long, toxic int")
    train = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")  # at most TRAIN_ROWS pairs of numbers
    tables = spark.sparkContext.broadcast((grams, counts))

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(*tables.value)
        for b in (x for batch in batches for x in slices(batch, 1)):
            words = [sorted(restorer.words(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[*map("\t".join, features(w))] for w in words], pa.list_(pa.string()))], ["toxic", "words"])

    rows = cut(train.mapInArrow(restore, "toxic int, words array<string>"))  # features by word, tabs between them; read by the counts and by the evidence

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each label that have a feature; '' stands for all documents."""
        n, pos = Counter(), Counter()
        for b in batches:
            for y, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {"", *(f for w in words for f in w.split("\t"))}
                n.update(own)
                if y > 0:
                    pos.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array([pos[f] for f in n], pa.int64()), pa.array(n.values(), pa.int64())], ["f", "pos", "n"])

    summed = cut(rows.mapInArrow(count, "f string, pos long, n long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")))
    _, all_pos, all_rows = summed.where("f = ''").first() or ("", 0, 0)
    all_neg = all_rows - all_pos
    if not all_pos or not all_neg:
        return Model(grams, counts, {}, (0.0, 0.0, 0.0), float(all_pos > 0))
    # features that can reach a weight above 0, with or without one document
    kept = summed.where((F.col("f") != "") & (F.col("n") >= MIN_DOCS) & (F.col("pos") > 0) & (F.col("pos") * all_rows > (F.col("n") - 1) * all_pos)).toPandas()
    counted = zip(kept.f, kept.pos.tolist(), (kept.n - kept.pos).tolist(), strict=True)
    table = {f: (p, q) for f, p, q in counted if weight(p, q, all_pos, all_neg) > 0 or q and weight(p, q - 1, all_pos, all_neg - 1) > 0}
    shared = spark.sparkContext.broadcast(table)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Evidence of each training document under counts without itself."""
        known = shared.value
        for b in batches:
            out = []
            for y, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                y, values = int(y > 0), []
                for w in words:
                    got = [known[f] for f in w.split("\t") if f in known]
                    if got and (v := max(weight(p - y, q - 1 + y, all_pos - y, all_neg - 1 + y) for p, q in got)) > 0:
                        values.append(v)
                out.append((*evidence(values), y))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.int64()))], ["top", "total", "y"])

    seen = rows.mapInArrow(left_out, "top double, total double, y long").toPandas()  # TRAIN_ROWS rows at most
    line = _fit_logistic(seen[["top", "total"]].to_numpy(), seen["y"].to_numpy())
    weights = {f: w for f, (p, q) in table.items() if (w := weight(p, q, all_pos, all_neg)) > 0}
    return Model(grams, counts, weights, tuple(map(float, line)), all_pos / (all_pos + all_neg))


#: What most words say, one object for all of them.
_NOTHING: tuple[float, tuple[str, ...]] = (0.0, ())


class Scorer:
    def __init__(self, m: Model):
        self.m, self.restorer, self.memo = m, Restorer(m.grams, m.counts), {}

    def _known(self, word: str) -> tuple[float, tuple[str, ...]]:
        """The weight of a word by itself, and its openings that weigh more where another word shares them; nothing for most words."""
        w = self.m.weights
        own = max((w.get(f, 0.0) for f in (f"={word}", *openings(word))), default=0.0)
        more = tuple(o for o in openings(word) if w.get(f"{o}*", 0.0) > own)
        return (own, more) if own or more else _NOTHING

    def __call__(self, text: str | None) -> float:
        m, memo = self.m, self.memo
        if not m.weights:
            return m.base
        if len(memo) > MEMO:
            memo.clear()
        found, shared = [], Counter()
        for w in self.restorer.words(text or ""):
            v = memo.get(w)
            if v is None:
                v = memo[w] = self._known(w)
            if v[0] > 0 or v[1]:
                found.append(v)
                shared.update(v[1])
        top, total = evidence([x for own, some in found if (x := max([own, *(m.weights[f"{o}*"] for o in some if shared[o] > 1)])) > 0])
        a, c, bias = m.line
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * top + c * total + bias))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row's doc_id and score, 0 to 1. Null and empty texts have no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(shared.value)
        for b in (x for batch in batches for x in slices(batch, 1)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold. No shuffle: rows are filtered in place."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(shared.value)
        for b in (x for batch in batches for x in slices(batch, at)):
            yield b.filter(pa.array([of(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    held_out: crc32 of the id as text leaves 2 modulo 4 (false for a null id). Null and empty
    texts score like a text without evidence. Repeated rows give repeated rows, an empty table none.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

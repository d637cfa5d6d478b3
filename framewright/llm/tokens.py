"""Token counts by section: whole documents are encoded once, and tokens are attributed by their character spans.

A byte-level BPE gives tokens whose byte lengths add up to the text, so spans come from a running sum. The interval
join of spans to sections is a binary search per document; a token across a boundary goes to the section
that holds most of its characters, on a tie the earlier ("majority"), or to that of its first character ("start").
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's splitting pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of this much white space go past the splitting pattern, whose matcher steps back over a run one character at a time. The tokens are the same.
LONG_RUN = 4096
_LONG_RUN = re.compile(f"[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{{{LONG_RUN},}}")
#: Rows of a batch of results.
ROWS = 50_000
#: Between fields that are encoded as one document.
FIELD_GAP = "\n\n"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token ranks of a vocabulary file (lines of base64 token and rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        """Tokens of a text. The pattern takes all but the last character of a white space run for itself (all of it at the text's end)."""
        ids, begin = [], 0
        for run in _LONG_RUN.finditer(text):
            stop = run.end() - (run.end() < len(text))
            ids += self.encoding.encode_ordinary(text[begin : run.start()])
            ids += self.encoding._encode_single_piece(text[run.start() : stop].encode())
            begin = stop
        return ids + self.encoding.encode_ordinary(text[begin:])

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Character spans [start, end) of the text's tokens; a token inside one character spans that character."""
        ids = np.array(self.encode(text), np.int64)
        ends = np.cumsum(self.sizes[ids])
        if len(text) == (ends[-1] if len(ends) else 0):
            return ends - self.sizes[ids], ends
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[ends - self.sizes[ids]], char[ends - 1] + 1


def line_bounds(text: str) -> np.ndarray:
    """Ends of the lines of a text, each line with its line feed; one empty line for an empty text."""
    ends = np.nonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10)[0] + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "majority") -> np.ndarray:
    """Tokens of each section; sections are [bounds[k - 1], bounds[k]) and cover the text."""
    own = np.searchsorted(bounds, starts, "right")
    if rule == "majority":
        last = np.searchsorted(bounds, ends - 1, "right")
        many = np.nonzero(last > own + 1)[0]
        two = np.nonzero(last == own + 1)[0]
        own[two] += ends[two] - bounds[own[two]] > bounds[own[two]] - starts[two]
        for t in many:
            s = np.arange(own[t], last[t] + 1)
            share = np.minimum(bounds[s], ends[t]) - np.maximum(np.where(s > 0, bounds[s - 1], 0), starts[t])
            own[t] = s[share.argmax()]
    elif rule != "start":
        raise ValueError(f"unknown rule {rule!r}")
    return np.bincount(own, minlength=len(bounds))


def token_counts(docs: DataFrame, fields: list[str] | None = None, rule: str = "majority", vocabulary: str = VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """One row per section: doc_id, section, char_start, char_end, n_tokens.

    Without fields, the sections are the lines of text. With fields, these columns are joined by FIELD_GAP,
    encoded as one document, and are its sections in order (the gap belongs to the field before it). Null counts
    as empty; an empty section has its row with no tokens; repeated rows repeat; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_ranks(vocabulary))  # one vocabulary
    columns = fields or ["text"]
    by_line = fields is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, held = Encoder(shared.value), [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            table = np.concatenate(out, axis=1) if out else np.empty((6, 0), np.int64)
            for i in range(0, table.shape[1], ROWS):
                some = table[:, i : i + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int64(), mask=some[5] > 0), *map(pa.array, some[1:5])], ["doc_id", "section", "char_start", "char_end", "n_tokens"])

        for b in (x for batch in batches for x in slices(batch, 1)):
            for doc, *values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if by_line:
                    text = values[0] or ""
                    bounds = line_bounds(text)
                else:
                    parts = [(v or "") + (FIELD_GAP if i < len(values) - 1 else "") for i, v in enumerate(values)]
                    text, bounds = "".join(parts), np.cumsum([len(p) for p in parts])
                n = len(bounds)
                out.append(np.stack([np.full(n, doc or 0), np.arange(n), np.append(0, bounds[:-1]), bounds, attribute(*encoder.spans(text), bounds, rule), np.full(n, doc is None)]).astype(np.int64))
                held += n
                if held > ROWS:
                    yield from rows()
                    out, held = [], 0
        yield from rows()

    return docs.select(F.col(id_col).cast("long").alias("__fw_id"), *[F.col(c).cast("string") for c in columns]).mapInArrow(run, "doc_id long, section long, char_start long, char_end long, n_tokens long")

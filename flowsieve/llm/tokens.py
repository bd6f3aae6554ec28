"""Exact token counts; huge texts are encoded in overlapping chunks and spliced.

A boundary of two tokens is *proven stable* if no piece of the vocabulary can span it: no piece has
the white-space mark after another sign, so a merge never crosses a place where white space begins.
There, what stands left and what stands right are encoded independently, and two chunks that overlap
agree from such a place on. Where an overlap has none it is widened, at most to the whole text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import text_of
from flowsieve.session import ship_package

MARK = "▁"
CHUNK, OVERLAP = 16_384, 256
LIMIT = 4096


class Counter:
    """Counts tokens with a SentencePiece model of pieces and bytes, given as its file's bytes."""

    def __init__(self, model: bytes, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk, overlap
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(k) for k in range(size)]
        plain = [k for k in range(size) if not (self.model.is_byte(k) or self.model.is_control(k) or self.model.is_unknown(k))]
        if any(MARK in pieces[k].lstrip(MARK) for k in plain):
            raise ValueError("pieces of this model span the start of white space: no boundary is proven")
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        for k in range(size):
            if self.model.is_byte(k):  # the last bytes of a sign add nothing to its length
                self.lengths[k] = not 0x80 <= int(pieces[k][3:5], 16) <= 0xBF
        self.encoded = 0

    def encode(self, text: str, start: int, end: int) -> np.ndarray:
        """Ends of the tokens of a part, as offsets into the text; the mark put before it is not in them."""
        self.encoded += end - start
        ids = np.array(self.model.encode(text[start:end], num_threads=1), np.int64)
        return np.cumsum(self.lengths[ids]) - 1 + start

    def _splice(self, text: str, a: np.ndarray, b: np.ndarray, low: int, high: int) -> int:
        """The last proven boundary in (low, high) that both encodings have; 0 if there is none."""
        both = np.intersect1d(a[(a > low) & (a < high)], b[(b > low) & (b < high)])
        for p in both[::-1].tolist():
            if text[p] in (" ", MARK) and text[p - 1] not in (" ", MARK):
                return p
        return 0

    def count(self, text: str) -> int:
        n = len(text)
        if n <= 2 * self.chunk:
            return len(self.model.encode(text, num_threads=1))
        total, done = 0, -1  # the mark put first may be a token that ends at 0
        start, end = 0, self.chunk
        ends = self.encode(text, start, end)
        while end < n:
            overlap = self.overlap
            while True:
                begin = max(start, end - overlap)
                stop = min(n, begin + overlap + self.chunk)
                nxt = self.encode(text, begin, stop)
                at = self._splice(text, ends, nxt, max(begin, done), end)
                if at or begin == start:
                    break
                overlap *= 2
            if at:
                total += int(np.count_nonzero((ends > done) & (ends <= at)))
                done, start, end, ends = at, begin, stop, nxt
            else:  # nothing to splice at in the whole chunk: lengthen it
                end = min(n, start + 2 * (end - start))
                ends = self.encode(text, start, end)
        return total + int(np.count_nonzero(ends > done))


@lru_cache(maxsize=2)
def _counter(model: bytes) -> Counter:
    return Counter(model)


def count_tokens(
    docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """``doc_id`` (named as ``id_col``), ``n_bytes``, ``n_tokens`` and ``over_limit``, one row per row.

    No begin, end or added tokens; strings of special tokens in a text are text. Null and empty
    texts have 0. Repeated rows are counted alike, ids may be null, other columns are not read.
    ``model_path`` is read on the driver and handed to the tasks.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches):
        counter = _counter(model.value)
        for batch in batches:
            counts = [counter.count(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "n_bytes": batch["n_bytes"], "n_tokens": counts})

    cut = docs.select(
        F.col(id_col).cast("string").alias("id"), text_of(text).alias("text"), F.octet_length(text_of(text)).cast("bigint").alias("n_bytes")
    )
    counted = cut.mapInPandas(run, "id string, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

"""Helpers of the operators: bounded blocks of texts, numbered words, selection of rows by a hash of their id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docketlake.operators.reduction import only_asked

#: Bytes of text that a Python worker takes at once; a longer text is a block of its own.
BLOCK = 4 << 20


def utf8(col: str) -> Column:
    """A text as its UTF-8 bytes, a null as empty; Arrow then hands bytes to Python without decoding them."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def in_one(docs: DataFrame) -> DataFrame:
    """All columns of each row in one column ``row``, where no name can clash with an operator's own; ``row.*`` undoes it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def remainder(col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("null")).cast("binary")) % parts


def blocks(batch: pa.RecordBatch, col: str = "text", limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has at most ``limit`` bytes in ``col``, or one row."""
    sizes = np.diff(offsets(batch.column(col)))
    ends = np.cumsum(sizes)
    start, n = 0, len(sizes)
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a binary column without nulls, starting where the column starts in its buffer."""
    wide = pa.types.is_large_binary(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the offsets of its rows in them."""
    at = offsets(column)
    data = column.buffers()[2]
    taken = np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])) if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return taken, at - at[0]


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the values between each two offsets."""
    running = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, axis=0, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return running[at[1:]] - running[at[:-1]]


def spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices values[start : start + length], one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)]


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words (runs of bytes other than 9 to 13 and 32) of all texts, and the offsets of each text's words."""
    found = [t.split() for t in texts]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in found], out=at[1:])
    return [w for ws in found for w in ws], at


#: The table that this process filled last: a worker that goes on to another operator lets the earlier one's go.
_IN_USE: list = []


class Words(dict):
    """Numbers words as they come; ``describe`` gives new words their rows in ``rows``.

    It lives as long as its Python worker, so that a word is described once for many batches, and is emptied when it holds
    ``limit`` words: its memory is bounded, and what it returns does not depend on what it has seen.
    """

    def __init__(self, describe: Callable[[list[bytes]], np.ndarray] | None = None, limit: int = 600_000):
        self.describe, self.limit, self.fresh, self.rows, self.filled = describe, limit, [], None, 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def forget(self) -> None:
        self.clear()
        self.fresh, self.rows, self.filled = [], None, 0

    def number(self, words: list[bytes]) -> np.ndarray:
        if not _IN_USE or _IN_USE[0] is not self:
            for other in _IN_USE:
                other.forget()
            _IN_USE[:] = [self]
        if len(self) > self.limit:
            self.forget()
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh and self.describe:
            new = self.describe(self.fresh)
            if self.rows is None or len(self) > len(self.rows):
                grown = np.empty((max(2 * len(self), 4096), *new.shape[1:]), new.dtype)
                if self.filled:
                    grown[: self.filled] = self.rows[: self.filled]
                self.rows = grown
            self.rows[self.filled : len(self)] = new
            self.filled = len(self)
        self.fresh = []
        return codes


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of unsigned 64-bit integers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, per_label: int | None = None) -> DataFrame:
    """(doc_id, text, label): all texts with a 0/1 label whose id hashes outside the held-out part, or about ``per_label`` of each label.

    Some are drawn among the labels, so the texts are only met by a join of bounded size; for all of them, a bit filter over the
    labelled ids thins out the texts before they are shuffled. Rows with a null id, text or label teach nothing and are left out.
    """
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    marks = marks.where(remainder("doc_id", parts) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    if per_label is None:
        teaching = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (remainder("doc_id", parts) != held_out))
        return only_asked(teaching, marks.select("doc_id"), "doc_id").join(marks, "doc_id")
    drawn = draw(marks, per_label)  # its size is bounded by per_label, so it may be broadcast
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")


def draw(rows: DataFrame, per_label: int, seed: int = 0) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of the id; a label with fewer rows gives all of them.

    The counts per label come first, so the number drawn depends on ``per_label`` and not on the input.
    """
    share = F.lit(0.0)
    for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect():
        share = F.when(F.col("label") == r["label"], F.lit(min(1.0, per_label / r["n"]))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) < share * (1 << 40))


def examples(rows: DataFrame) -> list:
    """Drawn rows on the driver, in an order that does not depend on partitions."""
    return rows.orderBy("doc_id", "label", "text").collect()

"""Spelling variants: words that differ by one edit, found by comparing blocks of padded code-point matrices.

Two words are one edit apart exactly if their common prefix and common suffix together reach the length of the longer one
minus one. So one of the two is at least half of that: words meet only where that half is the same, as rows of two matrices
that are compared all at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from docketlake.llm.common import blocks, utf8
from docketlake.session import discard, materialize

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: One document's word in so many loses a letter, a typing error whose place the document and the word decide.
ERROR_EVERY = 199
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
#: Code points in a tile of words that may meet, rows of a block that is compared at once, cells of one comparison.
TILE, BLOCK_ROWS, CELLS = 1 << 16, 128, 1 << 22


def mistyped(doc_id: str, word: str, every: int = ERROR_EVERY) -> str:
    """The lower-cased word as this document has it: without one letter where the hash of both says so."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _count(min_length: int, every: int):
    def run(batches):
        held: Counter = Counter()

        def told():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in blocks(batch):
                for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    start = zlib.crc32(f"{doc}:".encode())
                    for word, n in Counter(RUN.findall(text.lower().decode())).items():
                        if len(word) < min_length:
                            continue
                        if zlib.crc32(word.encode(), start) % every == 0:
                            word = mistyped(doc, word, every)
                        held[word] += n
                    if len(held) > HELD:
                        yield told()
                        held.clear()
        if held:
            yield told()

    return run


def frequent_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = ERROR_EVERY) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points and how often they occur in all texts, at least ``min_count`` times.

    A word is a run of ASCII letters and of U+00C0 to U+00FF with A-Z in lower case, after ``mistyped``. A null text has no
    words; a null id counts as the text 'null'.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text"))
    counted = rows.withColumn("text", utf8("text")).mapInArrow(_count(min_length, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) & (F.char_length("word") >= min_length))


def keyed(words: DataFrame) -> DataFrame:
    """(side, longest, half, word, n): the halves under which a word may meet its near words.

    A pair whose longer word has L code points shares a prefix or a suffix of ceil((L - 1) / 2). A word is the longer one for
    its own length and the shorter one for the next.
    """
    length = F.char_length("word")
    entries = []
    for longest in (length, length + 1):
        size = F.floor(longest / 2).cast("int")  # ceil((longest - 1) / 2)
        entries += [
            F.struct(F.lit("p").alias("side"), longest.alias("longest"), F.substr("word", F.lit(1), size).alias("half")),
            F.struct(F.lit("s").alias("side"), longest.alias("longest"), F.right("word", size).alias("half")),
        ]
    return words.select("word", "n", F.explode(F.array(*entries)).alias("_k")).select("_k.side", "_k.longest", "_k.half", "word", "n")


def tiles(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(side, longest, half, i, j, b, word, n): words that meet, cut into tiles of bounded size.

    Words of a group too large for a tile are dealt into parts by a hash, and every two parts (i <= j) are a tile; ``b`` is the part
    that the word comes from. Groups of one word are left out.
    """
    rows = keyed(words)
    key = ["side", "longest", "half"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_size")).where(F.col("_size") > 1)
    parts = F.ceil(F.col("_size") * F.col("longest") / tile).cast("int")
    placed = rows.join(sizes.select(*key, parts.alias("_parts")), key).withColumn("b", F.pmod(F.xxhash64("word"), F.col("_parts")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda o: F.struct(F.least(o, "b").alias("i"), F.greatest(o, "b").alias("j")))
    return placed.select(*key, F.explode(met).alias("_t"), "b", "word", "n").select(*key, "_t.i", "_t.j", "b", "word", "n")


def matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, padded at the right, and of the reversed words."""
    forward = np.array(words, f"U{width}")
    backward = np.array([w[::-1] for w in words], f"U{width}")
    return forward.view(np.uint32).reshape(len(words), width), backward.view(np.uint32).reshape(len(words), width)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of ``a`` with each row of ``b``."""
    differ = a[:, None, :] != b[None, :, :]
    return np.where(differ.any(2), differ.argmax(2), a.shape[1])


def near_pairs(words: list[str], group: np.ndarray, part: np.ndarray, side: np.ndarray, rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (a < b) of words that are one edit apart, of one group, and not of a part that is compared elsewhere.

    ``words`` are sorted by group, so a block of rows meets itself and the blocks up to where its last group ends. ``side``
    is twice the length that the longer word of the group has, plus 1 where the group shares a suffix; there, pairs that share the
    prefix of the same length as well are left to its group. ``part`` is the word's part of a group that is cut into tiles, where
    parts must differ, or -1.
    """
    left, right = [], []
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.searchsorted(group, group, side="right")
    start = 0
    while start < len(words):
        width = int(lengths[start : min(start + rows, len(words))].max())
        step = max(1, min(rows, int((CELLS // max(width, 1)) ** 0.5)))
        stop = min(start + step, len(words))
        until = int(ends[stop - 1])
        for low in range(start, until, step):
            high = min(low + step, until)
            width = int(max(lengths[start:stop].max(), lengths[low:high].max()))
            fa, ba = matrices(words[start:stop], width)
            fb, bb = matrices(words[low:high], width)
            longer = np.maximum(lengths[start:stop, None], lengths[None, low:high])
            able = (group[start:stop, None] == group[None, low:high]) & (np.arange(start, stop)[:, None] < np.arange(low, high)[None, :])
            able &= (part[start:stop, None] < 0) | (part[start:stop, None] != part[None, low:high])
            able &= longer == side[start:stop, None] // 2  # a pair of two shorter words belongs to the group of their own length
            prefix = np.minimum(common(fa, fb), np.minimum(lengths[start:stop, None], lengths[None, low:high]))
            suffix = np.minimum(common(ba, bb), np.minimum(lengths[start:stop, None], lengths[None, low:high]))
            able &= (prefix + suffix >= longer - 1) & ((side[start:stop, None] % 2 == 0) | (prefix < longer // 2))
            a, b = np.nonzero(able)
            left.append(a + start)
            right.append(b + low)
        start = stop
    return np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64)


_KEY = ["side", "longest", "half", "i", "j"]


def _compare(batches):
    """Pairs from batches sorted by tile; the last tile of a batch waits for the next batch."""
    waiting = None

    def told(table: pa.Table, numbers: np.ndarray):
        words, n = table["word"].to_pylist(), table["n"].to_numpy()
        i, j, b = (table[c].to_numpy() for c in ("i", "j", "b"))
        suffix = (table["side"].to_numpy(zero_copy_only=False) == "s").astype(np.int64)
        a, c = near_pairs(words, numbers, np.where(i == j, -1, b), 2 * table["longest"].to_numpy().astype(np.int64) + suffix)
        both = np.concatenate([a, c]), np.concatenate([c, a])
        picked = [table["word"].take(pa.array(k)).combine_chunks() for k in both]
        return pa.RecordBatch.from_arrays([picked[0], pa.array(n[both[0]]), picked[1], pa.array(n[both[1]])], ["word", "n", "near", "near_n"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table]).combine_chunks()
        if not table.num_rows:
            continue
        same = np.ones(table.num_rows - 1, bool)
        for c in _KEY:
            values = table[c].combine_chunks()
            same &= np.asarray(pc.equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False), bool)
        numbers = np.concatenate([[0], np.cumsum(~same)])
        done = int(np.searchsorted(numbers, numbers[-1]))
        waiting = table.slice(done)
        if done:
            yield told(table.slice(0, done), numbers[:done])
    if waiting is not None and waiting.num_rows:
        yield told(waiting, np.zeros(waiting.num_rows, np.int64))


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of ``words`` (word, n; distinct) that are one edit apart, once."""
    met = tiles(words, tile)
    return met.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_compare, "word string, n long, near string, near_n long")


def forms(words: DataFrame, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """(word, n_near, form, form_n): how many near words a word has, and the most frequent one if it is ``ratio`` times as frequent."""
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))  # ties go to the smaller word
    found = near_words(words, tile).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("_best"))
    enough = -F.col("_best.m") >= ratio * F.col("n")
    return found.select("word", "n_near", F.when(enough, F.col("_best.near")).alias("form"), F.when(enough, -F.col("_best.m")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms; ``links`` (word, form). Each pass doubles the step, so passes follow the log of the longest chain."""
    step = materialize(links.select("word", F.col("form").alias("root")), "form-links")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        jumped = materialize(step.join(ahead, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_on")), "form-links")
        discard(step)
        if jumped.where("_on").isEmpty():
            return jumped.select("word", "root")
        step = jumped.select("word", "root")
        step.scratch_path = jumped.scratch_path


def group_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, every: int = ERROR_EVERY, tile: int = TILE) -> DataFrame:
    """word, n, n_near, form, form_n, root: frequent words, their near words and the form that each is a variant of.

    A word's form is its most frequent near word (ties: the smaller one) if that is at least ``ratio`` times as frequent, so forms
    grow along a chain and it ends; the root is the end, or the word itself. Null and empty texts have no words; repeated rows
    count each; no rows or no frequent words give none; columns other than doc_id and text are ignored.
    """
    words = materialize(frequent_words(docs, min_length, min_count, every), "words")
    found = materialize(forms(words, ratio, tile), "forms")
    ends = roots(found.where(F.col("form").isNotNull()))
    joined = words.join(found, "word", "left").join(ends, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))

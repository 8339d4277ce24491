"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source.

A sketch is a table of integer buckets with counts. Small values have a bucket each, larger ones share buckets of at most
1/32 of their size, so a quantile is off by at most that factor; sketches merge by adding counts, and the same rows always
give the same sketch, whatever the partitioning. A cutoff lies beyond the upper quartile by three quartile distances (at
least by a tolerance), so up to a quarter of bad rows in a group cannot move it to their side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from docketlake.llm.common import Words, blocks, raw, sums, utf8, words_of
from docketlake.session import materialize

#: metric -> (least distance of the cutoff from the quartile, whether low values are bad too); all are integers
METRICS = {
    "length": (200, True),  # 100 x characters per word
    "symbols": (60, False),  # symbols per 1000 words
    "repeats": (150, False),  # words in repeated windows per 1000 words
    "lines": (200, False),  # repeated lines per 1000 lines
}
STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
#: Groups of fewer documents use the merged sketch of their language, or of all documents.
MIN_DOCS = 100

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WORDS = Words()


def windows(codes: np.ndarray) -> np.ndarray:
    """A number for each window of three codes; windows have the same number exactly if their codes are the same."""
    bits = int(codes.max()).bit_length()
    pair = (codes[:-1] << bits) | codes[1:]
    if 3 * bits > 63:  # pairs are numbered anew, so that a number and a code fit side by side
        pair = np.unique(pair, return_inverse=True)[1]
    return (pair[:-1] << bits) | codes[2:]


def repeated_words(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text: words that lie in a window of three words which the text has twice or more."""
    if len(codes) < 3:
        return np.zeros(len(at) - 1, np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = doc[2:] == doc[:-2]
    key = windows(codes)
    start = np.flatnonzero(inside)
    start = start[np.argsort(key[start], kind="stable")]
    same = (key[start[1:]] == key[start[:-1]]) & (doc[start[1:]] == doc[start[:-1]])
    twice = np.zeros(len(start), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(codes), np.int64)
    for k in range(3):
        covered[start[twice] + k] = 1
    return sums(covered, at)


def dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    if b"\n" not in text:
        return int(bool(text.strip())), 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def _measure(batches):
    for batch in batches:
        for part in blocks(batch):
            texts = part.column("text").to_pylist()
            data, at = raw(part.column("text"))
            words, word_at = words_of(texts)
            codes = _WORDS.number(words)
            lines = np.array([dup_lines(t) for t in texts], np.int64).reshape(-1, 2)
            chars = ((data & 0xC0) != 0x80) & ~_SPACE[data]
            stats = [np.diff(word_at), sums(chars, at), sums(_SYMBOL[data], at), lines[:, 0], lines[:, 1], repeated_words(codes, word_at)]
            keys = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "text"]
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(keys + [pa.array(s, pa.int64()) for s in stats], names + [x.split()[0] for x in STATS.split(", ")])


def measure(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Word, symbol, line and repetition counts of every whole text, beside the ``keys``.

    A null text counts as empty: all counts are 0.
    """
    kept = docs.select(*keys, utf8("text").alias("text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")
    return kept.mapInArrow(_measure, f"{types}, {STATS}")


def metric(name: str) -> Column:
    """One of the METRICS as an integer; null where a text has no words, which no cutoff then touches."""
    top, per, scale = {
        "length": ("word_chars", "n_words", 100), "symbols": ("n_symbols", "n_words", 1000),
        "repeats": ("n_repeat_words", "n_words", 1000), "lines": ("n_dup_lines", "n_lines", 1000),
    }[name]
    return F.when(F.col(per) > 0, F.expr(f"({scale} * {top}) div {per}"))


def bucket(value: str) -> Column:
    """Sketch bucket of an integer: itself below 64, else its leading six bits and their place."""
    place = f"(length(bin({value})) - 6)"
    return F.expr(f"CASE WHEN {value} < 64 THEN {value} ELSE 32 * {place} + shiftright({value}, {place}) END")


def floor_of(col: str) -> Column:
    """Smallest value of a bucket."""
    return F.expr(f"CASE WHEN {col} < 64 THEN {col} ELSE shiftleft(32 + {col} % 32, CAST({col} div 32 - 1 AS INT)) END")


def sketch(stats: DataFrame, by: list[str]) -> DataFrame:
    """(by..., metric, bucket, n): counts per bucket. Unions of sketches merge with :func:`merge`."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), metric(m).alias("value")) for m in METRICS])).alias("m")
    rows = stats.select(*by, values).select(*by, "m.metric", "m.value").where("value IS NOT NULL")
    return rows.groupBy(*by, "metric", bucket("value").alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Add the counts of sketches, to fewer keys if asked."""
    return sketches.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def cutoffs(sketches: DataFrame, by: list[str], suffix: str) -> DataFrame:
    """One row per group: its documents and, for each metric, the lowest and highest value that stays."""
    group = Window.partitionBy(*by, "metric")
    ranked = sketches.select("*", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("total"))
    at = lambda p: F.min(F.when(F.col("upto") * 4 >= F.col("total") * p, floor_of("bucket")))
    quartiles = ranked.groupBy(*by, "metric").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("total").alias("total"))
    columns = [F.max("total").alias(f"docs{suffix}")]
    for m, (least, both) in METRICS.items():
        width = F.greatest(3 * (F.col("q3") - F.col("q1")), F.lit(least))
        columns.append(F.max(F.when(F.col("metric") == m, F.col("q3") + width)).alias(f"{m}_high{suffix}"))
        if both:
            columns.append(F.max(F.when(F.col("metric") == m, F.col("q1") - width)).alias(f"{m}_low{suffix}"))
    return quartiles.groupBy(*by).agg(*columns)


def adaptive_filter(stats: DataFrame, by: tuple[str, str] = ("lang", "source"), min_docs: int = MIN_DOCS) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to measured rows.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows. ``kept`` is false for these
    and for rows beyond a cutoff of their group. Nulls in ``by`` are a group of their own; groups under ``min_docs`` use
    their language's cutoffs, small languages those of all rows. A row without words has failed already.
    """
    lang, source = by
    fine = materialize(sketch(stats, [lang, source]), "quality-sketch")
    coarse = merge(fine, [lang])
    groups, languages = cutoffs(fine, [lang, source], "_s"), cutoffs(coarse, [lang], "_l").withColumnRenamed(lang, "_lang")
    table = groups.join(languages, F.col(lang).eqNullSafe(F.col("_lang")))
    whole = cutoffs(merge(coarse, []), [], "").first()
    names = [f"{m}_{side}" for m, (_, both) in METRICS.items() for side in (("high", "low") if both else ("high",))]
    chosen = [
        F.when(F.col("docs_s") >= min_docs, F.col(f"{n}_s")).when(F.col("docs_l") >= min_docs, F.col(f"{n}_l")).otherwise(F.lit(whole[n])).alias(f"_{n}")
        for n in names
    ]
    table = table.select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), *chosen)
    joined = stats.join(table, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    fine_row = ~failed
    for m, (_, both) in METRICS.items():
        fine_row = fine_row & F.coalesce(metric(m) <= F.col(f"_{m}_high"), F.lit(True))
        if both:
            fine_row = fine_row & F.coalesce(metric(m) >= F.col(f"_{m}_low"), F.lit(True))
    return joined.select(*stats.columns, failed.alias("base_failed"), fine_row.alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Measure every text of ``docs`` (doc_id, text, lang, source) and judge it by its group's cutoffs."""
    return adaptive_filter(materialize(measure(docs, ["doc_id", "lang", "source"]), "quality-stats"))

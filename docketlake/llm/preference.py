"""Quality scores learned from preference pairs (Bradley-Terry).

A document's strength is a weighted sum of its features; the chance that one document is preferred to another is the
logistic function of the difference of their strengths. The weights minimize the logistic loss over all pairs of a preferred
and a rejected document of the whole training set. Strengths have no zero of their own, so the cut is a quantile of the training strengths: as many
lie below it as there were rejected documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docketlake.llm.common import Words, blocks, sums, utf8, words_of
from docketlake.llm.rules import repeated_words
from docketlake.session import materialize

#: Hashed word shapes, besides the named features.
SHAPES = 64
NAMED = ["words", "length", "long", "short", "upper", "title", "digit", "mark", "pipe", "end", "repeat", "adjacent", "distinct", "lines"]
SIZE = len(NAMED) + SHAPES
#: Score of the cut.
CUT_SCORE = 0.3
#: Rounds of the fit; bins of strengths in a round, and ranges in a step towards the cut.
ROUNDS, BINS, CUTS = 16, 64, 4096
#: Features as whole numbers: their greatest value and steps of one; steps of a standardized feature and of a weight.
MOST, FINE, STEPS, WEIGHT = 16, 1 << 18, 1 << 12, 1 << 20
_RUN = re.compile(r"(.)\1+")
_MARKS = re.compile(r"[#*$%&|<>!]")


def _shape(word: str) -> str:
    """A word's pattern of letters, digits and marks, runs as one."""
    if word.isalpha() and word.islower():
        return "a"
    return _RUN.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


def _describe(words: list[bytes]) -> np.ndarray:
    """Per word: characters, long, short, upper case, capitalized, with a digit, with a mark, a bar, sentence end, shape."""
    rows = np.empty((len(words), 10), np.float32)
    for k, w in enumerate(words):
        t = w.decode()
        n = len(t)
        shape = _shape(t)
        of_shape = _of_shape if len(shape) <= 40 else _of_shape.__wrapped__  # long shapes would fill the cache
        rows[k] = (n, n > 15, n < 3, *of_shape(shape), t == "|", t[-1] in ".!?", 0)
        rows[k, 9] = rows[k, 6]
        rows[k, 6] = _MARKS.search(t) is not None
    return rows


@lru_cache(100_000)
def _of_shape(shape: str) -> tuple:
    """Upper case, capitalized, with a digit, hashed dimension."""
    return shape.startswith("A") and "a" not in shape, shape.startswith("Aa"), "0" in shape, crc32(shape.encode()) % SHAPES


_WORDS = Words(_describe)


def features(texts: list[bytes]) -> np.ndarray:
    """Features of whole texts: logarithms of counts, shares of words with a property, shares of hashed word shapes."""
    words, at = words_of(texts)
    codes = _WORDS.number(words)
    per_word = _WORDS.rows[codes] if len(codes) else np.zeros((0, 10), np.float32)
    n = np.diff(at)
    share = 1 / np.maximum(n, 1)
    out = np.zeros((len(texts), SIZE))
    totals = sums(per_word[:, :9], at)
    out[:, 0] = np.log1p(n) / 5
    out[:, 1] = totals[:, 0] * share / 5
    out[:, 2:10] = totals[:, 1:] * share[:, None]
    out[:, 10] = repeated_words(codes, at) * share
    doc = np.repeat(np.arange(len(texts)), n)
    same = np.zeros(len(codes), np.int64)
    if len(codes):
        same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    out[:, 11] = sums(same, at) * share
    if len(codes):
        bits = int(codes.max()).bit_length()
        distinct = np.unique((doc << bits) | codes) >> bits
        out[:, 12] = np.bincount(distinct, minlength=len(texts)) * share
    out[:, 13] = np.log1p([t.count(b"\n") for t in texts]) / 5
    hashed = doc * SHAPES + per_word[:, 9].astype(np.int64)
    out[:, len(NAMED) :] = np.bincount(hashed, minlength=len(texts) * SHAPES).reshape(-1, SHAPES) * share[:, None]
    return out


@dataclass(frozen=True)
class Ranker:
    """Weights of the features, the strength at the cut, and the slope that turns strengths into scores."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, np.abs(z)], axis=1) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at_cut = np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(at_cut + (self.strength(x) - self.cut) * self.slope, -30, 30)))


def _described(rows: DataFrame) -> DataFrame:
    """(label, x): the features of labelled rows as whole numbers, so that their sums are exact in any order."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                x = np.rint(np.minimum(features(part.column("text").to_pylist()), MOST) * FINE).astype(np.int32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), SIZE).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("label"), lists], ["label", "x"])

    return rows.select((F.col("label") == 1).alias("label"), utf8("text").alias("text")).mapInArrow(run, "label boolean, x array<int>")


def _totals(table: DataFrame, size: int, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``size`` whole numbers that ``step(x, label)`` gives for a block of rows, summed over all rows of the table."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(-1, SIZE)
                total += step(x, batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "value"])

    out = np.zeros(size)
    for r in table.mapInArrow(run, "slot long, value long").groupBy("slot").agg(F.sum("value").alias("value")).collect():
        out[r["slot"]] = r["value"]
    return out


def fit(rows: DataFrame, rounds: int = ROUNDS, ridge: float = 1e-3) -> Ranker:
    """Fit on all labelled rows (doc_id, text, label): minimize the mean logistic loss of all pairs of a preferred and a rejected row.

    The features are written once. The loss of all pairs needs no pair: its curvature is bounded by that of zero weights, which
    follows from sums and products over the rows of each label, and its gradient from counts and sums of rows whose strengths
    lie in one of ``BINS`` narrow bins. Each round is one pass with momentum. Only such sums come to the driver.

    Without rows of both labels there is no pair: all strengths are then equal and every score is that of the cut.
    """
    table = materialize(_described(rows), "features")
    counts = {r["label"]: r["n"] for r in table.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = counts.get(False, 0), counts.get(True, 0)
    if not good or not bad:
        return Ranker(np.zeros(2 * SIZE), np.zeros(SIZE), np.ones(SIZE), 0.0, 1.0)
    n = good + bad
    first, second = _totals(table, 2 * SIZE, lambda x, _: np.concatenate([x.sum(0, dtype=np.int64), np.square(x, dtype=np.int64).sum(0)])).reshape(2, SIZE)
    mean = first / n / FINE
    scale = np.sqrt(np.maximum(second / n / FINE**2 - mean**2, 0.0))
    scale = np.where(scale > 1e-6, scale, 1.0)

    def lifted(x):
        z = np.rint(np.clip((x / FINE - mean) / scale, -6, 6) * STEPS)
        return np.concatenate([z, np.abs(z)], axis=1)

    width = 2 * SIZE

    def products(x, label):
        z = lifted(x)
        return np.concatenate([np.concatenate([z[label == k].sum(0), (z[label == k].T @ z[label == k]).ravel()]) for k in (0, 1)])

    sums_of, squares = np.split(_totals(table, 2 * (width + width**2), products).reshape(2, width + width**2), [width], axis=1)
    sums_of, squares = sums_of / STEPS, squares.reshape(2, width, width) / STEPS**2
    crossed = np.outer(sums_of[1], sums_of[0])
    bend = (bad * squares[1] + good * squares[0] - crossed - crossed.T) / (4.0 * good * bad) + ridge * np.eye(width)

    def binned(weights, low, step):
        """Count and sum of the rows of each label whose strengths lie in a bin."""
        whole = np.rint(weights * WEIGHT)

        def block(x, label):
            z = lifted(x)
            place = np.clip(np.floor((z @ whole / (STEPS * WEIGHT) - low) / step), 0, BINS - 1).astype(np.int64) + label * BINS
            member = np.zeros((2 * BINS, len(z)))
            member[place, np.arange(len(z))] = 1
            return np.concatenate([member.sum(1)[:, None], member @ z], axis=1).ravel()

        found = _totals(table, 2 * BINS * (width + 1), block).reshape(2, BINS, width + 1)
        return found[:, :, 0], found[:, :, 1:] / STEPS

    def cut_of(weights):
        """The strength below which as many rows lie as were rejected, by counts in ever narrower ranges."""
        whole = np.rint(weights * WEIGHT)
        low, reach, under = -6.0 * np.abs(weights).sum() - 1e-6, 12.0 * np.abs(weights).sum() + 2e-6, 0
        for _ in range(3):
            step = reach / CUTS

            def block(x, _):
                place = np.floor((lifted(x) @ whole / (STEPS * WEIGHT) - low) / step)
                return np.bincount(place[(place >= 0) & (place < CUTS)].astype(np.int64), minlength=CUTS)

            upto = under + np.cumsum(_totals(table, CUTS, block))
            at = min(int(np.searchsorted(upto, bad)), CUTS - 1)
            low, reach, under = low + at * step, step, upto[at - 1] if at else under
        return low + reach

    def spread(weights):
        middle = float(sums_of.sum(0) @ weights / n)
        return middle, float(np.sqrt(max(weights @ squares.sum(0) @ weights / n - middle**2, 0.0)))

    weights = ahead = np.zeros(width)
    for k in range(rounds):
        middle, deviation = spread(ahead)
        step = max(10 * deviation / BINS, 1e-9)
        count, total = binned(ahead, middle - step * BINS / 2, step)
        strength = total @ ahead / np.maximum(count, 1)
        miss = 1 / (1 + np.exp(np.clip(strength[1][:, None] - strength[0][None, :], -30, 30)))
        gradient = ((miss @ count[0]) @ total[1] - (count[1] @ miss) @ total[0]) / (good * bad) - ridge * ahead
        newer = ahead + np.linalg.solve(bend, gradient)
        ahead, weights = newer + k / (k + 3) * (newer - weights), newer

    return Ranker(weights, mean, scale, cut_of(weights), 4 / max(spread(weights)[1], 1e-9))


def score(docs: DataFrame, model: Ranker, keys: list[str], cut: float = CUT_SCORE) -> DataFrame:
    """Score every whole text: the ``keys``, score (0 to 1), predicted (1 from ``cut`` on). A null text counts as empty."""
    rows = docs.select(*keys, utf8("text").alias("text"))

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                s = model.score(features(part.column("text").to_pylist()))
                own = [part.column(k) for k in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array((s >= cut).astype(np.int32))], [*part.schema.names[:-1], "score", "predicted"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{types}, score double, predicted int")


def quantile_filter(scored: DataFrame, share: float) -> DataFrame:
    """Rows whose score lies in the best ``share`` of all, by a quantile over all rows; ties at the quantile stay."""
    cut = scored.agg(F.percentile_approx("score", 1.0 - share, 10_000)).first()[0]
    return scored.where(F.col("score") >= F.lit(cut)) if cut is not None else scored

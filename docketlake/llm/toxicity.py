"""Toxicity by compression distance.

Two raw Zstandard dictionaries are put together from training texts, one for toxic and one for ordinary text (Zstandard's own
trainer told them apart worse, see README). Both hold the same most frequent ordinary strings; behind them the one holds the strings that tell toxic texts apart, the other further ordinary strings. A window is a
word within a carrier phrase that both dictionaries know, so that the compressed length beyond the carrier is the word's
own. How many bytes the toxic dictionary saves is compared with a threshold per window; the windows beyond it, their share
of the text and their savings give the score. The threshold and the weights are calibrated on labelled texts that the
dictionaries have not seen.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from docketlake.llm.common import Words, blocks, examples, sums, utf8, words_of

#: Lengths of the strings that a dictionary is built from, and the strings it takes.
SIZES, TOXIC_STRINGS, COMMON_STRINGS, CARRIER = (5, 6, 7, 8), 150, 400, 48
#: Bytes behind the word: the compressor looks for no match that starts in the last eight.
TAIL = 12
#: A string is toxic if it is so many times more frequent in toxic texts, and stands in so many of them at least.
RATIO, LEAST = 12, 5
#: Texts of each label that teach, savings of a window to choose a threshold from.
PER_LABEL = 1500
THRESHOLDS = (1, 2, 3, 4)
PREDICT_FROM = 0.3


def _strings(documents: list[set[bytes]]) -> Counter:
    """How many documents have a word with each string (a document counts once per word)."""
    words = Counter(w for d in documents for w in d)
    found: Counter = Counter()
    for word, n in words.items():
        t = b" " + word + b" "
        for k in {t[i : i + size] for size in SIZES for i in range(len(t) - size + 1)}:
            found[k] += n
    return found


def train(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Content of the toxic and of the ordinary dictionary, and the carrier phrase."""
    tox, usual = [set(t.lower().split()) for t in toxic], [set(t.lower().split()) for t in ordinary]
    in_tox, in_usual = _strings(tox), _strings(usual)
    share = max(len(ordinary), 1) / max(len(toxic), 1)
    weight = {k: n * log(n * share / (in_usual[k] + 0.5)) for k, n in in_tox.items() if n >= LEAST and n * share > RATIO * (in_usual[k] + 0.5)}

    def pick(ranked, n):
        chosen: list[bytes] = []
        for k in ranked:
            if len(chosen) == n:
                break
            if not any(k in c or c in k for c in chosen):
                chosen.append(k)
        return chosen

    common = pick((k for k, _ in sorted(in_usual.items(), key=lambda x: (-x[1], x[0]))[:8000]), 2 * COMMON_STRINGS)
    distinctive = pick(sorted(weight, key=lambda k: (-weight[k], k)), TOXIC_STRINGS)
    base = b"".join(common[:COMMON_STRINGS])
    marks = b"".join(reversed(distinctive))
    return base + marks, base + b"".join(common[COMMON_STRINGS:])[: len(marks)], base[:CARRIER]


@dataclass
class Detector:
    """Both dictionaries, the carrier, the threshold of a window's saving, and the weights of a text's features."""

    toxic: bytes
    ordinary: bytes
    carrier: bytes
    threshold: int = 2
    weights: tuple[float, ...] = (-5.0, 0.0, 0.0, 0.0, 0.0)
    _words: Words | None = field(default=None, repr=False)

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("toxic", "ordinary", "carrier", "threshold", "weights")} | {"_words": None}

    @cached_property
    def _compressors(self):
        settings = zstandard.ZstdCompressionParameters(
            window_log=13, hash_log=12, chain_log=12, search_log=6, min_match=5, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=False, write_dict_id=False,
        )
        return [
            zstandard.ZstdCompressor(compression_params=settings, dict_data=zstandard.ZstdCompressionDict(d or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for d in (self.ordinary, self.toxic)
        ]

    def _savings(self, words: list[bytes]) -> np.ndarray:
        usual, tox = (c.compress for c in self._compressors)
        head, tail = self.carrier + b" ", b" " + self.carrier[:TAIL]
        out = np.empty(len(words), np.float32)
        for k, w in enumerate(words):
            window = head + w + tail
            out[k] = len(usual(window)) - len(tox(window))
        return out

    def savings(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that the toxic dictionary saves on each window of each text, and the offsets of the texts."""
        if self._words is None:
            self._words = Words(self._savings)
        words, at = words_of([t.lower() for t in texts])
        codes = self._words.number(words)
        return (self._words.rows[codes] if len(codes) else np.zeros(0, np.float32)), at

    def features(self, texts: list[bytes], threshold: int | None = None) -> np.ndarray:
        saved, at = self.savings(texts)
        n = np.diff(at)
        beyond = saved >= (threshold or self.threshold)
        hits, bytes_saved = sums(beyond.astype(np.int64), at), sums(np.where(beyond, saved, 0).astype(np.float64), at)
        share = hits / np.maximum(n, 1)
        return np.stack([np.ones(len(n)), np.log1p(hits), np.minimum(share, 0.1) * 50, np.log1p(bytes_saved), np.log1p(n) / 5], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.weights), -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * len(y) / 100 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + (ridge * len(y) / 100 + 1e-9) * np.eye(len(w))
        w = w - np.linalg.solve(bend, gradient)
    return w


def fit(rows: DataFrame) -> Detector:
    """Train on labelled rows (doc_id, text, label), of which there are at most about PER_LABEL of each label (``labelled``).

    Every second row trains the dictionaries, the others calibrate. Without rows of both labels every score is low.
    """
    drawn = examples(rows)
    texts, label = [r["text"].encode() for r in drawn], np.array([r["label"] for r in drawn], int)
    first, second = slice(0, None, 2), slice(1, None, 2)
    if min((label[half] == v).sum() for half in (first, second) for v in (0, 1)) == 0:
        return Detector(b"", b"", b"")
    toxic = [t for t, y in zip(texts[first], label[first]) if y == 1]
    ordinary = [t for t, y in zip(texts[first], label[first]) if y == 0]
    detector = Detector(*train(toxic, ordinary))
    y = label[second]
    best = None
    for threshold in THRESHOLDS:
        x = detector.features(texts[second], threshold)
        w = logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))
        if best is None or loss < best[0]:
            best = (loss, threshold, tuple(w))
    return Detector(detector.toxic, detector.ordinary, detector.carrier, best[1], best[2])


def score(docs: DataFrame, model: Detector, keys: list[str], predict_from: float = PREDICT_FROM) -> DataFrame:
    """Score every whole text: the ``keys``, score (0 to 1), predicted (1 from ``predict_from`` on). Null counts as empty."""
    rows = docs.select(*keys, utf8("text").alias("text"))

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                s = model.score(part.column("text").to_pylist())
                own = [part.column(k) for k in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array((s >= predict_from).astype(np.int32))], [*part.schema.names[:-1], "score", "predicted"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{types}, score double, predicted int")

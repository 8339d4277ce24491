"""Language of every word, and of a text, by a linear-chain conditional random field.

A word's features are its prefixes and suffixes, its character n-grams, and a lexicon of how often the training texts of
each language use it; transitions between the languages of neighbouring words are learned with them. Training chains are
put together from stretches of texts of several languages, so that the field sees code switching, and their likelihood is
maximized by gradients from forward-backward. A text's language is the one with the highest mean marginal over its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docketlake.llm.common import Words, blocks, draw, examples, in_one, remainder, sums, utf8, words_of

#: Words of a chain; a longer text is several chains, cut anywhere.
CHAIN = 64
#: Hashed features, lengths of character strings with the word's edges, words of the lexicon.
DIMS, GRAMS, LEXICON = 1 << 16, (2, 3, 4), 50_000
#: Bytes of text whose marginals are worked out at once, and of new words whose features are.
BLOCK, SLICE = 1 << 20, 1 << 18
#: Texts of each language that teach.
PER_LABEL = 300
UNKNOWN = "und"


def letters(word: bytes) -> bytes:
    """The letters of a word in lower case."""
    t = word.decode().lower()
    return (t if t.isalpha() else "".join(c for c in t if c.isalpha())).encode()


def string_hashes(text: np.ndarray, n: int) -> np.ndarray:
    """Feature of each string of ``n`` bytes (given as unsigned 64-bit numbers)."""
    h = np.full(len(text) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ text[k : len(text) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(DIMS)).astype(np.int64)


def slices(words: list[bytes], limit: int) -> list[tuple[int, int]]:
    """Ranges of words that have at most ``limit`` bytes together, or one word."""
    ends = np.cumsum([len(w) for w in words])
    cuts, start = [], 0
    while start < len(words):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        cuts.append((start, stop))
        start = stop
    return cuts


def gram_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed strings of each word between edge marks (so those at an edge are affixes), and the offsets of the words."""
    text = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(words)), size)
    found, owner = [], []
    for n in GRAMS:
        if len(text) < n:
            continue
        h = string_hashes(text, n)
        inside = word[n - 1 :] == word[: len(text) - n + 1]
        found.append(h[inside])
        owner.append(word[: len(text) - n + 1][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return found[order], np.concatenate([[0], np.cumsum(counts)])


def forward_backward(scores: np.ndarray, transitions: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the labels at each place of each chain, and expected counts of label pairs over all chains.

    scores: chains x places x labels; real: which places hold a word (a chain's words come first).
    """
    chains, length, labels = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions)
    forward, backward = np.empty_like(e), np.ones_like(e)
    forward[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        a = (forward[:, t - 1] @ move) * e[:, t]
        forward[:, t] = a / a.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = (e[:, t + 1] * backward[:, t + 1]) @ move.T
        backward[:, t] = np.where(real[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
    marginal = forward * backward
    marginal /= marginal.sum(2, keepdims=True)
    pairs = np.zeros((labels, labels))
    both = real[:, 1:]
    left, right = forward[:, :-1][both], (e[:, 1:] * backward[:, 1:])[both]
    total = np.einsum("ni,ij,nj->n", left, move, right)
    pairs = move * ((left / total[:, None]).T @ right)
    return marginal, pairs


def into_chains(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a ragged array as chains of at most CHAIN places: values, which are real, and each chain's row."""
    n = np.diff(at)
    count = -(-n // CHAIN)
    row = np.repeat(np.arange(len(n)), count)
    first = np.cumsum(count) - count
    begin = at[:-1][row] + (np.arange(len(row)) - first[row]) * CHAIN
    place = begin[:, None] + np.arange(CHAIN)
    real = place < at[1:][row][:, None]
    return flat[np.where(real, place, begin[:, None])], real, row


@dataclass
class Field:
    """Labels, weights of the hashed features, lexicon (word -> shares), its weight, and transitions."""

    labels: list[str]
    weights: np.ndarray
    lexicon: dict[bytes, np.ndarray]
    trust: float
    transitions: np.ndarray
    _words: Words | None = field(default=None, repr=False)

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("labels", "weights", "lexicon", "trust", "transitions")} | {"_words": None}

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Score of each label for each word; the last column says whether it has a letter."""
        clean = [letters(w) for w in words]
        out = np.zeros((len(words), len(self.labels) + 1), np.float32)
        for a, b in slices(clean, SLICE):
            if len(clean[a]) > SLICE:
                out[a, :-1] = self._of_long(clean[a])
            else:
                found, at = gram_features(clean[a:b])
                out[a:b, :-1] = sums(self.weights[found], at)
        none = np.zeros(len(self.labels))
        out[:, :-1] += self.trust * np.array([self.lexicon.get(w, none) for w in clean]).reshape(len(words), -1)
        out[:, -1] = [len(w) > 0 for w in clean]
        out[out[:, -1] == 0, :-1] = 0
        return out

    def _of_long(self, word: bytes) -> np.ndarray:
        """Sum of the weights of a long word's strings, piece by piece."""
        text = np.frombuffer(b"\x02" + word + b"\x03", np.uint8)
        total = np.zeros(len(self.labels))
        for n in GRAMS:
            for k in range(0, len(text) - n + 1, SLICE):
                total += self.weights[string_hashes(text[k : k + SLICE + n - 1].astype(np.uint64), n)].sum(0, dtype=np.float64)
        return total

    def marginals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label marginals of every word of every text, whether the word has a letter, and the offsets of the texts."""
        if self._words is None:
            self._words = Words(self.emissions, limit=400_000)
        words, at = words_of(texts)
        codes = self._words.number(words)
        rows = self._words.rows[codes] if words else np.zeros((0, len(self.labels) + 1), np.float32)
        place, real, _ = into_chains(np.arange(len(words)), at)
        out = np.zeros((len(words), len(self.labels)))
        for k in range(0, len(place), 4096):
            part, is_word = place[k : k + 4096], real[k : k + 4096]
            m, _ = forward_backward(rows[part][:, :, :-1], self.transitions, is_word)
            out[part[is_word]] = m[is_word]
        return out, rows[:, -1] > 0, at

    def judge(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and certainty of every text: means over its words with a letter, 0 where it has none.

        The score is the language's mean marginal, its share of the text. The certainty is the mean of each word's highest
        marginal, whichever language has it, so a text in several languages is as certain as its words. A field without
        labels has nothing to doubt: the language is 'und', the score 0 and the certainty 1.
        """
        if not self.labels:
            certain = [float(any(letters(w) for w in t.split())) for t in texts]
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.array(certain, np.float64)
        m, has_letter, at = self.marginals(texts)
        total = sums(m * has_letter[:, None], at)
        n = sums(has_letter.astype(np.int64), at)
        mean = total / np.maximum(n, 1)[:, None]
        best = mean.argmax(1)
        label = [self.labels[b] if c else UNKNOWN for b, c in zip(best, n)]
        certain = sums(m.max(1) * has_letter, at) / np.maximum(n, 1)
        return label, np.where(n > 0, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0), certain

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score (mean marginal over the words with a letter) of every text."""
        return self.judge(texts)[:2]


def train(texts: list[bytes], langs: list[str], chains: int = 2000, rounds: int = 60, rate: float = 0.1, ridge: float = 1e-4, seed: int = 3) -> Field:
    """Fit a field to texts of known language. Chains switch language at random places, on average twice."""
    labels = sorted(set(langs))
    number = {x: k for k, x in enumerate(labels)}
    counts: dict[bytes, np.ndarray] = {}
    by_lang = [[] for _ in labels]
    for t, lang in zip(texts, langs):
        words = [w for w in map(letters, t.split()) if w]
        if words:
            by_lang[number[lang]].append(words)
            for w, n in Counter(words).items():
                counts.setdefault(w, np.zeros(len(labels)))[number[lang]] += n
    if not all(by_lang):  # a language without words cannot be learned
        rest = [(t, x) for t, x in zip(texts, langs) if by_lang[number[x]]]
        return train([t for t, _ in rest], [x for _, x in rest], chains, rounds, rate, ridge, seed)
    if not labels:
        return Field([], np.zeros((DIMS, 0)), {}, 0.0, np.zeros((0, 0)))
    size = sum(counts.values())
    lexicon = {}
    for w in sorted(counts, key=lambda w: (-counts[w].sum(), w))[:LEXICON]:
        share = (counts[w] + 0.05) / (size + 0.05 * len(counts))
        lexicon[w] = np.log(share / share.mean()).clip(-4, 4)

    rng = np.random.default_rng(seed)
    words, gold = [], np.zeros((chains, CHAIN), np.int64)
    for c in range(chains):
        filled = 0
        while filled < CHAIN:
            k = int(rng.integers(len(labels)))
            own = by_lang[k][int(rng.integers(len(by_lang[k])))]
            start = int(rng.integers(len(own)))
            take = own[start : start + min(CHAIN - filled, int(rng.integers(4, 40)))]
            gold[c, filled : filled + len(take)] = k
            words += take
            filled += len(take)
    vocabulary = Words()
    code = vocabulary.number(words).reshape(chains, CHAIN)
    found, at = gram_features(list(vocabulary))
    none = np.zeros(len(labels))
    known = np.array([lexicon.get(w, none) for w in vocabulary])
    # a word helps to score itself with what is left of its lexicon entry when it is seen once; half of them go without
    known[rng.random(len(known)) < 0.5] = 0
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(at))
    weights, trust, transitions = np.zeros((DIMS, len(labels))), 0.5, np.zeros((len(labels), len(labels)))
    speed = [np.zeros_like(weights), 0.0, np.zeros_like(transitions)]
    real = np.ones(code.shape, bool)
    wanted = np.zeros((len(labels), len(labels)))
    np.add.at(wanted, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    uses = np.bincount(found, np.bincount(code.ravel(), minlength=len(vocabulary))[owner], DIMS)
    for _ in range(rounds):
        scores = sums(weights[found], at) + trust * known
        marginal, pairs = forward_backward(scores[code], transitions, real)
        miss = -marginal.reshape(-1, len(labels))
        miss[np.arange(len(miss)), gold.ravel()] += 1
        by_word = np.stack([np.bincount(code.ravel(), miss[:, k], len(vocabulary)) for k in range(len(labels))], axis=1)
        steps = [
            np.stack([np.bincount(found, by_word[owner, k], DIMS) for k in range(len(labels))], axis=1) / np.sqrt(uses + 1)[:, None] / np.sqrt(chains) - ridge * weights,
            float((by_word * known).sum()) / code.size,
            (wanted - pairs) / wanted.sum() * len(labels),
        ]
        speed = [0.8 * v + s for v, s in zip(speed, steps)]
        weights, trust, transitions = weights + rate * speed[0], trust + rate * speed[1], transitions + rate * speed[2]
    return Field(labels, weights.astype(np.float32), lexicon, float(trust), transitions)


def training_rows(docs: DataFrame, parts: int = 4, held_out: int = 2, per_label: int = PER_LABEL) -> DataFrame:
    """(doc_id, text, label) of rows drawn from those that may teach: not held out, with text and language."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder("doc_id", parts) != held_out))
    return draw(rows.select("doc_id", "text", F.col("lang").cast("string").alias("label")), per_label)


def fit(rows: DataFrame) -> Field:
    """Fit on drawn rows (doc_id, text, label), of which there are at most about PER_LABEL of each language."""
    drawn = examples(rows)
    return train([r["text"].encode() for r in drawn], [r["label"] for r in drawn])


def _judged(docs: DataFrame, model: Field, keys: list[str]) -> DataFrame:
    """The ``keys``, lang_pred, score and _certainty (``Field.judge``) of every whole text."""
    rows = docs.select(*keys, utf8("text").alias("text"))

    def run(batches):
        for batch in batches:
            for part in blocks(batch, limit=BLOCK):
                label, score, certain = model.judge(part.column("text").to_pylist())
                own = [part.column(k) for k in range(part.num_columns - 1)]
                found = [pa.array(label, pa.string()), pa.array(score), pa.array(certain)]
                yield pa.RecordBatch.from_arrays([*own, *found], [*part.schema.names[:-1], "lang_pred", "score", "_certainty"])

    kept = [f for f in rows.schema if f.name != "text"]
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("_certainty", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*kept, *new]))


def identify(docs: DataFrame, model: Field, keys: list[str]) -> DataFrame:
    """Language of every whole text: the ``keys``, lang_pred ('und' without a letter, also for null), score (0 to 1)."""
    return _judged(docs, model, keys).drop("_certainty")


def keep_identified(docs: DataFrame, model: Field, least: float = 0.4) -> DataFrame:
    """``docs`` with its columns, without texts that have no letter (or are null) or whose words are less certain.

    Texts that mix languages stay if the language of their words is clear; without labels every text with a letter stays.
    """

    def certain(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = blocks(pa.RecordBatch.from_arrays([column], ["text"]), limit=BLOCK)
            yield pa.array(np.concatenate([np.zeros(0), *(model.judge(p.column(0).to_pylist())[2] for p in parts)]))

    # only the text goes to Python; the row stays where it is
    certainty = F.arrow_udf(certain, "double").asNondeterministic()
    judged = in_one(docs).withColumn("_certainty", certainty(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")))
    return judged.where((F.col("_certainty") > 0) & (F.col("_certainty") >= least)).select("row.*")


def label_words(docs: DataFrame, model: Field) -> DataFrame:
    """(doc_id, place, word, lang, score) of every word with a letter: the field's own output for code-switched text."""
    rows = docs.select("doc_id", utf8("text").alias("text"))

    def run(batches):
        for batch in batches:
            for part in blocks(batch, limit=BLOCK):
                texts = part.column("text").to_pylist()
                words, at = words_of(texts)
                if not words or not model.labels:
                    continue
                m, has_letter, _ = model.marginals(texts)
                doc = np.repeat(np.arange(len(texts)), np.diff(at))
                pick = np.flatnonzero(has_letter)
                best = m[pick].argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc[pick])), pa.array(pick - at[doc[pick]]), pa.array([words[k].decode() for k in pick], pa.string()),
                        pa.array([model.labels[b] for b in best], pa.string()), pa.array(m[pick, best]),
                    ],
                    ["doc_id", "place", "word", "lang", "score"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, place long, word string, lang string, score double")

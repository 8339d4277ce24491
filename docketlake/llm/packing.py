"""Packing along a space-filling curve.

Documents become token ids; a hashed vector of each is projected to three numbers, and the Hilbert key of that point orders
the corpus so that documents with similar words are neighbours. The documents are then laid end to end along the curve and
cut every ``length`` tokens: only the last sequence of all has padding.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from docketlake.llm.common import Words, blocks, spread, sums, utf8
from docketlake.session import materialize

LENGTH = 4096
END = 2
#: Hashed dimensions of a document vector, dimensions of the curve, bits of each.
HASHED, DIMS, BITS = 256, 3, 10
_PUNCTUATION = b'.,;:!?*#$%&()|"'
#: Printable characters of ASCII and Latin-1: composed already, with one lower case each, no white space.
_LATIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u00ff]+")


class TokenIds(Words):
    """Token ids of whole texts, worked out word by word.

    The tokenizer drops white space and never joins what it separates, so a text has the ids of its words one after another,
    and a trailing run of punctuation after a letter or digit has ids of its own. Texts that may hold the string of an added
    token are encoded whole.
    """

    def __init__(self, path: str, limit: int = 1_000_000, end: int = 0):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for words that its normalizer would only put in lower case
        self.plain.normalizer = None
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.table = projection(max(self.vocabulary, end + 1))  # a word's place is the sum of its ids' places
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        super().__init__(self._describe, limit)

    def _encode(self, words: list[bytes]) -> dict[bytes, list[int]]:
        text = {w: w.decode() for w in words}
        plain = [w for w, t in text.items() if _LATIN.fullmatch(t)]
        rest = [w for w, t in text.items() if not _LATIN.fullmatch(t)]
        ids = dict(zip(plain, (e.ids for e in self.plain.encode_batch_fast([text[w].lower() for w in plain], add_special_tokens=False))))
        return ids | dict(zip(rest, (e.ids for e in self.tokenizer.encode_batch_fast([text[w] for w in rest], add_special_tokens=False))))

    def _describe(self, fresh: list[bytes]) -> np.ndarray:
        if not self.filled:
            self.used = 0
        parts, need = [], {}
        for w in fresh:
            base = w.rstrip(_PUNCTUATION)
            cut = 0 < len(base) < len(w) and w[:1].isalnum() and base[-1:].isalnum()
            parts.append((base, w[len(base):]) if cut else (w,))
            need.update(dict.fromkeys(parts[-1]))
        ids = self._encode(list(need))
        rows = np.empty((len(fresh), 2 + DIMS))  # start and length of its ids, and its place; whole numbers stay exact
        new: list[int] = []
        for k, ps in enumerate(parts):
            rows[k, 0] = self.used + len(new)
            for p in ps:
                new += ids[p]
            rows[k, 1] = self.used + len(new) - rows[k, 0]
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        rows[:, 2:] = sums(self.table[np.array(new, np.int64)], np.append(rows[:, 0] - self.used, len(new)).astype(np.int64))
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)
        return rows

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and the offsets of the texts in them."""
        return self.placed(texts, end)[:2]

    def placed(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, the offsets of the texts in them, and each text's mean place."""
        found = [[] if b"<|" in t else t.lower().split() for t in texts]
        words = [w for ws in found for w in ws]
        codes = self.number(words)
        told = self.rows[codes] if len(codes) else np.zeros((0, 2 + DIMS))
        starts, lengths = told[:, :2].T.astype(np.int64)
        ids = spread(self.flat, starts, lengths)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(w) for w in found], out=at[1:])
        counts = sums(lengths, at)
        whole = {k: e.ids for k, e in ((k, self.tokenizer.encode(t.decode(), add_special_tokens=False)) for k, t in enumerate(texts) if b"<|" in t)}
        place = np.repeat(self.table[end][None].astype(np.float64), len(texts), axis=0)
        filled = np.flatnonzero(np.diff(at))
        if len(filled):
            place[filled] += np.add.reduceat(told[:, 2:], at[filled])
        for k, own in whole.items():
            counts[k] = len(own)
            place[k] += self.table[own].sum(0, dtype=np.float64)
        out_at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(counts + 1, out=out_at[1:])
        out = np.empty(out_at[-1], np.uint32)
        body = np.ones(len(out), bool)
        body[out_at[1:] - 1] = False
        for k, own in whole.items():
            out[out_at[k] : out_at[k + 1] - 1] = own
            body[out_at[k] : out_at[k + 1]] = False
        out[body] = ids
        out[out_at[1:] - 1] = end
        return out, out_at, place / np.diff(out_at)[:, None]


@lru_cache(2)
def token_ids(path: str, end: int) -> TokenIds:
    return TokenIds(path, end=end)


@lru_cache(2)
def projection(size: int, seed: int = 7) -> np.ndarray:
    """Each token's share in the projected vector of its document: a signed hash dimension, seen along random axes."""
    rng = np.random.default_rng(seed)
    axes = rng.normal(size=(HASHED, DIMS))
    return (axes[rng.integers(0, HASHED, size)] * rng.choice([-1.0, 1.0], (size, 1))).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of points with whole coordinates under 2**bits."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of the curve from the coarsest cell to the finest
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where(x[dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(mean: np.ndarray) -> np.ndarray:
    """Hilbert key of each document's mean projected vector."""
    cells = (0.5 + np.arctan(8 * mean) / np.pi) * (1 << BITS)
    return hilbert(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64))


def _tokenize(path: str, end: int):
    def run(batches):
        tokens = token_ids(path, end)
        kind = np.dtype("<u2") if len(tokens.table) <= 1 << 16 else np.dtype("<u4")
        for batch in batches:
            for part in blocks(batch):
                ids, at, mean = tokens.placed(part.column("text").to_pylist(), end)
                keys = curve_keys(mean)
                data = ids.astype(kind).tobytes()
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * kind.itemsize).tobytes()), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("doc_id"), pa.array(keys), pa.array(np.diff(at)), binary], ["rid", "doc_id", "key", "n", "ids"]
                )

    return run


def tokenized(docs: DataFrame, path: str, end: int = END, id_type: str = "long") -> DataFrame:
    """(rid, doc_id, key, n, ids): token ids (with the end id) and curve key of each row. A null text counts as empty."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", utf8("text").alias("text"))
    return rows.mapInArrow(_tokenize(path, end), f"rid long, doc_id {id_type}, key long, n long, ids binary")


def starts_along_curve(rows: DataFrame) -> DataFrame:
    """(rid, start): tokens that lie before each row (rid, key, n) in curve order; ties keep the order of rid.

    Rows are range-partitioned, so equal keys may spread over partitions; sums per partition give each its start.
    """
    ranged = materialize(rows.repartitionByRange("key", "rid").withColumn("part", F.spark_partition_id()), "curve-order")
    totals = ranged.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))  # a row per partition
    within = F.sum("n").over(Window.partitionBy("part").orderBy("key", "rid")) - F.col("n")
    return ranged.join(F.broadcast(before), "part").select("rid", (within + F.col("base")).alias("start"))


def _cut(length: int, wide: bool):
    kind = np.dtype("<u4") if wide else np.dtype("<u2")

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, begin, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "n", "ids"))):
                ids = np.frombuffer(data, kind).astype("<u4")
                edges = [0, *range(length - begin % length, n, length), n]
                for a, b in zip(edges, edges[1:]):
                    for column, value in zip(out, (doc, a, b - a, zlib.crc32(ids[a:b]), n, (begin + a) // length, (begin + a) % length)):
                        column.append(value)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in out[1:])], names)

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pack ``docs`` (doc_id, text; other columns are ignored) into sequences of at most ``length`` tokens.

    One row per piece of a document: doc_id, start (its document's tokens before it), length, ids_crc32, doc_tokens,
    sequence_id, offset. Each document is its ids and ``end``; a null or empty text is ``end`` alone; repeated rows and null
    ids are packed like any others; no rows give no pieces.
    """
    from tokenizers import Tokenizer

    id_type = docs.schema["doc_id"].dataType.simpleString()
    wide = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1) > 1 << 16
    rows = materialize(tokenized(docs, tokenizer, end, id_type), "token-ids")
    placed = rows.select("rid", "doc_id", "n", "ids").join(starts_along_curve(rows.select("rid", "key", "n")), "rid")
    pieces = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.select("doc_id", "start", "n", "ids").mapInArrow(_cut(length, wide), pieces)

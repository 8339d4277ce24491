"""BPE encoding by a pair occurrence index, and decoding.

A block of texts is cut into words and each distinct piece of a word is encoded once. All pieces of the block lie in one row
of symbols; an index maps each mergeable pair to every place where it stands, active ranks are taken in ascending order, a
merge is carried out at all places of its pair, and only the lists of the pairs beside those places change.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from docketlake.llm.common import Words, blocks, spread, sums, utf8

#: Bytes of text in a block, and ids decoded at once: a text's ids and decoded form are several times its size.
BLOCK, SLICE = 1 << 20, 1 << 18
_GONE = -1
_PRINTABLE = re.compile("[!-~]+")


def _plain_pieces(stated: dict):
    """How the file cuts lower-case words of printable ASCII, which its normalizer and byte level leave as they are; else None."""
    steps = [n["type"] for n in (stated.get("normalizer") or {}).get("normalizers", [])]
    cuts = (stated.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return None
    split, level = cuts
    if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
        return None
    return regex.compile(split["pattern"]["Regex"]).findall


class Merges:
    """Vocabulary and merges of a tokenizer file, and the byte-pair merging of many pieces at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model = stated["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("byte_fallback") or model.get("unk_token"):
            raise ValueError(f"{path}: needs a plain BPE model over bytes")
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {a["content"]: a["id"] for a in stated["added_tokens"]}
        if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] or a["content"].split() != [a["content"]] for a in stated["added_tokens"]):
            raise ValueError(f"{path}: added tokens must be plain strings without white space")
        if stated.get("decoder"):
            raise ValueError(f"{path}: tokens are joined by spaces, a decoder is not applied")
        self.plain_pieces = _plain_pieces(stated)
        self.width = 1 + max([*self.vocab.values(), *self.added.values()])
        self.left, self.right, self.made, self.rank = [], [], [], {}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = self.vocab[a], self.vocab[b]
            self.rank[left * self.width + right] = len(self.made)
            self.left.append(left)
            self.right.append(right)
            self.made.append(self.vocab[a + b])
        self.inside, self.last = (self._by_point(mark) for mark in ("", self.end))
        # a merge whose product takes part in an earlier merge must give way to it: it is carried out place by place
        first = np.full(self.width, len(self.made), np.int64)
        for r in range(len(self.made) - 1, -1, -1):
            first[self.left[r]] = first[self.right[r]] = r
        self.yields = {r for r, made in enumerate(self.made) if first[made] < r}

    def _by_point(self, mark: str, points: int = 512) -> np.ndarray:
        """Id of each one-character token with this mark by its code point; bytes stand for code points below 512."""
        return np.array([self.vocab.get(chr(k) + mark, _GONE) for k in range(points)], np.int64)

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Merged ids of all pieces, one after another, and the number of ids of each piece.

        A piece is a string of the characters that stand for bytes; its last one takes the mark of a word's end.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        total = int(sizes.sum())
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        row = self.inside[points]
        row[np.cumsum(sizes) - 1] = self.last[points[np.cumsum(sizes) - 1]]
        if total and row.min() < 0:
            raise ValueError("the vocabulary lacks a byte")
        owner = np.repeat(np.arange(len(pieces)), sizes)
        after = np.arange(1, total + 1)
        after[np.cumsum(sizes) - 1] = _GONE
        before = np.arange(-1, total - 1)
        before[np.cumsum(sizes) - sizes] = _GONE
        symbol, follows, precedes = row.tolist(), after.tolist(), before.tolist()
        places = self._index(row, after)
        active = list(places)
        heapq.heapify(active)
        width, rank = self.width, self.rank
        while active:
            r = heapq.heappop(active)
            at = places.pop(r, None)
            if at is None:
                continue
            left, right, made = self.left[r], self.right[r], self.made[r]
            at.sort()
            if r in self.yields:
                at, later = self._first_of_each(at, owner, symbol, follows, left, right)
                if later:
                    places[r] = later
                    heapq.heappush(active, r)
            for i in at:
                j = follows[i]
                if symbol[i] != left or j < 0 or symbol[j] != right:
                    continue
                k, h = follows[j], precedes[i]
                symbol[i], symbol[j], follows[i] = made, _GONE, k
                if k >= 0:
                    precedes[k] = i
                    new = rank.get(made * width + symbol[k])
                    if new is not None:
                        if new in places:
                            places[new].append(i)
                        else:
                            places[new] = [i]
                            heapq.heappush(active, new)
                if h >= 0:
                    new = rank.get(symbol[h] * width + made)
                    if new is not None:
                        if new in places:
                            places[new].append(h)
                        else:
                            places[new] = [h]
                            heapq.heappush(active, new)
        left_over = np.array(symbol, np.int64)
        kept = left_over >= 0
        return left_over[kept], np.bincount(owner[kept], minlength=len(pieces))

    def _index(self, row: np.ndarray, after: np.ndarray) -> dict[int, list[int]]:
        """Rank of each mergeable pair -> all places of its left symbol."""
        at = np.flatnonzero(after >= 0)
        pairs, inverse = np.unique(row[at] * self.width + row[at + 1], return_inverse=True)
        ranks = np.array([self.rank.get(p, _GONE) for p in pairs.tolist()], np.int64)[inverse] if len(pairs) else inverse
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0):]
        cuts = np.flatnonzero(np.diff(ranks[order])) + 1
        return {int(ranks[part[0]]): at[part].tolist() for part in np.split(order, cuts) if len(part)}

    @staticmethod
    def _first_of_each(at, owner, symbol, follows, left, right) -> tuple[list[int], list[int]]:
        """The first place of a pair in each piece, and the places that wait for the pairs this one makes."""
        first, later, last = [], [], None
        for i in at:
            j = follows[i]
            if symbol[i] == left and j >= 0 and symbol[j] == right:
                if owner[i] == last:
                    later.append(i)
                else:
                    first.append(i)
                    last = owner[i]
        return first, later


class Encoder(Words):
    """Token ids of whole texts under a tokenizer that drops white space, word by word."""

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.pieces_of = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.plain = self.merges.plain_pieces
        added = sorted(self.merges.added, key=len, reverse=True)
        self.marked = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        super().__init__(self._describe, limit)

    def _describe(self, fresh: list[bytes]) -> np.ndarray:
        """(start, length) of each new word's ids in ``flat``."""
        if not self.filled:
            self.used = 0
        numbers: dict[str, int] = {}  # distinct pieces; an added token is a negative number instead
        found, counts = [], []
        for word in fresh:
            before = len(found)
            self._cut(word.decode(), numbers, found)
            counts.append(len(found) - before)
        ids, sizes = self.merges.merge(list(numbers))
        refs = np.array(found, np.int64)
        added = refs < 0
        ids = np.concatenate([ids, -1 - refs[added]])
        starts, lengths = np.ones((2, len(refs)), np.int64)
        starts[added] = len(ids) - np.arange(added.sum(), 0, -1)
        starts[~added], lengths[~added] = (np.cumsum(sizes) - sizes)[refs[~added]], sizes[refs[~added]]
        new = spread(ids, starts, lengths)
        at = np.zeros(len(fresh) + 1, np.int64)
        np.cumsum(counts, out=at[1:])
        per_word = sums(lengths, at)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        rows = np.stack([self.used + np.cumsum(per_word) - per_word, per_word], axis=1)
        self.used += len(new)
        return rows

    def _cut(self, word: str, numbers: dict[str, int], found: list[int]) -> None:
        """Append the numbers of the word's pieces."""
        if self.marked and self.marked.search(word):
            for k, segment in enumerate(self.marked.split(word)):
                if k % 2:
                    found.append(-1 - self.merges.added[segment])
                elif segment:
                    found += [numbers.setdefault(piece, len(numbers)) for piece, _ in self.pieces_of(self.normalize(segment))]
        elif self.plain and _PRINTABLE.fullmatch(word):
            found += [numbers.setdefault(piece, len(numbers)) for piece in self.plain(word.lower())]
        else:
            found += [numbers.setdefault(piece, len(numbers)) for piece, _ in self.pieces_of(self.normalize(word))]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of the texts in them."""
        found = [t.split() for t in texts]
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(w) for w in found], out=at[1:])
        codes = self.number([w for ws in found for w in ws])
        starts, lengths = self.rows[codes].T if len(codes) else np.zeros((2, 0), np.int64)
        counts = sums(lengths, at)
        return spread(self.flat, starts, lengths), np.concatenate([[0], np.cumsum(counts)])


class Decoder:
    """Token strings of ids, joined by a space; ids without a token are left out."""

    def __init__(self, path: str):
        merges = Merges(path)
        tokens = {number: token for token, number in (merges.vocab | merges.added).items()}
        strings = [(tokens[k].encode() + b" ") if k in tokens else b"" for k in range(merges.width)]
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """A whole text of one row of ids."""
        parts = []
        for k in range(0, len(ids), SLICE):
            some = ids[k : k + SLICE].astype(np.int64)
            some = some[(some >= 0) & (some < len(self.lengths))]
            parts.append(spread(self.flat, self.starts[some], self.lengths[some]).tobytes())
        return b"".join(parts)[:-1]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _id_lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _decoded(ids: np.ndarray, at: np.ndarray, path: str) -> pa.Array:
    own = decoder(path)
    return pa.array([own.decode(ids[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())


def encode(docs: DataFrame, path: str, keys: list[str], text: str = "text", decoded: bool = False) -> DataFrame:
    """The ``keys`` and ids (array of int) of every whole text, as the tokenizer of ``path`` gives without special tokens.

    With ``decoded``, also the text that the ids decode to. A null or empty text has no ids and decodes to an empty one. Rows are
    handled one by one, so repeated rows and null keys stay; other columns are ignored; no rows give none. The strings of
    added tokens are those tokens. Names of ``keys`` do not clash with ids, decoded or the text's.
    """
    rows = docs.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("row"), utf8(text).alias("text"))

    def run(batches):
        own = encoder(path)
        for batch in batches:
            for part in blocks(batch, limit=BLOCK):
                ids, at = own.encode(part.column("text").to_pylist())
                columns = [part.column("row"), _id_lists(ids, at), *([_decoded(ids, at, path)] if decoded else [])]
                yield pa.RecordBatch.from_arrays(columns, ["row", "ids", "decoded"][: len(columns)])

    found = [rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *([T.StructField("decoded", T.BinaryType())] if decoded else [])]
    made = rows.mapInArrow(run, T.StructType(found))
    return made.select("row.*", "ids", *([F.col("decoded").cast("string").alias("decoded")] if decoded else []))


def decode(rows: DataFrame, path: str, keys: list[str], ids: str = "ids") -> DataFrame:
    """The ``keys`` and the text that each array of ids decodes to; null decodes to an empty text, null and unknown ids are left out."""
    given = rows.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("row"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().fill_null(_GONE).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([batch.column("row"), _decoded(flat, at, path)], ["row", "decoded"])

    made = given.mapInArrow(run, T.StructType([given.schema["row"], T.StructField("decoded", T.BinaryType())]))
    return made.select("row.*", F.col("decoded").cast("string").alias("decoded"))

"""BPE by pair occurrence index against the tokenizers library and a plain word-by-word merge."""

import json
import random
from collections import Counter
from functools import lru_cache
from hashlib import sha256

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docketlake.llm import bpe

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
ALPHABET = ["a", "e", "th", "in", "İ", "Σ", "ς", "ß", "é", "é", "H̱", " ", " ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'s", "'S",
            "!", "!!", "123", "½", "你好", "👍🏽", "ẞ", "​", "\x1c", "\x85", "\n", "abab", "aaaa", "ﬁ", "١", "the", "ing", "Zz"]


@lru_cache(1)
def loaded():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return loaded()


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join) | st.text(max_size=40))
def test_any_text_as_the_library(text):
    ids, at = bpe.encoder(PATH).encode([text.encode("utf-8", "replace")])
    want = wanted(loaded(), text.encode("utf-8", "replace").decode())
    assert ids.tolist() == want[0] and at.tolist() == [0, len(ids)]
    assert bpe.decoder(PATH).decode(ids).decode() == want[1]


def test_every_row_is_encoded_and_decoded(spark, library):
    rng = random.Random(3)
    texts = [None, "", " \n ", "x", "<|endoftext|> and <|startoftext|>s", "z" * 60_000, " ".join(f"word{rng.randrange(9**6)}," for _ in range(90_000)), "same words", "same words"]
    rows = [(k, t, "clash", [7]) for k, t in enumerate(texts)] + [(None, "no id", "clash", None), (None, None, None, None), (7, "same words", "clash", [7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>").repartition(2)
    got = bpe.encode(docs, PATH, ["doc_id"], decoded=True)
    have = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got.collect())
    assert have == Counter((r[0], tuple(wanted(library, r[1])[0]), wanted(library, r[1])[1]) for r in rows)
    again = bpe.decode(got.drop("decoded"), PATH, ["doc_id"])
    assert Counter(map(tuple, again.collect())) == Counter((r.doc_id, r.decoded) for r in got.collect())


def test_no_rows_and_odd_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, PATH, ["doc_id"], decoded=True).collect() == []
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0, None, -5, 10**6, 1])], "doc_id long, ids array<int>")
    tokens = {v: k for k, v in json.load(open(PATH, encoding="utf-8"))["model"]["vocab"].items()}
    assert {r.doc_id: r.decoded for r in bpe.decode(odd, PATH, ["doc_id"]).collect()} == {1: "", 2: "", 3: f"{tokens[0]} {tokens[1]}"}


def test_the_word_table_may_be_emptied_between_blocks(library):
    small, rng = bpe.Encoder(PATH, limit=50), random.Random(8)
    texts = [" ".join(f"{rng.choice(['un', 're', 'over'])}{rng.choice(['load', 'think', 'ünd'])}{rng.randrange(500)}" for _ in range(40)) for _ in range(60)]
    for k in range(0, 60, 7):
        ids, at = small.encode([t.encode() for t in texts[k : k + 7]])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [wanted(library, t)[0] for t in texts[k : k + 7]]


def _plain(word, merges, end):
    s = [*word[:-1], word[-1] + end]
    while True:
        best = min((merges.get((a, b), 10**9), k) for k, (a, b) in enumerate(zip(s, s[1:]))) if len(s) > 1 else (10**9, 0)
        if best[0] == 10**9:
            return s
        s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]


def test_merges_whose_product_stands_in_an_earlier_merge(tmp_path):
    """A string made in two ways: its later merge gives way, place by place, to the earlier merges that use the string."""
    merges = [("b", "c"), ("a", "bc"), ("abc", "a"), ("abca", "b"), ("a", "b"), ("ab", "c"), ("c", "a"), ("ca", "ca"), ("abc", "ab"), ("a", "a"), ("aa", "b")]
    merges.insert(0, ("abc", "aa"))  # uses a string that later merges make
    rng = random.Random(2)
    for turn in range(40):
        if turn:
            rng.shuffle(merges)
        tokens = sorted({c for m in merges for c in (*m, "".join(m))} | set("abc"))
        vocab = {t: k for k, t in enumerate(tokens)}
        stated = {"added_tokens": [], "decoder": None, "normalizer": None, "pre_tokenizer": None, "model": {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]}}
        path = tmp_path / f"t{turn}.json"
        path.write_text(json.dumps(stated))
        model = bpe.Merges(str(path))
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 24))) for _ in range(60)]
        ids, sizes = model.merge(pieces)
        rank = {m: k for k, m in reversed(list(enumerate(merges)))}
        assert [tokens[i] for i in ids] == [t for p in pieces for t in _plain(p, rank, "")]
        assert sizes.tolist() == [len(_plain(p, rank, "")) for p in pieces]


def test_query_gives_digests(spark, library):
    from docketlake.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op13_pair_index_bpe"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, text = wanted(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest())

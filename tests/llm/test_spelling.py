"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from docketlake.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, near string, root string, side string, half string, i int, b int"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(rows, min_length=6, min_count=5, ratio=5, every=199):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return out


def made(seed=1):
    rng = random.Random(seed)
    base = ["language", "languages", "straße", "STRASSE", "naïveté", "Überlegung", "aaaaaa", "aaaaaaa", "aaaaaaaa", "abcabc", "abcabcabc", "queue", "queues", "z" * 300] + ["".join(rng.choices("abé", k=rng.randrange(5, 9))) for _ in range(60)]
    rows = []
    for k in range(150):
        words = []
        for _ in range(rng.randrange(0, 60)):
            w = rng.choice(base[: rng.choice([3, 10, 74])])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "y" + w[at + 1 :]])
            words.append(w)
        rows.append((k, rng.choice([" ", "-", "1", "\n"]).join(words)))
    rows += [(200, None), (201, ""), (None, "language " * 20), (None, None), rows[5], rows[5], (202, "12 !"), (203, " ".join(f"Wörter{chr(97 + k % 7)}{'m' * (k % 3)}" for k in range(120_000)))]
    return [(*r, "clash", 1, "clash", "clash", "p", "clash", 3, 4) for r in rows]


@pytest.mark.parametrize("options", [{}, {"every": 3}, {"every": 2, "min_count": 2, "ratio": 2, "tile": 40}, {"every": 1, "min_length": 2, "min_count": 1, "ratio": 1.5, "tile": 300}])
def test_equals_comparison_of_all_pairs(spark, options):
    rows = made()
    got = spelling.group_variants(spark.createDataFrame(rows, SCHEMA).repartition(4), **options).collect()
    own = {k: v for k, v in options.items() if k != "tile"}
    want = brute(rows, **own)
    assert len(got) == len(want) and {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want


def test_near_words_once_each_way(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("ab", k=rng.randrange(1, 9))) for _ in range(250)})
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    for tile in (8, 64, 1 << 16):
        got = [(r.word, r.near) for r in spelling.near_words(table, tile).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_no_words(spark):
    assert spelling.group_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.group_variants(spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")).collect() == []


def test_long_chains_end_at_one_root(spark):
    chain = ["a" * k for k in range(1, 40)]
    links = spark.createDataFrame(list(zip(chain, chain[1:])) + [("x", "y")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(links).collect()} == {(w, chain[-1]) for w in chain[:-1]} | {("x", "y")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abß", min_size=1, max_size=7), max_size=40, unique=True), st.integers(1, 9))
def test_blocks_of_any_size_find_the_same_pairs(words, rows):
    for longest in range(2, 9):
        group = sorted(w for w in words if len(w) in (longest, longest - 1))
        a, b = spelling.near_pairs(group, np.zeros(len(group), np.int64), np.full(len(group), -1), np.full(len(group), 2 * longest), rows)
        want = {(x, y) for x in range(len(group)) for y in range(x + 1, len(group)) if one_edit(group[x], group[y]) and max(len(group[x]), len(group[y])) == longest}
        assert len(a) == len(want) and set(zip(a.tolist(), b.tolist())) == want

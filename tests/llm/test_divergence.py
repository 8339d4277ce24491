"""Source divergence against plain counting in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docketlake.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, docs long, shard int, value long, rank int"


def brute(rows, min_docs, top=10):
    rows = [(r[1] or "", r[2] or "", r[3] or "") for r in rows]
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = TERM.findall("".join(c.lower() if c.isascii() else c for c in text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=str.encode)

        def shares(count):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(pairs)}
            terms = sorted(((-f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, t) in enumerate(terms)}
    return out


def rows_of(n=160):
    rng = random.Random(5)
    lexicon = ["Über", "ÜBER", "the", "THE", "naïve", "x", "日本", "a_b", "don't", "z" * 400] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(n):
        lang, source = rng.choice(["de", "en", "en", "en", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "ß", None])
        rows.append((k, " ".join(rng.choices(lexicon, k=rng.randrange(0, 40))), lang, source))
    rows += [(200, None, "xx", "s1"), (201, "", "xx", "s2"), (202, "12 34 !", "xx", None), (203, "lonely words", "yy", "only"), rows[3], rows[3], (None, None, None, None)]
    rows += [(300, " ".join(f"long{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(90_000)), "de", "s2")]
    return [(*r, "clash", 1, 2, 3, 4, 5) for r in rows]


@pytest.mark.parametrize("min_docs, cells", [(10, 500_000), (1, 60), (2, 7), (1000, 10)])
def test_equals_plain_counting(spark, min_docs, cells):
    rows = rows_of()
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(4), min_docs, cells).collect()
    assert [r.__fields__ for r in got[:1]] in ([], [["lang", "source", "part", "item", "value", "rank"]])
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, min_docs)


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_partial_counts_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 40)
    rows = rows_of()
    texts = [pa.array([r[k] or "" for r in rows], pa.string()) for k in (2, 3, 1)]
    batch = pa.RecordBatch.from_arrays([texts[0], texts[1], texts[2].cast(pa.binary())], ["lang", "source", "text"])
    parts = [p for k in range(0, len(rows), 9) for p in [batch.slice(k, 9)]]
    merged = divergence.merge_counts([pa.Table.from_batches([b]) for b in divergence._partials(iter(parts))])
    whole = divergence.merge_counts([divergence.count_block(*texts)])
    assert sorted(map(tuple, (r.values() for r in merged.to_pylist()))) == sorted(map(tuple, (r.values() for r in whole.to_pylist())))


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    for _ in range(300):
        total = rng.randrange(5, 9 * 10**15)
        count = rng.randrange(0, total - 1)
        assert int(divergence.shares(np.array([count]), total)[0]) == 1 + 10**9 * (count + 2) // total

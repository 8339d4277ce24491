"""Operators against brute force on small rows: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlake.llm import crf, group_join, line_dedup, media, mixing, packing, preference, rules, toxicity, warc

BPE = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, score double, text_id string, rid long, key string, n int, _doc long, words string"
EXTRA = (0.5, "clash", 7, "clash", 3, 9, "clash")


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [words(rng, 120) for _ in range(12)]
    near = []
    for k in range(30):  # a group of near copies
        w = base[0].split()
        w[rng.randrange(len(w))] = f"edit{k}"
        near.append(" ".join(w))
    lines = ["\n".join([words(rng, 12), "the very same line of words here", words(rng, 9)]) for _ in range(5)]
    return [None, "", " \n\t ", "a", "Ünïcode x   y", "!!! 123", "x\n\n x \nx", *base, *near, *lines, base[1], base[1], words(rng, 30_000), "z" * 200_000]


@pytest.fixture(scope="module")
def rows(texts):
    made = [(k, t, "de" if k % 3 else None, None if k % 5 == 0 else f"s{k % 2}") for k, t in enumerate(texts)]
    made += [(None, "some text without an id", "de", "s1"), (None, None, None, None), made[8], made[8]]
    return [(*r, *EXTRA) for r in made]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def jaccard(a, b):
    return len(a & b), len(a | b)


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


# quality rules


def base_counts(text):
    w = (text or "").encode().split()
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_count_and_keep(docs, rows):
    got = rules.quality_rules(docs).collect()
    assert len(got) == len(rows)
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert have == Counter((r[0], *base_counts(r[1])) for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.kept and r.base_failed) for r in got)


def test_sketches_merge_and_bound_their_error(spark):
    values = spark.range(5000).select(F.expr("CAST(id * id % 90000 AS BIGINT)").alias("v"))
    binned = values.select("v", rules.bucket("v").alias("bucket"))
    wrong = binned.withColumn("low", rules.floor_of("bucket")).where("low > v OR v - low > v / 32").count()
    assert wrong == 0
    stats = values.select(F.lit("x").alias("lang"), (F.col("v") % 3).cast("string").alias("source"), F.col("v").alias("word_chars"), F.lit(7).alias("n_words"), F.lit(1).alias("n_symbols"), F.lit(1).alias("n_lines"), F.lit(0).alias("n_dup_lines"), F.lit(0).alias("n_repeat_words"))
    parts = rules.merge(rules.sketch(stats.where("word_chars % 2 = 0"), ["lang", "source"]).unionByName(rules.sketch(stats.where("word_chars % 2 = 1"), ["lang", "source"])), ["lang"])
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, rules.sketch(stats, ["lang"]).collect()))


def test_words_beyond_21_bits_are_counted_apart(spark):
    # two windows that fall together where a code has 21 bits
    far = np.array([0, 1 << 21, 5, 1, 0, 5, 9, 9, 0, 1 << 21, 5])
    assert rules.repeated_words(far, np.array([0, 11])).tolist() == [6]
    assert rules.repeated_words(far[:8], np.array([0, 8])).tolist() == [0]
    wide = np.array([1 << 30, 2, 3, 1 << 30, 2, 4, 7, 2, 3, 1 << 30, 2, 3])
    assert rules.repeated_words(wide, np.array([0, 9, 12])).tolist() == [0, 0]
    assert rules.repeated_words(wide, np.array([0, 12])).tolist() == [10]
    n = (1 << 21) + 1000
    long = " ".join(map(str, range(n))) + " a b c x a b c"
    counts = rules.measure(spark.createDataFrame([(1, long)], "doc_id long, text string"), ["doc_id"]).first()
    assert (counts.n_words, counts.n_repeat_words) == (n + 7, 6)
    named = dict(zip(preference.NAMED, preference.features([b"short text", long.encode()])[1]))
    assert named["distinct"] == pytest.approx((n + 4) / (n + 7)) and named["repeat"] == pytest.approx(6 / (n + 7))


def test_a_word_has_its_whole_shape():
    assert preference._shape("ab1-" * 10 + "Z") == "a0-" * 10 + "A" != preference._shape("ab1-" * 10)


# packing


def test_packing_places_every_token_once(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    got = packing.pack(docs, BPE).collect()
    want = Counter()
    for r in rows:
        want[(r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids + [2]))] += 1
    lengths = Counter()
    for (doc, ids), n in want.items():
        lengths[doc] += n * len(ids)
    have = Counter()
    for r in got:
        have[r.doc_id] += r.length
    assert have == lengths
    by_doc = {doc: np.array(ids, "<u4") for (doc, ids), n in want.items() if doc is not None}
    assert all(zlib.crc32(by_doc[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 for r in got if r.doc_id is not None)
    at = sorted((r.sequence_id, r.offset, r.length) for r in got)
    ends = [s * packing.LENGTH + o + n for s, o, n in at]
    assert [s * packing.LENGTH + o for s, o, _ in at] == [0, *ends[:-1]] and all(o + n <= packing.LENGTH for _, o, n in at)


def test_words_have_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    alphabet = ["a", "B", "é", "É", "é", "'s", "'LL", " ", "\n", "\u0085", "\x1c", "²", "ß", "İ", "Σ", "K", "...", "!?", "<|endoftext|>", "<|ENDOFTEXT|>", "'", "1", "_", "|", "<", "日本", "\x01", "µ", "."]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    ids, at = packing.TokenIds(BPE, limit=500).encode([x.encode() for x in made], 2)
    t = Tokenizer.from_file(BPE)
    assert all(ids[a:b].tolist() == t.encode(x, add_special_tokens=False).ids + [2] for x, a, b in zip(made, at, at[1:]))


def test_hilbert_curve_steps_to_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = packing.hilbert(grid, 3)
    path = grid[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# near duplicates


def components(pairs, ids):
    low = {i: i for i in ids}

    def find(a):
        while low[a] != a:
            a = low[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_components_are_those_of_all_pairs(docs, rows, size, percent):
    sets = [(k, shingles(r[1], size)) for k, r in enumerate(rows)]
    pairs = [(a, b) for a, s in sets for b, t in sets if a < b and s and t and 100 * jaccard(s, t)[0] >= percent * jaccard(s, t)[1]]
    group = components(pairs, range(len(rows)))
    least = {}
    for k, r in enumerate(rows):
        least[group[k]] = min((x for x in (least.get(group[k]), r[0]) if x is not None), default=None)
    want = Counter((r[0], len(sets[k][1]), least[group[k]]) for k, r in enumerate(rows))
    assert Counter(map(tuple, group_join.near_duplicates(docs, size, percent).collect())) == want


def test_one_document_of_each_group_stays(docs, rows, texts):
    left = group_join.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    got = left.select("doc_id", "text").collect()
    sets = [shingles(r.text, 5) for r in got]
    assert all(100 * jaccard(a, b)[0] < 80 * jaccard(a, b)[1] for i, a in enumerate(sets) for b in sets[:i] if a and b)
    assert {t for t in texts if not shingles(t, 5)} == {r.text for r in got if not shingles(r.text, 5)}


# lines


def test_lines_go_that_an_earlier_line_matches(docs, rows):
    seen, want = [], {}
    for doc, text in sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0, __import__("hashlib").md5(x[1].encode()).digest())):
        gone, n = [], 0
        for k, line in enumerate(text.lower().split("\n")):
            s = frozenset(line.encode().split())
            if s:
                n += 1
                if any(100 * len(s & t) >= 80 * len(s | t) for t in seen):
                    gone.append(k)
                seen.append(s)
        if n:
            want[(doc, text)] = (n, gone)
    got = {(r.doc_id, bytes(r.text_id)): (r.n_lines, list(r.removed)) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == {(d, __import__("hashlib").md5(t.encode()).digest()): v for (d, t), v in want.items()}
    left = line_dedup.line_dedup(docs)
    assert left.columns == docs.columns
    for r in left.where("doc_id IS NOT NULL").collect():
        original = dict((x[0], x[1]) for x in rows)[r.doc_id]
        n, gone = want.get((r.doc_id, original or ""), (0, []))
        assert r.text == (original if not gone else "\n".join(x for k, x in enumerate(original.split("\n")) if k not in gone))


# media


def test_media_come_back_whole(docs, rows):
    got = media.media_columns(docs, ["doc_id"]).collect()

    def row(text):
        b = (text or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        return len(b), len(p), sha256(p).hexdigest(), zlib.crc32(p[-64:])

    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == Counter((r[0], *row(r[1])) for r in rows)
    assert len({(r.payload_sha256, r.media_sha256, r.media_bytes, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def test_chunks_are_stored_once_and_cut_by_content(docs):
    _, stored = media.store(docs)
    chunks = stored.select(F.explode("chunks").alias("c")).select("c.digest")
    assert chunks.count() == chunks.distinct().count()
    rng = random.Random(2)
    long = words(rng, 20_000).encode()
    a, b = media.chunks([long])[0], media.chunks([b"front " + long])[0]
    assert b"".join(a) == long and max(map(len, a)) <= media.MOST
    assert len({media.digest(x) for x in a} & {media.digest(x) for x in b}) >= len(a) - 3
    assert media.chunks([b"x" * 100, long])[1] == a


# archives


def test_archives_round_trip(spark, tmp_path):
    long = "<html>" + "long page " * 30_000
    made = [(1, "http://a/\nb", "<p>short</p>"), (2, None, None), (3, "http://c", long), (4, "http://d", long), (None, "http://e", long), (6, "http://f", ""), (3, "http://c", long)]
    made += [(k, f"http://x/{k}", f"<html><body>page {k} " + "shared words " * 20) for k in range(10, 60)]
    pages = spark.createDataFrame([(*r, "clash") for r in made], "page_id long, url string, html string, digest string").repartition(2)
    archives = warc.write_archives(pages, archive_bytes=2000)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect())
    want = Counter()
    for page, _, html in made:
        b = (html or "").encode()
        revisit = html == long and page != 3
        want[(page, len(b), sha256(b).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)] += 1
    assert got == want
    assert warc.export(archives, str(tmp_path)) == len(list(tmp_path.glob("*.warc.zst"))) > 1
    first = next(tmp_path.glob("*.warc.zst")).read_bytes()
    assert first[:4] == (0x184D2A5D).to_bytes(4, "little") and list(warc.read_records(first))


# mixing


def test_exponents_meet_their_targets():
    totals = [1000, 400, 90, 10, 0]
    a = mixing.find_exponent(totals, max_repeats=3.0)
    assert max(mixing.repeats(totals, a)) == pytest.approx(3.0) and max(mixing.repeats(totals, a - 0.01)) > 3
    b = mixing.find_exponent(totals, target_entropy=0.9)
    assert mixing.entropy(totals, b) == pytest.approx(0.9) and mixing.weights(totals, b)[4] == 0
    assert mixing.find_exponent([5, 5], 2.0) == 0.0 and mixing.find_exponent([], 2.0) == 0.0


def test_mixture_fills_budgets_with_whole_documents(docs, rows):
    got = mixing.mixture(docs, max_repeats=3.0, block_tokens=500).collect()
    n = {}
    for r in rows:
        n[(r[0], r[3], r[1] or "")] = len((r[1] or "").encode().split())
    first = [r for r in got if r.epoch == 1]
    assert len(first) == len(n) and sum(r.n_tokens for r in first) == sum(n.values())
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        used = sum(r.n_tokens * r.n_rows for r in own)
        assert used <= own[0].run_tokens
        for epoch in {r.epoch for r in own}:
            run = sorted((r.start, r.n_tokens * r.n_rows) for r in own if r.epoch == epoch)
            assert all(a + x <= b for (a, x), (b, _) in zip(run, run[1:]))
    again = mixing.mixture(docs.repartition(5), max_repeats=3.0, block_tokens=500).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    mixed = mixing.mix(docs, max_repeats=3.0)
    assert mixed.columns == docs.columns and mixed.count() >= len(rows)


# models


def test_field_labels_switched_text():
    rng = random.Random(6)
    vocab = {"de": ["schön", "straße", "nicht", "gehen", "haus", "werden"], "en": ["which", "the", "house", "going", "they", "with"]}
    train = [(lang, " ".join(rng.choice(v) for _ in range(60))) for lang, v in vocab.items() for _ in range(20)]
    field = crf.train([t.encode() for _, t in train], [x for x, _ in train], chains=100, rounds=30)
    m, has_letter, _ = field.marginals([b"the house 42 going with nicht haus werden gehen"])
    assert has_letter.tolist() == [True, True, False, *[True] * 6] and m.argmax(1)[has_letter].tolist() == [1, 1, 1, 1, 0, 0, 0, 0]
    assert m.sum(1) == pytest.approx(1)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    scores, move = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    real = np.array([[True] * 4, [True, True, False, False]])
    m, pairs = crf.forward_backward(scores, move, real)
    total_pairs = np.zeros((3, 3))
    for c, n in ((0, 4), (1, 2)):
        weight, own = 0.0, np.zeros((n, 3))
        together = np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            w = np.exp(sum(scores[c, t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            weight += w
            for t, y in enumerate(path):
                own[t, y] += w
            for a, b in zip(path, path[1:]):
                together[a, b] += w
        assert m[c, :n] == pytest.approx(own / weight)
        total_pairs += together / weight
    assert pairs == pytest.approx(total_pairs)


def test_language_of_rows_without_letters_is_unknown(docs, rows):
    field = crf.fit(crf.training_rows(docs))
    got = crf.identify(docs, field, ["doc_id"]).collect()
    want = Counter((r[0], any(c.isalpha() for c in r[1] or "")) for r in rows)
    assert Counter((r.doc_id, r.lang_pred != "und") for r in got) == want
    assert all(0 <= r.score <= 1 for r in got)
    assert crf.keep_identified(docs, field).columns == docs.columns
    assert crf.label_words(docs.where("doc_id = 3"), field).first().word == "a"


def test_mixed_languages_are_kept_and_so_are_all_without_labels(spark):
    rng = random.Random(6)
    vocab = {
        "de": ["schön", "straße", "nicht", "gehen", "haus"], "en": ["which", "the", "house", "going", "they"],
        "fr": ["quelle", "maison", "avec", "pour", "été"], "pl": ["który", "dziękuję", "jest", "wszystko", "być"],
    }
    train = [(lang, " ".join(rng.choice(v) for _ in range(60))) for lang, v in vocab.items() for _ in range(20)]
    field = crf.train([t.encode() for _, t in train], [x for x, _ in train], chains=200, rounds=30)
    parts = {lang: " ".join(rng.choice(v) for _ in range(30)) for lang, v in vocab.items()}
    made = [(1, " ".join(parts[x] for x in ("de", "en", "fr"))), (2, " ".join(parts.values())), (3, parts["pl"]), (4, "123 !!!"), (5, None), (6, "")]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    score = {r.doc_id: r.score for r in crf.identify(docs, field, ["doc_id"]).collect()}
    assert score[1] < 0.4 and score[2] < 0.4
    assert {r.doc_id for r in crf.keep_identified(docs, field).collect()} == {1, 2, 3}
    assert crf.keep_identified(docs, field, 1.01).count() == 0
    blank = crf.fit(crf.training_rows(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert not blank.labels and {r.doc_id for r in crf.keep_identified(docs, blank).collect()} == {1, 2, 3}


def test_models_score_every_row(spark, docs, rows):
    rng = random.Random(8)
    made = [(k, (words(rng, 60) + (" loserish" * (k % 2))) if k % 4 else "bad### " * 40 + " loserish" * (k % 2)) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), k % 2) for k, _ in made] + [(None, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int")
    from docketlake.llm.common import labelled

    corpus = spark.createDataFrame(made, "doc_id long, text string")
    for module, label in ((preference, "quality"), (toxicity, "toxic")):
        model = module.fit(labelled(corpus, labels, label, 4, 2, 100))
        got = module.score(docs, model, ["doc_id"]).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        right = module.score(corpus, model, ["doc_id"]).join(labels.where(f"{label} IS NOT NULL"), "doc_id").where(f"predicted = {label}").count()
        assert right >= 380, (label, right)
        blank = module.fit(labelled(corpus, labels.where("false"), label, 4, 2, 100))
        assert module.score(docs, blank, ["doc_id"]).count() == len(rows)
    assert 30 <= preference.quantile_filter(preference.score(corpus, model if module is preference else preference.fit(labelled(corpus, labels, "quality", 4, 2, 100)), ["doc_id"]), 0.1).count() <= 400


def test_all_labelled_texts_teach_quality(spark):
    """Every labelled text outside the held-out part counts, the fit does not depend on partitions, and the loss of all pairs is least."""
    from docketlake.llm.common import labelled, remainder

    rng = random.Random(9)
    made = [(k, words(rng, rng.randrange(3, 30), 50) + (" ### 12" if rng.random() < (0.2 if k % 3 else 0.6) else "")) for k in range(4200)]
    corpus = spark.createDataFrame(made, "doc_id long, text string")
    labels = corpus.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    teaching = labelled(corpus, labels, "quality", 5, 0)
    taught = {r.doc_id for r in teaching.select("doc_id").collect()}
    assert taught == {r.doc_id for r in corpus.where(remainder("doc_id", 5) != 0).collect()} and len(taught) > 3000
    model = preference.fit(teaching.repartition(1))
    again = preference.fit(teaching.repartition(7))
    assert np.array_equal(model.weights, again.weights) and model.cut == again.cut

    kept = [(k, t) for k, t in made if k in taught]
    strength, bad = model.strength(preference.features([t.encode() for _, t in kept])), np.array([k % 3 == 0 for k, _ in kept])
    assert abs(int((strength < model.cut).sum()) - int(bad.sum())) <= 10

    def loss(s, w):
        return np.mean(np.logaddexp(0, s[bad][None, :] - s[~bad][:, None])) + 0.5e-3 * w @ w

    assert loss(strength, model.weights) < min(loss(0 * strength, 0 * model.weights), loss(strength * 0.8, model.weights * 0.8), loss(strength * 1.25, model.weights * 1.25))


def test_no_rows_give_no_rows(spark, empty):
    assert rules.quality_rules(empty).count() == 0
    assert packing.pack(empty, BPE).count() == 0
    assert group_join.near_duplicates(empty).count() == 0
    assert group_join.drop_near_duplicates(empty).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0
    assert media.media_columns(empty, ["doc_id"]).count() == 0
    assert mixing.mix(empty).count() == 0
    assert crf.keep_identified(empty, crf.fit(crf.training_rows(empty))).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages)).count() == 0


def test_long_words_are_described_in_pieces(monkeypatch):
    """Slices of new words and pieces of one long word give what all of them give at once."""
    rng = random.Random(6)
    langs = {"de": ["haus", "nicht", "schön", "werden"], "en": ["house", "not", "nice", "would"]}
    texts, labels = zip(*[(" ".join(rng.choices(langs[x], k=30)).encode(), x) for x in ("de", "en") for _ in range(20)])
    field = crf.train(list(texts), list(labels), chains=50, rounds=5)
    words = [b"haus", b"x" * 3000, "schön".encode() * 500, b"12", b"", b"would" * 77, *(f"w{k}".encode() for k in range(300))]
    whole = field.emissions(words)
    for size in (7, 64, 1000):
        monkeypatch.setattr(crf, "SLICE", size)
        assert np.allclose(field.emissions(words), whole, rtol=1e-4, atol=1e-3)


def test_few_records_have_a_dictionary_too(spark):
    """Fewer records than the trainer takes: their own bytes are the dictionary, in the leading frame, and all is read back."""
    for n in (1, 3, 9):
        pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>page {k} of a very small crawl</p>") for k in range(n)], "page_id long, url string, html string")
        archives = warc.write_archives(pages)
        content = archives.first().content
        assert bytes(content[:4]) == (0x184D2A5D).to_bytes(4, "little") and len(list(warc.read_records(bytes(content)))) >= 1
        assert {(r.page_id, r.record_type) for r in warc.read_archives(archives).collect()} == {(k, "response") for k in range(n)}


def test_lines_that_are_similar_enough_share_a_mark_and_pass_the_bits():
    import pyarrow as pa

    class Held:
        def __init__(self, value):
            self.value = value

    rng = random.Random(5)
    for percent in (50, 67, 80, 93):
        texts = []
        for _ in range(400):
            words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 40))]
            other = [w for w in words if rng.random() > 0.12] + [f"v{rng.randrange(60)}" for _ in range(rng.randrange(4))]
            texts += [" ".join(words).encode(), " ".join(other).encode()]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary()), pa.array(texts, pa.binary())], ["doc_id", "text_id", "text"])
        run = line_dedup._line_sets(percent, Held(np.zeros(0, np.uint64)), Held(np.zeros(0, np.int64)))
        rows = {r["doc_id"]: r for made in run([batch]) for r in made.to_pylist()}
        met = 0
        for k in range(0, len(texts), 2):
            a, b = set(texts[k].split()), set(texts[k + 1].split())
            if a != b and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = rows[k], rows[k + 1]
                marks = [{r["marks"][i : i + line_dedup.MARK_BYTES] for i in range(0, len(r["marks"]), line_dedup.MARK_BYTES)} for r in (x, y)]
                assert marks[0] & marks[1]
                differ = sum(((x[c] ^ y[c]) % (1 << 64)).bit_count() for c in group_join.bits_of(line_dedup.LANES))
                assert differ <= len(a ^ b)
                met += 1
        assert met > 20


def test_the_order_of_words_counts_every_word_of_every_text(spark, monkeypatch):
    """More texts than were drawn once; "each" stands once in a text and "twice" once in each of two partitions."""
    n = 9_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('Each\tw', id, ' ', if(id IN (0, 8999), 'twice', ''), '\n') AS text").repartition(3, "doc_id")
    seen = []
    monkeypatch.setattr(line_dedup, "frequent_words", lambda texts, f=line_dedup.frequent_words: seen.append(f(texts)) or seen[0])
    found = line_dedup.repeated_lines(docs).collect()
    assert len(found) == n and all(r.n_lines == 1 for r in found)
    of = dict(zip(seen[0][0].tolist(), seen[0][1].tolist()))
    hashes = [int(h) for h in group_join._numbers([b"each", b"twice", b"w7"])]
    assert [of.get(h) for h in hashes] == [n, 2, None] and len(of) == 2


def test_lines_are_taken_apart_like_bytes_of_python():
    import pyarrow as pa

    texts = [b"", b"\n", b" A b\tB\n\n\x0b \nc\x0cd\r\n", "\u00c4 \u00a0x\u0085y\x1c z\x00w".encode(), b"\xff\xfe bad \xc3\nOk", b"last\nline"]
    want = [(k, i, line.split()) for k, t in enumerate(texts) for i, line in enumerate(t.lower().split(b"\n")) if line.split()]
    column = pa.array([b"before", *texts], pa.binary()).slice(1)
    doc, seq, line, words = line_dedup.lines_of(column)
    flat = [words.dictionary.cast(pa.binary())[i].as_py() for i in words.indices.to_pylist()]
    assert [(d, s, [w for w, of in zip(flat, line) if of == k]) for k, (d, s) in enumerate(zip(doc.tolist(), seq.tolist()))] == want


def test_marks_that_several_lines_have_are_found_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BUCKET_MARKS", 3)
    marks = [[1, 2, 2**39], [2, 3], [], [2**39, 5, 6, 7]]
    rows = [(k, len(m), b"".join(x.to_bytes(line_dedup.MARK_BYTES, "little") for x in m)) for k, m in enumerate(marks)]
    found = line_dedup.met_again(spark.createDataFrame(rows, "cid long, n long, marks binary")).collect()
    assert sorted(map(tuple, found)) == [(2, 0, 3), (2, 1, 2), (2**39, 0, 3), (2**39, 3, 4)]


def test_compare_counts_common_members_over_blocks(monkeypatch):
    import pyarrow as pa

    hub, spokes = b"a b c d e", [b"a b x", b"", b"e d c b a a", b"q"]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 5 + [2, 2]), pa.array([None, 10, 11, 12, 13, None, 14], pa.int64()), pa.array([hub, *spokes, b"", b"a"], pa.binary())], ["hub", "spoke", "text"])
    whole = [r for b in group_join._compare(1)([batch]) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in whole] == [(1, 10, 5, 3, 2), (1, 11, 5, 0, 0), (1, 12, 5, 5, 5), (1, 13, 5, 1, 0), (2, 14, 0, 1, 0)]
    rows = [batch.slice(k, 1) for k in range(7)]
    assert [r for b in group_join._compare(1)(rows) for r in b.to_pylist()] == whole

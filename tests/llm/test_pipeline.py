"""The pipeline's stages on small rows: columns, copies, lines, whole documents."""

import random

import corpus_pipeline


def test_stages_keep_columns_and_one_of_each_copy(spark, tmp_path):
    rng = random.Random(9)
    made = []
    for k in range(40):
        text = "\n".join(" ".join(rng.choice(["haus", "werden", "nicht", "schön"]) + str(rng.randrange(300)) + "x" for _ in range(14)) for _ in range(4))
        made.append((k, text, "de", f"s{k % 3 and 1}", len(text)))
    made += [(100, made[3][1], "de", "s1", 1), (101, made[4][1].replace("haus", "Haus"), "de", "s1", 1), (102, "12345 !!!", "de", "s1", 9), (103, None, "de", "s1", 0)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    # copies lose all their lines to the first; texts without letters and nulls go with the first stage
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(k, t) for k, t, *_ in made[:40]]
    mixed = corpus_pipeline.mix_sources(spark, kept, str(tmp_path))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == set(range(40))
    pieces = corpus_pipeline.pack_sequences(spark, spark.createDataFrame(mixed.collect(), docs.schema), str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == set(range(40))


def test_the_line_stage_counts_all_texts_and_leaves_one_table(spark, monkeypatch):
    import glob

    from docketlake.llm import line_dedup
    from docketlake.session import checkpoint_dir

    texts = [f"one line of its own number{k} and{k}\nthe same line everywhere" for k in range(8_500)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    totals = []
    monkeypatch.setattr(line_dedup, "frequent_words", lambda seen, f=line_dedup.frequent_words: totals.append(seen.count()) or f(seen))
    tables = lambda: set(glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/docketlake-*"))
    before = tables()
    kept = corpus_pipeline.dedup_lines(spark, docs, "")
    assert totals == [len(texts)] and len(tables() - before) == 1
    got = {r.doc_id: r.text for r in kept.collect()}
    assert got == {k: t if k == 0 else t.split("\n")[0] for k, t in enumerate(texts)}

"""Trees, entities, metadata, catalogs and rules on literal inputs."""

import re
import random
import json

import pytest
from pyspark.sql import functions as F

from docketlake.functions import entities as en, ids, query as fq, text as tx
from docketlake.operators import catalog as ca, evaluation as ev, metadata as md, quality as qu, sections as se, trees as tr


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).collect()[0].y


def test_banner_tree_is_hoisted_and_deduplicated(spark):
    tree = [{"title": "Zimbabwe", "text": "b", "nodes": [{"title": "Labour Act", "text": "", "nodes": [
        {"title": "Chapter 8:07", "nodes": [{"title": "1. Title", "text": "short"}, {"title": "1.  title", "text": "much longer text", "nodes": [{"title": "kid", "text": "k"}]}]},
        {"title": "2. Scope", "text": "## 2. Scope\nApplies"}]}]}]
    df = spark.createDataFrame([("d", json.dumps(tree))], "doc_id string, tree string")
    nodes = tr.flatten_tree(df)
    assert nodes.count() == 7
    clean = {r.title: r for r in tr.clean_tree(nodes).collect()}
    assert set(clean) == {"Labour Act", "1.  title", "kid", "2. Scope"}
    assert clean["2. Scope"].text == "Applies" and list(clean["1.  title"].kept_parent) == [0, 0]
    assert tr.tree_markdown(nodes.where("depth = 0")).collect()[0].markdown == "# Zimbabwe\n\nb\n\n"


def test_deep_trees_keep_every_node(spark):
    levels = 20
    inner = '{"title": "leaf", "text": "last", "nodes": []}, {"title": "leaf", "node_id": "b", "page_index": 4}'
    deep = "[" + "".join(f'{{"title": "{"Contents" if k == 7 else f"t{k}"}", "text": "x{k}", "nodes": [' for k in range(levels - 1)) + inner + "]}" * (levels - 1) + "]"
    trees = [("deep", 1, deep), ("flat", 2, '[{"title": "a"}, {"title": "b", "nodes": [{"title": "c"}]}]'), ("none", 3, "[]"), ("null", 4, None)]
    nodes = tr.flatten_tree(spark.createDataFrame(trees, "doc_id string, n int, tree string"))
    assert nodes.columns == ["doc_id", "n", "path", "kept_parent", "breadcrumb", "title", "node_id", "text", "page_index", "depth", "ordinal"]
    got = {(r.doc_id, *r.path): r for r in nodes.collect()}
    assert set(got) == {("deep", *[0] * k) for k in range(1, levels + 1)} | {("deep", *[0] * (levels - 1), 1), ("flat", 0), ("flat", 1), ("flat", 1, 0)}
    titles = ["Contents" if k == 7 else f"t{k}" for k in range(levels - 1)] + ["leaf"]
    for k in range(levels):
        r = got[("deep", *[0] * (k + 1))]
        assert (r.title, r.depth, r.breadcrumb, r.n) == (titles[k], k, " > ".join(titles[: k + 1]), 1)
        assert r.kept_parent == (None if k == 0 else [0] * (7 if k == 8 else k))
    last = got[("deep", *[0] * (levels - 1), 1)]
    assert (last.node_id, last.page_index, last.ordinal, last.text) == ("b", 4, 1, None)


def test_trees_of_thousands_of_levels_beside_small_ones(spark):
    """Deeper than any recursive reader goes: every node, and the small trees beside them as ever."""
    def chain(n):
        return "[" + '{"title": "t", "nodes": [' * (n - 1) + '{"title": "leaf"}' + "]}" * (n - 1) + "]"

    wide = json.dumps([{"title": "t", "nodes": [{"title": str(k)} for k in range(1200)]}])
    trees = [("a", chain(501)), ("b", chain(5000)), ("c", wide), ("d", '[{"title": "x"}]'), ("bad", '[{"title" "x"}]'), ("cut", chain(700)[:-1]), ("empty", " ")]
    nodes = tr.flatten_tree(spark.createDataFrame(trees, "doc_id string, tree string"))
    got = nodes.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("depth").alias("deep"), F.max_by("title", "depth").alias("last"))
    assert {r.doc_id: (r.n, r.deep) for r in got.collect()} == {"a": (501, 500), "b": (5000, 4999), "c": (1201, 1), "d": (1, 0)}
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def _recursive(items, parent=None, path=(), crumb=None):
    out = []
    for k, n in enumerate(items):
        n = n or {}
        here = (*path, k)
        texts = [n.get(f) if n.get(f) is None or isinstance(n.get(f), str) else json.dumps(n[f]) for f in ("title", "node_id", "text")]
        line = texts[0] or "" if crumb is None else f"{crumb} > {texts[0] or ''}"
        page = n.get("page_index") if isinstance(n.get("page_index"), int) and not isinstance(n.get("page_index"), bool) else None
        out.append((here, line, *texts, page))
        if isinstance(n.get("nodes"), list):
            out += _recursive(n["nodes"], n, here, line)
    return out


def test_nodes_read_by_events_equal_a_recursive_reading():
    rng = random.Random(3)

    def value(depth):
        return rng.choice([None, "a \"quoted\" ] } text", "ünï\n", 7, -1.5, True, {"k": [1, {"nodes": []}]}, [[], {"title": "no"}], "", "\\"])

    def node(depth):
        made = {f: value(depth) for f in rng.sample(["title", "node_id", "text", "other", "page_index"], rng.randrange(6))}
        if depth and rng.random() < 0.7:
            made["nodes"] = [node(depth - 1) if rng.random() < 0.95 else None for _ in range(rng.randrange(4))]
        items = list(made.items())
        rng.shuffle(items)
        return dict(items)

    for turn in range(300):
        tree = [node(4) for _ in range(rng.randrange(4))]
        text = json.dumps(tree, ensure_ascii=bool(turn % 2))
        nodes = tr.read_nodes(text)
        got = list((tuple(r[0]), r[2], *(json.dumps(json.loads(x)) if x and x[0] in "[{" else x for x in r[3:6]), r[6]) for r in tr._node_rows(nodes, re.compile("never")))
        assert sorted(map(repr, got)) == sorted(map(repr, _recursive(tree))), text
        spaced = tr.read_nodes(json.dumps(tree, indent=2))
        assert (spaced.parent, spaced.ordinal) == (nodes.parent, nodes.ordinal)
        for cut in (rng.randrange(1, max(2, len(text))), len(text) - 1):
            broken = text[:cut]
            try:
                json.loads(broken)
            except ValueError:
                assert tr.read_nodes(broken) is None, broken


def test_too_deep_trees_are_refused(spark):
    tree = [{"title": "a", "nodes": [{"title": "b", "nodes": [{"title": "c"}]}]}]
    df = spark.createDataFrame([("d", json.dumps(tree))], "doc_id string, tree string")
    assert tr.flatten_tree(df, depth=3).count() == 3
    try:
        tr.flatten_tree(df, depth=2).collect()
        raise AssertionError("expected an error")
    except Exception as e:
        assert "deeper" in str(e)


def test_clean_text(spark):
    dirty = "<physical_index_3>\nAbout this collection of laws\n![x](y.png)\n# Title\nBody $\\quad$ on $ 1 / 2 / 3 $\n\n\n\nEnd\nwww.site.org"
    assert one(spark, lambda c: tr.clean_text(c, F.lit("Title")), dirty) == "Body   on 1/2/3\n\nEnd"


def test_judgment_sections(spark):
    text = "\n".join(["head"] * 15 + ["FACTS: the plaintiff sued the defendant", "for a large debt", "ORDER", "The claim is dismissed with costs."])
    rows = se.split_judgments(spark.createDataFrame([("d", text)], "doc_id string, markdown string")).collect()
    assert [(r.title, r.node_id) for r in rows] == [("Case Header", "header"), ("Facts", "section_0"), ("Order", "section_1")]


def test_judgment_headers_and_sections_of_odd_texts_match_their_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    from oracle import compare

    body = "\nthe rest of the text\nFACT\u017f and many more words of it\nBAC\u212aGROUND and many more words of it"
    texts = ["", None, " ", "\n", "head\n" * 15 + "\u0130ssue: x" + body, "head\n" * 20 + "bac\u212aground: x" + body, "head\n" * 16 + "\u00e9" * 101 + body, "head\n" * 60]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(None, "head\n" * 15 + body, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("w11_case_headers", "w10_judgment_sections"):
        assert compare(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) is None


def test_entities(spark):
    text = ("On 21/05/2025 and 3-1-49 and January 15, 2025 and 21 May 2025 the High Court of Zimbabwe, per MUTEVEDZI J, applied s 12A of the Labour Act [Chapter 28:01]"
            " as in [2025] ZWHHC 304. Justice Mathonsi agreed; see Shumba v Moyo")
    got = one(spark, en.extract_entities, text)
    assert got["dates"] == ["2025-01-15", "2025-05-21", "2049-01-03"]
    assert "12A" in got["statute_refs"] and got["case_refs"] == ["2025 ZWHHC 304"]
    assert got["courts"] == ["High Court of Zimbabwe"] and set(got["judges"]) == {"MUTEVEDZI J", "Justice Mathonsi"}
    assert got["parties"] == ["Shumba v Moyo"]
    assert one(spark, en.extract_entities, "nothing here") == {}


def test_vector_rows_conform(spark):
    rows = spark.createDataFrame([("c1", "k", "x" * 30, None, None), ("", "k", "act", "eng", 3), ("c3", None, "act", "eng", 3)],
                                 "chunk_id string, chunk_object_key string, doc_type string, language string, year int")
    good, bad = md.conform_vectors(rows)
    r = good.collect()
    assert len(r) == 1 and len(r[0].doc_type) == 20 and r[0].language == "eng" and r[0].year == 0 and r[0].nature == ""
    assert bad.count() == 2
    try:
        md.conform_vectors(rows, strict=True)[0].collect()
        raise AssertionError("expected an error")
    except Exception as e:
        assert "required" in str(e)


def test_document_metadata(spark):
    docs = spark.createDataFrame(
        [("corpus/sources/legislation/acts/akn_zw_act_1860_28_eng_2016-12-31.pdf", "Zimbabwe\nArt Unions Act\nChapter 25:01", ["Zimbabwe"]),
         ("x/constitution/doc.pdf", "Preamble\nConstitution of Zimbabwe", []), ("x/unknown.pdf", "This Act may be cited as the Water Works Act.", [])],
        "key string, markdown string, tree_titles array<string>")
    got = {r.key: r for r in md.document_metadata(docs).collect()}
    a = got["corpus/sources/legislation/acts/akn_zw_act_1860_28_eng_2016-12-31.pdf"]
    assert (a.title, a.canonical_citation, a.akn_uri) == ("Art Unions Act", "Art Unions Act [Chapter 25:01]", "/akn/zw/act/1860/28/eng@2016-12-31")
    assert got["x/constitution/doc.pdf"].canonical_citation == "Constitution of Zimbabwe" and got["x/constitution/doc.pdf"].hierarchy_rank == 1
    assert got["x/unknown.pdf"].title == "Water Works Act"


def test_judges_topics_and_parties(spark):
    html = '<meta name="keywords" content="tax, duty"><table><tr><th>Judges</th><td>MAKARAU JA &amp; BERE J</td></tr></table><a class="label x">Labour</a>'
    df = spark.createDataFrame([(html, "State v Dube [2025] ZWSC 1 (3 May 2025)")], "html string, title string").select(
        ca.judges_on_page(F.col("html")).alias("j"), ca.topics_on_page(F.col("html")).alias("t"), ca.case_parties(ca.case_name(F.col("title"))).alias("p"))
    r = df.collect()[0]
    assert r.j == ["MAKARAU JA", "BERE J"] and r.t == ["tax", "duty", "Labour"] and r.p["plaintiff"] == ["State"] and r.p["defendant"] == ["Dube"]


def test_text_functions(spark):
    assert one(spark, tx.normalize_text, "  “a”\n\t—b ") == '"a" -b'
    assert one(spark, lambda c: tx.normalize_text(c, True), "“a”") == "“a”"
    assert one(spark, tx.legal_tokens, "S. 12A of the [Chapter 28:01] and [2025] ZWHHC 304, étude sec 7") == ["section12a", "chapter28", "01", "2025zwhhc304", "section7"]
    assert one(spark, tx.keywords, "The big-cat is on it") == ["the", "big", "cat"]
    import hashlib
    import hmac

    assert one(spark, lambda c: ids.pseudonym(c, "k" * 80), "user") == hmac.new(b"k" * 80, b"user", hashlib.sha256).hexdigest()[:16]
    want = int(hashlib.md5(b"u1:e").hexdigest(), 16) % 10000 / 10000
    assert one(spark, lambda c: ids.assignment_ratio(c, F.lit("e")), "u1") == want


def test_query_rules(spark):
    q = [("hello there",), ("What are my rights under the Constitution?",), ("section 12C of the Labour Act [chapter 28:01]",), ("blue sky",)]
    got = [(r.intent, r.complexity, r.user_type) for r in fq.classify_intents(spark.createDataFrame(q, "query string")).collect()]
    assert got == [("conversational", "simple", "citizen"), ("rag_qa", "complex", "citizen"), ("rag_qa", "complex", "professional"), (None, None, None)]
    assert one(spark, lambda c: fq.reformulations(c), "s 12C chapter 28:01")[:2] == ["s 12c chapter 28 01", "section 12c chapter 28 01"]
    r = one(spark, fq.date_context, "duty as at 2023/01/05 for cars")
    assert (r.clean_query, r.date) == ("duty for cars", "2023-01-05")
    assert one(spark, fq.is_follow_up, "What about overtime") and not one(spark, fq.is_follow_up, "Define overtime")


def test_refinement_rules(spark):
    cases = [(True, 0.9, [], "simple", 0, "pass"), (False, None, ["x"], "simple", 0, "pass"), (False, 0.4, ["Insufficient sources"], "simple", 2, "fail"),
             (False, 0.6, ["Missing coverage", "logic"], "simple", 0, "retrieve_more"), (False, 0.55, ["weak reasoning"], "simple", 1, "refine_synthesis"),
             (False, 0.65, ["tone"], "simple", 0, "refine_synthesis"), (False, 0.3, ["tone"], "expert", 0, "refine_synthesis"), (False, 0.3, ["tone"], "simple", 0, "pass")]
    df = spark.createDataFrame(cases, "p boolean, c double, i array<string>, l string, n int, want string")
    for r in df.select("want", qu.refinement_step("p", "c", "i", "l", "n").alias("got")).collect():
        assert r.got == r.want


def test_scores(spark):
    df = spark.createDataFrame([("Alpha beta", "beta gamma", 7500, ["Art Unions Act 25"], ["art unions act", "Chapter 25:01"])],
                               "a string, e string, ms int, s array<string>, x array<string>")
    r = df.select(ev.answer_similarity("a", "e").alias("sim"), ev.latency_score("ms").alias("lat"), ev.citation_accuracy("s", "x").alias("cit"),
                  ev.precision_at_k("s", "x", 5).alias("p")).collect()[0]
    assert (r.sim, r.lat, r.cit, r.p) == (0.5, 0.5, 0.5, 0.5)
    answers = spark.createDataFrame([("q", 'He said "the tax must be paid on time" and "this was never in any source".')], "query_id string, answer string")
    ctx = spark.createDataFrame([("q", "Here THE TAX MUST BE PAID ON TIME indeed")], "query_id string, content string")
    v = qu.verify_quotes(answers, ctx).collect()[0]
    assert (v.all_verified, v.verified_count, v.unverified_quotes) == (False, 1, "this was never in any source")


def test_quotes_meet_contexts_by_one_gram(spark):
    """Against a search of every quote in every context of its answer: case, letters beyond ASCII, repeats, short contexts, nulls."""
    rng = random.Random(4)
    words = ["Über", "the", "COURT", "held", "naïve", "ab", "日本", "Σίσυφος", "zu", "…"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(30)] + [None, ""]
    contexts, answers = [], []
    for q in range(40):
        own = rng.sample(texts, 4)
        contexts += [(q, t) for t in own] + [(q, own[0])]
        quotes = []
        for _ in range(rng.randrange(0, 7)):
            t = rng.choice(own if rng.random() < 0.6 else texts) or "no such words anywhere"
            start = rng.randrange(max(1, len(t) - 25))
            quote = t[start : start + rng.randrange(20, 140)]
            quotes.append(quote.upper() if rng.random() < 0.3 else quote)
        answers.append((q, " and ".join(f'"{x}"' for x in quotes) if quotes else None))
    got = qu.verify_quotes(spark.createDataFrame(answers, "query_id int, answer string"), spark.createDataFrame(contexts, "query_id int, content string"))
    want = {}
    for q, a in answers:
        quotes = re.findall(r'"([^"]{20,})"', a or "")
        held = [t.lower() for k, t in contexts if k == q and t is not None]
        ok = [any(x.lower() in t for t in held) for x in quotes]
        bad = [x[:100] + "..." if len(x) > 100 else x for x, good in zip(quotes, ok) if not good]
        if quotes:
            want[q] = (all(ok), sum(ok), " | ".join(bad[:3]))
    assert {r.query_id: (r.all_verified, r.verified_count, r.unverified_quotes) for r in got.collect()} == want and len(want) > 20


def test_both_readers_of_trees_agree():
    def seen(nodes):
        return nodes and (nodes.parent, nodes.ordinal, nodes.fields)

    odd = [
        "null", "5", "", "[", "[]", "{}", "[null, 3, {}]", '[[{"title": "x"}], {"title": "y"}]', '{"title": 5}', '{"title": {"a": [1, 2]}}', '{"text": "a", "text": "b"}',
        '{"nodes": [{}], "nodes": [{}, {}], "page_index": 3}', '{"nodes": {"title": "x"}}', '{"nodes": 4, "page_index": "7"}', '{"page_index": 4.0}', '{"page_index": true}',
        '{"page_index": -0}', '{"page_index": 007}', '{"page_index": 2147483648}', '{"page_index": [1]}', '{"title": "\\ud800x", "nodes": [{"text": "\\u00e9\\ud83d\\ude00"}]}',
        '{"title": "\\q"}', '{"title": "a\nb"}', '{"title": NaN}', '{"other": {"nodes": [{}]}, "nodes": [1, {"text": "t", "nodes": [{}]}, {"node_id": "n"}]}', "[] x", "\ufeff[]",
        '{"nodes": [' * 20_000 + "]}" * 20_000,
    ]
    assert [seen(tr.read_nodes(t)) for t in odd] == [seen(tr.nodes_by_events(t)) for t in odd]


def test_trees_are_cleaned_in_one_shuffle(spark):
    rows = [("d", [0], None, "Act", ""), ("d", [0, 0], [0], "One", "a"), ("d", [0, 0, 0], [0, 0], "kid", "k"), ("d", [0, 1], [0], "one ", "longer"),
            ("d", [0, 1, 0], [0, 1], "kid", "k"), ("d", [0, 2], [0], "Two", "t"), ("d", [0, 2, 0], [0, 2], "x", "1"), ("d", [0, 2, 1], [0, 2], "x", "12"), ("d", [0, 10], [0], "ten", ""),
            ("e", [0], None, "Act", "one text of two that share an id"), ("e", [0], None, "Act", "shorter")]
    nodes = spark.createDataFrame(rows, "doc_id string, path array<int>, kept_parent array<int>, title string, text string")
    clean = tr.clean_tree(nodes)
    assert clean._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.doc_id, tuple(r.path), tuple(r.place)) for r in clean.collect()}
    assert got == {("d", (0,), (0,)), ("d", (0, 1), (0, 0)), ("d", (0, 1, 0), (0, 1, 0)), ("d", (0, 2), (0, 2)), ("d", (0, 2, 1), (0, 2, 0)), ("d", (0, 10), (0, 10)), ("e", (0,), (0,))}


def test_metadata_join_has_more_tasks_for_more_rows(spark, monkeypatch):
    from docketlake.plans import load, registry

    monkeypatch.setattr(registry, "TASK_ROWS", 500)
    found = load().QUERIES["j3_propagate_metadata"](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500 > 4

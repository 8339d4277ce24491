"""Audit of how the sources of a language diverge in their terms, by Arrow compute kernels.

Inside mapInArrow a block of texts becomes partial counts by kernels alone: lower-casing, splitting at a pattern, dictionary
encoding and hash grouping. Spark merges the counts per language and term; each shard of a language's terms is then a dense
table of sources by terms, from which it gives its part of every divergence. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from docketlake.llm.common import blocks, utf8
from docketlake.session import materialize

#: A term is a run of ASCII letters and of characters beyond ASCII; it is cut at everything else.
BETWEEN_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a term must be in; terms listed per group.
MIN_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: Partial counts that a task holds before it hands them on, and numbers in a shard's dense table.
HELD, CELLS = 400_000, 500_000
_SALTS = 32


def count_block(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """(lang, source, term, n, docs) of one block; the row of the empty term counts the group's texts."""
    lists = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN_TERMS)
    terms, row = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(terms), 0)
    coded = terms.filter(real).dictionary_encode()
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    per_text = pa.table({"row": row.filter(real), "term": coded.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    keyed = pa.table({"lang": langs.indices.take(per_text["row"].combine_chunks()), "source": sources.indices.take(per_text["row"].combine_chunks()), "term": per_text["term"], "n": per_text["count_all"]})
    counted = keyed.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    groups = pa.table({"lang": langs.indices, "source": sources.indices}).group_by(["lang", "source"], use_threads=False).aggregate([([], "count_all")])
    nothing = pa.nulls(groups.num_rows, pa.string()).fill_null("")
    return pa.table({
        "lang": pa.chunked_array([langs.dictionary.take(k["lang"].combine_chunks()) for k in (counted, groups)]),
        "source": pa.chunked_array([sources.dictionary.take(k["source"].combine_chunks()) for k in (counted, groups)]),
        "term": pa.chunked_array([coded.dictionary.take(counted["term"].combine_chunks()), nothing]),
        "n": pa.chunked_array([counted["n_sum"].combine_chunks(), pa.array(np.zeros(groups.num_rows, np.int64))]),
        "docs": pa.chunked_array([counted["n_count"].combine_chunks(), groups["count_all"].combine_chunks()]),
    })


def merge_counts(tables: list[pa.Table]) -> pa.Table:
    keys = ["lang", "source", "term"]
    merged = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return merged.select([*keys, "n_sum", "docs_sum"]).rename_columns([*keys, "n", "docs"])


def _partials(batches):
    held, size = [], 0
    for batch in batches:
        for part in blocks(batch):
            held.append(count_block(part.column("lang"), part.column("source"), part.column("text").cast(pa.string())))
            size += held[-1].num_rows
            if size > HELD:
                held = [merge_counts(held)]
                size = held[0].num_rows
                if size > HELD // 2:  # little left to merge: let the shuffle do it
                    yield from held[0].to_batches()
                    held, size = [], 0
    if held:
        yield from merge_counts(held).to_batches()


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term and documents with it, from each task; nulls count as ''."""
    rows = docs.select(
        *[F.make_valid_utf8(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in ("lang", "source", "text")]
    ).withColumn("text", utf8("text"))
    return rows.mapInArrow(_partials, "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, leads): counts of the terms that enough documents of their language have.

    ``leads`` marks one row of each term of a language. The row of the empty term stands for the group itself. Rows are dealt by
    language and term, so the counts of a source as well as of the language are merged without another shuffle.
    """
    term = W.partitionBy("lang", "term")
    merged = partial_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    known = merged.withColumn("_all", F.sum("docs").over(term)).withColumn("_first", F.min("source").over(term))
    return known.where((F.col("term") == "") | (F.col("_all") >= min_docs)).select("lang", "source", "term", "n", ((F.col("source") == F.col("_first")) & (F.col("term") != "")).alias("leads"))


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total) in whole numbers, three digits at a time: exact for totals below 9e15."""
    whole, rest = np.divmod(count + 2, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return 1 + whole


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _shard(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """What one shard of a language's terms adds: divergence of each two sources (once), and its leading terms per source."""
    groups = groups.sort_by("source")
    sources = groups["source"].combine_chunks()
    terms = counts["term"].combine_chunks().dictionary_encode() if counts.num_rows else pa.array([], pa.string()).dictionary_encode()
    order = pc.sort_indices(terms.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    n = np.zeros((len(sources), len(order)), np.int64)
    if counts.num_rows:
        at = pc.index_in(counts["source"].combine_chunks(), sources).to_numpy()
        n[at, place[terms.indices.to_numpy()]] = counts["n"].to_numpy()
    first = {k: groups[k][0].as_py() for k in ("lang", "n_terms", "lang_total")}
    total = groups["total"].to_numpy()[:, None] + 2 * first["n_terms"]
    p = shares(n, total) if len(order) else np.zeros_like(n)
    left, right, value = [], [], []
    for k in range(len(sources) - 1):
        left += [k] * (len(sources) - 1 - k)
        right += range(k + 1, len(sources))
        value.append(divergence(p[k], p[k + 1 :]).sum(1))
    items = [sources.take(pa.array(right, pa.int64()))]
    owner, kind = list(left), len(left)
    if len(order):
        q = shares(n.sum(0), first["lang_total"] + 2 * first["n_terms"])
        f = divergence(p, q)
        for k in range(len(sources)):
            able = np.flatnonzero((n[k] > 0) & (p[k] > q))
            best = able[np.argsort(-f[k, able], kind="stable")[:TOP]]
            owner += [k] * len(best)
            value.append(f[k, best])
            items.append(terms.dictionary.take(pa.array(order[best])))
    size = len(owner)
    return pa.table({
        "lang": pa.array([first["lang"]] * size, pa.string()), "source": sources.take(pa.array(owner, pa.int64())),
        "part": pa.array(["pair"] * kind + ["term"] * (size - kind), pa.string()), "item": pa.chunked_array(items, pa.string()),
        "value": pa.array(np.concatenate(value) if value else np.zeros(0, np.int64)),
    })


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other one, and its own leading terms.

    Part ``pair`` ranks the other sources of the language by the sum of ``divergence`` over all kept terms; part ``term`` ranks the
    ten terms by which a source differs most from its whole language, among those it uses more. Ties go to the smaller item in
    UTF-8 order. Null text, language and source count as ''; a language without kept terms gives pairs of value 0; a lone
    source has no pairs; repeated rows count each; no rows give none; other columns are ignored.
    """
    kept = materialize(kept_counts(docs, min_docs), "term-counts")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("leads").alias("_terms"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("_terms").alias("n_terms"), F.count("*").alias("_sources"))
    langs = langs.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("n_terms") * F.col("_sources") / cells)).cast("int"))
    salted = langs.select("lang", "shards", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt"))  # a language may hold most rows
    terms = kept.where(F.col("term") != "").withColumn("_salt", F.pmod(F.xxhash64("source", "term"), F.lit(_SALTS)).cast("int"))
    rows = terms.join(salted, ["lang", "_salt"]).select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "source", "term", "n")
    own = groups.join(langs, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source", "total", "lang_total", "n_terms"
    )
    own = own.toDF(*own.columns)  # both sides come from one table: new column ids
    parts = rows.groupBy("lang", "shard").cogroup(own.groupBy("lang", "shard")).applyInArrow(_shard, "lang string, source string, part string, item string, value long")
    once = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    other = F.struct(F.col("item").alias("source"), F.col("source").alias("item"))
    both = F.when(F.col("part") == "pair", F.array(F.struct("source", "item"), other)).otherwise(F.array(F.struct("source", "item")))
    found = once.select("lang", F.explode(both).alias("_two"), "part", "value").select("lang", "_two.source", "part", "_two.item", "value")
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item")))
    ranked = found.withColumn("rank", rank)
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP))

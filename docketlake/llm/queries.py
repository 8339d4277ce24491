"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cutoff_sql(by: str, suffix: str) -> str:
    """Quartiles of the bucketed values of each group, then its cutoffs."""
    key = f"{by}, " if by else ""
    part = f"{key}metric"
    return f"""q{suffix} AS (SELECT {part}, max(total) AS total,
      min(low) FILTER (upto * 4 >= total) AS q1, min(low) FILTER (upto * 4 >= total * 3) AS q3
    FROM (SELECT {part}, low, sum(n) OVER (PARTITION BY {part} ORDER BY low) AS upto, sum(n) OVER (PARTITION BY {part}) AS total
          FROM (SELECT {part}, low, count(*) AS n FROM vals GROUP BY {part}, low)) GROUP BY {part}),
  c{suffix} AS (SELECT {key}max(total) AS docs,
      max(q3 + greatest(3 * (q3 - q1), 200)) FILTER (metric = 'length') AS length_high,
      max(q1 - greatest(3 * (q3 - q1), 200)) FILTER (metric = 'length') AS length_low,
      max(q3 + greatest(3 * (q3 - q1), 60)) FILTER (metric = 'symbols') AS symbols_high,
      max(q3 + greatest(3 * (q3 - q1), 150)) FILTER (metric = 'repeats') AS repeats_high,
      max(q3 + greatest(3 * (q3 - q1), 200)) FILTER (metric = 'lines') AS lines_high
    FROM q{suffix} {"GROUP BY " + by if by else ""})"""


_WORD = r"[^\x20\x09-\x0D]+"
_PICK = ",\n    ".join(
    f"CASE WHEN s.docs >= 100 THEN s.{n} WHEN l.docs >= 100 THEN l.{n} ELSE a.{n} END AS {n}"
    for n in ("length_high", "length_low", "symbols_high", "repeats_high", "lines_high")
)
QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
  w AS (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
  wl AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
  tri AS (SELECT rid, pos, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM wl WINDOW o AS (PARTITION BY rid ORDER BY pos)),
  rep AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, word, w2, w3) AS c FROM tri WHERE w3 IS NOT NULL) WHERE c > 1),
  cov AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS p FROM rep) GROUP BY rid),
  ln AS (SELECT rid, sum(c)::BIGINT AS n_lines, sum(c - 1)::BIGINT AS n_dup_lines
    FROM (SELECT rid, line, count(*) AS c FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY rid, line) GROUP BY rid),
  st AS (SELECT d.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN ln USING (rid)),
  m AS (SELECT *, CASE WHEN n_words > 0 THEN 100 * word_chars // n_words END AS m_length, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words END AS m_symbols,
      CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words END AS m_repeats, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines END AS m_lines FROM st),
  long AS (SELECT lang, source, unnest(['length', 'symbols', 'repeats', 'lines']) AS metric, unnest([m_length, m_symbols, m_repeats, m_lines]) AS v FROM m),
  vals AS (SELECT lang, source, metric, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)::BIGINT) << (length(bin(v)) - 6)::BIGINT END AS low FROM long WHERE v IS NOT NULL),
  {_cutoff_sql("lang, source", "_s")},
  {_cutoff_sql("lang", "_l")},
  {_cutoff_sql("", "_a")},
  cut AS (SELECT s.lang, s.source, {_PICK} FROM c_s s JOIN c_l l ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN c_a a),
  j AS (SELECT m.*, cut.* EXCLUDE (lang, source), (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed
    FROM m LEFT JOIN cut ON m.lang IS NOT DISTINCT FROM cut.lang AND m.source IS NOT DISTINCT FROM cut.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(m_length <= length_high AND m_length >= length_low, true) AND coalesce(m_symbols <= symbols_high, true)
    AND coalesce(m_repeats <= repeats_high, true) AND coalesce(m_lines <= lines_high, true) AS kept
FROM j"""


@query("op10_adaptive_quality_rules", QUALITY_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from docketlake.llm.rules import quality_rules

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(table(spark, folder, "documents")).select(*names)


@query("op7_hilbert_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from docketlake.llm.packing import pack

    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_bradley_terry_quality")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from docketlake.llm.common import labelled, remainder
    from docketlake.llm.preference import fit, score

    docs = table(spark, folder, "documents")
    model = fit(labelled(docs, table(spark, folder, "labels"), "quality", 5, 0))
    return score(docs, model, ["doc_id"]).select("doc_id", (remainder("doc_id", 5) == F.lit(0)).alias("held_out"), "score", "predicted")


@query("op6_compression_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from docketlake.llm.common import labelled, remainder
    from docketlake.llm.toxicity import PER_LABEL, fit, score

    docs = table(spark, folder, "documents")
    model = fit(labelled(docs, table(spark, folder, "labels"), "toxic", 4, 2, PER_LABEL))
    return score(docs, model, ["doc_id"]).select("doc_id", (remainder("doc_id", 4) == F.lit(2)).alias("held_out"), "score", "predicted")


@query("op1_crf_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from docketlake.llm.common import remainder
    from docketlake.llm.crf import fit, identify, training_rows

    docs = table(spark, folder, "documents")
    found = identify(docs, fit(training_rows(docs)), ["doc_id"])
    return found.select("doc_id", (remainder("doc_id", 4) == F.lit(2)).alias("held_out"), "lang_pred", "score")


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
  f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""


@query("op8_dictionary_warc", WARC_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from docketlake.llm.warc import read_archives, write_archives

    pages = table(spark, folder, "pages")
    return read_archives(write_archives(pages), pages.schema["page_id"].dataType.simpleString())


@query("op4_chunked_media")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from docketlake.llm.media import media_columns

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
    return media_columns(table(spark, folder, "documents"), ["doc_id"]).select(*names)


@query("op3_grouped_prefix_join")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from docketlake.llm.group_join import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), size=4, percent=85)


@query("op5_line_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, removed (line numbers from 0, joined by commas)."""
    from pyspark.sql import functions as F

    from docketlake.llm.line_dedup import repeated_lines

    docs = table(spark, folder, "documents")
    found = repeated_lines(docs)
    named = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_id"))
    same = named["doc_id"].eqNullSafe(found["doc_id"]) & (named["text_id"] == found["text_id"])
    return named.join(found, same, "left").select(
        named["doc_id"], F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"),
        F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"),
    )


MIX_SQL = r"""
WITH items AS (SELECT doc_id, source, md5(coalesce(text, '')) AS text_id, max(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens, count(*)::BIGINT AS n_rows
    FROM documents GROUP BY doc_id, source, md5(coalesce(text, ''))),
  tot AS (SELECT source, sum(n_tokens * n_rows)::BIGINT AS total FROM items GROUP BY source),
  ends AS (SELECT max(total) AS hi, min(total) FILTER (total > 0) AS lo FROM tot),
  a AS (SELECT hi, CASE WHEN lo = hi OR hi / lo <= 2 THEN 0.0 ELSE 1 - ln(2) / ln(hi / lo) END AS ex FROM ends),
  plan AS (SELECT source, total, CASE WHEN total = 0 THEN 0 ELSE greatest(total, floor(total * pow(total / hi, ex - 1) + 0.5)::BIGINT) END AS run_tokens FROM tot, a),
  p AS (SELECT items.*, n_tokens * n_rows AS size, total, run_tokens,
      ('0x' || substr(md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, 'null'), text_id)), 1, 8))::BIGINT % greatest(ceil(total / 1048576)::BIGINT, 1) AS block,
      unnest(generate_series(1, greatest(ceil(run_tokens / greatest(total, 1))::BIGINT, 1))) AS epoch
    FROM items JOIN plan ON items.source IS NOT DISTINCT FROM plan.source),
  b AS (SELECT *, sum(bs) OVER (PARTITION BY source, epoch ORDER BY md5(concat_ws('|', 'mix', epoch::VARCHAR, coalesce(source, 'null'), block::VARCHAR)), block) - bs AS before
    FROM (SELECT source, epoch, block, sum(size) AS bs FROM p GROUP BY source, epoch, block)),
  o AS (SELECT *, sum(size) OVER (PARTITION BY source, epoch, block ORDER BY md5(concat_ws('|', 'mix', epoch::VARCHAR, coalesce(doc_id::VARCHAR, 'null'), text_id)), doc_id, text_id) - size AS off FROM p)
SELECT doc_id, o.source, n_tokens, o.epoch::INT AS epoch, ((o.epoch - 1) * total + before + off)::BIGINT AS start, run_tokens
FROM o JOIN b ON o.source IS NOT DISTINCT FROM b.source AND o.epoch = b.epoch AND o.block = b.block
WHERE o.epoch = 1 OR (o.epoch - 1) * total + before + off + size <= run_tokens"""


@query("op2_temperature_mixing", MIX_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, n_tokens, epoch, start, run_tokens: no source is repeated more than twice."""
    from docketlake.llm.mixing import mixture

    return mixture(table(spark, folder, "documents")).select("doc_id", "source", "n_tokens", "epoch", "start", "run_tokens")


@query("op13_pair_index_bpe")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the ids and of the text they decode to."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from docketlake.llm.bpe import encode

    made = encode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"], decoded=True)
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
DIVERGENCE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
  o AS (SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), {_UPPER}) AS term FROM d),
  kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
  g AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
  v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
  ng AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
  nl AS (SELECT lang, sum(total)::HUGEINT AS total FROM ng GROUP BY lang),
  own AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) JOIN nl USING (lang) JOIN v USING (lang)),
  dense AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (total + 2 * v) AS p
    FROM g JOIN kept USING (lang) JOIN v USING (lang) JOIN ng USING (lang, source) LEFT JOIN c USING (lang, source, term)),
  pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM dense a JOIN dense b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
  found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b USING (lang) LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source WHERE a.source <> b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM dense JOIN own USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 10"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from docketlake.llm.divergence import audit

    return audit(table(spark, folder, "documents"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from docketlake.llm.spelling import group_variants

    return group_variants(table(spark, folder, "documents")).select("word", "form", "root", "n", "n_near", "form_n")

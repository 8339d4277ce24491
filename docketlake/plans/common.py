"""Derived inputs shared by several registered queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketlake.functions.text import legal_tokens
from docketlake.operators.chunking import chunk_text, with_chunk_ids

# white space and word characters as RE2 classes
SWS = r"[\t\n\x0b\f\r\x1c-\x20\x{85}\p{Z}]"
SNW = r"[^\t\n\x0b\f\r\x1c-\x20\x{85}\p{Z}]"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SWS}+|{SWS}+$', '', 'g')"


def sql_collapse(c: str) -> str:
    return f"regexp_replace({c}, '{SWS}+', ' ', 'g')"


def sql_normalize(c: str) -> str:
    return f"""trim(translate({sql_collapse(c)}, '“”‘’—–', '""''''--'))"""


def sql_words(c: str) -> str:
    return f"regexp_extract_all({c}, '{SNW}+')"


def sql_any(c: str, parts: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(c, p.replace("'", "''")) for p in parts) + ")"


STOP_SQL = (
    "['a','an','and','are','as','at','be','by','for','from','has','he','in','is','it','its','of','on',"
    "'that','the','to','was','will','with']"
)


def sql_tokens(c: str) -> str:
    """Token list of a text: the folds, then whole words made of a-z0-9 only."""
    t = f"lower({c})"
    t = rf"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}_])s\.?{SWS}*([0-9]+[a-z]?)\b', '\1section\2', 'g')"
    t = rf"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}_])sec\.?{SWS}*([0-9]+[a-z]?)\b', '\1section\2', 'g')"
    t = rf"regexp_replace({t}, '\[chapter{SWS}+([0-9:]+)\]', 'chapter\1', 'g')"
    t = rf"regexp_replace({t}, '\[([0-9]{{4}})\]{SWS}*([a-z]+){SWS}*([0-9]+)', '\1\2\3', 'g')"
    found = rf"regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+')"
    return (
        f"list_filter({found}, lambda w: regexp_full_match(w, '[a-z0-9]{{2,}}') "
        f"AND NOT list_contains({STOP_SQL}, w))"
    )


DOC_TYPE_SQL = "CASE lang WHEN 'en' THEN 'act' WHEN 'de' THEN 'si' WHEN 'fr' THEN 'ordinance' ELSE 'constitution' END"


def doc_type_of_lang(col: str = "lang"):
    c = F.col(col)
    return F.when(c == "en", "act").when(c == "de", "si").when(c == "fr", "ordinance").otherwise("constitution")


def chunk_cte(keys: str, source: str, pre: str = "") -> str:
    """CTEs that cut ``source``(keys, text) into windows; the last one is {pre}all_chunks."""
    return f"""
{pre}norm AS (SELECT {keys}, {sql_normalize('text')} AS t FROM {source}),
{pre}base AS (SELECT *, length(t) AS n FROM {pre}norm WHERE length(t) > 0),
{pre}pieces AS (SELECT {keys}, unnest(ps) AS p, generate_subscripts(ps, 1) AS ord
  FROM (SELECT {keys}, regexp_extract_all(t, '(?s).*?(?:[.!?] |$)') AS ps FROM {pre}base WHERE n // 4 > 256)),
{pre}ends AS (SELECT * FROM (SELECT {keys}, p, (sum(length(p)) OVER (PARTITION BY {keys} ORDER BY ord))::BIGINT AS b FROM {pre}pieces)
  WHERE regexp_matches(p, '(?s)[.!?] $')),
{pre}wins AS (SELECT {keys}, t, n, w * 872 AS pos, least(w * 872 + 1024, n) AS e
  FROM (SELECT *, unnest(generate_series(0, (n - 1) // 872)) AS w FROM {pre}base WHERE n // 4 > 256)),
{pre}near AS (SELECT {keys}, w.pos, max(b) FILTER (b <= e) AS back, min(b) FILTER (b >= e + 2) AS fwd
  FROM {pre}wins w LEFT JOIN {pre}ends USING ({keys}) GROUP BY ALL),
{pre}word_near AS (SELECT w.*, coalesce(back, 0) AS back, coalesce(fwd, n) AS fwd,
    CASE WHEN strpos(reverse(left(t, e)), ' ') > 0 THEN e - strpos(reverse(left(t, e)), ' ') ELSE 0 END AS wback,
    CASE WHEN strpos(substr(t, e + 1), ' ') > 0 THEN strpos(substr(t, e + 1), ' ') - 1 ELSE n - e END AS wgap
  FROM {pre}wins w JOIN {pre}near USING ({keys}, pos)),
{pre}cut AS (SELECT {keys}, n, pos, t, CASE
    WHEN e >= n THEN n
    WHEN fwd = n AND back = 0 THEN CASE WHEN wgap = 0 THEN e WHEN e - wback <= wgap THEN wback ELSE e + wgap END
    WHEN e - back <= fwd - e THEN back ELSE fwd END AS fin
  FROM {pre}word_near),
{pre}long_chunks AS (SELECT {keys}, pos AS start_char, fin AS end_char,
    CASE WHEN fin > pos THEN substr(t, pos + 1, fin - pos) ELSE '' END AS chunk_text, n FROM {pre}cut),
{pre}all_chunks AS (SELECT {keys}, start_char, end_char, chunk_text FROM {pre}long_chunks
    WHERE length(chunk_text) // 4 >= 10 OR end_char = n
  UNION ALL SELECT {keys}, 0, n, t FROM {pre}base WHERE n // 4 <= 256)"""


def sql_chunk_id(doc, path, start, end, text) -> str:
    return (
        f"substr(sha256(concat_ws('|', {doc}, {path}, {start}, {end}, "
        f"substr(sha256({sql_strip(sql_collapse(text))}), 1, 8))), 1, 16)"
    )


CHUNK_CTE = f"""{chunk_cte('doc_id, lang, source', 'documents')},
chunks AS (SELECT doc_id, lang, source, {DOC_TYPE_SQL} AS doc_type, start_char, end_char, chunk_text,
    (row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1)::BIGINT AS chunk_index,
    (length(chunk_text) // 4)::BIGINT AS num_tokens,
    {sql_chunk_id('doc_id', "'Body'", 'start_char', 'end_char', 'chunk_text')} AS chunk_id
  FROM all_chunks)"""


def chunks(t) -> DataFrame:
    """Documents cut into chunks with ids; the language stands in for the document type."""
    docs = t.dealt("documents", "doc_id").select("doc_id", "lang", "source", "text")
    cut = chunk_text(docs).withColumn("section_path", F.lit("Body"))
    return with_chunk_ids(cut).withColumn("doc_type", doc_type_of_lang())


def chunk_tokens(t) -> DataFrame:
    return chunks(t).select("chunk_id", "doc_id", "doc_type", legal_tokens("chunk_text").alias("tokens"))

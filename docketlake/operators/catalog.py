"""HTML pages to legislation and judgment catalogs, and the links in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from docketlake.constants import COURT_CODES, LANGUAGE_NAMES
from docketlake.functions.ids import judgment_file_name
from docketlake.functions.text import NOT_BEFORE_WORD as E, WS, collapse_ws, strip

ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
ANCHOR = r'(?is)<a\s[^>]*?href\s*=\s*["\']([^"\']*)["\'][^>]*>(.*?)</a>'
ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<t[dh][^>]*>(.*?)(?=</t[dh]>|<t[dh]|\z)"
TRACKED = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("title", "work_frbr_uri", "expression_frbr_uri", "frbr_uri_number", "publication_date")
])


def unescape(c: Column) -> Column:
    for code, char in ENTITIES.items():
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def visible_text(html: Column, gap: str = " ") -> Column:
    """Text between tags, without comments, scripts and styles."""
    c = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", gap)
    return unescape(F.regexp_replace(c, r"(?s)<[^>]*>", gap))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def with_head(pages: DataFrame, site_suffix: str = "") -> DataFrame:
    """Tracked properties of the page head; a missing title comes from the title element."""
    raw = F.regexp_extract("html", r'(?is)<script[^>]*id=["\']track-page-properties["\'][^>]*>(.*?)</script>', 1)
    title = strip(unescape(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    if site_suffix:
        title = strip(F.replace(title, F.lit(site_suffix), F.lit("")))
    head = pages.withColumn("_m", F.from_json(raw, TRACKED))
    return head.withColumns({
        "work_frbr_uri": F.col("_m.work_frbr_uri"), "expression_frbr_uri": F.col("_m.expression_frbr_uri"),
        "frbr_number": F.col("_m.frbr_uri_number"), "publication_date": F.col("_m.publication_date"),
        "title": F.coalesce(F.col("_m.title"), F.nullif(title, F.lit(""))),
    }).drop("_m")


def chapter_in(text: Column) -> Column:
    return first_group(text, r"(?i)Chapter\s+([0-9]+:[0-9]+)")


def legislation_catalog(pages: DataFrame, site: str = "", site_suffix: str = "") -> DataFrame:
    """pages(url, html) to one catalog row per page."""
    head = with_head(pages, site_suffix)
    work, expr = F.col("work_frbr_uri"), F.col("expression_frbr_uri")
    uri = F.lower(F.coalesce(expr, work, F.lit("")))
    number = F.col("frbr_number")
    file_name = F.regexp_extract(F.col("url"), r"([^/]*)/?\z", 1)
    return head.select(
        "url",
        F.coalesce(work, expr, F.lit("")).alias("akn_uri"),
        F.when(uri.contains("/act/si/"), "Statutory Instrument").when(uri.contains("/act/ord/"), "Ordinance")
        .otherwise("Act").alias("nature"),
        F.coalesce("title", file_name).alias("title"),
        chapter_in(visible_text(F.col("html"))).alias("chapter"),
        "work_frbr_uri", "expression_frbr_uri",
        F.coalesce(first_group(expr, r"@(\d{4}-\d{2}-\d{2})"), F.col("publication_date")).alias("effective_date"),
        F.coalesce(first_group(expr, r"/(\d{4})/"), F.when(number.rlike(r"^\d{4}\z"), number)).cast("int").alias("year"),
        F.coalesce(F.concat(F.lit(site), F.coalesce(expr, work)), file_name).alias("source_url"),
    )


def first_per_key(catalog: DataFrame, order: str = "url") -> DataFrame:
    """One row per work (per address where the work is unknown): the first in address order."""
    key = F.coalesce(F.nullif(F.col("akn_uri"), F.lit("")), F.col("url"))
    cols = catalog.columns
    return (
        catalog.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
        .select(*[F.col(f"_r.{c}").alias(c) for c in cols])
    )


def filter_catalog(
    catalog: DataFrame, years: list[int] | None = None, start_year: int | None = None, end_year: int | None = None,
    court: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Optional year list (rows without a year stay), year range, court code and size."""
    out = catalog
    if years is not None:
        out = out.where(F.col("year").isNull() | F.col("year").isin(years))
    if start_year is not None:
        out = out.where(F.col("year") >= start_year)
    if end_year is not None:
        out = out.where(F.col("year") <= end_year)
    if court is not None:
        out = out.where(F.col("court_code") == court)
    return out if limit is None else out.limit(limit)


def sorted_catalog(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("year"), F.desc("court_code"), F.desc("case_number"))


def counts_by(catalog: DataFrame, column: str) -> DataFrame:
    return catalog.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


# --- judgments -------------------------------------------------------------


def judge_names(text: Column) -> Column:
    """Names that end in a judicial suffix; otherwise the separated parts that contain one."""
    flat = strip(collapse_ws(F.coalesce(text, F.lit(""))))
    direct = F.regexp_extract_all(flat, F.lit(rf"([A-Z][A-Za-z\-.'\s]+\s(?:CJ|DCJ|JA|AJA|JP|J){E})"), F.lit(1))
    parts = F.filter(
        F.transform(F.split(flat, r",|;|\band\b|&"), strip), lambda p: p.rlike(r"\b(CJ|DCJ|JA|AJA|JP|J)\b")
    )
    names = F.when(F.size(direct) > 0, direct).otherwise(parts)
    trimmed = F.transform(names, lambda m: F.regexp_replace(collapse_ws(m), r"^[ ,;]+|[ ,;]+\z", ""))
    return F.array_distinct(F.filter(trimmed, lambda n: F.length(n) > 0))


def judges_on_page(html: Column) -> Column:
    """Judges from a definition list, a table row, meta tags, or "Before:" near the top; null if none."""
    label = r"(?is)<dt[^>]*>\s*(?:<[^>]+>\s*)*Judges?\s*:?\s*(?:<[^>]+>\s*)*</dt>\s*<dd[^>]*>(.*?)</dd>"
    row = r"(?is)<t[dh][^>]*>\s*(?:<[^>]+>\s*)*Judges?\s*:?\s*(?:<[^>]+>\s*)*</t[dh]>\s*<td[^>]*>(.*?)</td>"
    meta = r'(?is)<meta[^>]*name=["\']{}["\'][^>]*content=["\']([^"\']*)["\']'
    before = F.regexp_extract(F.substring(strip(collapse_ws(visible_text(html))), 1, 1500), r"(?i)Before\s*:\s*([^\n]{1,160})", 1)
    tries = [
        judge_names(visible_text(F.regexp_extract(html, label, 1))),
        judge_names(visible_text(F.regexp_extract(html, row, 1))),
        judge_names(F.coalesce(first_group(html, meta.format("judges")), first_group(html, meta.format("author")))),
        judge_names(before),
    ]
    return F.coalesce(*[F.when(F.size(t) > 0, t) for t in tries])


def topics_on_page(html: Column, limit: int = 10) -> Column:
    """Keywords, badge labels and Subject or Category lines, distinct, in that order; null if none."""
    def listed(c):
        return F.filter(F.transform(F.split(c, ","), strip), lambda t: F.length(t) > 0)

    keywords = listed(F.coalesce(
        first_group(html, r'(?is)<meta[^>]*name=["\']keywords["\'][^>]*content=["\']([^"\']*)["\']'), F.lit("")))
    badges = F.transform(
        F.regexp_extract_all(html, F.lit(r'(?is)<(?:span|a)\b[^>]*class=["\'][^"\']*(?:badge|label)[^"\']*["\'][^>]*>(.*?)</(?:span|a)>'), F.lit(1)),
        lambda b: strip(collapse_ws(visible_text(b))),
    )
    lines = F.regexp_extract_all(visible_text(html, "\n"), F.lit(r"(?im)^(?:Subject|Category)\s*:\s*(.+)$"), F.lit(1))
    every = F.concat(keywords, badges, F.flatten(F.transform(lines, listed)))
    distinct = F.slice(F.array_distinct(F.filter(every, lambda t: F.length(t) > 0)), 1, limit)
    return F.when(F.size(distinct) > 0, distinct)


def case_name(title: Column) -> Column:
    c = F.regexp_replace(title, r"(?s)\s*\[?\d{4}\]?\s+[A-Z]+\s+\d+.*\z", "")
    return strip(F.regexp_replace(c, r"\s*\(\d+\s+\w+\s+\d{4}\)\s*\z", ""))


def case_parties(name: Column) -> Column:
    """map of role to names, by the form of the case name."""
    two = F.split(name, r"\s+v\.?\s+", 2)
    ok = (name.contains(" v ") | name.contains(" v. ")) & (F.size(two) == 2)
    a, b = strip(F.get(two, F.lit(0))), strip(F.get(two, F.lit(1)))
    appeal = (F.lower(a).contains("appellant") | F.lower(b).contains("respondent")) & ~F.lower(a).isin("state", "the state", "s")
    none = F.array().cast("array<string>")

    def role(test, value):
        return F.when(ok & test, F.array(value)).otherwise(none)

    return F.create_map(
        F.lit("plaintiff"), role(~appeal, a), F.lit("defendant"), role(~appeal, b),
        F.lit("appellant"), role(appeal, a), F.lit("respondent"), role(appeal, b),
    )


def judgment_catalog(pages: DataFrame, site_suffix: str = "") -> DataFrame:
    """pages(url, html) to judgment rows; pages without a PDF link are left out."""
    head = with_head(pages, site_suffix)
    expr = F.col("expression_frbr_uri")
    title = F.coalesce("title", F.lit("Untitled Judgment"))
    rows = head.where(F.exists(link_array(F.col("html")), lambda a: a["text"].contains("Download PDF") | F.lower(a["href"]).contains(".pdf")))
    rows = rows.withColumn("akn_uri", F.coalesce("work_frbr_uri", expr, F.col("url"))).withColumn("_title", title)
    uri = F.col("akn_uri")
    code = F.coalesce(first_group(uri, r"/judgment/([a-z]+)/"), F.lit("unknown"))
    court = F.upper(code)
    for key, name in COURT_CODES.items():
        court = F.when(code == key, name).otherwise(court)
    cited = rf"\[(\d{{4}})\]\s+([A-Z]+)\s+(\d+)"
    from_uri = r"/([a-z]+)/(\d{4})/(\d+)/"

    def citation(subject, pattern, order):
        y, c, n = (F.regexp_extract(subject, pattern, i) for i in order)
        return F.when(subject.rlike(pattern), F.concat(F.lit("["), y, F.lit("] "), F.upper(c), F.lit(" "), n))

    year = first_group(uri, r"/(\d{4})/").cast("int")
    lang = first_group(expr, r"/([a-z]{2,3})@")
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    in_title = F.date_format(F.try_to_date(first_group(F.col("_title"), r"\((\d+\s+\w+\s+\d{4})\)"), "d MMMM yyyy"), "yyyy-MM-dd")
    rows = rows.withColumns({
        "court_code": code,
        "court": F.when(code == "unknown", "Unknown Court").otherwise(court),
        "citation": F.coalesce(citation(F.col("_title"), cited, (1, 2, 3)), citation(uri, from_uri, (2, 1, 3))),
        "case_name": case_name(F.col("_title")),
        "year": year,
        "case_number": F.coalesce(
            first_group(F.col("_title"), r"\((\d+\s+of\s+\d{4})\)"),
            F.when(uri.rlike(r"/(\d{4})/(\d+)/"), F.concat(F.regexp_extract(uri, r"/(\d{4})/(\d+)/", 2), F.lit(" of "), F.regexp_extract(uri, r"/(\d{4})/(\d+)/", 1))),
            F.concat(F.lit("unknown of "), year.cast("string")), F.lit("unknown")),
        "judgment_date": F.coalesce(first_group(expr, r"@(\d{4}-\d{2}-\d{2})"), in_title, F.concat(year.cast("string"), F.lit("-01-01"))),
        "language": F.coalesce(F.try_element_at(names, lang), lang, F.lit("English")),
        "judges": judges_on_page(F.col("html")),
        "topics": topics_on_page(F.col("html")),
    })
    human = F.date_format(F.try_to_date("judgment_date", "yyyy-MM-dd"), "dd MMMM yyyy")
    return rows.withColumns({
        "parties": case_parties(F.col("case_name")),
        "citation_full": F.trim(F.concat_ws(
            " ", F.nullif("case_name", F.lit("")), F.concat(F.lit("("), "case_number", F.lit(")")), "citation",
            F.concat(F.lit("("), human, F.lit(")")))),
        "pdf_name": judgment_file_name("akn_uri", "expression_frbr_uri", "case_name"),
    }).drop("html", "_title", "frbr_number", "publication_date")


# --- links -----------------------------------------------------------------


def link_array(html: Column) -> Column:
    """array of (href, text) of all anchors."""
    whole = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0))
    return F.transform(
        whole,
        lambda m: F.struct(
            F.regexp_extract(m, ANCHOR, 1).alias("href"), strip(collapse_ws(visible_text(F.regexp_extract(m, ANCHOR, 2)))).alias("text")
        ),
    )


def links(pages: DataFrame) -> DataFrame:
    return pages.withColumn("_links", link_array(F.col("html"))).select("url", F.explode_outer("_links").alias("_l")).where(F.col("_l").isNotNull()).select(
        F.col("url").alias("page_url"), "_l.href", "_l.text",
        F.lower("_l.href").endswith(".pdf").alias("is_pdf"),
        F.col("_l.href").contains("/akn/zw/judgment/").alias("is_judgment"),
    )


def listed_years(pages: DataFrame) -> DataFrame:
    """Years between 1980 and 2030 that appear as link texts, newest first."""
    year = F.when(F.col("text").rlike(r"^\d{4}\z"), F.col("text").cast("int"))
    return links(pages).select(year.alias("year")).where(F.col("year").between(1980, 2030)).distinct().orderBy(F.desc("year"))


def index_rows(pages: DataFrame, prefix: str = "/akn/zw/act/") -> DataFrame:
    """Document address and chapter of every row of the index table."""
    table = F.regexp_extract("html", r'(?is)<div[^>]*class=["\'][^"\']*table-responsive[^"\']*["\'][^>]*>.*?<table[^>]*class=["\'][^"\']*doc-table[^"\']*["\'][^>]*>(.*?)</table>', 1)
    rows = pages.withColumn("_rows", F.regexp_extract_all(table, F.lit(ROW), F.lit(1))).select("url", F.explode("_rows").alias("_row"))
    hrefs = F.transform(link_array(F.col("_row")), lambda a: a["href"])
    cells = F.regexp_extract_all("_row", F.lit(CELL), F.lit(1))
    first = F.get(F.filter(hrefs, lambda h: h.startswith(prefix)), F.lit(0))
    chapters = F.array_compact(F.transform(
        F.filter(cells, lambda c: ~F.contains(c, first)), lambda c: chapter_in(visible_text(c))))
    return rows.withColumn("href", first).where(F.col("href").isNotNull()).select(
        F.col("url").alias("page_url"), "href", F.get(chapters, F.lit(0)).alias("chapter")
    ).distinct()

"""Document and chunk metadata: hierarchy, instrument details, propagation, titles, conforming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketlake.constants import CONSTITUTION_PHRASES, COURT_CODES, HIERARCHY, VECTOR_COLUMNS
from docketlake.functions.text import NOT_AFTER_WORD as B, NOT_BEFORE_WORD as E, _c, strip

HIERARCHY_FIELDS = ["authority_level", "hierarchy_rank", "binding_scope", "subject_category"]


def _filled(c: Column, kind: str = "string") -> Column:
    """Null for empty text and for 0."""
    return F.nullif(c, F.lit(0)) if kind == "int" else F.nullif(c, F.lit(""))


def hierarchy_value(field: str, doc_type: Column, default=None) -> Column:
    position = HIERARCHY_FIELDS.index(field) + 1
    out = F.lit(default)
    for row in HIERARCHY:
        out = F.when(doc_type == row[0], F.lit(row[position])).otherwise(out)
    return out


def _kind(field: str) -> str:
    return "int" if field == "hierarchy_rank" else "string"


def repair_document_hierarchy(docs: DataFrame) -> DataFrame:
    """Rewrite all four fields unless all four are filled; other types become unknown with rank 99."""
    complete = F.lit(True)
    for f in HIERARCHY_FIELDS:
        complete = complete & _filled(F.col(f), _kind(f)).isNotNull()
    unknown = {"hierarchy_rank": 99}
    return docs.withColumn("hierarchy_fixed", ~complete).withColumns({
        f: F.when(complete, F.col(f)).otherwise(hierarchy_value(f, F.col("doc_type"), unknown.get(f, "unknown")))
        for f in HIERARCHY_FIELDS
    })


def repair_chunk_hierarchy(chunks: DataFrame) -> DataFrame:
    """Fill each missing field on its own; unknown types stay as they are."""
    kind = F.lower(F.coalesce("doc_type", F.lit("unknown")))
    known = kind.isin([row[0] for row in HIERARCHY])
    missing = F.lit(False)
    for f in HIERARCHY_FIELDS:
        missing = missing | _filled(F.col(f), _kind(f)).isNull()
    return chunks.withColumn("hierarchy_fixed", known & missing).withColumns({
        f: F.coalesce(_filled(F.col(f), _kind(f)), hierarchy_value(f, kind), F.col(f)) for f in HIERARCHY_FIELDS
    })


def parse_hierarchy(doc_type: Column, court: Column) -> dict[str, Column]:
    """Authority at parse time, with judgments ranked by court."""
    c = F.lower(F.coalesce(court, F.lit("")))
    top, high = c.contains("constitutional court"), c.contains("supreme court")
    judgment = doc_type == "judgment"

    def pick(judged, by_type):
        out = F.lit(None)
        for kind, value in by_type.items():
            out = F.when(doc_type == kind, F.lit(value)).otherwise(out)
        return F.when(judgment, F.when(top, judged[0]).when(high, judged[1]).otherwise(judged[2])).otherwise(out)

    return {
        "authority_level": pick(("supreme", "high", "medium"), {r[0]: r[1] for r in HIERARCHY}),
        "hierarchy_rank": pick((1, 2, 3), {r[0]: r[2] for r in HIERARCHY}),
        "binding_scope": pick(("all_courts", "all_courts", "persuasive"), {r[0]: r[3] for r in HIERARCHY}),
    }


# --- instruments and ordinances --------------------------------------------


def enhance_instruments(docs: DataFrame) -> DataFrame:
    """Year, number, date and nature of statutory instruments and ordinances from file name and title.

    Expects doc_type, pdf_key, title, year, date_context, nature, act_year, version_date; fills only
    what is missing.
    """
    name = F.regexp_extract(F.coalesce("pdf_key", F.lit("")), r"([^/]*)\z", 1)
    title = F.lower(F.coalesce("title", F.lit("")))
    si, ordinance = F.col("doc_type") == "si", F.col("doc_type") == "ordinance"
    pattern = r"{}_(\d{{4}})_(\d+)_eng_(\d{{4}}-\d{{2}}-\d{{2}})"

    def exact(tag, group):
        return F.nullif(F.regexp_extract(name, pattern.format(tag), group), F.lit(""))

    def found(p):
        return F.regexp_extract_all(name, F.lit(p), F.lit(1))

    old_years = F.filter(F.transform(found(r"(\d{4})"), lambda y: y.cast("int")), lambda y: y >= 1800)
    matched = F.when(si, exact("si", 1)).otherwise(exact("ord", 1)).isNotNull()
    year = (
        F.when(si & matched, exact("si", 1).cast("int"))
        .when(si, F.get(found(r"(20\d{2})"), F.lit(0)).cast("int"))
        .when(matched, exact("ord", 1).cast("int"))
        .otherwise(F.array_min(old_years))
    )
    date = (
        F.when(si & matched, exact("si", 3))
        .when(si, F.try_element_at(found(r"(20\d{2}-\d{2}-\d{2})"), F.lit(-1)))
        .when(matched, exact("ord", 3))
        .otherwise(F.try_element_at(found(r"(\d{4}-\d{2}-\d{2})"), F.lit(-1)))
    )
    nature = (
        F.when(~si, "Ordinance").when(title.contains("rules"), "Rules").when(title.contains("regulations"), "Regulations")
        .when(title.contains("notice"), "Notice").when(title.contains("order"), "Order").otherwise("Statutory Instrument")
    )
    applies = (si | ordinance) & (F.coalesce(F.length("pdf_key"), F.lit(0)) > 0)
    number = F.when(si, exact("si", 2)).otherwise(exact("ord", 2)).cast("int")

    def fill(column, value, kind="string"):
        return F.coalesce(_filled(F.col(column), kind), F.when(applies, value), F.col(column))

    return docs.withColumns({
        "year": fill("year", year, "int"),
        "instrument_number": F.when(applies, number),
        "date_context": fill("date_context", date),
        "nature": fill("nature", nature),
        "act_year": fill("act_year", year, "int"),
        "version_date": fill("version_date", date),
    })


def enhance_instrument_chunks(chunks: DataFrame) -> DataFrame:
    """Nature by type and year from the title, where year, date or nature is missing."""
    nature = F.when(F.col("doc_type") == "si", "Statutory Instrument").when(F.col("doc_type") == "ordinance", "Ordinance")
    found = F.nullif(F.regexp_extract(F.coalesce("title", F.lit("")), r"(19\d{2}|20\d{2})", 1), F.lit("")).cast("int")
    return chunks.withColumns({
        "nature": F.coalesce(_filled(F.col("nature")), nature, F.col("nature")),
        "year": F.coalesce(_filled(F.col("year"), "int"), found, F.col("year")),
    })


def propagate_metadata(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Document values into empty chunk fields; year before act_year, date_context before version_date."""
    inherited = ["title", "canonical_citation", "akn_uri", "pageindex_doc_id"]
    source = docs.select(
        "doc_id",
        F.coalesce(_filled(F.col("year"), "int"), _filled(F.col("act_year"), "int")).alias("_year"),
        F.coalesce(_filled(F.col("date_context")), _filled(F.col("version_date"))).alias("_date_context"),
        _filled(F.col("nature")).alias("_nature"),
        *[_filled(F.col(c)).alias(f"_{c}") for c in inherited],
    )
    fields = [("year", "int"), ("date_context", "string"), ("nature", "string"), *[(c, "string") for c in inherited]]
    changed = F.lit(False)
    for c, kind in fields:
        changed = changed | (_filled(F.col(c), kind).isNull() & F.col(f"_{c}").isNotNull())
    joined = chunks.join(source, "doc_id", "left").withColumn("modified", changed)
    filled = joined.withColumns({c: F.coalesce(_filled(F.col(c), kind), F.col(f"_{c}"), F.col(c)) for c, kind in fields})
    return filled.drop(*[f"_{c}" for c, _ in fields])


# --- vector table ----------------------------------------------------------


def conform_vectors(chunks: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows for the vector table, rejected rows). Rows without chunk_id or object key are rejected;
    with ``strict`` the first one raises an error instead."""
    have = set(chunks.columns)

    def text(name, size, default):
        c = F.col(name) if name in have else F.lit(None).cast("string")
        if name == "parent_doc_id" and "doc_id" in have:
            c = F.coalesce(c, F.col("doc_id").cast("string"))
        return F.substring(F.coalesce(c, F.lit(default)), 1, size).alias(name)

    def number(name):
        return F.coalesce(F.col(name) if name in have else F.lit(None), F.lit(0)).cast("long").alias(name)

    source = F.coalesce(*[_filled(F.col(c)) for c in ("source_document_key", "pdf_key") if c in have], F.lit(""))
    missing = (F.coalesce("chunk_id", F.lit("")) == "") | (F.coalesce("chunk_object_key", F.lit("")) == "")
    good = chunks.where(~missing)
    if strict:
        good = chunks.where(F.when(missing, F.raise_error(F.lit("chunk_id and chunk_object_key are required"))).otherwise(True))
    out = good.select(
        "chunk_id", *(["embedding"] if "embedding" in have else []), "chunk_object_key",
        source.alias("source_document_key"),
        *[text(*column) for column in VECTOR_COLUMNS],
        *[number(c) for c in ("num_tokens", "year", "hierarchy_rank")],
    )
    return out, chunks.where(missing)


# --- document metadata ------------------------------------------------------

LEGISLATION_NAME = r"akn_([a-z]{2})_([a-z]+)_(\d{4})_(\d+)_([a-z]{3})_(\d{4}-\d{2}-\d{2})"
JUDGMENT_NAME = r"([a-z]+)_(\d{4})_(\d+)_([a-z]{3})_(\d{4}-\d{2}-\d{2})_(.+?)_([a-f0-9]{8})\.pdf"
TITLE_LINE = rf"^([A-Z][A-Za-z'\- ]+?(?:Act|Ordinance|Constitution)){E}"
INSTRUMENT_LINE = rf"(Statutory\s+Instrument\s+No\.?\s*\d+\s*of\s*\d{{4}}){E}"
SHORT_TITLE = rf"(?i)This\s+(?:Act|Ordinance|Constitution)\s+may\s+be\s+cited\s+as\s+the\s+(.+?)\s+(Act|Ordinance|Constitution){E}"
CONSTITUTION_TITLE = "Constitution of Zimbabwe"


def court_name(code: Column) -> Column:
    out = F.upper(code)
    for key, name in COURT_CODES.items():
        out = F.when(F.lower(code) == key, name).otherwise(out)
    return out


def detect_type(key: Column, content: Column) -> Column:
    """Document type from the path, then from the text."""
    low = F.lower(F.coalesce(content, F.lit("")))
    head = F.substring(low, 1, 200)
    constitution = F.lit(False)
    for phrase in CONSTITUTION_PHRASES:
        constitution = constitution | low.contains(phrase)
    return (
        F.when(F.lower(key).contains("/constitution/"), "constitution")
        .when(key.contains("/acts/"), "act").when(key.contains("/ordinances/"), "ordinance")
        .when(key.contains("/statutory_instruments/"), "si")
        .when(key.contains("/judgments/") | key.contains("/judgements/"), "judgment")
        .when(key.contains("/case_law/"), "case")
        .when(constitution, "constitution")
        .when(low.contains("statutory instrument") & ~head.contains("act"), "si")
        .when(low.contains("ordinance") & ~head.contains("act"), "ordinance")
        .otherwise("act")
    )


def clean_title(title: Column) -> Column:
    t = F.regexp_replace(strip(title), r"^\d+\.\s+", "")
    return strip(F.regexp_replace(t, r"(?i)\s*Chapter\s+\d+:\d+\s*\z", ""))


def legislation_title(base: Column, tree_titles: Column, markdown: Column) -> Column:
    """Title ladder: title lines of the text, wider patterns, tree headings, file name."""
    heading = F.get(
        F.filter(
            F.transform(tree_titles, strip),
            lambda t: t.rlike(rf"{B}(Act|Ordinance|Constitution){E}") | t.startswith("Statutory Instrument")
            | F.lower(t).contains("constitution of zimbabwe"),
        ),
        F.lit(0),
    )
    lines = F.transform(F.split(markdown, "\n"), strip)

    def line_title(ln):
        return (
            F.when(F.lower(ln).contains("constitution of zimbabwe"), CONSTITUTION_TITLE)
            .when(ln.rlike(TITLE_LINE), strip(F.regexp_extract(ln, TITLE_LINE, 1)))
            .when(ln.rlike("^" + INSTRUMENT_LINE), F.regexp_extract(ln, "^" + INSTRUMENT_LINE, 1))
        )

    from_lines = F.get(F.array_compact(F.transform(lines, line_title)), F.lit(0))

    def wide(pattern, flatten=False):
        c = strip(F.regexp_extract(markdown, pattern, 1))
        c = F.regexp_replace(c, r"\s+", " ") if flatten else c
        return F.when(F.length(c) >= 6, c)

    from_text = F.coalesce(
        F.when(markdown.rlike(r"(?i)Constitution\s+of\s+Zimbabwe|Zimbabwe\s+Constitution"), CONSTITUTION_TITLE),
        wide(rf"([A-Z][A-Za-z'\-\s]+Act){E}", True),
        wide(rf"([A-Z][A-Za-z'\-\s]+Ordinance){E}"),
        wide(INSTRUMENT_LINE),
        wide(rf"([A-Z][A-Za-z'\-\s]+Constitution){E}"),
    )
    title = F.coalesce(from_lines, from_text, _filled(clean_title(heading)), base)
    cited = F.concat_ws(" ", strip(F.regexp_extract(markdown, SHORT_TITLE, 1)), F.initcap(F.regexp_extract(markdown, SHORT_TITLE, 2)))
    vague = (F.length(title) == 0) | F.lower(title).isin("this act", "this ordinance", "this constitution")
    return F.when(vague & markdown.rlike(SHORT_TITLE), clean_title(cited)).otherwise(title)


def document_metadata(docs: DataFrame, judgments: bool = False) -> DataFrame:
    """key, markdown and tree_titles to title, type, citation, dates and authority.

    ``judgments`` reads the judgment file name pattern, otherwise the legislation pattern.
    """
    key = F.col("key")
    text = F.coalesce("markdown", F.lit(""))
    name = F.regexp_extract(key, r"([^/]*)\z", 1)
    base_title = F.regexp_replace(name, r"\.pdf", "")
    pattern, subject = (JUDGMENT_NAME, name) if judgments else (LEGISLATION_NAME, key)
    hit = subject.rlike(pattern)

    def g(i):
        return F.nullif(F.regexp_extract(subject, pattern, i), F.lit(""))

    detected = docs.withColumn("_hit", hit).withColumn("_detected", detect_type(key, F.col("markdown")))
    if judgments:
        code, year, number, lang, date = g(1), g(2), g(3), g(4), g(5)
        case_name = F.initcap(F.replace(g(6), F.lit("_"), F.lit(" ")))
        citation = F.concat(F.lit("["), year, F.lit("] "), F.upper(code), F.lit(" "), number)
        out = detected.withColumns({
            "doc_type": F.when(F.col("_hit"), "judgment").otherwise(F.col("_detected")),
            "title": F.coalesce(case_name, base_title), "case_name": case_name, "citation": citation,
            "court": court_name(code), "court_code": F.upper(code), "case_number": F.concat(number, F.lit(" of "), year),
            "judgment_date": date, "language": F.coalesce(lang, F.lit("eng")), "jurisdiction": F.lit("ZW"), "act_year": year,
            "akn_uri": F.concat(F.lit("/akn/zw/judgment/"), code, F.lit("/"), year, F.lit("/"), number, F.lit("/"), lang, F.lit("@"), date),
            "canonical_citation": F.concat(case_name, F.lit(" "), citation, F.lit(" ("), date, F.lit(")")),
        })
        category = F.when(F.col("doc_type").isin("judgment", "case"), "case_law")
    else:
        place, kind, year, number, lang, date = (g(i) for i in range(1, 7))
        chapter = F.nullif(F.regexp_extract(text, r"(?i)Chapter\s+(\d+:\d+)", 1), F.lit(""))
        out = detected.withColumns({
            "doc_type": F.coalesce(kind, F.col("_detected")),
            "title": legislation_title(base_title, F.col("tree_titles"), text),
            "chapter": chapter, "jurisdiction": F.coalesce(F.upper(place), F.lit("ZW")),
            "language": F.coalesce(lang, F.lit("eng")), "act_year": year, "act_number": number, "version_date": date,
            "akn_uri": F.concat(F.lit("/akn/"), place, F.lit("/"), kind, F.lit("/"), year, F.lit("/"), number, F.lit("/"), lang, F.lit("@"), date),
            "court": F.lit(None).cast("string"),
        })
        out = out.withColumn(
            "canonical_citation",
            F.when((F.col("doc_type") != "constitution") & F.col("chapter").isNotNull(),
                   F.concat("title", F.lit(" [Chapter "), "chapter", F.lit("]"))).otherwise(F.col("title")),
        )
        category = F.when(F.col("doc_type").isin("judgment", "case"), "case_law")
    default_category = F.when(F.col("doc_type") == "constitution", "constitutional_law").otherwise("legislation")
    return out.withColumn("subject_category", F.coalesce(category, default_category)).withColumns(
        parse_hierarchy(F.col("doc_type"), F.col("court"))
    ).drop("_hit", "_detected")

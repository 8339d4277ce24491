"""Query understanding: dates, sections, variants, intent and follow-ups, as ordered Column rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docketlake.functions.text import NOT_AFTER_WORD, NOT_BEFORE_WORD, WS, _c, collapse_ws, normalize_query, strip, word_count
from docketlake.operators.fusion import complexity_value

DATE_PHRASE = rf"(?i){NOT_AFTER_WORD}(?:as\s+(?:at|of)|on|before|after)\s+(\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}){NOT_BEFORE_WORD}"

# --- fixed word lists of the rule-based classifier ---------------------------
PROFESSIONAL_SIGNS = [
    r"\bact\b.*\[chapter", r"section \d+\(", r"\bsi \d+/", r"\bv\.", r"\bsc \d+/", "constitutional court",
    "precedent", "ratio decidendi", "obiter dicta", "statutory interpretation", r"\birac\b", "legal framework",
    "pursuant to", "notwithstanding", "hereinafter",
]
GREETINGS = [
    "hello", "hi", "hey", "thanks", "thank you", "bye", "goodbye", "how are you",
    "good morning", "good afternoon", "good evening",
]
SUMMARY_PHRASES = [
    "summarize", "summary", "tl;dr", "tldr", "explain differently", "what did you say", "what did you just say",
    "repeat that", "can you explain", "break it down", "in simple terms",
]
CONSTITUTION_WORDS = ["constitution", "constitutional", "fundamental right", "bill of rights"]
STATUTE_PATTERN = r"(act|statute|section|chapter \d+)"
PROCEDURE_WORDS = ["procedure", "file", "court process", "how to", "steps"]
CASE_WORDS = ["precedent", "judgment", "court held", "ruling", "held in"]
RIGHTS_WORDS = ["my rights", "can i", "am i allowed", "do i have to"]
UNCLEAR_WORDS = ["what do you mean", "clarify", "i don't understand", "unclear"]
LEGAL_WORDS = [
    "act", "law", "legal", "statute", "regulation", "chapter", "section", "court", "judge", "penalty", "fine",
    "employment", "labour", "contract", "company", "registration", "license", "permit", "rights", "obligations",
    "wage", "salary", "tax", "duty", "liability", "damages", "compensation",
]
STATUTE_CONNECTIVES = [" and ", " or ", "versus", "compare", "between", "differences"]
GENERAL_CONNECTIVES = [" and ", " or ", "versus", "compare", "between"]
STATUTE_AREAS = [
    ("labour_law", ["labour", "employment", "worker"]),
    ("company_law", ["company", "director", "shareholder"]),
    ("criminal_law", ["criminal", "offence", "penalty"]),
]
GENERAL_AREAS = [
    ("labour_law", ["labour", "employment", "worker", "salary", "wage"]),
    ("company_law", ["company", "director", "shareholder", "corporation"]),
    ("criminal_law", ["criminal", "offence", "penalty"]),
    ("contract_law", ["contract", "agreement", "breach", "damages"]),
]
FOLLOW_UP_PATTERNS = [
    r"^(what about|how about|and if|but if|also|additionally)",
    r"\b(it|that|this|those|these)\b",
    r"(as you (said|mentioned)|as mentioned)",
    r"^(yes,?\s|no,?\s|okay,?\s)",
    r"(tell me more|explain|clarify|elaborate)",
    r"(the same|similar)",
]
JURISDICTION_WORDS = ["zimbabwe", "zimbabwean", "zw", "harare"]
DECOMPOSITION_WORDS = [
    " and ", " or ", "compare", "versus", "vs", "difference between", "both", "either", "as well as",
    "in addition to", "also",
]


def any_of(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def count_of(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [c.contains(p).cast("int") for p in parts])


def any_match(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def date_context(query: Column | str) -> Column:
    """struct(clean_query, date): a phrase like "as at 2023-01-01" is taken out of the query."""
    q = _c(query)
    found = F.regexp_extract(q, DATE_PHRASE, 1)
    clean = collapse_ws(strip(F.regexp_replace(q, DATE_PHRASE, "")))
    return F.struct(
        F.when(found != "", clean).otherwise(q).alias("clean_query"),
        F.when(found != "", F.translate(found, "/", "-")).alias("date"),
    )


def section_of(query: Column | str) -> Column:
    q = _c(query)
    tries = [
        F.nullif(F.regexp_extract(q, rf"(?i){NOT_AFTER_WORD}{p}([0-9]+[A-Za-z]?){NOT_BEFORE_WORD}", 1), F.lit(""))
        for p in (rf"section{WS}+", rf"s\.?{WS}*", rf"sec\.?{WS}*")
    ]
    return F.upper(F.coalesce(*tries))


def chapter_of(query: Column | str) -> Column:
    found = F.regexp_extract(
        _c(query), rf"(?i){NOT_AFTER_WORD}chapter{WS}*([0-9]{{1,3}}:[0-9]{{2}}){NOT_BEFORE_WORD}", 1
    )
    return F.nullif(found, F.lit(""))


def intent_flags(query: Column | str, statutes: Column | None = None) -> Column:
    """Lookup flags from the normalized query; ``statutes`` is an optional array of recognized titles."""
    norm = normalize_query(query)
    section, chapter = section_of(norm), chapter_of(norm)
    has_statutes = F.lit(False) if statutes is None else F.size(statutes) > 0
    return F.struct(
        (section.isNotNull() & (has_statutes | chapter.isNotNull())).alias("section_lookup"),
        (has_statutes & section.isNull()).alias("statute_lookup"),
        (~(has_statutes | section.isNotNull())).alias("general_question"),
        section.alias("section"),
        chapter.alias("chapter"),
    )


def distinct_capped(variants: Column, limit: int) -> Column:
    """Non-empty values in first-seen order, at most ``limit``."""
    return F.slice(F.array_distinct(F.filter(variants, lambda v: v.isNotNull() & (v != ""))), 1, limit)


def reformulations(query: Column | str, limit: int = 4) -> Column:
    base = normalize_query(query)
    section, chapter = section_of(base), chapter_of(base)
    spelled = F.regexp_replace(base, rf"(?i){NOT_AFTER_WORD}s\.?{WS}*(\d+[A-Za-z]?)", "section $1")
    variants = F.array(
        base,
        F.when(F.concat(F.lit(" "), base, F.lit(" ")).contains(" si "), F.replace(base, F.lit(" si "), F.lit(" statutory instrument "))),
        F.when(section.isNotNull(), spelled),
        F.when(chapter.isNotNull() & ~F.contains(base, chapter), F.concat_ws(" chapter ", base, chapter)),
    )
    return distinct_capped(variants, limit)


def _area(q: Column, table) -> Column:
    out = F.lit("general")
    for name, parts in reversed(table):
        out = F.when(any_of(q, parts), F.lit(name)).otherwise(out)
    return out


def classify_intents(df: DataFrame, query: str = "query") -> DataFrame:
    """Add intent, complexity, user_type, confidence, framework, area, retrieve and keep; null if unclear.

    The tests become columns first and the first true one is the rule, so that no test is evaluated
    once per output field.
    """
    raw = _c(query)
    base = df.withColumn("_q", strip(F.lower(raw))).withColumn("_n", word_count(raw))
    q, n = F.col("_q"), F.col("_n")
    base = base.withColumns({
        "_pro": any_match(q, PROFESSIONAL_SIGNS),
        "_several": any_of(q, STATUTE_CONNECTIVES),
        "_joined": any_of(q, GENERAL_CONNECTIVES),
        "_legal": count_of(q, LEGAL_WORDS),
        "_statute_area": _area(q, STATUTE_AREAS),
        "_general_area": _area(q, GENERAL_AREAS),
    })
    rule = (
        F.when(q.rlike(NOT_AFTER_WORD + "(" + "|".join(GREETINGS) + ")" + NOT_BEFORE_WORD), "greeting")
        .when(any_of(q, SUMMARY_PHRASES), "summary")
        .when(any_of(q, CONSTITUTION_WORDS), "constitution")
        .when(q.rlike(STATUTE_PATTERN), "statute")
        .when(any_of(q, PROCEDURE_WORDS), "procedure")
        .when(any_of(q, CASE_WORDS), "case")
        .when(any_of(q, RIGHTS_WORDS), "rights")
        .when(any_of(q, UNCLEAR_WORDS), "unclear")
        .when(F.col("_legal") > 0, "general")
    )
    base = base.withColumn("_rule", rule)
    r = F.col("_rule")
    user = F.when(F.col("_pro") & ~r.isin("greeting", "rights"), "professional").otherwise("citizen")
    statute_level = F.when((n >= 25) | F.col("_several") | F.col("_pro"), "complex").otherwise("moderate")
    general_level = (
        F.when((n >= 25) | (F.col("_joined") & (F.col("_legal") >= 3)), "complex")
        .when((n > 15) | (F.col("_legal") >= 2), "moderate")
        .otherwise("simple")
    )

    def by_rule(**values) -> Column:
        out = F.lit(None)
        for name, value in values.items():
            out = F.when(r == name, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
        return out

    base = base.withColumns({
        "intent": by_rule(greeting="conversational", summary="summarize", unclear="disambiguate", constitution="rag_qa",
                          statute="rag_qa", procedure="rag_qa", case="rag_qa", rights="rag_qa", general="rag_qa"),
        "complexity": by_rule(greeting="simple", summary="simple", constitution="complex", statute=statute_level,
                              procedure="simple", case="complex", rights="simple", unclear="simple", general=general_level),
        "user_type": F.when(r.isNotNull(), user),
        "confidence": by_rule(greeting=0.95, summary=0.9, constitution=0.9, statute=0.85, procedure=0.8, case=0.85,
                              rights=0.85, unclear=0.8, general=0.7),
        "framework": by_rule(greeting="none", summary="none", constitution="constitutional", statute="statutory",
                             procedure="irac", case="precedent", rights="irac", unclear="irac", general="irac"),
        "area": by_rule(greeting="", summary="", constitution="constitutional_law", statute=F.col("_statute_area"),
                        procedure="procedure", case="case_law", rights="general", unclear="general",
                        general=F.col("_general_area")),
    })
    silent = r.isin("greeting", "summary")
    return base.withColumns({
        "retrieve": F.when(silent, 0).when(r.isNotNull(), complexity_value("retrieve")),
        "keep": F.when(silent, 0).when(r.isNotNull(), complexity_value("keep")),
    }).drop("_q", "_n", "_pro", "_several", "_joined", "_legal", "_statute_area", "_general_area", "_rule")


def is_follow_up(query: Column | str) -> Column:
    return any_match(F.lower(_c(query)), FOLLOW_UP_PATTERNS)


def jurisdiction_of(query: Column | str) -> Column:
    return F.when(any_of(F.lower(_c(query)), JURISDICTION_WORDS), "ZW")


def needs_decomposition(query: Column | str) -> Column:
    return any_of(F.lower(_c(query)), DECOMPOSITION_WORDS)


def rewrite_query(query: Column | str, jurisdiction: Column | None = None, as_of: Column | None = None,
                  interest: Column | None = None) -> Column:
    """Query plus topic words, jurisdiction and date hints; ``interest`` is the user's main area."""
    q = _c(query)
    low = F.lower(q)
    topic = (
        F.when(low.contains("rights") | low.contains("constitution"), " constitutional law Zimbabwe fundamental rights")
        .when(low.contains("act") | low.contains("law"), " Zimbabwe legislation statutory provisions")
        .otherwise("")
    )
    hint = F.lit("")
    if interest is not None:
        hint = F.when(
            interest.isNotNull() & ~F.contains(low, interest), F.concat(F.lit(" (user context: "), interest, F.lit(")"))
        ).otherwise("")

    def tail(label, value):
        if value is None:
            return F.lit("")
        return F.when(value.isNotNull(), F.concat(F.lit(f" [{label}: "), value, F.lit("]"))).otherwise("")

    return F.concat(q, hint, topic, tail("Jurisdiction", jurisdiction), tail("As of", as_of))


def category_variants(query: Column | str, category: Column | str) -> Column:
    q, c = _c(query), _c(category)
    extra = (
        F.when(c == "corporate", F.array(F.lit(" company law"), F.lit(" business regulations")))
        .when(c == "constitutional", F.array(F.lit(" constitutional law"), F.lit(" rights")))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.concat(F.array(q), F.transform(extra, lambda s: F.concat(q, s)))


def gap_query(query: Column | str, issues: Column, source_types: Column) -> Column:
    """Follow-up query that names what the quality issues miss; looks at the first five source types."""
    low = F.transform(issues, F.lower)

    def about(*parts):
        return F.exists(low, lambda i: any_of(i, list(parts)))

    missing = F.array_compact(F.array(
        F.when(about("citation", "source"), "legal citations and statutory references"),
        F.when(about("coverage", "incomplete"), "comprehensive coverage"),
        F.when(about("case law", "precedent"), "case law precedents"),
        F.when(about("constitutional"), "constitutional provisions"),
    ))
    kinds = F.slice(source_types, 1, 5)
    statute, case = F.array_contains(kinds, "statute"), F.array_contains(kinds, "case_law")
    focus = F.when(
        F.size(missing) > 0, F.concat(F.lit(" - specifically focusing on "), F.array_join(missing, ", "))
    ).otherwise(" - additional legal sources and authorities")
    other = (
        F.when(statute & ~case, " including case law and judicial precedents")
        .when(case & ~statute, " including statutory provisions and regulations")
        .otherwise("")
    )
    return F.concat(_c(query), focus, other)

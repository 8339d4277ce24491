"""Text normalizing, token estimates, tokenizing and safe names, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docketlake.constants import CHARS_PER_TOKEN, STOP_WORDS

# Unicode white space and word characters, spelled out so that Java, Python and RE2 agree.
# Single characters come first: Java tests them with one bit set before the category.
WS_SET = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x{85}\p{Z}"
WS = f"[{WS_SET}]"
NOT_WS = f"[^{WS_SET}]"
WS_NOT_SPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x{85}\p{Z}&&[^ ]]"
WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse_ws(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), f"{WS}{{2,}}|{WS_NOT_SPACE}", " ")


def strip(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), f"^{WS}+|{WS}+\\z", "")


def normalize_text(col: Column | str, legacy_quotes: bool = False) -> Column:
    """Single spaces, straight quotes (unless legacy_quotes) and plain dashes, trimmed."""
    flat = collapse_ws(col)
    if legacy_quotes:
        flat = F.translate(flat, "—–", "--")
    else:
        flat = F.translate(flat, "“”‘’—–", "\"\"''--")
    return F.trim(flat)


def normalize_query(col: Column | str) -> Column:
    flat = collapse_ws(strip(F.lower(_c(col))))
    return strip(F.regexp_replace(flat, rf"[^\p{{L}}\p{{N}}_{WS_SET}\-.]", " "))


def cache_key(query: Column | str) -> Column:
    """md5 of the lower-cased query with single spaces."""
    return F.md5(strip(collapse_ws(F.lower(_c(query)))))


def word_count(col: Column | str) -> Column:
    return F.regexp_count(_c(col), F.lit(f"{NOT_WS}+"))


def words(col: Column | str) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(f"({NOT_WS}+)"), F.lit(1))


def estimate_tokens(col: Column | str, method: str = "chars") -> Column:
    """chars: length // 4; words: words * 1.3; ratio: int(words / 0.75)."""
    if method == "chars":
        return F.floor(F.length(_c(col)) / CHARS_PER_TOKEN).cast("int")
    if method == "words":
        return word_count(col) * F.lit(1.3)
    if method == "ratio":
        return F.floor(word_count(col) / F.lit(0.75)).cast("int")
    raise ValueError(f"unknown token estimate: {method}")


def legal_tokens(col: Column | str, limit: int | None = None) -> Column:
    """Lower-case alphanumeric tokens with section, chapter and citation references folded into one.

    Tokens that touch other letters (accents, underscores) are not plain words and are left out.
    ``limit`` keeps only the first tokens of a text; by default the whole text is tokenized.
    """
    low = F.lower(_c(col))
    t = F.regexp_replace(low, rf"{NOT_AFTER_WORD}s\.?{WS}*([0-9]+[a-z]?){NOT_BEFORE_WORD}", "section$1")
    t = F.regexp_replace(t, rf"{NOT_AFTER_WORD}sec\.?{WS}*([0-9]+[a-z]?){NOT_BEFORE_WORD}", "section$1")
    t = F.regexp_replace(t, rf"\[chapter{WS}+([0-9:]+)\]", "chapter$1")
    t = F.regexp_replace(t, rf"\[([0-9]{{4}})\]{WS}*([a-z]+){WS}*([0-9]+)", "$1$2$3")
    t = F.when(low.rlike("[0-9]"), t).otherwise(low)  # every fold needs a digit
    found = F.regexp_extract_all(t, F.lit(f"({NOT_AFTER_WORD}[a-z0-9]{{2,}}{NOT_BEFORE_WORD})"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    kept = F.filter(found, lambda w: ~F.array_contains(stop, w))
    return kept if limit is None else F.slice(kept, 1, limit)


def keywords(col: Column | str, limit: int | None = 20) -> Column:
    """Words longer than two characters; the first 20 by definition, all with limit=None."""
    found = F.regexp_extract_all(F.lower(_c(col)), F.lit(rf"({WORD}{{3,}})"), F.lit(1))
    return found if limit is None else F.slice(found, 1, limit)


def slug(col: Column | str, max_len: int = 80) -> Column:
    s = F.lower(F.trim(F.regexp_replace(_c(col), "[^A-Za-z0-9]+", "_"), F.lit("_")))
    s = F.when(F.length(s) > max_len, F.rtrim(F.substring(s, 1, max_len), F.lit("_"))).otherwise(s)
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, F.lit("unknown")).otherwise(s)


def safe_pdf_name(uri: Column | str) -> Column:
    """Path of a document address as one flat file name."""
    path = F.regexp_replace(F.regexp_replace(_c(uri), "^https?://[^/]+", ""), "^/", "")
    name = F.regexp_replace(path, "[^A-Za-z0-9._-]", "_")
    return F.when(name.endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def ascii_only(col: Column | str) -> Column:
    flat = F.translate(_c(col), "“”‘’—–", "\"\"''--")
    return F.regexp_replace(flat, r"[^\x00-\x7F]", "")


def header_value(col: Column | str, max_len: int = 1000) -> Column:
    """Object-store header form: one line, trimmed, bounded; null becomes empty."""
    return F.substring(strip(F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"[\r\n]", " ")), 1, max_len)


def rule_title(text: Column | str, default: str = "Supreme Court Rules, 2025") -> Column:
    """First of the leading 20 lines that reads like a title of rules, an instrument or an act."""
    lines = F.transform(F.slice(F.split(_c(text), "\n"), 1, 20), strip)
    pattern = (
        r"(?i)^(Supreme Court Rules|High Court Rules|[A-Z][A-Za-z\s]+Rules|Statutory Instrument|[A-Z][A-Za-z\s]+Act)"
    )
    return F.coalesce(F.get(F.filter(lines, lambda ln: ln.rlike(pattern)), F.lit(0)), F.lit(default))

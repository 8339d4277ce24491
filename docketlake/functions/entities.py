"""Entity extraction from legal text.

One pass of a multi-pattern automaton finds the literals that every entity holds: words like "Act" or "Justice", month and
court names, digits. The patterns are then tried only at the places from where they can reach such a literal, so prose
without one costs a single pass. The work is done in Arrow batches.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F

from docketlake.constants import COURT_NAMES, MONTHS
from docketlake.functions.text import NOT_AFTER_WORD as B, NOT_BEFORE_WORD as E, _c

MONTH = "(?:" + "|".join(MONTHS) + ")"

# fixed patterns, one per entity type
DATES = (
    rf"{B}(?:\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}|\d{{1,2}}\s+{MONTH}\s+\d{{4}}|{MONTH}\s+\d{{1,2}},?\s+\d{{4}}"
    rf"|(?:19|20)\d{{2}}[-/]\d{{1,2}}[-/]\d{{1,2}}){E}"
)
# the two short forms of a section, then titles of acts with and without their chapter
SECTIONS = rf"{B}s\.?\s*(\d+[A-Z]?)(?:\s*\(\d+\))?(?:\s*\([a-z]\))?|{B}section\s+(\d+[A-Z]?)(?:\s*\(\d+\))?(?:\s*\([a-z]\))?"
STATUTES = rf"{SECTIONS}|{B}([A-Za-z\s]+)\s+Act\s+\[Chapter\s+(\d+:\d+)\]|{B}([A-Za-z\s]+)\s+Act{E}"
CASES = (
    r"\[(\d{4})\]\s+([A-Z]{2,5})\s+(\d+)|(\d{4})\s*\((\d+)\)\s*([A-Z]{2,5})\s*(\d+)"
    r"|S\s+v\s+([A-Z][a-z]+)\s+([A-Z]{2,5})\s+(\d+)/(\d+)"
)
JUDGES = rf"{B}([A-Z]{{2,}})\s+J{E}|{B}([A-Z]{{2,}})\s+JA{E}|{B}Justice\s+([A-Z][A-Za-z]+){E}"
PARTIES = rf"{B}([A-Z][a-z]+(?:\s+[A-Za-z]+)*)\s+v\.?\s+([A-Z][a-z]+(?:\s+[A-Za-z]+)*){E}"


# --- places where a pattern may begin ---------------------------------------


def _compiled(pattern: str) -> re.Pattern:
    """A pattern with white space and digits of ASCII alone, and word edges that know all letters."""
    plain = pattern.replace(B, r"(?<!\w)").replace(E, r"(?!\w)")
    return re.compile(plain.replace(r"\s]", r" \t-\r]").replace(r"\s", r"[ \t-\r]").replace(r"\d", "[0-9]"))


_DATES, _STATUTES, _CASES, _JUDGES, _PARTIES = map(_compiled, (DATES, STATUTES, CASES, JUDGES, PARTIES))
_DIGITS = re.compile("[0-9]+")
_ACT, _OPPONENT = re.compile(r"Act(?!\w)"), re.compile(r"v\.?[ \t-\r]+[A-Z][a-z]")
_WORDS, _TAIL = re.compile(r"[A-Za-z \t-\r]*"), re.compile(r"[A-Za-z0-9 \t-\r\[\]():.]*")
_SPACE = " \t\n\x0b\x0c\r"
_LETTERS_AND_SPACE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + _SPACE)
_CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@lru_cache(1)
def _automaton():
    import ahocorasick

    literals = ahocorasick.Automaton()
    kinds = {"Act": "act", "Justice": "justice", "J": "judge", "v": "versus"}
    kinds |= {m: "month" for m in MONTHS} | {c: "court" for c in COURT_NAMES} | {str(d): "digit" for d in range(10)}
    for literal, kind in kinds.items():
        literals.add_word(literal, (kind, literal))
    literals.make_automaton()
    return literals


def _back(text: str, at: int, chars) -> int:
    """Where the run of ``chars`` that ends before ``at`` begins."""
    while at and text[at - 1] in chars:
        at -= 1
    return at


def _starts(text: str) -> tuple[dict[str, list], set[str]]:
    """Places from where each kind of pattern may match, as (from, anchor or None), in order, and the courts."""
    found: dict[str, list] = {"dates": [], "statutes": [], "cases": [], "judges": [], "parties": []}
    courts, digits_end, run = set(), -1, (0, 0)

    def run_start(at: int) -> int:
        nonlocal run
        if not run[0] <= at < run[1]:
            run = _back(text, at, _LETTERS_AND_SPACE), _WORDS.match(text, at).end()
        return run[0]

    for end, (kind, literal) in _automaton().iter(text):
        at = end - len(literal) + 1
        before = text[at - 1] if at else ""
        if kind == "digit":
            if at < digits_end:
                continue
            digits_end = _DIGITS.match(text, at).end()
            found["dates"].append((at, None))
            gap = _back(text, at, _SPACE)
            dot = gap - 1 if gap and text[gap - 1] == "." else gap
            if dot and text[dot - 1] == "s":
                found["statutes"].append((dot - 1, None))
            if gap < at and text.endswith("section", 0, gap):
                found["statutes"].append((gap - 7, None))
            if before == "[":
                found["cases"].append((at - 1, None))
            if digits_end - at >= 4:
                found["cases"].append((digits_end - 4, None))
        elif kind == "month":
            found["dates"].append((at, None))
        elif kind == "court":
            courts.add(literal)
        elif kind == "act" and before and before in _SPACE and _ACT.match(text, at):
            found["statutes"].append((run_start(at), at))
        elif kind == "justice":
            found["judges"].append((at, None))
        elif kind == "judge" and before and before in _SPACE:
            gap = _back(text, at, _SPACE)
            found["judges"].append((_back(text, gap, _CAPITALS), None))
        elif kind == "versus" and before and before in _SPACE and _OPPONENT.match(text, at):
            gap = _back(text, at, _SPACE)
            if gap and text[gap - 1] == "S":
                found["cases"].append((gap - 1, None))
            found["parties"].append((run_start(at), at))
    return found, courts


def _matches(pattern: re.Pattern, text: str, starts: list) -> Iterator[re.Match]:
    """What a search through the whole text would find, in order and without overlap.

    A start with an anchor may lie anywhere between the two, so it is searched for, up to where the pattern could reach.
    """
    done = 0
    for start, anchor in sorted(starts, key=lambda s: s[0]):
        if anchor is None:
            match = pattern.match(text, start) if start >= done else None
        elif anchor >= done:
            match = pattern.search(text, max(start, done), min(len(text), _TAIL.match(text, anchor).end() + 1))
        else:
            match = None
        if match:
            done = match.end()
            yield match


def iso_date(raw: str) -> str:
    """D/M/Y with a two-digit pivot at 50 and month names become YYYY-MM-DD; anything else stays."""
    numeric = re.fullmatch("([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4}|[0-9]{2})", raw)
    if numeric:
        day, month, year = numeric.groups()
        return f"{year if len(year) == 4 else ('20' if year < '50' else '19') + year}-{month:0>2}-{day:0>2}"
    named = re.fullmatch("([0-9]{1,2}) +([A-Z][a-z]+) +([0-9]{4})|([A-Z][a-z]+) +([0-9]{1,2}) +([0-9]{4})", re.sub(rf",?[{_SPACE}]+", " ", raw))
    if not named:
        return raw
    day, month, year = named.group(1, 2, 3) if named.group(1) else named.group(5, 4, 6)
    try:
        return datetime.date(int(year), MONTHS.index(month) + 1, int(day)).isoformat()
    except ValueError:
        return raw


def _groups(match: re.Match) -> str:
    return " ".join(g for g in match.groups() if g and g.strip()).strip()


def find_entities(text: str | None) -> list[tuple[str, list[str]]]:
    """(type, values) of one text; types without a value are left out, values but courts and parties are sorted."""
    if not text:
        return []
    starts, courts = _starts(text)
    values = {
        "dates": {iso_date(m.group()) for m in _matches(_DATES, text, starts["dates"])},
        "statute_refs": {_groups(m) for m in _matches(_STATUTES, text, starts["statutes"])},
        "case_refs": {_groups(m) for m in _matches(_CASES, text, starts["cases"])},
        "courts": [c for c in COURT_NAMES if c in courts],
        "judges": {re.sub(rf"[{_SPACE}]+", " ", m.group()) for m in _matches(_JUDGES, text, starts["judges"])},
        "parties": [p for m in _matches(_PARTIES, text, starts["parties"]) if len(p := f"{m.group(1).strip()} v {m.group(2).strip()}") > 3],
    }
    listed = {kind: sorted(v - {""}) if isinstance(v, set) else v for kind, v in values.items()}
    return [(kind, v) for kind, v in listed.items() if v]


@lru_cache(1)
def _entity_udf():
    kind = pa.map_(pa.string(), pa.list_(pa.string()))

    @F.arrow_udf("map<string,array<string>>")
    def entities(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([find_entities(t.as_py()) for t in column], kind)

    return entities


def extract_entities(text: Column | str) -> Column:
    """map of entity type to values; types without a value are left out, values are sorted. A null text has none."""
    return _entity_udf()(_c(text).cast("string"))


def merge_entities(existing: Column, fresh: Column) -> Column:
    """Union per type; new parties replace the old ones."""
    empty = F.array().cast("array<string>")
    both = F.map_zip_with(
        existing, fresh,
        lambda k, old, new: F.when(new.isNull(), old).when((k == "parties") | old.isNull(), new)
        .otherwise(F.array_sort(F.array_union(F.coalesce(old, empty), F.coalesce(new, empty)))),
    )
    return F.coalesce(both, existing, fresh)


def enrich(chunks, text: str = "chunk_text"):
    """Add entities; fill date_context with the first date and court with the first court where empty."""
    fresh = chunks.withColumn("_fresh", extract_entities(text))
    have = F.col("entities") if "entities" in chunks.columns else F.lit(None).cast("map<string,array<string>>")

    def first(kind):
        return F.get(F.try_element_at("_fresh", F.lit(kind)), F.lit(0))

    def filled(name, kind):
        old = F.nullif(F.col(name), F.lit("")) if name in chunks.columns else F.lit(None).cast("string")
        return F.coalesce(old, first(kind))

    return (
        fresh.withColumn("date_context", filled("date_context", "dates"))
        .withColumn("court", filled("court", "courts"))
        .withColumn("entities", F.when(have.isNull(), F.col("_fresh")).otherwise(merge_entities(have, F.col("_fresh"))))
        .drop("_fresh")
    )


def entity_counts(chunks):
    return (
        chunks.select(F.explode_outer("entities").alias("entity_type", "_v")).where(F.col("_v").isNotNull())
        .groupBy("entity_type").agg(F.sum(F.size("_v")).alias("n"))
    )

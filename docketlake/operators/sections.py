"""Line-based structure: judgment headers and sections, rule sections, page fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketlake.functions.text import strip
from docketlake.operators.fusion import top_k

# fixed section markers of judgments, in order of precedence
JUDGMENT_MARKERS = [
    ("Facts", "FACTS?|BACKGROUND"),
    ("Issues", "ISSUES?|QUESTIONS?"),
    ("Arguments", "ARGUMENTS?|SUBMISSIONS?"),
    ("Holding", "HELD|HOLDING|JUDGMENT|DECISION|RULING"),
    ("Order", "ORDER|CONCLUSION|DISPOSITION"),
    ("Reasoning", "REASONING|ANALYSIS"),
]
HEADER_WORDS = ["held:", "judgment:", "facts:", "issue:", "background:"]
RULE_HEADS = r"(?i)^(?:Rule\s+\d+[A-Za-z]?|Order\s+\d+|Part\s+[IVX]+|Section\s+\d+|Chapter\s+\d+)[.-]"
HEADER_MIN, HEADER_MAX, LONG_LINE = 15, 50, 100


def _marker(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(JUDGMENT_MARKERS):
        folded = words.replace("S", "[S\u017f]").replace("K", "[K\u212a]")  # Java's (?i) leaves out the long s and the Kelvin sign
        out = F.when(strip(line).rlike(f"(?i)^(?:{folded})"), F.lit(name)).otherwise(out)
    return out


def _spans(n: Column, starts: Column, with_lead: bool) -> Column:
    """Half-open line ranges [a, b) that begin at the given 0-based line numbers."""
    begins = F.concat(F.array(F.lit(0)), starts) if with_lead else starts
    begins = F.array_distinct(begins)
    return F.transform(
        begins, lambda a, i: F.struct(a.alias("a"), F.coalesce(F.get(begins, i + 1), n).alias("b"))
    )


def split_judgments(df: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Case header and marked sections of every judgment; sections of 20 characters or less are dropped.

    An empty text has an empty header, a null one no row. Lines stay in one array per document, so there is no shuffle.
    """
    others = [c for c in df.columns if c != markdown]
    base = df.where(F.col(markdown).isNotNull()).withColumn("_lines", F.split(markdown, "\n"))
    n = F.size("_lines")

    def body_starts(i):
        line = F.get("_lines", i)
        lower = F.lower(F.translate(line, "\u0130", "i"))  # letter by letter; lower alone makes two characters of a dotted capital I
        words = F.exists(F.array(*[F.lit(w) for w in HEADER_WORDS]), lambda w: F.contains(lower, w))
        return (F.length(strip(line)) > LONG_LINE) | words

    late = F.when(n > HEADER_MIN, F.sequence(F.lit(HEADER_MIN), F.least(n, F.lit(HEADER_MAX)) - 1))
    stop = F.array_min(F.filter(late, body_starts))
    base = base.withColumn("_stop", F.coalesce(stop, F.least(n, F.lit(HEADER_MAX))))
    rest = strip(F.array_join(F.slice("_lines", F.col("_stop") + 1, F.greatest(n - F.col("_stop"), F.lit(0))), "\n"))
    base = base.withColumn("_rest", F.split(rest, "\n"))
    base = base.withColumn("_marks", F.transform("_rest", _marker))
    count = F.size("_rest")
    starts = F.filter(F.sequence(F.lit(0), count - 1), lambda i: F.get("_marks", i).isNotNull())
    sections = F.transform(
        _spans(count, starts, True),
        lambda s, i: F.struct(
            F.coalesce(F.get("_marks", s["a"]), F.lit("Judgment")).alias("title"),
            F.concat(F.lit("section_"), i.cast("string")).alias("node_id"),
            strip(F.array_join(F.slice("_rest", s["a"] + 1, s["b"] - s["a"]), "\n")).alias("text"),
        ),
    )
    header = F.struct(
        F.lit("Case Header").alias("title"), F.lit("header").alias("node_id"),
        strip(F.array_join(F.slice("_lines", F.lit(1), F.col("_stop")), "\n")).alias("text"),
    )
    nodes = F.concat(F.array(header), F.filter(sections, lambda s: F.length(s["text"]) > 20))
    return base.withColumn("_nodes", nodes).select(*others, F.posexplode_outer("_nodes").alias("ordinal", "_n")).select(
        *others, "ordinal", "_n.title", "_n.node_id", "_n.text", F.lit(1).alias("page_index")
    )


def split_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Sections that begin at rule, order, part, section or chapter lines; empty lines are ignored."""
    others = [c for c in df.columns if c != text]
    base = df.withColumn("_lines", F.filter(F.transform(F.split(text, "\n"), strip), lambda ln: F.length(ln) > 0))
    base = base.where(F.size("_lines") > 0)
    count = F.size("_lines")
    starts = F.filter(F.sequence(F.lit(0), count - 1), lambda i: F.get("_lines", i).rlike(RULE_HEADS))
    sections = F.filter(
        F.transform(
            _spans(count, starts, False),
            lambda s: F.struct(
                F.get("_lines", s["a"]).alias("title"),
                F.array_join(F.slice("_lines", s["a"] + 2, s["b"] - s["a"] - 1), "\n").alias("text"),
            ),
        ),
        lambda s: F.length(s["text"]) > 0,
    )
    rows = base.withColumn("_s", sections).select(*others, F.posexplode_outer("_s").alias("ordinal", "_n"))
    return rows.where(F.col("_n").isNotNull()).select(
        *others, "ordinal", "_n.title", "_n.text", F.lpad(F.col("ordinal").cast("string"), 4, "0").alias("node_id"),
        F.lit(1).alias("page_index"),
    )


def page_fallback(pages: DataFrame, sections: DataFrame, max_pages: int = 10, chars: int = 2000) -> DataFrame:
    """First pages of documents that have no section, as nodes; pages(doc_id, page_index, text)."""
    bare = pages.join(sections.select("doc_id").distinct(), "doc_id", "left_anti")
    first = top_k(bare, max_pages, ["doc_id"], [F.asc("page_index")], "_r")
    return first.select(
        "doc_id", (F.col("_r") - 1).alias("ordinal"),
        F.concat(F.lit("Page "), F.col("page_index").cast("string")).alias("title"),
        F.substring("text", 1, chars).alias("text"), F.lpad((F.col("_r") - 1).cast("string"), 4, "0").alias("node_id"), "page_index",
    )

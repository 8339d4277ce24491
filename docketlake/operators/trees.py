"""Document trees as node tables: parsing, breadcrumbs, cleaning, merging with page text, markdown."""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from docketlake.constants import BANNER_TITLES, MIN_TOKENS
from docketlake.functions.ids import chunk_id
from docketlake.functions.text import _c, collapse_ws, estimate_tokens, strip


def tree_schema(depth: int) -> T.ArrayType:
    """Nested node type; what lies deeper stays as text."""
    fields = [
        T.StructField("title", T.StringType()), T.StructField("node_id", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("page_index", T.IntegerType()),
    ]
    below = T.StringType() if depth <= 1 else tree_schema(depth - 1)
    return T.ArrayType(T.StructType(fields + [T.StructField("nodes", below)]))


def is_wrapper(title: Column) -> Column:
    """Banner and chapter headings, which carry no content of their own."""
    t = strip(F.coalesce(title, F.lit("")))
    return t.isin(BANNER_TITLES) | t.rlike(r"(?i)^Chapter\s+\d+:\d+(?![\p{L}\p{N}_])")


def _children(parent: Column, nodes: Column) -> Column:
    """The nodes below a parent (path, kept_parent, breadcrumb and title), in order."""
    return F.transform(
        nodes,
        lambda c, i: F.struct(
            F.concat(parent["path"], F.array(i)).alias("path"),
            F.when(is_wrapper(parent["title"]), parent["kept_parent"]).otherwise(parent["path"]).alias("kept_parent"),
            F.concat(parent["breadcrumb"], F.lit(" > "), F.coalesce(c["title"], F.lit(""))).alias("breadcrumb"),
            c.alias("n"),
        ),
    )


def _placed(p: Column) -> Column:
    return F.struct(p["path"].alias("path"), p["kept_parent"].alias("kept_parent"), p["breadcrumb"].alias("breadcrumb"), p["n"]["title"].alias("title"))


def _descend(df: DataFrame, first: Column, others: list[str], levels: int) -> DataFrame:
    """The nodes of ``levels`` levels in the struct ``_n``; there must be nothing below."""
    out = df.withColumn("_l0", first)
    for level in range(1, levels):
        out = out.withColumn(f"_l{level}", F.flatten(F.transform(
            F.filter(f"_l{level - 1}", lambda p: p["n"]["nodes"].isNotNull()), lambda p: _children(_placed(p), p["n"]["nodes"]),
        )))
    flat = [
        F.transform(f"_l{k}", lambda p: F.struct(
            p["path"].alias("path"), p["kept_parent"].alias("kept_parent"), p["breadcrumb"].alias("breadcrumb"),
            p["n"]["title"].alias("title"), p["n"]["node_id"].alias("node_id"), p["n"]["text"].alias("text"),
            p["n"]["page_index"].alias("page_index"),
        ))
        for k in range(levels)
    ]
    nothing = F.array().cast(
        "array<struct<path:array<int>,kept_parent:array<int>,breadcrumb:string,title:string,node_id:string,text:string,page_index:int>>"
    )
    every = F.concat(*[F.coalesce(a, nothing) for a in flat])
    lost = F.exists(f"_l{levels - 1}", lambda p: p["n"]["nodes"].isNotNull())
    every = F.when(F.coalesce(lost, F.lit(False)), F.raise_error(F.lit(f"tree deeper than {levels} levels"))).otherwise(every)
    rows = out.withColumn("_nodes", every).select(*others, F.explode_outer("_nodes").alias("_n"))
    return rows.where(F.col("_n").isNotNull())


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("[^"\\\x00-\x1f]*(?:\\.[^"\\\x00-\x1f]*)*")|(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null))')
_TEXTS = {"title": 0, "node_id": 1, "text": 2}


class Nodes:
    """Nodes of one JSON tree, parents before children: parent's number (-1 for none), place among its siblings, and fields."""

    def __init__(self) -> None:
        self.parent, self.ordinal, self.fields = [], [], []

    def add(self, parent: int, ordinal: int) -> int:
        self.parent.append(parent)
        self.ordinal.append(ordinal)
        self.fields.append([None, None, None, None])
        return len(self.parent) - 1


def _unquoted(string: str) -> str:
    """The text of a JSON string; half a surrogate pair becomes the replacement character."""
    if "\\" not in string:
        return string[1:-1]
    try:
        return json.loads(string).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    except json.JSONDecodeError:  # an escape that JSON does not know
        return string[1:-1]


class _ByEvents(Exception):
    """A tree that is left to the reader by events."""


def _unique(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise _ByEvents
    return found


def _no_constant(name: str):
    raise _ByEvents


_PLAIN = json.JSONDecoder(object_pairs_hook=_unique, parse_constant=_no_constant)
_PAGE = re.compile("-?[0-9]{1,10}")


def _page_number(value) -> int | None:
    if isinstance(value, str):
        value = int(value) if _PAGE.fullmatch(value) else None
    return value if type(value) is int and abs(value) < 1 << 31 else None


def _plain_nodes(text: str) -> Nodes:
    """The nodes of a tree as Python's own JSON reader sees it; raises where the two readers might differ."""
    if "\\ud" in text or "\\uD" in text:  # half a surrogate pair
        raise _ByEvents
    tree, nodes = _PLAIN.decode(text), Nodes()
    if isinstance(tree, dict):
        tree = [tree]
    elif tree is not None and not isinstance(tree, list):
        raise _ByEvents
    stack = [(iter(tree or ()), -1)]
    ordinals = [0]
    while stack:
        siblings, parent = stack[-1]
        for value in siblings:
            if isinstance(value, list):  # not a node
                continue
            number = nodes.add(parent, ordinals[-1])
            ordinals[-1] += 1
            if not isinstance(value, dict):
                continue
            fields = nodes.fields[number]
            for name, k in _TEXTS.items():
                fields[k] = field = value.get(name)
                if field is not None and type(field) is not str:
                    raise _ByEvents
            fields[3] = _page_number(value.get("page_index"))
            below = value.get("nodes")
            if below and isinstance(below, list):
                stack.append((iter(below), number))
                ordinals.append(0)
                break
        else:
            stack.pop()
            ordinals.pop()
    return nodes


def read_nodes(text: str) -> Nodes | None:
    """The nodes of a JSON tree of any depth; None if the text is not JSON.

    Fields that are not known are passed over. A text field that holds another value keeps that value's JSON text. Plain trees
    are read by Python's JSON reader; what it refuses, what is too deep for it, and what it may see otherwise is read by events.
    """
    try:
        return _plain_nodes(text)
    except (_ByEvents, ValueError, RecursionError):
        return nodes_by_events(text)


def nodes_by_events(text: str) -> Nodes | None:
    """The nodes of a JSON tree by its events, with a stack of its own and so of any depth; None if the text is not JSON."""
    nodes, stack, pos = Nodes(), [], 0  # a frame: kind ("array", "node" or "other"), node number or parent's, count or key
    expect, passing = "value", None  # passing: (depth of the stack outside, begin, node, field) of a value that is not taken apart

    def store(node: int, field: str, value) -> None:
        if field in _TEXTS:
            nodes.fields[node][_TEXTS[field]] = value
        elif field == "page_index":
            nodes.fields[node][3] = _page_number(value)

    while True:
        found = _TOKEN.match(text, pos)
        if not found:
            rest = text[pos:].strip(" \t\n\r")
            return nodes if not rest and not stack and expect == "end" else None
        mark, string, scalar = found.groups()
        begin, pos = found.start(found.lastindex), found.end()
        if expect == "end":
            return None
        if expect in ("key", "first key"):
            if mark == "}" and expect == "first key":
                closed = True
            elif string is not None:
                stack[-1][2], expect = _unquoted(string), "colon"
                continue
            else:
                return None
        elif expect == "colon":
            if mark != ":":
                return None
            expect = "value"
            continue
        elif expect == "after":
            if mark == ",":
                expect = "key" if stack[-1][3] == "{" else "value"
                continue
            if mark != ("}" if stack[-1][3] == "{" else "]"):
                return None
            closed = True
        elif mark == "]" and expect == "first value":
            closed = True
        elif mark in ("{", "["):
            top = stack[-1] if stack else None
            if passing is None and mark == "[" and (top is None or (top[0] == "node" and top[2] == "nodes")):
                stack.append(["array", top[1] if top else -1, 0, "["])
            elif passing is None and mark == "{" and (top is None or top[0] == "array"):
                number = nodes.add(top[1] if top else -1, top[2] if top else 0)
                if top:
                    top[2] += 1
                stack.append(["node", number, None, "{"])
            else:
                if passing is None:
                    passing = (len(stack), begin, top[1] if top and top[0] == "node" else None, top[2] if top else None)
                stack.append(["other", None, None, mark])
            expect = "first key" if mark == "{" else "first value"
            continue
        elif mark is not None:
            return None
        else:
            closed = False
            top = stack[-1] if stack else None
            if top is None:
                return Nodes() if scalar == "null" else None
            if passing is None and top[0] == "node":
                value = None if scalar == "null" else scalar if scalar is not None else _unquoted(string)
                store(top[1], top[2], value)
            elif passing is None and top[0] == "array":  # a node without fields
                nodes.add(top[1], top[2])
                top[2] += 1
        if closed:
            stack.pop()
            if passing and len(stack) == passing[0]:
                if passing[2] is not None and passing[3] in _TEXTS:
                    store(passing[2], passing[3], text[passing[1] : pos])
                passing = None
        expect = "after" if stack else "end"


def _node_rows(nodes: Nodes, wrapper: re.Pattern):
    """(path, kept_parent, breadcrumb, title, node_id, text, page_index, depth, ordinal) of every node."""
    paths, kept, crumbs, hides = [], [], [], []
    for k, (parent, ordinal, (title, node_id, text, page)) in enumerate(zip(nodes.parent, nodes.ordinal, nodes.fields)):
        paths.append((paths[parent] if parent >= 0 else []) + [ordinal])
        kept.append(None if parent < 0 else kept[parent] if hides[parent] else paths[parent])
        crumbs.append(f"{crumbs[parent]} > {title or ''}" if parent >= 0 else title or "")
        bare = (title or "").strip()
        hides.append(bare in BANNER_TITLES or wrapper.match(bare) is not None)
        yield paths[k], kept[k], crumbs[k], title, node_id, text, page, len(paths[k]) - 1, ordinal


def _read_trees(kind: pa.DataType, rows: int = 2000, chars: int = 4 << 20):
    wrapper = re.compile(r"(?i:chapter)[ \t-\r]+[0-9]+:[0-9]+(?!\w)")

    def run(batches):
        for batch in batches:
            own, made, size = [], [], 0
            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                nodes = read_nodes(text.as_py()) if text.is_valid else None
                for row in _node_rows(nodes, wrapper) if nodes else ():
                    own.append(k)
                    made.append(row)
                    size += len(row[2]) + len(row[5] or "") + 2 * len(row[0])
                    if len(made) >= rows or size >= chars:
                        yield _told(batch, own, made, kind)
                        own, made, size = [], [], 0
            yield _told(batch, own, made, kind)

    return run


def _told(batch: pa.RecordBatch, own: list[int], made: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*made)) if made else [()] * kind.num_fields
    carried = [batch.column(k).take(pa.array(own, pa.int64())) for k in range(batch.num_columns - 1)]
    new = [_int_lists(c) if kind.field(k).type == _INTS else pa.array(c, kind.field(k).type) for k, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays([*carried, *new], [*batch.schema.names[:-1], *(kind.field(k).name for k in range(kind.num_fields))])


def _int_lists(lists: tuple) -> pa.ListArray:
    """A column of lists of integers, None for a null list; as one array it is made faster than list by list."""
    offsets = np.concatenate([[0], np.cumsum([len(x) if x else 0 for x in lists])]).astype(np.int32)
    values = np.fromiter(chain.from_iterable(x for x in lists if x), np.int32, offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.array([*(x is None for x in lists), False])), pa.array(values))


_INTS = pa.list_(pa.int32())
_NODE = pa.struct([
    ("path", _INTS), ("kept_parent", _INTS), ("breadcrumb", pa.string()), ("title", pa.string()), ("node_id", pa.string()), ("text", pa.string()),
    ("page_index", pa.int32()), ("depth", pa.int32()), ("ordinal", pa.int32()),
])


def flatten_tree(df: DataFrame, tree: str = "tree", depth: int | None = None) -> DataFrame:
    """JSON trees to one row per node, with path, breadcrumb and the nearest ancestor that is not a wrapper.

    A tree of whatever depth is read in Arrow batches: one pass, nothing written, no shuffle. A text that is not
    JSON has no nodes. With ``depth`` the trees are declared to have no more levels: they are taken apart by expressions
    alone, and a deeper tree raises an error instead of losing nodes.
    """
    others = [c for c in df.columns if c != tree]
    if depth is None:
        ints = T.ArrayType(T.IntegerType())
        kinds = {"path": ints, "kept_parent": ints, "page_index": T.IntegerType(), "depth": T.IntegerType(), "ordinal": T.IntegerType()}
        rows = df.select(*others, tree)
        schema = T.StructType([*(rows.schema[c] for c in others), *(T.StructField(f.name, kinds.get(f.name, T.StringType())) for f in _NODE)])
        return rows.mapInArrow(_read_trees(_NODE), schema)
    roots = F.transform(
        F.from_json(tree, tree_schema(depth)),
        lambda n, i: F.struct(
            F.array(i).alias("path"), F.lit(None).cast("array<int>").alias("kept_parent"),
            F.coalesce(n["title"], F.lit("")).alias("breadcrumb"), n.alias("n"),
        ),
    )
    found = _descend(df, roots, others, depth)
    return found.select(
        *others, *[f"_n.{c}" for c in ("path", "kept_parent", "breadcrumb", "title", "node_id", "text", "page_index")],
        (F.size("_n.path") - 1).alias("depth"), F.element_at("_n.path", -1).alias("ordinal"),
    )


def tree_chunks(nodes: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """One chunk per node with enough text; its section path is the breadcrumb."""
    enough = (F.length(strip("text")) > 0) & (estimate_tokens("text") >= min_tokens)
    return nodes.where(enough).select(
        "doc_id", F.col("node_id").alias("tree_node_id"), F.col("breadcrumb").alias("section_path"),
        F.lit(0).alias("start_char"), F.length("text").alias("end_char"),
        estimate_tokens("text").alias("num_tokens"), strip("text").alias("chunk_text"), "page_index",
        chunk_id("doc_id", "breadcrumb", F.lit(0), F.length("text"), "text").alias("chunk_id"),
    )


def tree_markdown(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Headings by depth with the node texts, in tree order."""
    keys = keys or ["doc_id"]
    block = F.concat(
        F.repeat(F.lit("#"), F.col("depth") + 1), F.lit(" "), F.coalesce("title", F.lit("Untitled")), F.lit("\n\n"),
        F.when(F.length("text") > 0, F.concat("text", F.lit("\n\n"))).otherwise(""),
    )
    ordered = F.array_sort(F.collect_list(F.struct("path", block.alias("b"))))
    return nodes.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "").alias("markdown"))


def title_key(title: Column | str) -> Column:
    return F.lower(collapse_ws(strip(F.coalesce(_c(title), F.lit("")))))


def clean_text(text: Column | str, title: Column | str | None = None) -> Column:
    """Text without page markers, images, boilerplate lines, a repeated heading and extra blank lines."""
    c = F.coalesce(_c(text), F.lit(""))
    c = F.regexp_replace(c, r"<physical_index_\d+>\n?", "")
    c = F.regexp_replace(c, r"!\[[^\]]*\]\([^\)]*\)\n?", "")
    # fixed boilerplate line starts
    c = F.regexp_replace(
        c,
        r"(?m)^(?:About this collection[^\n]*|FRBR URI[^\n]*|This PDF copy is licensed[^\n]*"
        r"|There (?:is no copyright|may have been updates)[^\n]*|www\.[^\s]+|info@[^\s]+)$", "",
    )
    if title is not None:
        t = _c(title)
        quoted = F.concat(F.lit(r"(?m)^#{1,6}\s+\Q"), t, F.lit(r"\E(?:\s*|(?![\p{L}\p{N}_])[^\n]*)$"))
        c = F.when(F.coalesce(F.length(t), F.lit(0)) > 0, F.regexp_replace(c, quoted, F.lit(""))).otherwise(c)
    c = F.replace(c, F.lit("$\\quad$"), F.lit(" "))
    c = F.regexp_replace(c, r"\$\s*(\d+)\s*/\s*(\d+)\s*/\s*(\d+)\s*\$", "$1/$2/$3")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def mark_tree(nodes: DataFrame) -> DataFrame:
    """Drop wrappers (their children move up), clean texts, and tell with ``gone`` which nodes a cleaned tree leaves out.

    Of the nodes of a parent and title the longest text stays, the first on ties, at the first one's ``place``; nodes below one
    that goes go too. All nodes of a document meet in one shuffle. In path order the nodes below one are those up to its
    next possible sibling, so the furthest such end so far tells whether a node lies below one that goes.
    """
    kept = nodes.where(~is_wrapper(F.col("title"))).withColumn("text", clean_text("text", "title"))
    kept = kept.withColumn("_key", title_key("title")).withColumn("_length", F.length("text")).repartition("doc_id")
    group = W.partitionBy("doc_id", "kept_parent", "_key").orderBy(F.desc("_length"), "path")
    whole = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    placed = kept.withColumn("_best", F.row_number().over(group)).withColumn("place", F.min("path").over(whole))
    end = F.concat(F.slice("path", F.lit(1), F.size("path") - 1), F.array(F.element_at("path", -1) + 1))
    upto = W.partitionBy("doc_id").orderBy("path").rowsBetween(W.unboundedPreceding, W.currentRow)
    reach = placed.withColumn("_end", end).withColumn("_reach", F.max(F.when(F.col("_best") > 1, F.col("_end"))).over(upto))
    below = F.col("doc_id").isNotNull() & F.coalesce(F.col("_reach") > F.col("_end"), F.lit(False))
    return reach.withColumn("gone", (F.col("_best") > 1) | below).drop("_key", "_length", "_best", "_end", "_reach")


def clean_tree(nodes: DataFrame) -> DataFrame:
    """The nodes that stay of those that ``mark_tree`` marks."""
    return mark_tree(nodes).where(~F.col("gone")).drop("gone")


def fill_from_pages(nodes: DataFrame, pages: DataFrame, by_page: bool = True) -> DataFrame:
    """Page text into nodes by title. With ``by_page`` only empty nodes on the same page are filled,
    otherwise every node with the title is overwritten. The last page row of a key wins.

    pages: doc_id, title, page_index, text, ordinal.
    """
    keys = ["doc_id", "_key"] + (["page_index"] if by_page else [])
    usable = pages.withColumn("_key", title_key("title")).withColumn("_page_text", strip("text")).where(
        (F.length("_key") > 0) & (F.length("_page_text") > 0)
    )
    if by_page:
        usable = usable.where(F.col("page_index").isNotNull())
    last = usable.groupBy(*keys).agg(F.max_by("_page_text", "ordinal").alias("_page_text"))
    joined = nodes.withColumn("_key", title_key("title")).join(last, keys, "left")
    empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    text = (
        F.when(empty, F.coalesce("_page_text", "text")).otherwise(F.col("text")) if by_page
        else F.coalesce("_page_text", "text")
    )
    return joined.withColumn("text", text).drop("_key", "_page_text")


def node_statistics(nodes: DataFrame) -> DataFrame:
    filled = F.length(F.coalesce("text", F.lit("")))
    return nodes.groupBy("doc_id").agg(
        F.count("*").alias("nodes"), F.count(F.when(filled > 0, 1)).alias("with_text"),
        F.count(F.when(F.length(strip("text")) > 50, 1)).alias("with_long_text"),
    )


def join_pages(pages: DataFrame) -> DataFrame:
    """Page texts in page order under page headings: doc_id, page_index, text."""
    block = F.concat(F.lit("--- Page "), F.col("page_index").cast("string"), F.lit(" ---\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("page_index", block.alias("b"))))
    return pages.groupBy("doc_id").agg(strip(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n")).alias("markdown"))

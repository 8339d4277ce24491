"""Shingle sets whose Jaccard similarity reaches a threshold, by a grouped prefix join.

The shingles of a text are put in one global order: those that stand in few texts first. Two sets that are similar enough
share shingles in their prefixes. Sets with the same prefix and size form a group, and only groups are joined; pairs of
groups that pass the filters on size and common prefix are expanded to their members, which are verified on their whole sets.

Links are needed only as far as they connect. Each group is first verified against one centre; what is connected then needs
no further check among itself, so a large group of near copies costs a line, not a square. The remaining candidate pairs lie
between different components and are all verified.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F, Window

from docketlake.llm.common import Words, blocks, in_one, mix, utf8
from docketlake.session import discard, materialize

#: A shingle is frequent if it stands in this share of the texts; there are at most (mean set size / share) of them.
FREQUENT = 1e-3
#: Fixed number of hash buckets by which texts are preselected before those that need verifying are joined.
BUCKETS = 1 << 20
#: Words of 64 bits that sum up the members of a set; two sets differ in at least as many members as in bits.
LANES = 8


def _numbers(words: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(w, digest_size=8).digest(), "little") for w in words], np.uint64)


_WORDS = Words(_numbers)


def shingle_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text in order, repeated ones too, and the offsets of the texts.

    A text of fewer words than ``size`` has its whole sequence as one shingle, a text without words none.
    """
    found = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in found], np.int64)
    codes = _WORDS.number([w for ws in found for w in ws])
    flat = _WORDS.rows[codes] if len(codes) else np.zeros(0, np.uint64)
    start = np.concatenate([[0], np.cumsum(n)])
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    first = np.arange(at[-1]) - np.repeat(at[:-1], count) + np.repeat(start[:-1], count)
    width = np.repeat(np.minimum(n, size), count)
    h = width.astype(np.uint64)
    for k in range(size):
        inside = k < width
        h = np.where(inside, mix(h ^ (flat[np.where(inside, first + k, 0)] * np.uint64(2 * k + 3))), h)
    return h, at


def sets_of(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, at = shingle_hashes(texts, size)
    return [np.unique(h[a:b]) for a, b in zip(at, at[1:])]


def parities(hashes: np.ndarray, sizes: np.ndarray, lanes: int) -> list[np.ndarray]:
    """Per set, ``lanes`` words of 64 bits: a bit is set if an odd number of its members hash to it."""
    bit = np.uint64(1) << (hashes & np.uint64(63))
    lane = (hashes >> np.uint64(6)) % np.uint64(lanes)
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    out = []
    for k in range(lanes):
        word = np.zeros(len(sizes), np.uint64)
        if len(full):
            word[full] = np.bitwise_xor.reduceat(np.where(lane == k, bit, np.uint64(0)), starts)
        out.append(word.view(np.int64))
    return out


def bits_of(lanes: int = LANES) -> list[str]:
    """Names of the columns of :func:`parities`."""
    return [f"bits{k}" for k in range(lanes)]


def close(percent: int, x: str, y: str, lanes: int = LANES) -> Column:
    """Whether sets x and y (n and their parities) can be similar enough: their bits differ in no more places than their members may."""
    apart = " + ".join(f"bit_count({x}.{b} ^ {y}.{b})" for b in bits_of(lanes))
    return F.expr(f"{apart} <= {x}.n + {y}.n - 2 * ceil({percent} * ({x}.n + {y}.n) / {100 + percent})")


def _count_shared(size: int):
    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                h, at = shingle_hashes(part.column("text").to_pylist(), size)
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                order = np.argsort(h, kind="stable")
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                values, n = np.unique(h[new], return_counts=True)
                often = n >= max(2, FREQUENT / 2 * (len(at) - 1))
                rows = [pa.array(np.append(values[often].view(np.int64), 0)), pa.array(np.append(n[often], 0)), pa.array(np.append(np.zeros(often.sum(), np.int64), len(at) - 1))]
                yield pa.RecordBatch.from_arrays(rows, ["shingle", "n", "texts"])

    return run


def frequent_shingles(texts: DataFrame, size: int, share: float = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in at least ``share`` of the texts (sorted) and their rank class, from counts over all texts.

    Blocks report what several of their texts have, so a count is short by less than half of ``share``. Any fixed order of
    shingles gives the same links; the counts make it a cheap one.
    """
    counted = materialize(texts.mapInArrow(_count_shared(size), "shingle long, n long, texts long"), "shingle-counts")
    total = counted.agg(F.sum("texts")).first()[0] or 0
    often = counted.where("n > 0").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(max(2.0, share * total))).collect()
    values = np.array([r["shingle"] for r in often], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], np.log2(np.array([r["n"] for r in often], float))[order].astype(np.int64) + 1


def _prefixes(size: int, percent: int, frequent, classes):
    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                out: list[list] = [[] for _ in range(4)]
                sets = sets_of(part.column("text").to_pylist(), size)
                bits = [pa.array(b) for b in parities(np.concatenate(sets), np.array([len(own) for own in sets]), LANES)]
                for own in sets:
                    n = len(own)
                    rank = np.zeros(n, np.int64)
                    if n and len(frequent.value):
                        at = np.minimum(np.searchsorted(frequent.value, own), len(frequent.value) - 1)
                        rank = np.where(frequent.value[at] == own, classes.value[at], 0)
                    keep = n - -(-percent * n // 100) + 1 if n else 0
                    prefix = own[np.argsort(rank, kind="stable")[:keep]] if rank.any() else own[:keep]
                    for column, value in zip(out, (n, blake2b(own.tobytes(), digest_size=16).digest(), blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest(), prefix.view(np.int64))):
                        column.append(value)
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(part.num_columns - 1)] + [pa.array(c, t) for c, t in zip(out, kinds)] + bits, [*part.schema.names[:-1], "n", "set_id", "group_key", "prefix", *bits_of()])

    return run


def _compare(size: int):
    """Rows come sorted: a hub's text, then the texts of its spokes. Gives each spoke's overlap with its hub."""

    def run(batches):
        held = np.zeros(0, np.uint64)  # the hub that the last block ended with
        for batch in batches:
            for part in blocks(batch):
                h, at = shingle_hashes(part.column("text").to_pylist(), size)
                h, sizes = np.concatenate([held, h]), np.concatenate([[len(held)], np.diff(at)])
                values, code = np.unique(h, return_inverse=True)
                row = np.repeat(np.arange(len(sizes)), sizes)
                width = len(values).bit_length()  # rows and shingles of a block are fewer than its bytes, so both fit
                both = np.unique((row << width) | code)  # each row's distinct shingles
                row, code = both >> width, both & ((1 << width) - 1)
                n = np.bincount(row, minlength=len(sizes))
                is_hub = np.append(True, pa.compute.is_null(part.column("spoke")).to_numpy(zero_copy_only=False))
                hub = np.maximum.accumulate(np.where(is_hub, np.arange(len(sizes)), 0))
                sought = (hub[row] << width) | code
                spot = np.minimum(np.searchsorted(both, sought), max(0, len(both) - 1))
                shared = np.bincount(row[both[spot] == sought], minlength=len(sizes))
                spokes = np.flatnonzero(~is_hub)
                held = values[code[row == hub[-1]]]
                taken = pa.array(spokes - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("hub").take(taken), part.column("spoke").take(taken), pa.array(n[hub[spokes]]), pa.array(n[spokes]), pa.array(shared[spokes])], ["a", "b", "n_a", "n_b", "shared"]
                )

    return run


def near_texts(docs: DataFrame, wanted: DataFrame, column: str = "text_id") -> DataFrame:
    """Distinct texts (text_id, text) of ``docs`` (text) whose digest shares a hash bucket with one in ``wanted``.

    The buckets are broadcast, and their number is fixed: the more texts are wanted, the less this filter saves.
    """
    place = F.pmod(F.xxhash64("text_id"), F.lit(BUCKETS))
    needed = wanted.select(F.pmod(F.xxhash64(column), F.lit(BUCKETS)).alias("bucket")).distinct()
    texts = docs.select(F.unhex(F.md5("text")).alias("text_id"), "text")
    return texts.join(F.broadcast(needed), place == F.col("bucket"), "left_semi").groupBy("text_id").agg(F.first("text").alias("text"))


def compare(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b, n_a, n_b, shared) of distinct pairs (hub, spoke), from the whole ``texts`` (id, text).

    Each spoke's text goes to its hub; a hub with many spokes is several blocks, read one text after another.
    """
    key = pairs.schema["hub"].dataType.simpleString()
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / 500).alias("parts"))
    placed = materialize(pairs.join(sizes, "hub").select("hub", "spoke", F.pmod(F.xxhash64("spoke"), F.col("parts")).alias("part")), "placed")
    spokes = placed.join(texts.withColumnRenamed("id", "spoke"), "spoke").select("hub", "part", "spoke", "text")
    hubs = placed.select("hub", "part").distinct().join(texts.withColumnRenamed("id", "hub"), "hub").select("hub", "part", F.lit(None).cast(key).alias("spoke"), "text")
    ordered = spokes.unionByName(hubs).repartition("hub", "part").sortWithinPartitions("hub", "part", "spoke")  # nulls first
    verified = materialize(ordered.select("hub", "spoke", "text").mapInArrow(_compare(size), f"a {key}, b {key}, n_a long, n_b long, shared long"), "verified")
    discard(placed)
    return verified


def alike(percent: int, n: str, m: str) -> Column:
    """Whether sets of n and m members can be similar enough."""
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})")


def enough(percent: int, c: str, n: str, m: str) -> Column:
    """Whether sets of n and m members with c common ones in their prefixes can be similar enough.

    Up to the end of the prefix that ends first in the global order, all common members are among the c; behind it that set
    has ceil(percent * size / 100) - 1 more. This holds every place that a member can have in its prefix to account at once.
    """
    return F.expr(f"{100 + percent} * ({c} + ceil({percent} * greatest({n}, {m}) / 100) - 1) >= {percent} * ({n} + {m})")


def within(percent: int, i: str, n: str, j: str, m: str) -> Column:
    """Whether places i and j lie in the prefixes that sets of n and m members must share a member of to be similar enough.

    These prefixes are shorter than those for any partner, as both sizes are known.
    """
    need = f"{percent} * ({n} + {m})"
    return F.expr(f"{100 + percent} * ({n} - {i}) >= {need} AND {100 + percent} * ({m} - {j}) >= {need}")


def placed_alike(percent: int, i: str, n: str, j: str, m: str) -> Column:
    """Whether a common member at places i and j leaves room for enough others before and behind it.

    Every common member of similar sets passes, so those that pass can be counted for :func:`enough`.
    """
    return F.expr(f"{100 + percent} * (least({i}, {j}) + 1 + least({n} - 1 - {i}, {m} - 1 - {j})) >= {percent} * ({n} + {m})")


class GroupJoin:
    """One run over the texts of ``docs`` (doc_id, text): ``members`` and verified ``links`` between distinct sets."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.size, self.percent = size, percent
        self.docs = docs.select("doc_id", utf8("text").alias("text"))
        spark = docs.sparkSession
        frequent, classes = frequent_shingles(self.docs.select("text"), size)
        shared = [spark.sparkContext.broadcast(x) for x in (frequent, classes)]
        kind = docs.schema["doc_id"].dataType.simpleString()
        keyed = self.docs.select("doc_id", F.unhex(F.md5("text")).alias("text_id"), "text")
        self.rows = materialize(keyed.mapInArrow(_prefixes(size, percent, *shared), f"doc_id {kind}, text_id binary, n long, set_id binary, group_key binary, prefix array<long>, {', '.join(f'{b} long' for b in bits_of())}"), "prefixes")

    def _candidates(self) -> None:
        """``tokens`` (token, i, n, gid): prefix tokens of groups that another set has too; ``sets`` with their group."""
        some = self.rows.where("n > 0")
        sets = materialize(some.groupBy("set_id").agg(F.min("text_id").alias("text_id"), F.first("group_key").alias("group_key"), *[F.first(b).alias(b) for b in bits_of()]), "sets")
        grouped = some.groupBy("group_key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        held = sets.groupBy("group_key").agg(F.min("set_id").alias("rep"), F.count("*").alias("k"))
        groups = materialize(grouped.join(held, "group_key").withColumn("gid", F.monotonically_increasing_id()), "groups")
        tokens = groups.select("gid", "n", "k", F.posexplode("prefix").alias("i", "token"))
        several = F.sum("k").over(Window.partitionBy("token")) > 1
        self.tokens = materialize(tokens.withColumn("several", several).where("several").select("token", "i", "n", "gid"), "tokens")
        self.sets = materialize(sets.join(groups.select("group_key", "gid", "rep"), "group_key").select("set_id", "text_id", "gid", "rep", *bits_of()), "members")

    def _stars(self) -> DataFrame:
        """(hub, spoke): each set with the centre that its group meets most often, and with the first set of its group.

        The centre of a token is, among its groups of about the same size, the one that shares most of its tokens: in a group
        of near copies that is one with few changes of its own.
        """
        band = F.floor(F.log("n") / F.log(F.lit(100 / self.percent)))
        first = F.min(F.struct(-F.col("held"), "gid", "n")).over(Window.partitionBy("token", "band"))
        met = self.tokens.withColumn("held", F.count("*").over(Window.partitionBy("gid"))).withColumn("band", band).withColumn("c", first).where("gid <> c.gid").where(alike(self.percent, "n", "c.n"))
        votes = met.groupBy("gid", F.col("c.gid").alias("center")).agg(F.count("*").alias("votes"), F.first("n").alias("n"), F.first("c.n").alias("m"))
        votes = votes.where(enough(self.percent, "votes", "n", "m"))
        best = votes.groupBy("gid").agg(F.max_by("center", F.struct("votes", -F.col("center"))).alias("center"))
        reps = self.sets.where("set_id = rep").select(F.col("gid").alias("center"), F.col("rep").alias("hub"))
        outer = self.sets.join(best, "gid").join(reps, "center").select("hub", F.col("set_id").alias("spoke"))
        return outer.unionByName(self.sets.where("set_id <> rep").select(F.col("rep").alias("hub"), F.col("set_id").alias("spoke")))

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """(a, b, n_a, n_b, shared) of pairs (hub, spoke), from their whole texts."""
        pairs = materialize(pairs.distinct(), "pairs")
        wanted = materialize(pairs.select(F.explode(F.array("hub", "spoke")).alias("set_id")).distinct().join(self.sets, "set_id").select("set_id", "text_id"), "wanted")
        texts = materialize(near_texts(self.docs, wanted).join(wanted, "text_id").select(F.col("set_id").alias("id"), "text"), "texts", compression="zstd")
        verified = compare(pairs, texts, self.size)
        discard(pairs, wanted, texts)
        return verified

    def _linked(self, verified: DataFrame) -> DataFrame:
        return verified.where(F.expr(f"100 * shared >= {self.percent} * (n_a + n_b - shared)")).select("a", "b")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Verified links (a, b) that connect all linked sets, and the component (set_id, component) of every linked set."""
        self._candidates()
        found = self._linked(self._verify(self._stars()))
        component = components(found)
        of = self.tokens.join(self.sets.select("set_id", "gid"), "gid").join(component, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        w = Window.partitionBy("token")
        mixed = of.withColumn("low", F.min("component").over(w)).withColumn("high", F.max("component").over(w)).where("low <> high")
        mixed = materialize(mixed.select("token", "i", "n", "set_id", "component").join(self.sets.select("set_id", *bits_of()), "set_id"), "apart")
        x, y = mixed.alias("x"), mixed.alias("y")
        met = F.expr("x.token = y.token AND x.set_id < y.set_id AND x.component <> y.component")
        both = x.join(y, met).where(alike(self.percent, "x.n", "y.n") & placed_alike(self.percent, "x.i", "x.n", "y.i", "y.n") & close(self.percent, "x", "y"))
        near = both.groupBy(F.col("x.set_id").alias("hub"), F.col("y.set_id").alias("spoke")).agg(
            F.count("*").alias("c"), F.max(within(self.percent, "x.i", "x.n", "y.i", "y.n")).alias("early"), F.first("x.n").alias("n"), F.first("y.n").alias("m")
        )
        rest = self._linked(self._verify(near.where("early").where(enough(self.percent, "c", "n", "m")).select("hub", "spoke")))
        found = found.unionByName(rest)
        return found, components(found)


def components(edges: DataFrame) -> DataFrame:
    """(set_id, component): the smallest set_id that each end of an edge reaches. Labels are lowered until none changes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    label = materialize(both.groupBy(F.col("a").alias("set_id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("set_id").alias("b"), "component"), "b").groupBy(F.col("a").alias("set_id")).agg(F.min("component").alias("lowest"))
        jump = label.select(F.col("set_id").alias("component"), F.col("component").alias("further"))
        next_label = label.join(near, "set_id").join(jump, "component").select("set_id", F.least("component", "lowest", "further").alias("component"), (F.least("lowest", "further") < F.col("component")).alias("changed"))
        label = materialize(next_label, "labels")
        if not label.where("changed").limit(1).count():
            return label.select("set_id", "component")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Texts link when 100 x shared shingles >= ``percent`` x united shingles; component_id is the smallest doc_id that links
    reach, null only if all ids there are null. A text without words (null, empty) links with nothing and is its own
    component. Equal texts are one set, so repeated rows share a component.
    """
    join = GroupJoin(docs, size, percent)
    _, component = join.links()
    rows = join.rows.select("doc_id", "n", "set_id").join(component, "set_id", "left")
    rows = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "set_id")).alias("component"))
    smallest = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(smallest, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with its columns, one row of each component: the one with the smallest doc_id (nulls last), then text digest.

    Texts without words are components of their own, so all their rows stay, but for rows that repeat an id and a text.
    """
    join = GroupJoin(docs, size, percent)
    _, component = join.links()
    rows = join.rows.select("doc_id", "text_id", "n", "set_id").join(component, "set_id", "left")
    group = F.when(F.col("n") > 0, F.coalesce("component", "set_id"))
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_id")
    chosen = rows.where("n > 0").groupBy(group.alias("g")).agg(F.min(key).alias("k")).select("k.doc_id", "k.text_id")
    chosen = chosen.unionByName(rows.where("n = 0").select("doc_id", "text_id").distinct())
    counts = rows.groupBy("doc_id", "text_id").agg(F.count("*").alias("_rows"))
    same = chosen["doc_id"].eqNullSafe(counts["doc_id"]) & (chosen["text_id"] == counts["text_id"])
    keep = materialize(chosen.join(counts, same).select(chosen["doc_id"].alias("_doc"), chosen["text_id"].alias("_text"), "_rows"), "kept")
    left = in_one(docs).join(keep, F.col("row.doc_id").eqNullSafe(F.col("_doc")) & (F.unhex(F.md5(utf8("row.text"))) == F.col("_text")))
    if not keep.where("_rows > 1").limit(1).count():
        return left.select("row.*")
    # rows that repeat an id and a text: any one of them
    once = left.where("_rows > 1").groupBy("_doc", "_text").agg(F.first("row").alias("row")).select("row.*")
    return left.where("_rows = 1").select("row.*").unionByName(once)

"""Lines that an earlier line nearly repeats, by an exact set-similarity join.

A line is the set of its words in lower case, its words in one global order, rare ones first. Two lines whose Jaccard
similarity reaches the threshold have two words in their prefixes that are neighbours in both (see :func:`_reach`); such a
pair of neighbours is a mark. Few marks stand in two lines, and only these are joined; candidates are verified on the whole
lines. A line goes if an earlier one matches it, in the order of (doc_id, text, line); whether the earlier one stays itself
does not matter. Before they are compared, lines also pass a filter on bits that sum them up.

One match is enough, so each distinct line meets the first line of its commonest mark before any other, and only those
that this does not settle meet all earlier candidates.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, Window

from docketlake.llm.common import Words, blocks, in_one, mix, raw, spread, utf8
from docketlake.llm.group_join import _numbers, alike, bits_of, close, compare, near_texts, parities
from docketlake.session import discard, materialize

PERCENT = 80
#: A word is frequent if it makes up this share of all words; there are at most 1 / share of them.
FREQUENT = 2e-6
#: Words that a worker counts before they leave it (distinct ones in each block), those that it hashes at once, and groups that they are summed in.
COUNTED, SLICE, COUNT_BUCKETS = 1 << 19, 1 << 15, 256
#: Bytes of text whose line sets are made at once.
BLOCK = 1 << 20
#: From this threshold on marks are pairs of neighbours, below it single words.
PAIRED = 67
#: Bytes of a mark: chance meetings of marks cost a comparison and change no result.
MARK_BYTES = 5
#: Words of 64 bits that sum up a line.
LANES = 4
#: Marks that are counted together, on average, and marks that a task deals out at once.
BUCKET_MARKS, DEAL_MARKS = 1_000_000, 1 << 20
_WORDS = Words(_numbers, limit=250_000)


def _split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all ``texts``, one after another, and the number of the text of each."""
    found = pc.ascii_split_whitespace(texts)
    words, of = found.flatten(), pc.list_parent_indices(found)
    real = pc.greater(pc.binary_length(words), 0)
    return words.filter(real), of.filter(real).to_numpy()


def _lower(column: pa.Array) -> pa.Array:
    """Texts given as bytes, in lower case (A-Z). Bytes that are no UTF-8 stay as they are."""
    return pc.ascii_lower(pc.cast(column, options=pc.CastOptions(pa.string(), allow_invalid_utf8=True)))


def _bytes(words) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist() if len(words) else []


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Of all lines with a word: their text and number in it; of all words: their line (among these) and, coded, themselves."""
    split = pc.split_pattern(_lower(texts), "\n")
    words, of = _split_words(split.flatten())
    doc = pc.list_parent_indices(split).to_numpy()
    seq = np.arange(len(doc)) - np.searchsorted(doc, doc)
    full = np.unique(of)
    return doc[full], seq[full].astype(np.int32), np.searchsorted(full, of), words.dictionary_encode()


def _count_words(batches):
    """Every word (as a hash) with the number of its occurrences, gathered by bucket; one row has the number of all."""

    def counted(held, total):
        if held:
            sums = pa.concat_tables(held).group_by("values", use_threads=False).aggregate([("counts", "sum")])
            values, n = sums.column("values"), sums.column("counts_sum").to_numpy()
            word = np.concatenate([_numbers(_bytes(values.slice(k, SLICE))) for k in range(0, len(values), SLICE)])
            bucket = (word % np.uint64(COUNT_BUCKETS)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            used, at = np.unique(bucket[order], return_index=True)
            ends = pa.py_buffer((np.append(at, len(word)) * 8).astype(np.int32))
            columns = [pa.Array.from_buffers(pa.binary(), len(used), [None, ends, pa.py_buffer(x[order])]) for x in (word, n)]
            yield pa.RecordBatch.from_arrays([pa.array(used), *columns, pa.array(np.zeros(len(used), np.int64))], ["bucket", "word", "n", "words"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *[pa.array([b""])] * 2, pa.array([total], pa.int64())], ["bucket", "word", "n", "words"])

    _WORDS.number([])  # tables of other operators go
    _WORDS.forget()
    held, size, total = [], 0, 0
    for batch in batches:
        for part in blocks(batch, limit=BLOCK):
            words, _ = _split_words(_lower(part.column("text")))
            if len(words):
                held.append(pa.Table.from_struct_array(words.value_counts()))
                size, total = size + len(held[-1]), total + len(words)
            if size >= COUNTED:
                yield from counted(held, total)
                held, size, total = [], 0, 0
    yield from counted(held, total)


def _sum_words(bucket: pa.Table) -> pa.Table:
    """(word, n, words): the words of a bucket that stand in all texts twice or more; one row has the number of all words."""
    word, n = (np.frombuffer(b"".join(bucket[c].to_pylist()), kind) for c, kind in (("word", np.int64), ("n", np.int64)))
    order = np.argsort(word)
    word, at = np.unique(word[order], return_index=True)
    n = np.add.reduceat(n[order], at) if len(at) else n
    often = n >= 2
    words = np.append(np.zeros(often.sum(), np.int64), sum(bucket["words"].to_pylist()))
    return pa.table({"word": np.append(word[often], 0), "n": np.append(n[often], 0), "words": words})


def frequent_words(texts: DataFrame, share: float = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that are at least ``share`` of all words (sorted) and how often they stand in all texts."""
    counted = texts.mapInArrow(_count_words, "bucket int, word binary, n binary, words long").groupBy("bucket").applyInArrow(_sum_words, "word long, n long, words long")
    counted = materialize(counted, "word-counts")
    total = counted.agg(F.sum("words")).first()[0] or 0
    often = counted.where(F.col("n") >= F.lit(max(2.0, share * total))).collect()
    discard(counted)
    value = np.array([r["word"] for r in often], np.int64).view(np.uint64)
    order = np.argsort(value)
    return value[order], np.array([r["n"] for r in often], np.int64)[order]


def _reach(n: np.ndarray, percent: int) -> np.ndarray:
    """How many marks, from the rarest word on, a line of n words needs.

    Of two similar sets in one order let o members be common, a only in the first and b only in the second. The common ones and
    the end make o gaps between neighbours; each other member breaks at most one, and o > a + b from two thirds on, so some gap is
    whole in both. Before the first whole one lie at most a + b broken ones, so it begins at place 2a + b of the first set at most.
    With o at least percent / (100 + percent) of both sizes together this is at most 2 (1 - percent / 100) n. Sets that are too small to be
    similar to any but themselves need none.
    """
    if percent < PAIRED:
        return n - -(-percent * n // 100) + 1
    return np.where(n * (100 - percent) < percent, 0, np.minimum(n, 2 * n * (100 - percent) // 100 + 1))


def _line_sets(percent: int, value, count):
    def run(batches):
        for batch in batches:
            for part in blocks(batch, limit=BLOCK):
                doc, seq, line, words = lines_of(part.column("text"))
                codes = _WORDS.number(_bytes(words.dictionary))
                hashes = _WORDS.rows[codes] if len(codes) else np.zeros(0, np.uint64)
                often = np.zeros(len(hashes), np.int64)
                if len(value.value) and len(hashes):
                    spot = np.minimum(np.searchsorted(value.value, hashes), len(value.value) - 1)
                    often = np.where(value.value[spot] == hashes, count.value[spot], 0)
                order = np.lexsort((hashes, often))
                rank = np.zeros(len(hashes), np.int64)
                rank[order] = np.arange(len(hashes))
                width = len(hashes).bit_length()  # lines and words of a block are fewer than its bytes, so both fit
                both = np.sort((line << width) | rank[words.indices.to_numpy()])
                both = both[np.r_[True, both[1:] != both[:-1]][: len(both)]]  # each line's words in global order, once
                hashes = hashes[order][both & ((1 << width) - 1)]
                n = np.bincount(both >> width, minlength=len(doc))
                start = np.cumsum(n) - n
                every = hashes.tobytes()
                ids = [blake2b(every[8 * a : 8 * (a + k)], digest_size=16).digest() for a, k in zip(start.tolist(), n.tolist())]
                marks = hashes
                if percent >= PAIRED and len(hashes):
                    following = np.append(hashes[1:], np.uint64(0))
                    following[start + n - 1] = 0
                    marks = mix(hashes ^ mix(following + np.uint64(1)))
                keep = _reach(n, percent)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), part.column("text_id").take(pa.array(doc)), pa.array(seq), pa.array(n), pa.array(ids, pa.binary()), _packed(spread(marks, start, keep), keep), *map(pa.array, parities(hashes, n, LANES))],
                    ["doc_id", "text_id", "seq", "n", "set_id", "marks", *bits_of(LANES)],
                )

    return run


def _packed(marks: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The marks of each line as bytes."""
    data = np.ascontiguousarray(marks.view(np.uint8).reshape(-1, 8)[:, :MARK_BYTES])
    at = np.concatenate([[0], np.cumsum(sizes * MARK_BYTES)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(data)])


def _unpacked(data: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(data) // MARK_BYTES, 8), np.uint8)
    wide[:, :MARK_BYTES] = data.reshape(-1, MARK_BYTES)
    return wide.view(np.int64).ravel()


def _deal(buckets: int):
    """Marks with the number and size of their line, gathered by bucket: a row per bucket for about ``DEAL_MARKS`` marks."""

    def dealt(held):
        marks, cid, n = (np.concatenate(c) for c in zip(*held))
        bucket = marks % buckets
        order = np.argsort(bucket, kind="stable")
        used, at = np.unique(bucket[order], return_index=True)
        columns = []
        for values, kind in ((marks, np.int64), (cid, np.int64), (n, np.int32)):
            values = values[order].astype(kind)
            ends = np.append(at, len(values)) * values.itemsize
            columns.append(pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)]))
        columns[0] = _packed(marks[order], np.diff(np.append(at, len(marks))))
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *columns], ["bucket", "marks", "cids", "sizes"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            data, at = raw(batch.column("marks"))
            each = np.diff(at) // MARK_BYTES
            held.append((_unpacked(data), np.repeat(batch.column("cid").to_numpy(), each), np.repeat(batch.column("n").to_numpy(), each)))
            size += int(each.sum())
            if size >= DEAL_MARKS:
                yield dealt(held)
                held, size = [], 0
        if size:
            yield dealt(held)

    return run


def _met_again(bucket: pa.Table) -> pa.Table:
    """(token, cid, n): the marks of a bucket that several lines have."""
    marks, cid, n = (np.frombuffer(b"".join(bucket[c].to_pylist()), kind) for c, kind in (("marks", np.uint8), ("cids", np.int64), ("sizes", np.int32)))
    marks = _unpacked(marks)
    order = np.argsort(marks)
    marks = marks[order]
    same = marks[1:] == marks[:-1]
    kept = np.append(same, False) | np.append(False, same)
    return pa.table({"token": marks[kept], "cid": cid[order][kept], "n": n[order][kept].astype(np.int64)})


def met_again(classes: DataFrame) -> DataFrame:
    """(token, cid, n): the marks that several of the ``classes`` (cid, n, marks) have."""
    total = classes.agg(F.sum(F.octet_length("marks"))).first()[0] or 0
    buckets = -(-total // (MARK_BYTES * BUCKET_MARKS)) or 1
    spread_out = classes.select("cid", "n", "marks").mapInArrow(_deal(buckets), "bucket int, marks binary, cids binary, sizes binary")
    return spread_out.groupBy("bucket").applyInArrow(_met_again, "token long, cid long, n long")


def _pick_lines(batches):
    """The wanted lines of each text."""
    for batch in batches:
        for part in blocks(batch):
            out: list[list] = [[], []]
            for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
                lines = text.split(b"\n")
                for w in wanted:
                    out[0].append(w["cid"])
                    out[1].append(lines[w["seq"]])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["id", "text"])


def repeated_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_id, n_lines, removed): per distinct (doc_id, text) of ``docs``, its lines with a word and the numbers
    (from 0, among all lines) of those that an earlier line matches.

    text_id is the digest of the text. Lines without a word match nothing. Rows that repeat an id and a text are one
    document. Texts without a line with a word (null, empty) have no row. Null ids come before all others.
    """
    rows = docs.select("doc_id", utf8("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(x) for x in frequent_words(rows.select("text"))]
    keyed = rows.select("doc_id", F.unhex(F.md5("text")).alias("text_id"), "text")
    bits = bits_of(LANES)
    lines = materialize(keyed.mapInArrow(_line_sets(percent, *shared), f"doc_id {kind}, text_id binary, seq int, n long, set_id binary, marks binary, {', '.join(f'{b} long' for b in bits)}"), "lines")
    at = F.struct("doc_id", "text_id", "seq")
    classes = lines.groupBy("set_id").agg(F.min(at).alias("at"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("marks", *bits)])
    # sorted first, so that a smaller number is an earlier line
    classes = materialize(classes.orderBy("at.doc_id", "at.text_id", "at.seq").withColumn("cid", F.monotonically_increasing_id()), "line-classes")
    tokens = materialize(met_again(classes), "line-tokens")

    def lines_for(pairs):
        wanted = pairs.select(F.explode(F.array("hub", "spoke")).alias("cid")).distinct().join(classes.select("cid", "at"), "cid")
        by_text = materialize(wanted.groupBy("at.text_id").agg(F.collect_list(F.struct("cid", "at.seq")).alias("wanted")), "wanted-lines")
        found = materialize(near_texts(rows, by_text).join(by_text, "text_id").select("text", "wanted").mapInArrow(_pick_lines, "id long, text binary"), "picked-lines")
        discard(by_text)
        return found

    def matched(pairs):
        """(cid) of the spokes that match their hub."""
        pairs = materialize(pairs, "line-pairs")
        texts = lines_for(pairs)
        verified = compare(pairs, texts, 1)
        discard(pairs, texts)
        met = materialize(verified.where(F.expr(f"100 * shared >= {percent} * (n_a + n_b - shared)")).select(F.col("b").alias("cid")).distinct(), "matched")
        discard(verified)
        return met

    band = F.floor(F.log("n") / F.log(F.lit(100 / percent)))
    first = F.min(F.struct("cid", "n")).over(Window.partitionBy("token", "band"))  # only an earlier line can settle one
    met = tokens.withColumn("band", band).withColumn("c", first).where("cid <> c.cid").where(alike(percent, "n", "c.n"))
    votes = met.groupBy("cid", F.col("c.cid").alias("hub")).agg(F.count("*").alias("votes"))
    own = classes.select("cid", "n", *bits)
    votes = votes.join(own.alias("x"), "cid").join(own.withColumnRenamed("cid", "hub").alias("y"), "hub").where(close(percent, "x", "y", LANES))
    best = votes.groupBy(F.col("cid").alias("spoke")).agg(F.max_by("hub", F.struct("votes", -F.col("hub"))).alias("hub"))
    best = materialize(best.select("hub", "spoke"), "line-hubs")
    settled = matched(best)
    # marks where a line that is not settled meets an earlier one, and no others, go on
    w = Window.partitionBy("token")
    left = tokens.join(settled.withColumn("settled", F.lit(True)), "cid", "left").withColumn("open", F.col("settled").isNull())
    left = left.withColumn("low", F.min("cid").over(w)).withColumn("high", F.max(F.when(F.col("open"), F.col("cid"))).over(w)).where("low < high AND cid <= high")
    left = materialize(left.select("token", "cid", "open").join(own, "cid"), "open-marks")
    discard(tokens)
    x, y = left.alias("x"), left.where("open").alias("y")
    later = x.join(y, F.expr("x.token = y.token AND x.cid < y.cid")).where(alike(percent, "x.n", "y.n") & close(percent, "x", "y", LANES))
    later = later.select(F.col("x.cid").alias("hub"), F.col("y.cid").alias("spoke")).distinct().join(best, ["hub", "spoke"], "left_anti")
    late = matched(later)
    discard(left, best)
    gone = settled.unionByName(late).distinct().withColumn("gone", F.lit(True))
    verdict = classes.select("cid", "set_id", "at").join(gone, "cid", "left").select("set_id", "at", F.coalesce("gone", F.lit(False)).alias("gone"))
    judged = lines.select("doc_id", "text_id", "seq", "set_id", at.alias("own")).join(verdict, "set_id")
    out = F.when(F.col("gone") | ~F.col("own").eqNullSafe(F.col("at")), F.col("seq"))
    # rows that repeat an id and a text give each line several times
    found = judged.groupBy("doc_id", "text_id").agg(F.count_distinct("seq").alias("n_lines"), F.sort_array(F.collect_set(out)).alias("removed"))
    found = materialize(found, "removed-lines")
    discard(lines, classes, settled, late)
    return found


def line_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with its columns, its texts without the lines that an earlier line matches.

    A document that loses all its lines with a word goes; one that had none stays as it is.
    """
    found = repeated_lines(docs, percent)
    found = found.where(F.size("removed") > 0).select(F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text"), F.col("removed").alias("_removed"), (F.size("removed") == F.col("n_lines")).alias("_empty"))
    same = F.col("row.doc_id").eqNullSafe(F.col("_doc")) & (F.unhex(F.md5(utf8("row.text"))) == F.col("_text"))
    joined = in_one(docs).join(found, same, "left").where("NOT coalesce(_empty, false)")
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda line, k: ~F.array_contains("_removed", k)), "\n")
    return joined.select(F.when(F.col("_removed").isNull(), F.col("row")).otherwise(F.col("row").withField("text", left)).alias("row")).select("row.*")

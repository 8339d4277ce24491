"""Mixing sources by temperature.

A source's weight is its share of all tokens to the power of an exponent between 0 (all alike) and 1 (as they are). Bisection
finds the exponent that meets a target entropy, or a limit on how often the rarest source is repeated. The budget is the
smallest at which every source is read at least once, so no document is lost. A source is realised as epochs, each a
permutation of its blocks and of the documents in a block; its last epoch ends where its tokens are used up.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, functions as F, Window

from docketlake.llm.common import in_one, utf8
from docketlake.session import materialize

#: Tokens of a block: what one task orders. Repetition limit where no target is given.
BLOCK_TOKENS, MAX_REPEATS = 1 << 20, 2.0


def weights(totals: list[int], exponent: float) -> list[float]:
    """Normalised weights of sources with these token totals; a source without tokens weighs nothing."""
    top = max(totals, default=0)
    raw = [exp(exponent * log(n / top)) if n else 0.0 for n in totals]
    return [r / sum(raw) for r in raw] if top else [0.0 for _ in totals]


def repeats(totals: list[int], exponent: float) -> list[float]:
    """How often each source is read when the least read one is read once."""
    w = weights(totals, exponent)
    per = [x / n if n else 0.0 for x, n in zip(w, totals)]
    least = min((p for p in per if p), default=1.0)
    return [p / least for p in per]


def entropy(totals: list[int], exponent: float) -> float:
    """Entropy of the weights as a share of the greatest possible one; 1 for a single source."""
    w = [x for x in weights(totals, exponent) if x]
    return -sum(x * log(x) for x in w) / log(len(w)) if len(w) > 1 else 1.0


def find_exponent(totals: list[int], max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, rounds: int = 60) -> float:
    """The exponent, by bisection: the smallest with no source repeated more than ``max_repeats`` times, or the one whose
    entropy is ``target_entropy`` (as a share of the greatest). Both fall as it grows; beyond the ends, the nearest end."""
    too_flat = (lambda a: entropy(totals, a) > target_entropy) if target_entropy is not None else (lambda a: max(repeats(totals, a), default=1.0) > max_repeats)
    low, high = 0.0, 1.0
    if not too_flat(low):
        return low
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


def order_key(*parts: str | Column) -> Column:
    """A pseudo-random order that depends on its parts alone."""
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def tokens(col: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mixture(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = "mix") -> DataFrame:
    """One row per distinct (source, doc_id, text) and epoch of ``docs``: doc_id, text_id (digest of the text), source,
    n_tokens, n_rows (rows that are alike), epoch (from 1), start (tokens before it in its source's run), run_tokens.

    Rows that are alike are placed together. A null source is a source; null ids and null texts are placed like others; a
    source without any token is read once. The documents of a last, partial epoch are those that fit its tokens whole.
    Sorting by start / run_tokens gives all sources in their proportions all along. The driver sees one number per source.
    """
    rows = docs.select("doc_id", "source", F.md5(utf8("text")).alias("text_id"), tokens().alias("n_tokens"))
    items = rows.groupBy("doc_id", "source", "text_id").agg(F.max("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"))
    items = materialize(items.withColumn("size", F.col("n_tokens") * F.col("n_rows")), "mix-items")
    found = items.groupBy("source").agg(F.sum("size").alias("total")).orderBy(F.col("source").asc_nulls_first()).collect()
    totals = [r["total"] for r in found]
    times = repeats(totals, find_exponent(totals, max_repeats, target_entropy))
    budgets = [max(n, int(n * t + 0.5)) if n else 0 for n, t in zip(totals, times)]
    spark = docs.sparkSession
    kind = docs.schema["source"].dataType.simpleString()
    plan = spark.createDataFrame([(r["source"], int(n), int(b)) for r, n, b in zip(found, totals, budgets)], f"_source {kind}, total long, run_tokens long")

    blocks = F.greatest(F.ceil(F.col("total") / block_tokens), F.lit(1))
    block = F.conv(F.substring(order_key(seed, F.col("doc_id"), F.col("text_id")), 1, 8), 16, 10).cast("long") % blocks
    last = F.greatest(F.ceil(F.col("run_tokens") / F.greatest("total", F.lit(1))), F.lit(1)).cast("int")  # one row per source
    placed = items.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("block", block)
    placed = placed.withColumn("epoch", F.explode(F.sequence(F.lit(1), last)))
    sums = placed.groupBy("source", "epoch", "block").agg(F.sum("size").alias("block_size"))
    turn = Window.partitionBy("source", "epoch").orderBy(order_key(seed, F.col("epoch"), F.col("source"), F.col("block")), "block")
    before = sums.withColumn("before", F.sum("block_size").over(turn) - F.col("block_size"))
    before = before.select(F.col("source").alias("_source"), F.col("epoch").alias("_epoch"), F.col("block").alias("_block"), "before")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("epoch") == F.col("_epoch")) & (F.col("block") == F.col("_block"))
    inside = Window.partitionBy("source", "epoch", "block").orderBy(order_key(seed, F.col("epoch"), F.col("doc_id"), F.col("text_id")), "doc_id", "text_id")
    offset = F.sum("size").over(inside) - F.col("size")
    run = placed.withColumn("offset", offset).join(before, same).withColumn("start", (F.col("epoch") - 1) * F.col("total") + F.col("before") + F.col("offset"))
    return run.where((F.col("epoch") == 1) | (F.col("start") + F.col("size") <= F.col("run_tokens"))).select(
        "doc_id", "text_id", "source", "n_tokens", "n_rows", "epoch", "start", "run_tokens"
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its columns, each row as often as its epochs say, at least once (options as in :func:`mixture`)."""
    chosen = mixture(docs, **options).groupBy("doc_id", "text_id", "source").agg(F.count("*").alias("_times"))
    chosen = chosen.select(F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text"), F.col("source").alias("_from"), "_times")
    same = F.col("row.doc_id").eqNullSafe(F.col("_doc")) & (F.md5(utf8("row.text")) == F.col("_text")) & F.col("row.source").eqNullSafe(F.col("_from"))
    copies = in_one(docs).join(chosen, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return copies.select("row.*")

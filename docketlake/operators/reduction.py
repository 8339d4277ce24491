"""Reduction of a wide table by the keys that a small side asks for, before anything of it is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the filter: eight per key, within these bounds (8 KiB to 8 MiB).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
_WORD = 64


def _places(key: Column, bits: int) -> list[Column]:
    h = F.xxhash64(key)
    return [F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits))]


def bit_filter(keys: DataFrame, key: str, bits: int | None = None) -> Column:
    """One array of 64-bit words, as a scalar subquery: the bits that the keys' hashes set. ``keys`` should be cheap to read.

    Its size is bounded whatever the number of keys; beyond MOST_BITS / 8 keys it lets more rows through and stays correct.
    """
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * keys.count()).bit_length()))
    places = keys.select(F.explode(F.array(*_places(F.col(key), bits))).alias("p"))
    words = places.groupBy((F.col("p") / _WORD).cast("long").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("word"))
    dense = keys.sparkSession.range(bits // _WORD).join(words, "id", "left")
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).alias("word")))), lambda x: x["word"]).alias("words")).scalar()


def may_contain(words: Column, key: Column, bits: Column) -> Column:
    """False only where the key is certainly not among the filter's."""
    h = F.xxhash64(key)
    found = [F.pmod(h, bits), F.pmod(F.shiftrightunsigned(h, 32), bits)]
    return F.bit_get(F.get(words, (found[0] / _WORD).cast("int")), (found[0] % _WORD).cast("int")).cast("boolean") & F.bit_get(
        F.get(words, (found[1] / _WORD).cast("int")), (found[1] % _WORD).cast("int")).cast("boolean")


def only_asked(table: DataFrame, keys: DataFrame, key: str, bits: int | None = None) -> DataFrame:
    """Rows of ``table`` whose ``key`` may be among ``keys``: a superset of the semi-join that needs no shuffle of ``table``.

    A join behind it then shuffles the rows that are asked for and few others. The filter runs in the scan's stage.
    """
    words = bit_filter(keys, key, bits)
    return table.where(may_contain(words, F.col(key), (F.size(words) * _WORD).cast("long")))

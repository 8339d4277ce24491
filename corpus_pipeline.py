"""Corpus pipeline: language ID, line dedup, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that the caller writes as Parquet and hands to the next stage as
its ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketlake.llm.crf import fit, keep_identified, training_rows
from docketlake.llm.group_join import drop_near_duplicates
from docketlake.llm.line_dedup import line_dedup
from docketlake.llm.mixing import mix
from docketlake.llm.packing import pack
from docketlake.session import materialize

#: Largest number of times that a source is repeated: small sources gain up to a quarter.
MAX_REPEATS = 1.25

#: Not expressible in SQL: the language model and the tokenizer.
ORACLE_SQL = None


#: Bytes of rows that go to Python at once: whole texts wait on both sides of the border, for every task of an executor.
BATCH_BYTES = 8 << 20


def _bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose text has no letter or no clear language."""
    _bounded_batches(spark)
    return keep_identified(docs, fit(training_rows(docs)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that an earlier line nearly repeats; documents that consist of such lines go."""
    _bounded_batches(spark)
    left = line_dedup(docs)
    return left.withColumn("n_chars", F.length("text").cast(left.schema["n_chars"].dataType)) if "n_chars" in left.columns else left


def drop_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more)."""
    _bounded_batches(spark)
    return drop_near_duplicates(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of small sources as the tempered weights ask; every document stays at least once."""
    return mix(docs, max_repeats=MAX_REPEATS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents along the Hilbert curve: one row per piece."""
    _bounded_batches(spark)
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

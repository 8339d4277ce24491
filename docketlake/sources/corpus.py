"""Reading and writing corpus tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docketlake.constants import KEY_PREFIXES, MAX_DOCUMENT_BYTES
from docketlake.operators.catalog import counts_by, sorted_catalog
from docketlake.operators.reduction import only_asked
from docketlake.schemas import CHUNK, GOLDEN_QUERY
from docketlake.session import materialize

LEGISLATION_FOLDERS = ["acts", "ordinances", "statutory_instruments", "constitution"]


def read_chunks(spark: SparkSession, path: str, doc_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, malformed rows) of JSON objects, one per line, under doc_type folders; the file path is the object key."""
    schema = T.StructType(CHUNK.fields + [T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path)
    if doc_types is not None and "doc_type" in lines.columns:
        lines = lines.where(F.col("doc_type").isin(doc_types))  # prunes folders
    folder = F.col("doc_type") if "doc_type" in lines.columns else F.lit(None).cast("string")
    parsed = lines.select(
        F.col("_metadata.file_path").alias("chunk_object_key"), folder.alias("_folder"), F.col("value").alias("line"),
        F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("_c"),
    )
    broken = F.col("_c._corrupt_record").isNotNull()
    chunks = parsed.where(~broken & (F.coalesce(F.col("_c.chunk_text"), F.lit("")) != "")).select(
        "chunk_object_key", *[F.col(f"_c.{c}").alias(c) for c in CHUNK.fieldNames() if c != "doc_type"],
        F.coalesce("_folder", "_c.doc_type").alias("doc_type"),
    )
    return chunks, parsed.where(broken).select("chunk_object_key", "line")


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines; empty lines are ignored."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def list_objects(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """key, size and modification time of files; contents are never read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(path)
        .select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))
    )


def in_source(key: Column | str, source: str = "legislation") -> Column:
    """Object keys of legislation folders, or of judgments."""
    c = F.col(key) if isinstance(key, str) else key
    if source == "judgments":
        return c.contains("/judgements/") | c.contains("/judgments/")
    return c.rlike("/legislation/(" + "|".join(LEGISLATION_FOLDERS) + ")/")


def read_pages(spark: SparkSession, path: str, fmt: str = "html") -> DataFrame:
    """url and html: one HTML file per page (the file path is the url), or a table with both columns."""
    if fmt != "html":
        return spark.read.format(fmt).load(path).select("url", "html")
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    )


def with_golden_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "expected_confidence_min": F.coalesce("expected_confidence_min", F.lit(0.7)),
        "complexity": F.coalesce("complexity", F.lit("moderate")),
        "tags": F.coalesce("tags", F.array().cast("array<string>")),
    })


def read_golden(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Golden queries, from {"queries": [...]} or a plain array of queries; with ``lines``, one such value per line."""
    either = T.StructType([*GOLDEN_QUERY.fields, T.StructField("queries", T.ArrayType(GOLDEN_QUERY))])
    rows = spark.read.schema(either).option("multiLine", not lines).json(path)
    alone = F.array(F.struct(*[F.col(c) for c in GOLDEN_QUERY.fieldNames()]))  # a plain array gives a row per query
    return with_golden_defaults(rows.select(F.explode(F.coalesce("queries", alone)).alias("q")).select("q.*"))


def valid_key(key: Column | str, size: Column | str | None = None) -> Column:
    """Servable object: relative, under an allowed prefix, PDF under sources/, within the size limit."""
    k = F.col(key) if isinstance(key, str) else key
    allowed = F.lit(False)
    for prefix in KEY_PREFIXES:
        allowed = allowed | k.startswith(prefix)
    ok = (F.length(k) > 0) & ~k.contains("..") & ~k.startswith("/") & allowed & (~k.startswith("sources/") | k.endswith(".pdf"))
    if size is not None:
        ok = ok & ((F.col(size) if isinstance(size, str) else size) <= MAX_DOCUMENT_BYTES)
    return F.coalesce(ok, F.lit(False))


def unprocessed(df: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    return df if force else df.join(done.select(key).distinct(), key, "left_anti")


def progress(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk count per document and whether it has any."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    out = documents.join(counts, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    return out.withColumn("done", F.col("chunks") > 0)


def write_by_type(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Chunks or parent documents under doc_type folders."""
    df.write.mode(mode).partitionBy("doc_type").format(fmt).save(path)


#: Folders by key hash that a keyed table is laid out in, unless it was begun with another number; part of the column's name.
KEY_FOLDERS = 32
_KEY_FOLDER = re.compile(r"key_of_(\d+)")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def first_of_each(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row per key: the first by ``order``, or by a hash of the row, so that it does not depend on partitions."""
    others = [c for c in df.columns if c != key]
    plain = [f.name for f in df.schema if f.name != key and "map<" not in f.dataType.simpleString()]  # maps have no order and no hash
    by = F.struct(*[F.col(c) for c in order or []], F.xxhash64(*plain) if plain else F.lit(0))
    if not others:
        return df.distinct()
    picked = df.groupBy(key).agg(F.min_by(F.struct(*others), by).alias("_r"))
    return picked.select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def append_new(
    df: DataFrame, path: str, key: str, fmt: str = "parquet", partition: list[str] | None = None, order: list[str] | None = None,
    folders: int = KEY_FOLDERS,
) -> DataFrame:
    """Append the rows whose key the table does not have; returns what was added. Of repeats inside df the first by ``order`` counts.

    The table lies in folders by a hash of the key. Only the folders that the batch may meet are read, of them only the key
    column, and a bit filter over the batch's keys leaves few stored keys to shuffle. ``folders`` counts for a new table.
    """
    spark = df.sparkSession
    stored = None
    if _exists(spark, path):
        stored = spark.read.schema(T.StructType([df.schema[key]])).format(fmt).load(path)
    found = next((c for c in stored.columns if _KEY_FOLDER.fullmatch(c)), None) if stored is not None else None
    column = found or f"key_of_{folders}"
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(int(_KEY_FOLDER.fullmatch(column)[1]))).cast("int")
    fresh = materialize(first_of_each(df, key, order).withColumn(column, place), "batch")
    if stored is not None:
        if found:
            met = [r[0] for r in fresh.select(column).distinct().collect()]  # at most as many numbers as there are folders
            stored = stored.where(F.col(column).isin(met))
        fresh = materialize(fresh.join(only_asked(stored.select(key), fresh.select(key), key), key, "left_anti"), "fresh")
    fresh.repartition(*(partition or []), column).write.mode("append").format(fmt).partitionBy(*(partition or []), column).save(path)
    return fresh.drop(column)


def read_keyed(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """A table of ``append_new`` without the column of its folders."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.format(fmt).load(path)
    return rows.drop(*[c for c in rows.columns if _KEY_FOLDER.fullmatch(c)])


def write_catalog(catalog: DataFrame, path: str) -> DataFrame:
    """Newest first as JSON; returns the counts per court."""
    sorted_catalog(catalog).write.mode("overwrite").json(path)
    return counts_by(catalog, "court")


def index_freshness(corpus_stats: DataFrame, as_of: Column, max_age_hours: int = 24) -> DataFrame:
    """Age, size and freshness of index builds: corpus_stats(n_docs, built_at)."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(F.max("built_at"))) / 3600.0
    return corpus_stats.agg(
        F.max_by("n_docs", "built_at").alias("corpus_size"), F.round(age, 2).alias("age_hours"), (age <= max_age_hours).alias("is_fresh")
    )

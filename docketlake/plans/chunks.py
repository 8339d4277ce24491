"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake.plans.common import CHUNK_CTE, chunks
from docketlake.plans.registry import query


@query(
    "f10_sliding_chunks",
    f"""WITH {CHUNK_CTE} SELECT doc_id, chunk_index, start_char, end_char, num_tokens, chunk_id,
    md5(chunk_text) AS text_md5 FROM chunks""",
)
def f10(t):
    return chunks(t).select(
        "doc_id", "chunk_index", "start_char", "end_char", "num_tokens", "chunk_id", F.md5("chunk_text").alias("text_md5")
    )

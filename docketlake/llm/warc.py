"""Dictionary-compressed web archives.

An archive is what a ``.warc.zst`` file holds: a skippable frame with a Zstandard dictionary built from archived records,
then one frame per record, so that a reader can start at any record. Archives are written by Spark as rows (name, content),
which any shared store can hold; :func:`export` writes them as files to a mounted folder.
"""

from __future__ import annotations

import io
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from docketlake.llm.common import utf8
from docketlake.session import materialize

#: Magic number of the skippable frame that holds a dictionary (fixed by the format).
DICT_MAGIC = 0x184D2A5D
#: Archives are closed at this size; records that the dictionary is built from, and its size; shortest payload worth a revisit.
ARCHIVE_BYTES, DICT_RECORDS, DICT_BYTES, REVISIT_FROM = 8 << 20, 400, 64 << 10, 100
DATE = "2000-01-01T00:00:00Z"


def record(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit of the record that it refers to; line ends in the address are taken out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((url or 'about:blank').split())}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def read_records(content: bytes):
    """(headers, block) of each record of an archive, read frame after frame as one stream of bounded buffers."""
    dictionary, pos = None, 0
    if len(content) >= 8:
        magic, size = struct.unpack_from("<II", content)
        if magic == DICT_MAGIC:
            data = content[8 : 8 + size]
            if data[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may be a frame itself
                data = zstandard.ZstdDecompressor().decompress(data)
            dictionary, pos = zstandard.ZstdCompressionDict(data), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(memoryview(content)[pos:]), read_across_frames=True)
    stream = io.BufferedReader(reader, 1 << 16)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().strip()):
            name, _, value = line.decode().partition(": ")
            headers[name] = value
        size = int(headers["Content-Length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends early")
        yield headers, block


def roles(pages: DataFrame) -> DataFrame:
    """(digest, first): payloads of at least REVISIT_FROM bytes that several pages have, and the smallest id among these."""
    light = pages.select("page_id", utf8("html").alias("payload")).select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))
    return light.where(F.col("size") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")


def build_dictionary(pages: DataFrame, records: int = DICT_RECORDS, size: int = DICT_BYTES) -> bytes:
    """A dictionary from at most about ``records`` records (the bounded sample that it is fitted on); empty without records.

    Where the trainer asks for more text than they have, the end of their own bytes is the dictionary's content.
    """
    rows = pages.select("page_id", "url", utf8("html").alias("html"))
    total = pages.count()
    share = min(1.0, records / total) if total else 0.0
    drawn = rows.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 40)) < share * (1 << 40)).collect()
    samples = [record(str(r["page_id"]), r["url"], bytes(r["html"]), "0" * 64, None) for r in drawn]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b"".join(samples)[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _writer(dictionary: bytes, archive_bytes: int):
    def run(batches):
        used = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if used:
            used.precompute_compress(level=6)
        compress = zstandard.ZstdCompressor(level=6, dict_data=used).compress
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        head = struct.pack("<II", DICT_MAGIC, len(packed)) + packed if dictionary else b""
        parts, size, n = [head], 0, 0

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([b"".join(parts)], pa.binary())], ["records", "content"])

        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(c) for c in ("page", "url", "payload", "digest", "refers_to"))):
                frame = compress(record(page.as_py(), url.as_py(), html.as_py(), digest.as_py(), refers.as_py()))
                parts.append(frame)
                size, n = size + len(frame), n + 1
                if size >= archive_bytes:
                    yield archive()
                    parts, size, n = [head], 0, 0
        if n:
            yield archive()

    return run


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive ``pages`` (page_id, url, html): rows (records, content), written to the shared folder.

    A null html is an empty payload. Of pages with the same payload of at least REVISIT_FROM bytes the smallest id is the
    response, the others revisit it; rows that repeat an id and its payload have the same part. A null id is larger than any.
    """
    first = materialize(roles(pages), "warc-roles")
    rows = pages.select("page_id", "url", utf8("html").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    marked = rows.join(first, "digest", "left").select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page"), "url", "payload", "digest",
        F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("refers_to"),
    )
    return materialize(marked.mapInArrow(_writer(build_dictionary(pages), archive_bytes), "records long, content binary"), "warc")


def _digests(batches):
    from hashlib import sha256

    for batch in batches:
        for content in batch.column("content"):
            out: list[list] = [[] for _ in range(5)]
            for headers, block in read_records(content.as_py()):
                http, _, payload = block.partition(b"\r\n\r\n")
                stated = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(http.rpartition(b"Content-Length: ")[2])
                kind = headers["WARC-Type"]
                if kind == "response" and (len(payload) != size or sha256(payload).hexdigest() != stated):
                    raise ValueError(f"{headers['WARC-Record-ID']}: the payload is not the one that was archived")
                page, refers = (headers.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("WARC-Record-ID", "WARC-Refers-To"))
                for column, value in zip(out, (None if page == "null" else page, size, stated, kind, refers or None)):
                    column.append(value)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["page", "payload_bytes", "payload_digest", "record_type", "refers"])


def read_archives(archives: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per record, read and checked: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The payload of every response is hashed again; a revisit states the size and digest of the payload that it stands for.
    """
    rows = archives.select("content").mapInArrow(_digests, "page string, payload_bytes long, payload_digest string, record_type string, refers string")
    return rows.select(F.col("page").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type).alias("refers_to"))


def export(archives: DataFrame, folder: str) -> int:
    """Write each archive as a ``.warc.zst`` file to a folder that every executor has mounted; returns how many."""

    def run(batches):
        import os
        from hashlib import sha256

        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                path = f"{folder}/{sha256(data).hexdigest()[:32]}.warc.zst"
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(data)
                os.replace(f.name, path)  # a task that runs twice writes the same file
                yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return archives.select("content").mapInArrow(run, "path string").distinct().count()

"""Media columns in content-defined chunks.

A medium is a wave file of 8-bit samples. It is cut where a rolling gear hash of the last 32 bytes ends in a fixed pattern,
so that equal stretches of different media give equal chunks. Spark joins on the chunks' digests find one owner of each
chunk; the store holds, per medium, the chunks that it owns. Media are put together again from their ordered chunk lists
and compared with the digest that was taken before they were stored.
"""

from __future__ import annotations

import struct
from hashlib import blake2b, sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from docketlake.llm.common import BLOCK, blocks, utf8
from docketlake.session import discard, materialize

#: Chunk sizes: none shorter but the last, none longer, a cut about every 2**MASK_BITS bytes.
LEAST, MOST, MASK_BITS, WINDOW = 256, 8192, 10, 32
UNIT = 64
ZSTD = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}
HEADER = 44
GEAR = np.random.default_rng(20240101).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload(text: bytes) -> bytes:
    """The text with bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def medium(samples: bytes) -> bytes:
    """A wave file of one channel of 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", len(samples) + HEADER - 8, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(samples)) + samples


def samples_of(wave: bytes) -> bytes:
    """Samples of a wave file as :func:`medium` writes it."""
    size = struct.unpack_from("<I", wave, HEADER - 4)[0]
    if wave[:4] != b"RIFF" or size != len(wave) - HEADER:
        raise ValueError("not a whole wave file")
    return wave[HEADER:]


def gear_cuts(media: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each medium. The hash at a byte covers the bytes before it in its own medium only."""
    gap = bytes(WINDOW)
    joined = np.frombuffer(gap.join(media) if media else b"", np.uint8)
    h = GEAR[joined]
    begin, spots = 0, []
    for m in media:
        spots.append((begin, begin + len(m)))
        begin += len(m) + WINDOW
    for _, end in spots[:-1]:
        h[end : end + WINDOW] = 0
    for k in (1, 2, 4, 8, 16):  # the hash of 2k bytes from two of k bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    cuts = []
    for begin, end in spots:
        own, at, last = [], np.searchsorted(marks, begin), begin
        while end - last > LEAST:
            at = np.searchsorted(marks, last + LEAST) if at >= len(marks) or marks[at] < last + LEAST else at
            stop = int(marks[at]) if at < len(marks) else end
            last = min(stop, last + MOST, end)
            own.append(last - begin)
        if last < end:
            own.append(end - begin)
        cuts.append(own)
    return cuts


def chunks(media: list[bytes]) -> list[list[bytes]]:
    return [[m[a:b] for a, b in zip([0, *own], own)] for m, own in zip(media, gear_cuts(media))]


def digest(chunk: bytes) -> bytes:
    return blake2b(chunk, digest_size=16).digest()


_LIST = pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32())]))


def _list_chunks(batches):
    for batch in batches:
        for part in blocks(batch):
            texts = part.column("text").to_pylist()
            media = [medium(payload(t)) for t in texts]
            lists = [[{"digest": digest(c), "size": len(c)} for c in cs] for cs in chunks(media)]
            yield pa.RecordBatch.from_arrays(
                [part.column("media_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([sha256(m).digest() for m in media]), pa.array(lists, _LIST)],
                ["media_id", "n_bytes", "media_digest", "chunks"],
            )


def _squeeze(batches):
    """Texts as Zstandard frames, for the shuffle."""
    compress = zstandard.ZstdCompressor(level=9).compress
    for batch in batches:
        for part in blocks(batch):
            yield pa.RecordBatch.from_arrays([part.column("media_id"), pa.array([compress(t) for t in part.column("text").to_pylist()], pa.binary())], ["media_id", "frame"])


_OWNED = pa.list_(pa.struct([("seq", pa.int32()), ("digest", pa.binary()), ("shared", pa.bool_()), ("data", pa.binary())]))


def _store_owned(batches):
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for part in blocks(batch, "frame", BLOCK // 4):
            texts = [expand(f) for f in part.column("frame").to_pylist()]
            media = [medium(payload(t)) for t in texts]
            stored = []
            for cs, plan in zip(chunks(media), part.column("plan").to_pylist()):
                stored.append([{"seq": p["seq"], "digest": digest(cs[p["seq"]]), "shared": p["shared"], "data": cs[p["seq"]]} for p in plan])
            keep = [part.column("media_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([sha256(m).digest() for m in media]), part.column("complete")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(stored, _OWNED)], ["media_id", "n_bytes", "media_digest", "complete", "chunks"])


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write the media of ``docs`` (text): their chunk lists, and the chunks, each distinct chunk once.

    lists: media_id (digest of the text), n_bytes, media_digest, chunks (digest, size). store: the same keys, complete (the
    medium owns all its chunks), chunks (seq, digest, shared, data). Equal texts are one medium; a null text is empty.
    """
    rows = docs.select(utf8("text").alias("text")).select(F.unhex(F.sha2("text", 256)).alias("media_id"), "text")
    listed = rows.mapInArrow(_list_chunks, "media_id binary, n_bytes long, media_digest binary, chunks array<struct<digest: binary, size: int>>")
    lists = materialize(listed.dropDuplicates(["media_id"]), "media-lists")
    refs = lists.select("media_id", F.posexplode("chunks").alias("seq", "chunk")).select("media_id", "seq", "chunk.digest")
    owners = refs.groupBy("digest").agg(F.min(F.struct("media_id", "seq")).alias("owner"), F.count("*").alias("uses"))
    joined = refs.join(owners, "digest").withColumn("mine", F.col("owner") == F.struct("media_id", "seq"))
    item = F.struct("seq", (F.col("uses") > 1).alias("shared"))
    plan = joined.groupBy("media_id").agg(F.sort_array(F.collect_list(F.when(F.col("mine"), item))).alias("plan"), F.count("*").alias("n"))
    plan = materialize(plan.where(F.size("plan") > 0), "media-plan")
    frames = rows.mapInArrow(_squeeze, "media_id binary, frame binary").groupBy("media_id").agg(F.first("frame").alias("frame"))
    work = frames.join(plan, "media_id").select("media_id", (F.size("plan") == F.col("n")).alias("complete"), "frame", "plan")
    kinds = "media_id binary, n_bytes long, media_digest binary, complete boolean, chunks array<struct<seq: int, digest: binary, shared: boolean, data: binary>>"
    stored = materialize(work.mapInArrow(_store_owned, kinds), "media-store", **ZSTD)
    discard(plan)
    return lists, stored


def describe(samples: bytes) -> str:
    """Mean, deviation and zero crossings of 8-bit samples around their middle."""
    x = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
    return f"mean={x.mean():.4f};deviation={x.std():.4f};crossings={int(np.count_nonzero(np.diff(np.signbit(x))))}"


_FEATURES = [
    ("media_id", pa.binary()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_chunks", pa.int32()),
]


def _rebuild(batches):
    for batch in batches:
        out: list[list] = [[] for _ in _FEATURES]
        for key, n, stated, parts in zip(*(batch.column(c) for c in ("media_id", "n_bytes", "media_digest", "parts"))):
            parts = sorted((p["seq"], p["data"]) for p in parts.as_py())
            wave = b"".join(data for _, data in parts)
            if [s for s, _ in parts] != list(range(len(parts))) or sha256(wave).digest() != stated.as_py():
                raise ValueError(f"medium {key.as_py().hex()} cannot be put together from its chunks")
            own = samples_of(wave)
            row = (key.as_py(), n.as_py(), len(own), sha256(own).hexdigest(), crc32(own[-UNIT:]), len(wave), sha256(wave).hexdigest(), describe(own), len(parts))
            for column, value in zip(out, row):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, _FEATURES)], [n for n, _ in _FEATURES])


def read_back(lists: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per medium, put together from the store: sizes, digests, features.

    A medium that owns all its chunks is read where it lies. The others gather their own chunks and those of other media,
    which meet their references in a join.
    """
    kinds = "media_id binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"
    part = F.transform("chunks", lambda c: F.struct(c.seq.alias("seq"), c.data.alias("data")))
    whole = stored.where("complete").select("media_id", "n_bytes", "media_digest", part.alias("parts"))
    keys = ["media_id", "n_bytes", "media_digest"]
    own = stored.where("NOT complete").select(*keys, F.explode("chunks").alias("c")).select(*keys, "c.seq", "c.data")
    others = lists.join(stored.where("complete").select("media_id"), "media_id", "left_anti")
    refs = others.select(*keys, F.posexplode("chunks").alias("seq", "chunk")).select(*keys, "seq", "chunk.digest")
    foreign = refs.join(own.select("media_id", "seq"), ["media_id", "seq"], "left_anti")
    shared = stored.select(F.explode("chunks").alias("c")).where("c.shared").select("c.digest", "c.data")
    parts = own.unionByName(foreign.join(shared, "digest").select(*keys, "seq", "data"))
    found = parts.groupBy("media_id").agg(F.first("n_bytes").alias("n_bytes"), F.first("media_digest").alias("media_digest"), F.collect_list(F.struct("seq", "data")).alias("parts"))
    return whole.mapInArrow(_rebuild, kinds).unionByName(found.mapInArrow(_rebuild, kinds))


def media_columns(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Store the texts of ``docs`` as media, read them back, and give each row its ``keys`` and its medium's columns.

    A null text is empty; equal texts share one medium; null and repeated keys are kept as they are.
    """
    media = materialize(read_back(*store(docs)), "media-features")
    named = docs.select(*keys, F.unhex(F.sha2(utf8("text"), 256)).alias("media_id"))
    return named.join(media, "media_id").drop("media_id")

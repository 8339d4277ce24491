"""Stable identifiers, pseudonyms and experiment buckets."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from docketlake.functions.text import _c, collapse_ws, slug, strip


def chunk_id(doc_id, section_path, start_char, end_char, text) -> Column:
    text_hash = F.substring(F.sha2(strip(collapse_ws(text)), 256), 1, 8)
    parts = [_c(doc_id), _c(section_path), _c(start_char), _c(end_char), text_hash]
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 16)


def document_id(key) -> Column:
    return F.substring(F.sha2(_c(key).cast("string"), 256), 1, 16)


def sub_chunk_id(original_id, index, text) -> Column:
    joined = F.concat_ws("_", _c(original_id), _c(index).cast("string"), F.substring(_c(text), 1, 100))
    return F.substring(F.sha2(joined, 256), 1, 16)


def judgment_file_name(akn_uri, expr_uri, case_name) -> Column:
    """court_year_number_language_date_slug_hash.pdf, unique per expression."""
    uri, expr = _c(akn_uri), F.coalesce(_c(expr_uri), F.lit(""))

    def part(col, pattern, default):
        return F.coalesce(F.nullif(F.regexp_extract(col, pattern, 1), F.lit("")), default)

    court = part(uri, r"/judgment/([a-z]+)/", F.lit("unknown"))
    year = part(uri, r"/(\d{4})/", F.lit("0000"))
    number = part(uri, r"/\d{4}/(\d+)(?:/|$)", F.lit("0"))
    date = part(expr, r"@(\d{4}-\d{2}-\d{2})", year)
    lang = part(expr, r"/([a-z]{2,3})@", F.lit("eng"))
    basis = F.coalesce(F.nullif(expr, F.lit("")), F.nullif(uri, F.lit("")), _c(case_name))
    name = F.concat_ws("_", court, year, number, lang, date, slug(case_name), F.substring(F.sha1(basis), 1, 8))
    return F.regexp_replace(F.concat(name, F.lit(".pdf")), "[^a-z0-9._-]", "_")


def pseudonym(user_id, secret: str) -> Column:
    """First 16 hex digits of HMAC-SHA256; the key pads are fixed, so the JVM only hashes."""
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in key))
    message = F.encode(_c(user_id).cast("string"), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(inner_pad, message), 256))
    return F.substring(F.sha2(F.concat(outer_pad, inner), 256), 1, 16)


def assignment_ratio(user_id, experiment_id) -> Column:
    """128-bit md5 modulo 10000 as a share; the two 64-bit halves are recombined (2**64 % 10000 = 1616)."""
    digest = F.md5(F.concat_ws(":", _c(user_id).cast("string"), _c(experiment_id).cast("string")))

    def half(start):
        return F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)") % F.lit(10000)

    return ((half(1) * F.lit(1616) + half(17)) % F.lit(10000)).cast("double") / F.lit(10000.0)


def assign_variant(user_id, experiment_id, shares: list[tuple[str, float]], running: Column | None = None) -> Column:
    """First variant whose cumulative share reaches the user's ratio; the first variant beyond the last share."""
    total = sum(s for _, s in shares)
    if abs(total - 1.0) > 0.01:
        raise ValueError("traffic shares must sum to 1")
    ratio = assignment_ratio(user_id, experiment_id)
    bound, picked = 0.0, None
    for name, share in shares:
        bound += share
        hit = ratio <= F.lit(bound)
        picked = F.when(hit, F.lit(name)) if picked is None else picked.when(hit, F.lit(name))
    picked = picked.otherwise(F.lit(shares[0][0]))
    return picked if running is None else F.when(running, picked)

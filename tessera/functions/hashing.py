"""Digests and identifiers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the URL namespace of name-based UUIDs (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def token_bucket(token: Column, dimensions: int) -> Column:
    """First four bytes of the SHA-256 digest, big-endian, modulo dimensions."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dimensions).cast("int")


def uuid5_url(name: Column) -> Column:
    """Version 5 UUID of a name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def hmac_sha256(secret: str):
    """A function from a binary column to the hexadecimal HMAC under secret (RFC 2104): two digests, with the key's pads in front; null for null."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))

    def digest(body: Column | str) -> Column:
        body = F.col(body) if isinstance(body, str) else body
        return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256)

    return digest

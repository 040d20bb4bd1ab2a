"""HMAC-SHA256 from Spark's own hash functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """Keyed digest as BINARY; the two pads depend on the secret alone."""
    if len(secret) > _BLOCK:
        secret = hashlib.sha256(secret).digest()
    key = secret.ljust(_BLOCK, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(outer, first), 256))

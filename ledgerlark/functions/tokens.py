"""Signed action tokens: id:action:time:signature, a signature being 16 hex digits of HMAC-SHA-256.

HMAC is composed of sha2, so signing and checking stay in the JVM. The clock and the secret are passed in.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

EXPIRY_SECONDS = 86_400
ACTIONS = ("approve", "reject")


def signature(message: Column, secret: str) -> Column:
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(F.lit(outer), first), 256), 1, 16)


def signed(item: Column | str, action: Column | str, at: Column | str, secret: str) -> Column:
    message = F.concat_ws(":", col(item).cast("string"), col(action), col(at).cast("string"))
    return F.concat(message, F.lit(":"), signature(message, secret))


def verdict(token: Column | str, now: Column, secret: str) -> Column:
    """valid, item_id, action, error of a token: form, numbers, expiry, signature and action are looked at in this order."""
    p = F.split(col(token), ":")
    item, at, action = F.get(p, 0).try_cast("long"), F.get(p, 2).try_cast("long"), F.get(p, 1)
    expected = signature(F.concat_ws(":", item.cast("string"), action, at.cast("string")), secret)
    four, numbers = F.size(p) == 4, item.isNotNull() & at.isNotNull()
    expired = (now - at) > EXPIRY_SECONDS
    error = (
        F.when(col(token).isNull() | ~four, "Invalid token format")
        .when(~numbers, "Token parse error")
        .when(expired, "Token expired")
        .when(F.get(p, 3) != expected, "Invalid signature")
        .when(~action.isin(*ACTIONS), "Invalid action")
    )
    shown = error.isNull() | (error == "Token expired")
    return F.struct(error.isNull().alias("valid"), F.when(shown, item).alias("item_id"), F.when(shown, action).alias("action"), error.alias("error"))

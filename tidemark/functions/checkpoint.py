"""Opaque positions in a feed: `epoch~scopehash:position`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = r"^(.*)~([^~:]*):([^:]*)$"


def scope_hash(fingerprint: Column, principal: Column | None = None) -> Column:
    """First 16 digits of the digest of what a caller sees; empty if nothing restricts the view."""
    text = fingerprint if principal is None else F.concat(F.coalesce(fingerprint, F.lit("")), F.lit("\u001f"), principal)
    return F.when(text.isNull(), F.lit("")).otherwise(F.substring(F.upper(F.sha2(text, 256)), 1, 16))


def encode(epoch: Column, scope: Column, position: Column) -> Column:
    return F.concat(epoch, F.lit("~"), scope, F.lit(":"), position.cast("string"))


def position(checkpoint: Column) -> Column:
    """The version after the last colon; 0 for the start, null where malformed."""
    text = F.regexp_extract(checkpoint, r":([^:]*)$", 1)
    return F.when(checkpoint.isNull(), F.lit(0).cast("long")).when(text.rlike("^(0|[1-9][0-9]{0,18})$"), text.try_cast("long"))


def reset_reason(checkpoint: Column, epoch: Column, scope: Column, purged_through: Column) -> Column:
    """malformed, epoch, scope-changed or expired; null if the feed can go on from there."""
    since = position(checkpoint)
    head = F.regexp_replace(checkpoint, r":[^:]*$", "")
    return (
        F.when(checkpoint.isNull(), F.lit(None).cast("string"))
        .when(since.isNull(), "malformed")
        .when(~head.contains("~"), "epoch")
        .when(F.regexp_replace(head, r"~[^~]*$", "") != epoch, "epoch")
        .when(F.regexp_extract(head, r"~([^~]*)$", 1) != scope, "scope-changed")
        .when((since > 0) & (since < purged_through), "expired")
    )

"""Featurizers: how a key becomes a feature."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(key: Column) -> Column:
    """A 64-bit number of a key: its bytes where they are fewer than 8, else a hash whose highest byte is odd, so that the two don't meet; #123 is 123."""
    raw = F.encode(key, "UTF-8")
    short = F.conv(F.hex(raw), 16, 10).cast("long")
    long = F.xxhash64(key).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)).bitwiseOR(F.lit(1 << 56))
    literal = F.when(key.rlike("^#[0-9]{1,18}$"), F.substring(key, 2, 30).cast("long"))
    return F.coalesce(literal, F.when(F.length(raw) < 8, F.coalesce(short, F.lit(0).cast("long"))).otherwise(long))


def unhashed(feature: Column) -> Column:
    """The key of a number that holds a short key's bytes; # and the number of others."""
    text = F.decode(F.unhex(F.hex(feature)), "UTF-8")
    return F.when(F.shiftrightunsigned(feature, 56) == 0, text).otherwise(F.concat(F.lit("#"), feature.cast("string")))


def tagged(tag: str) -> Callable[[Column], Column]:
    """Keys with a prefix."""
    return lambda key: F.concat(F.lit(f"{tag}:"), key)


def plain(key: Column) -> Column:
    return key


def nothing(key: Column) -> Column:
    return F.lit(None).cast("string")


def not_structural(key: Column) -> Column:
    """Keys but for the markers of JSON structure."""
    return F.when(~key.rlike("^[﷐-﷯]+$"), key)


#: By name: a key's Column to its feature's; "tagging" takes the tag first.
FEATURIZERS: dict[str, Callable] = {"plain": plain, "hashing": hashed, "tagging": tagged, "json": not_structural, "null": nothing}

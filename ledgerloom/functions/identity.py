"""Identifiers: UUIDs in any notation, hash units, name-based UUIDs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: texts that denote a UUID: 32 hexadecimal digits, hyphens, braces, a URN prefix and white space aside.
UUID_NOTATION = r"(?i)^[\s\x{A0}\x{FEFF}]*(?:urn:uuid:)?[{(]?((?:[0-9a-f]-?){31}[0-9a-f])[)}]?[\s\x{A0}\x{FEFF}]*\z"


def uuid_bytes(text: Column | str) -> Column:
    """The 16 bytes of the UUID that a text denotes; NULL for null, empty and other texts.

    The usual notations, 32 digits with or without the four hyphens, are read without a pattern.
    """
    column = F.col(text) if isinstance(text, str) else text
    plain = F.replace(column, F.lit("-"), F.lit(""))
    placed = F.length(column) == 32
    hyphens = F.length(column) == 36
    for at in (9, 14, 19, 24):
        hyphens = hyphens & (F.substring(column, at, 1) == "-")
    usual = F.when((F.length(plain) == 32) & (placed | hyphens), F.unhex(plain))
    digits = F.regexp_replace(F.regexp_extract(column, UUID_NOTATION, 1), "-", "")
    return F.coalesce(usual, F.when(F.length(digits) == 32, F.unhex(digits)))


def hash_unit(text: Column) -> Column:
    """A number in [0, 1] from the first 32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)


def hash_unit_sha(text: Column) -> Column:
    """A number in [0, 1] from the first 64 bits of a text's SHA-256."""
    head = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return head.cast("double") / F.lit(float(2**64 - 1))


def name_uuid(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name in a namespace UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )

"""Text rules: blanks, keys, spelling variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(text: Column, otherwise: str = "UNKNOWN") -> Column:
    """The text without white space of any script at its ends, or another text where it is null or blank."""
    return F.coalesce(F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+\z", ""), F.lit("")), F.lit(otherwise))


def blank(text: Column) -> Column:
    """Null or nothing but white space of any script."""
    return text.isNull() | text.rlike(r"(?U)^\s*\z")


def tidy(text: Column) -> Column:
    """Runs of white space of any script as one space, none at the ends, no byte order mark."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\x{FEFF}", ""), r"(?U)\s+", " "))


def match_key(text: Column) -> Column:
    """What spelling variants of a text share: tidy and in lower case."""
    return F.lower(tidy(text))


#: Characters that fold to several, by rule: those whose full case folding isn't one character.
_SEVERAL = {chr(c): chr(c).casefold() for c in range(0x80, 0x20000) if len(chr(c).casefold()) > 1}
#: Characters that fold to one other than their lower case.
_ONE = {chr(c): chr(c).casefold() for c in range(0x80, 0x20000) if len(chr(c).casefold()) == 1 and chr(c).casefold() != chr(c).lower()}


def casefolded(text: Column) -> Column:
    """Full case folding, so that spellings that differ in case only are equal (ß and ss too). Stays in the JVM."""
    single = F.translate(text, "".join(_ONE), "".join(_ONE.values()))
    several = single
    for character, folded in _SEVERAL.items():
        several = F.replace(several, F.lit(character), F.lit(folded))
    rare = text.rlike("[" + "".join(_SEVERAL) + "]")
    # what folding made of such characters must not be lowered otherwise
    return F.translate(F.lower(F.when(rare, several).otherwise(single)), "".join(_ONE), "".join(_ONE.values()))


def first_marker(text: Column, markers: list[str]) -> Column:
    """The first of ``markers``, in their order, that a text holds in any case; null for none."""
    found = F.lit(None).cast("string")
    for marker in reversed(markers):
        found = F.when(F.contains(F.upper(text), F.lit(marker.upper())), marker).otherwise(found)
    return found

"""Sizes and words of texts."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the public word-and-punctuation tokenizer.
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: The same for the JVM: letters and digits of all scripts and the underscore; white space as Python has it.
TOKEN_JVM = r"[\p{L}\p{N}_]++|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]++"
WORD = re.compile(r"[^\W_]+")


def size(text: str | Column) -> Column:
    """A text's number of tokens; 0 for an empty text, null for null. Stays in the JVM."""
    return F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(TOKEN_JVM)).cast("long")


#: Format characters, variation selectors and joiners that show nothing.
INVISIBLE = {c: None for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf" or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c == 0x34F}


def words(text: str) -> list[str]:
    """The runs of letters and digits, without case, invisible characters and compatibility forms."""
    if text.isascii():
        return WORD.findall(text.lower())
    plain = unicodedata.normalize("NFKC", text.translate(INVISIBLE)).casefold()
    return WORD.findall(unicodedata.normalize("NFKC", plain))

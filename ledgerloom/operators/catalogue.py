"""Catalogue records: normalised, rejected with a reason, first of each key kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_key, tidy


def normalised(records: DataFrame, name: str, maker: str, route: str, price: str) -> DataFrame:
    """Records with tidy texts, a ``match_key`` of name and maker, and ``reject_reason`` (null: accepted).

    A route that is blank or a mere filler becomes UNKNOWN. Reasons in order: no name, no maker, no price above zero.
    """
    filler = F.upper(tidy(F.col(route))).isin("", ".", "-", "N/A", "NA", "NONE", "UNKNOWN", "NULL", "?")
    tidied = records.withColumns({
        "name": tidy(F.col(name)), "maker": tidy(F.col(maker)),
        "route": F.when(F.col(route).isNull() | filler, "UNKNOWN").otherwise(F.upper(tidy(F.col(route)))),
        "match_key": F.concat_ws("|", match_key(F.coalesce(F.col(name), F.lit(""))), match_key(F.coalesce(F.col(maker), F.lit("")))),
    })
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    reason = F.when(empty("name"), "no_name").when(empty("maker"), "no_maker").when(F.col(price).isNull() | (F.col(price) <= 0), "no_price")
    return tidied.withColumn("reject_reason", reason)


def first_of_key(records: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The first record of each key by ``order``: a minimum, which merges on the map side."""
    return records.groupBy(key).agg(F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("m"), F.count(F.lit(1)).alias("copies")).select(key, *[F.col(f"m.{c}").alias(c) for c in keep], "copies")

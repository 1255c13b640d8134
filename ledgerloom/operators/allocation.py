"""Quantities shared out: demand over lots in order, totals over weights without a remainder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .running import along


def from_lots(requests: DataFrame, lots: DataFrame, keys: list[str], request_order: list[str], lot_order: list[str], request_id: str, lot_id: str, request_units: str, lot_units: str, stretch: int = 100_000) -> DataFrame:
    """(keys, request, lot, units): requests served in order from lots in order, each lot used up before the next.

    Running totals turn requests and lots of a key into intervals on one line, and a pair shares what its intervals have
    in common. The line is cut into stretches of ``stretch`` units, which hold at most that many requests and lots and are
    worked on apart, so that a key with most rows has many tasks; in a stretch the borders of both are merged in order and
    what lies between two borders belongs to the request and lot that end next. No pairs are tried. What lots don't cover
    isn't shared out. Rows with null or no units are left out; equal places are decided by the ids.
    """

    def intervals(rows: DataFrame, order: list[str], own: str, units: str, name: str) -> DataFrame:
        known = rows.filter(F.col(units) > 0).select(*keys, *order, F.col(own).alias("own"), F.col(units).cast("long").alias("own_units"))
        ends = along(known, keys, [*order, "own"], {"until": F.col("own_units")}).withColumn("since", F.col("until") - F.col("own_units"))
        cells = F.sequence(F.floor(F.col("since") / stretch), F.floor((F.col("until") - 1) / stretch))
        pieces = ends.withColumn("cell", F.explode(cells))
        other = "lot" if name == "request" else "request"
        return pieces.select(*keys, "cell", F.least("until", (F.col("cell") + 1) * stretch).alias("until"), F.col("own").alias(name), F.lit(None).alias(other))

    borders = intervals(requests, request_order, request_id, request_units, "request").unionByName(intervals(lots, lot_order, lot_id, lot_units, "lot"))
    line = Window.partitionBy(*keys, "cell").orderBy("until", F.col("request").isNull(), "request", "lot")
    # the next one that ends: the last seen from the end of the line on, which is carried along instead of searched for
    back = Window.partitionBy(*keys, "cell").orderBy(F.col("until").desc(), F.col("request").isNull().desc(), F.col("request").desc(), F.col("lot").desc()).rowsBetween(Window.unboundedPreceding, 0)
    parts = borders.withColumns({
        "since": F.coalesce(F.lag("until").over(line), F.col("cell") * stretch),
        "request": F.last("request", ignorenulls=True).over(back),
        "lot": F.last("lot", ignorenulls=True).over(back),
    })
    shared = parts.filter("request IS NOT NULL AND lot IS NOT NULL AND until > since")
    whole = shared.groupBy(*keys, F.col("request").alias(request_id), F.col("lot").alias(lot_id))
    return whole.agg(F.sum(F.col("until") - F.col("since")).alias("units"))


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int, least: int = 0, group: list[str] | None = None) -> DataFrame:
    """(group, key, share): ``total`` over each group's keys by weight, at least ``least`` each, without a remainder.

    What rounding down leaves goes to the greatest remainders, ties to the greatest key. Null and negative weights count 0;
    a group without positive weight shares out only ``least``.
    """
    group = group or []
    with_sums = lambda rows, sums: rows.join(sums if group else F.broadcast(sums), group) if group else rows.join(F.broadcast(sums))  # noqa: E731  one row without a group
    # a null group is a group: it can't be joined by equality
    named = weights.select(*[F.struct(g).alias(g) for g in group], F.col(key).alias(key), F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("w"))
    sums = named.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("all_w"))
    rest = F.lit(total) - F.lit(least) * F.col("n")
    raw = cut(with_sums(named, sums).withColumn("raw", F.coalesce(F.try_divide(rest * F.col("w"), F.col("all_w")), F.lit(0.0))).withColumn("floor", F.floor("raw")))
    floors = raw.groupBy(*group).agg(F.sum("floor").alias("all_floors"))
    left = F.when(F.col("all_w") > 0, rest - F.col("all_floors")).otherwise(0)
    # places along a sort, so that no group has to fit a task
    placed = along(with_sums(raw, floors), group, [(F.col("raw") - F.col("floor")).desc(), F.col(key).desc()], {"place": F.lit(1).cast("long")})
    share = F.lit(least) + F.col("floor") + F.when(F.col("place") <= left, 1).otherwise(0)
    return placed.select(*[F.col(g)[g].alias(g) for g in group], key, share.cast("long").alias("share"))

import uuid

from pyspark.sql import functions as F

from ledgerloom.functions.identity import hash_unit, hash_unit_sha, uuid_bytes
from ledgerloom.functions.temporal import compact_date, utc_day, zoned_moment
from ledgerloom.functions.text import blank, match_key, named, tidy


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def applied(frame, expression):
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


def test_moments_with_a_zone(spark):
    good = ["2025-01-01T00:00:00Z", "2025-01-01 02:00:00+02:00", "2024-12-31T19:00:00.000-05:00", "2025-01-01T05:30:00+0530", "2025-01-01T02:00+02", " 2025-01-01t00:00:00.000000z ", "2025-01-01T00:00:00,000 Z"]
    assert set(applied(column(spark, good), F.unix_millis(zoned_moment("v")))) == {1_735_689_600_000}
    bad = [None, "", "yesterday", "2025-01-01T00:00:00", "2025-13-01T00:00:00Z", "2025-02-30T00:00:00Z", "2025-01-01T25:00:00Z", "2025-01-01", "2025-01-01Z", "2025-01-01T00:00:00 Europe/Berlin", "x2025-01-01T00:00:00Z", "2025-01-01T00:00:00Z" * 10_000]
    assert set(applied(column(spark, bad), zoned_moment("v"))) == {None}


def test_days_before_1970_and_at_borders(spark, at):
    moments = [at("1969-12-31 23:59:59.999999"), at("1970-01-01 00:00:00"), at("2025-08-31 23:59:59.999999"), None]
    assert [str(d) for d in applied(column(spark, moments, "timestamp"), utc_day("v"))] == ["1969-12-31", "1970-01-01", "2025-08-31", "None"]


def test_compact_dates(spark):
    texts = ["20250131", "2025-01-31", "01/31/2025", " 20250131 ", "20250231", "13/01/2025", "2025-1-31", "", None, "x"]
    assert [str(d) for d in applied(column(spark, texts), compact_date(F.col("v")))] == ["2025-01-31"] * 4 + ["None"] * 6


def test_uuid_notations(spark):
    own = uuid.UUID("0001dd15-ec04-4eb8-af25-ae8046906f20")
    good = [str(own), str(own).upper(), own.hex, f"{{{own}}}", f"({own})", own.urn, f"\t{own}\n", f"\xa0{own} "]
    assert {bytes(b) for b in applied(column(spark, good), uuid_bytes("v"))} == {own.bytes}
    bad = [None, "", "n/a", own.hex[:-1], own.hex + "0", str(own)[:-1] + "g", f"{own} {own}", "-" * 32, "evt-" + own.hex]
    assert set(applied(column(spark, bad), uuid_bytes("v"))) == {None}


def test_texts(spark):
    frame = column(spark, ["  a \t b\xa0c ", "﻿X", "", "\xa0", None, "ÄÖ  Z"])
    assert applied(frame, tidy(F.col("v"))) == ["a b c", "X", "", "", None, "ÄÖ Z"]
    assert applied(frame, match_key(F.col("v"))) == ["a b c", "x", "", "", None, "äö z"]
    assert applied(frame, blank(F.col("v"))) == [False, False, True, True, True, False]
    assert applied(frame, named(F.col("v")))[2:5] == ["UNKNOWN"] * 3


def test_hash_units(spark):
    import hashlib

    texts = ["", "a", "é", "x" * 1000]
    assert applied(column(spark, texts), hash_unit(F.col("v"))) == [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) / 4294967295.0 for t in texts]
    found = applied(column(spark, texts), hash_unit_sha(F.col("v")))
    assert all(abs(f - int(hashlib.sha256(t.encode()).hexdigest()[:16], 16) / (2**64 - 1)) < 1e-12 for f, t in zip(found, texts))

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.fingerprints import blake2b_number, farm_fingerprint, fingerprint
from ledgerloom.functions.numbers import ladder
from ledgerloom.functions.text import casefolded, first_marker
from ledgerloom.operators.changes import load_plan
from ledgerloom.sources import readers, sinks

# published examples of FARM_FINGERPRINT
KNOWN = {"": -7286425919675154353, "1footrue": -1541654101129638711, "2applefalse": 2794438866806483259, "3true": -4880158226897771312}


def test_fingerprints(spark):
    frame = spark.createDataFrame([(t,) for t in [*KNOWN, None]], "t string")
    assert {r["t"]: r["f"] for r in frame.select("t", farm_fingerprint(F.col("t")).alias("f")).collect()} == KNOWN | {None: None}
    texts = ["x" * n for n in range(200)] + ["é" * n for n in range(1, 40)]
    assert len({fingerprint(t) for t in texts}) == len(texts) and all(-(2**63) <= fingerprint(t) < 2**63 for t in texts)


def test_blake2b(spark):
    ids = [uuid.UUID(int=i * 7919) for i in range(5)]
    frame = spark.createDataFrame([(bytearray(u.bytes),) for u in ids] + [(None,)], "b binary")
    found = [r["n"] for r in frame.select(blake2b_number(F.col("b")).alias("n")).collect()]
    assert [None if n is None else int(n) for n in found] == [int.from_bytes(hashlib.blake2b(u.bytes, digest_size=8).digest(), "big") for u in ids] + [None]


def test_case_folding_is_that_of_unicode(spark):
    texts = ["Straße", "STRASSE", "İstanbul", "ﬁ ﬂ", "ΣΊΣΥΦΟΣ ς", "ŉ", "Ǆ ǅ", "plain ASCII", "", "Ω ℧", "ᏸ Ꮳ", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", casefolded(F.col("t")).alias("f")).collect()
    assert {r["t"]: r["f"] for r in found} == {t: t and t.casefold() for t in texts}


def test_markers_and_ladders(spark):
    frame = spark.createDataFrame([("a Beta alpha", 1.0), ("ALPHA", 2.0), ("gamma", 2.5), (None, None)], "t string, v double")
    marker = first_marker(F.col("t"), ["alpha", "beta"])
    closed, opened = ladder(F.col("v"), [(1, "a"), (2, "b")], "c"), ladder(F.col("v"), [(1, "a"), (2, "b")], "c", strict=True)
    assert [tuple(r) for r in frame.select(marker, closed, opened).collect()] == [("alpha", "a", "b"), ("alpha", "b", "c"), (None, "c", "c"), (None, None, None)]


def test_parts_of_text_come_back_in_order(spark, tmp_path):
    frame = spark.createDataFrame([(g, i, 'a "b", c\n' if i % 7 == 0 else None) for i in range(100) for g in ["x", "y", "z", None][i % 4 :][:1]], "g string, i int, t string")
    parts = sinks.write_text_parts(frame, str(tmp_path / "p"), "g", 3, rows_a_file=10)
    assert parts == ["part=0", "part=1"] and len(list((tmp_path / "p/part=0").glob("*.csv"))) >= 8
    contract = T.StructType([T.StructField("g", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("t", T.StringType())])
    read = readers.ordered_parts(spark, str(tmp_path / "p"), contract, parts)
    assert read.count() == 100 and read.filter("t IS NOT NULL").count() == frame.filter("t IS NOT NULL").count()
    first = {r["part_no"]: r["place"] for r in read.groupBy("part_no").agg(F.min("place").alias("place")).collect()}
    assert first[0] < first[1]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.ordered_parts(spark, str(tmp_path / "p"), contract, ["part=9"])
    assert readers.ordered_parts(spark, str(tmp_path / "p"), contract, []).count() == 0
    assert sinks.write_text_parts(frame.limit(0), str(tmp_path / "q"), "g", 3) == []


def test_reconciled_folders_go_before_snapshots():
    assert load_plan({"b": "/s/b", "a": "/s/a"}, {"a": "/r/a"}) == {"a": "/r/a", "b": "/s/b"}
    with pytest.raises(ValueError):
        load_plan({"a": "/s/a"}, {"c": "/r/c"})

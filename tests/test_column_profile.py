import math
import random
import re
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import column_profile as cp

RULES = [cp.Rule("price", above=0, at_most=100_000, level_factor=3), cp.Rule("maker", names=True, broken_share=0.25, single_share=0.5)]
SCHEMA = "id string, price decimal(14,2), maker string, load string, value string, column_name int"
MAKERS = ["Lavisogli Remedies", "Mersara Pharma", "Helselri Remedies", "Wenvi", "X & X", "None Such Works", "A.N.A. Drug House", "Nullmar Labs", "Novalue & Sons", "Unkn Brothers Mfg", "zero point laboratories", "3M", "Testa Pharma", "شركة النيل", "Ka", "Unknownia Ltd", "Ni", "X"]
NAMELESS = [None, "", "   ", "\xa0", "-", "--", ".", "?", "0", "000", "n/a", "N/A", "#N/A", "N.A.", "none", "NULL", "nan", "xxx", "TBD", "t.b.c.", "unknown ", "UNKNOWN MANUFACTURER", "not available", "to be confirmed", "Not yet known", "غير معروف", "unbekannt", "Not yet", "mfr. unknown", "(none)", "<NULL>", "U/K", "k. A.", "awaiting details", "0.0"]


def frame(spark, records):
    return spark.createDataFrame([(i, Decimal(p) if p is not None else None, m, load, "clash", 1) for i, p, m, load in records], SCHEMA)


def judged(spark, records):
    return cp.judged(cp.value_counts(frame(spark, records), RULES, "load"), RULES)


def test_values_that_name_nothing(spark, rows):
    records = [(f"{i}", "5", m, "l") for i, m in enumerate(MAKERS + NAMELESS)]
    broken = rows(cp.broken_records(frame(spark, records), "id", RULES, judged(spark, records)))
    assert broken == sorted([("maker", str(i)) for i in range(len(MAKERS), len(MAKERS + NAMELESS))], key=str)


def test_prices_out_of_range_and_repeated_rows(spark, rows):
    prices = ["0.00", "0.01", "-4", None, "100000.00", "100000.01"]
    records = [(str(i), p, "Wenvi", "l") for i, p in enumerate(prices)] * 2
    assert rows(cp.broken_records(frame(spark, records), "id", RULES, judged(spark, records))) == [("price", i) for i in "0235"]


@pytest.mark.parametrize(("text", "good"), [('{"a": 1}', True), ("{}", True), (' {"a" : 0 ,"b":12}\n', True), ('{"a\\"}": 1}', True), ('{"a": -1}', False), ('{"a": 1.0}', False), ('{"a": 1e3}', False), ('{"a": "1"}', False), ('{"a": null}', False), ('{"a": {"b": 1}}', False), ('{"a": 01}', False), ('{"a": 1,}', False), ('{"a": 1', False), ("[1]", False), ("", False), ("null", False), ('{"a": 1} x', False), ('{"a": 1} ', False)])
def test_plain_counts(spark, text, good):
    frame_of = spark.createDataFrame([(text,)], "t string")
    assert frame_of.filter(frame_of.t.rlike(cp.PLAIN_COUNTS)).count() == good


def test_plain_counts_in_a_very_long_text(spark):
    long = "{" + ", ".join(f'"key_{i}": {i}' for i in range(200_000)) + "}"
    frame_of = spark.createDataFrame([(long,), (long[:-1],)], "t string")
    assert frame_of.filter(frame_of.t.rlike(cp.PLAIN_COUNTS)).count() == 1


def test_induced_expressions_describe_what_they_cover(spark):
    records = [(str(i), f"{i}.{i % 100:02d}", m, "l") for i, m in enumerate([f"{a}{b} Pharma" for a in ("Ba", "Ke", "Lo", "Mu", "Ni", "Ta") for b in ("ra", "sel", "tomi", "vanaku")] + ["#12-x!", "AB/12\\x", "Ba\nra"])]
    found = cp.induce(cp.value_counts(frame(spark, records), RULES, "load"), RULES).collect()
    makers = {r["value"]: r["expression"] for r in found if r["column_name"] == "maker"}
    common = {e for v, e in makers.items() if v.endswith("Pharma")}
    assert len(common) == 1 and None not in common, "one expression covers the common form"
    assert makers["#12-x!"] is None and makers["AB/12\\x"] is None, "single odd values are exceptions"
    assert found and all(r["expression"] is None or spark.createDataFrame([(r["value"],)], "v string").selectExpr(f"v rlike r'{r['expression']}'").first()[0] for r in found if "'" not in (r["expression"] or ""))
    assert all(re.fullmatch(r"\^.*\\z|\(\?s\)\.\*", e) for e in makers.values() if e)


def test_loads_out_of_order(spark):
    ordinary = [(f"{k}-{i}", "40" if i % 2 else "50", f"Maker{chr(65 + i)} Pharma", f"load-{k}") for k in range(5) for i in range(8)]
    dear = [(f"d{i}", "200", f"Maker{chr(65 + i)} Pharma", "dear") for i in range(8)]
    cheap = [(f"c{i}", "10", f"Maker{chr(65 + i)} Pharma", "cheap") for i in range(8)]
    one_maker = [(f"o{i}", "45", "Wenvi" if i < 5 else f"Maker{i} Pharma", "one-maker") for i in range(8)]
    nameless = [(f"n{i}", "45", None if i < 3 else f"Maker{chr(65 + i)} Pharma", "nameless") for i in range(8)]
    half = [(f"h{i}", "45", "Wenvi" if i < 4 else f"Maker{chr(65 + i)} Pharma", "exactly-half") for i in range(8)]
    values = judged(spark, ordinary + dear + cheap + one_maker + nameless + half)
    found = {(r["column_name"], r["load"]) for r in cp.profile(values, RULES).collect() if r["out_of_order"]}
    assert found == {("price", "dear"), ("price", "cheap"), ("maker", "one-maker"), ("maker", "nameless")}


def test_shifts_between_loads(spark):
    plain = [(f"a{i}", "5", f"Bara{chr(97 + i % 20)}{chr(97 + i // 20)} Pharma", "1") for i in range(60)]
    same = [(f"b{i}", "5", m, "2") for i, (_, _, m, _) in enumerate(plain)]
    other = [(f"c{i}", "5", f"{i}-{i}/{i}", "3") for i in range(10, 70)]
    found = {(r["column_name"], r["load"]): (r["shift_before"], r["shift_overall"]) for r in cp.profile(judged(spark, plain + same + other), RULES).collect()}
    assert found["maker", "1"][0] is None and found["maker", "2"][0] == 0 and found["maker", "3"][0] > 0.9
    assert found["price", "3"] == (0, 0)


def test_empty_and_all_null_columns(spark):
    assert cp.profile(judged(spark, [("1", None, None, None)]), RULES).count() == 2
    empty = frame(spark, []).limit(0)
    values = cp.judged(cp.value_counts(empty, RULES, "load"), RULES)
    assert cp.profile(values, RULES).count() == 0 and cp.broken_records(empty, "id", RULES, values).count() == 0


def test_very_long_values(spark):
    makers = ["aA_" * 200_000, "a1-" * 200_000, "n/a " * 50_000, "x" * 1_000_000, '{"a": 1, ' * 30_000]
    records = [(str(i), "5", m, "l") for i, m in enumerate(makers)]
    values = judged(spark, records)
    assert cp.profile(values, RULES).count() == 2
    assert [r["record_key"] for r in cp.broken_records(frame(spark, records), "id", RULES, values).collect()] in (["2", "3"], ["3", "2"])


def test_the_chosen_expressions_decide(spark, rows):
    records = [(str(i), "5", m, "l") for i, m in enumerate(MAKERS + NAMELESS)]
    counts = cp.value_counts(frame(spark, records), RULES, "load")

    def nothing_chosen(distinct, rules):
        return cp._induced(distinct, rules).withColumn("sign", F.lit(None).cast("string")).withColumn("expression", F.lit(None).cast("string"))

    without = rows(cp.valued(counts, RULES, nothing_chosen).filter("broken AND value IS NOT NULL"), "column_name", "value")
    assert without == [], "without expressions no text is known to name nothing"
    known = cp.valued(counts, RULES)
    assert known.filter("broken AND value IS NOT NULL").count() == len(set(NAMELESS)) - 1
    assert known.filter("broken AND value IS NOT NULL AND NOT conforms").count() == 0


def test_a_text_that_says_nothing_has_an_expression_even_alone(spark):
    for text in NAMELESS[1:]:
        (row,) = cp.valued(cp.value_counts(frame(spark, [("1", "5", text, "l")]), RULES, "load"), RULES).filter("column_name = 'maker'").collect()
        assert row["conforms"] and row["broken"], text


COUNT_TEXTS = ['{"a": 1}', "{}", ' {"a" : 0 ,"b":12}\n', '{"a\\"}": 1}', '{"a": -1}', '{"a": 1.0}', '{"a": 1e3}', '{"a": "1"}', '{"a": null}', '{"a": {"b": 1}}', '{"a": 01}', '{"a": 00}', '{"a": 1,}', '{"a": 1', "[1]", "", "null", '{"a": 1} x', '{""": 1}', '{"": 1}', '{"a": ٣}', '{"a":\xa01}', '{"a\tb": 1}', '{"a": 1 "b": 2}', '{"a_b": 1, "c-d.e": 20, "f9": 3}', '{"a": 1}}', '{{"a": 1}', '{"a" "b": 1}', '{"a": 10, "b": 0, "c": 33, "d": 4}', '{,"a": 1}', '{"a":: 1}', '{"a": 1,,"b": 2}', '{"x": 1, "y": 2, "z": 3, }']


def test_sound_expressions_admit_only_plain_counts(spark):
    rule = cp.Rule("value", pattern=cp.PLAIN_COUNTS, sound=cp.PLAIN_COUNT_SIGNS)
    texts = COUNT_TEXTS + [t.replace("a", "ab") for t in COUNT_TEXTS]
    table = spark.createDataFrame([(t,) for t in texts], "value string")
    found = cp.valued(cp.value_counts(table, [rule]), [rule]).withColumn("plain", F.col("value").rlike(cp.PLAIN_COUNTS))
    assert found.filter("broken = plain").count() == 0
    shaped = cp._shapes(table, [rule])
    for shape in ("shape_1", "shape_2", "shape_3"):
        sound = shaped.filter(F.col(shape).rlike(cp.PLAIN_COUNT_SIGNS))
        assert sound.filter(~F.col("value").rlike(cp.PLAIN_COUNTS)).count() == 0 and sound.count() >= 4


def test_sound_numbers_are_within_the_range(spark, rows):
    prices = ["0.00", "0.01", "-4.00", "5.00", "99999.99", "100000.00", "100000.01", "999999999.99", "-0.01", "10.00", "-10.50"]
    records = [(str(i), p, "Wenvi", "l") for i, p in enumerate(prices * 30)]
    values = judged(spark, records)
    assert set(rows(values.filter("column_name = 'price' AND broken"), "value")) == {("0.00",), ("-4.00",), ("100000.01",), ("999999999.99",), ("-0.01",), ("-10.50",)}


def best_bits(values):
    """The fewest bits over every cut of the tree, tried one by one; values: (shapes by level, bits by level, bits in full)."""
    n = len(values)
    code = lambda shape, members, level: len(shape) * 8 + 8 + sum(v[1][level] for v in members) + len(members) * math.log2(n / len(members))

    def best(members, level):
        if level < 0:
            return sum(v[2] + math.log2(n) for v in members)
        groups = defaultdict(list)
        for v in members:
            groups[v[0][level]].append(v)
        return sum(min(code(shape, own, level), best(own, level - 1)) for shape, own in groups.items())

    return best(values, 2)


def test_no_cut_of_the_tree_has_fewer_bits(spark):
    rng = random.Random(5)
    makers = sorted({rng.choice(["Ba", "Ke", "lo", "M.", "3"]) + rng.choice(["ra", "sel", "-2", " & Co", ""]) * rng.randint(0, 2) for _ in range(60)} | {"n/a", "?", "--", "Tbd"})
    counts = cp.value_counts(frame(spark, [(str(i), None, m, "l") for i, m in enumerate(makers)]), RULES, "load").filter("column_name = 'maker'")
    shaped = cp._bits(cp._shapes(counts.select("column_name", "value"), RULES)).collect()
    values = {r["value"]: ([r["shape_1"], r["shape_2"], r["shape_3"]], [r["bits_1"], r["bits_2"], r["bits_3"]], r["bits_0"]) for r in shaped}
    chosen = {r["value"]: r["sign"] for r in cp.induce(counts, RULES).collect()}
    assert cp.ANYTHING not in chosen.values()
    groups = defaultdict(list)
    for value, sign in chosen.items():
        groups[sign].append(value)
    n, total = len(values), 0
    for sign, own in groups.items():
        if sign is None:
            total += sum(values[v][2] + math.log2(n) for v in own)
        else:
            level = min(k for k in range(3) if all(values[v][0][k] == sign for v in own))
            total += len(sign) * 8 + 8 + sum(values[v][1][level] for v in own) + len(own) * math.log2(n / len(own))
    assert total == pytest.approx(best_bits(list(values.values())))

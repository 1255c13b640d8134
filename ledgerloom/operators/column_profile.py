"""Column profiles: standard aggregates, regular expressions induced by minimum description length, and loads compared."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .spread import spread_join

# Signs of an expression besides the characters that stand for themselves. Letters and digits never stand for themselves.
UPPER, LOWER, LETTER, DIGIT, SPACE = "A", "a", "b", "9", " "
AGAIN, ABSENT, ABOUT, ZERO, WORD, NUMBER, OPEN, CLOSE, LOOSE, NOTHING, ANYTHING, LEADING = (chr(0xE000 + i) for i in range(12))

#: Words and abbreviations that say a value is absent, unknown or not yet known, or fill its place.
ABSENCE = (
    "not (?:yet )?(?:available|applicable|known|specified|stated|given|provided|recorded|assigned|determined|confirmed|defined|set|found|listed|disclosed)",
    "to be (?:confirmed|determined|announced|advised|added|defined|specified|completed|decided|supplied)",
    "no (?:value|data|name|info|information|manufacturer|maker|producer|company|entry)",
    "unknown", "unkn?", "unspecified", "unstated", "undefined", "undetermined", "undisclosed", "unavailable", "unnamed", "unidentified", "unassigned", "not?hing",
    "none", "null", "nil", "nan", "missing", "absent", "blank", "empty", "pending", "void", "default", "dummy", "placeholder", "test", "sample",
    r"n\W?\s?[akds]\W?", r"u\W\s?k\W?", r"t\W?b\W?[dcasn]\W?", "x{2,}", "y{3,}", "z{3,}", r"k\W\s?a\W?",
    "not yet", "awaiting (?:confirmation|data|information|details)", "unlisted", "unregistered", "unbekannt", "keine angabe", "inconnue?", "non (?:connu|disponible|renseigné)", "desconocid[oa]", "no (?:disponible|aplica)", "sin datos",
    "غير (?:معروف|محدد|متوفر|متاح|معلوم|مسجل)", "لا يوجد", "مجهول",
)
#: Words that may go with them without naming anything.
SUBJECT = ("manufacturer", "maker", "producer", "company", "supplier", "vendor", "brand", "mfg", "mfr", "name", "value", "data", "details", "information", "yet", "is", "the", "at present", "currently", "الشركة", "المصنع")
#: Fixed value: a JSON object whose values are all numbers in plain digits. Possessive, so that long texts need no stack.
PLAIN_COUNTS = r"""^[ \t\n\r]*+\{[ \t\n\r]*+(?:"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"[ \t\n\r]*+:[ \t\n\r]*+(?:0|[1-9][0-9]*+)[ \t\n\r]*+(?:,[ \t\n\r]*+"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"[ \t\n\r]*+:[ \t\n\r]*+(?:0|[1-9][0-9]*+)[ \t\n\r]*+)*+)?\}[ \t\n\r]*+\z"""

_GAP = f"(?:{LOOSE}| {AGAIN}?)*+"
_PAIR = rf'{_GAP}"(?:[Aab9_.\-{WORD}{NUMBER}]{AGAIN}?)*+"{_GAP}:{_GAP}(?:9++{AGAIN}?|{NUMBER}){_GAP}'
#: The same in the signs of expressions, for texts without escapes and odd keys; other expressions leave it to the value.
PLAIN_COUNT_SIGNS = rf"^{_GAP}\{{(?:{_GAP}|(?:{OPEN}{_PAIR},{_GAP}{CLOSE})?{_PAIR}(?:,{_PAIR})*)\}}{_GAP}\z"


@dataclass(frozen=True)
class Rule:
    """What a column should hold. Null values always break the rule."""

    column: str
    above: float | None = None  #: numbers must be greater
    at_most: float | None = None  #: and not greater than this
    pattern: str | None = None  #: texts must match
    sound: str | None = None  #: expressions, in signs, under which every text does
    names: bool = False  #: texts must name something, not say that the name is absent
    level_factor: float | None = None  #: a load whose median is off the median load's by more than this factor is out of order
    broken_share: float | None = None  #: as is a load with a greater share of broken values
    single_share: float | None = None  #: or one value in a greater share of its rows


def _values(rules: list[Rule]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(r.column).alias("column_name"), F.col(r.column).cast("string").alias("value")) for r in rules]))


def loaded_values(rows: DataFrame, rules: list[Rule], load: str | None = None) -> DataFrame:
    """(load, column_name, value): the values of the rules' columns, as text, nulls included, with their load."""
    return rows.select((F.col(load) if load else F.lit(None)).cast("string").alias("load"), _values(rules).alias("pair")).select("load", "pair.*")


def value_counts(rows: DataFrame, rules: list[Rule], load: str | None = None, *others: DataFrame) -> DataFrame:
    """(load, column_name, value, row_count): rows by distinct value of each column; ``others`` are loaded_values() of more tables."""
    named = loaded_values(rows, rules, load)
    for other in others:
        named = named.unionByName(other)
    return named.groupBy("load", "column_name", "value").agg(F.count(F.lit(1)).alias("row_count"))


def _per_rule(rules: list[Rule], make, otherwise: Column) -> Column:
    """``make(rule)`` for the rows of each rule's column; rules for which it is None give ``otherwise``."""
    chosen = otherwise
    for rule in rules:
        if (made := make(rule)) is not None:
            chosen = F.when(F.col("column_name") == rule.column, made).otherwise(chosen)
    return chosen


def _token(words: tuple[str, ...]) -> str:
    return r"(?iU)(?<![\p{L}\p{N}])(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + r")(?![\p{L}\p{N}])"


def _number(rule: Rule) -> bool:
    return rule.above is not None or rule.at_most is not None


_ALL_ZERO = r"(?<![\p{L}\p{N}])0+(?![\p{L}\p{N}])"


def _shapes(values: DataFrame, rules: list[Rule]) -> DataFrame:
    """Three expressions for each value, each more general: by character, by run, by word, loose spacing and repeated unit.

    Where a name is asked for, texts that only say that there is none share one expression at the last level.
    """
    plain = F.regexp_replace("value", rf"[{AGAIN}-{LEADING}]", chr(0xFFFD))
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, _token(ABSENCE), ABSENT), _token(SUBJECT), ABOUT), _ALL_ZERO, ZERO)
    text = _per_rule(rules, lambda r: words if r.names else F.regexp_replace(plain, _ALL_ZERO, ZERO) if _number(r) else None, F.regexp_replace(plain, "(?<![0-9])0(?=[0-9])", LEADING))
    for classes, sign in ((r"\p{Lu}", UPPER), (r"\p{Ll}", LOWER), ("[0-9]", DIGIT), (r"[\p{L}\p{N}](?<![Aa9])", LETTER), (r"[ \t\n\r]", SPACE)):
        text = F.regexp_replace(text, classes, sign)
    with_1 = values.withColumn("shape_1", text)
    with_2 = with_1.withColumn("shape_2", F.regexp_replace("shape_1", r"(.)\1+", "$1" + AGAIN))
    merged = F.regexp_replace(F.regexp_replace("shape_2", f"(?:[Aab_]{AGAIN}?+)++", WORD), f"9{AGAIN}?+", NUMBER)
    loose = F.regexp_replace(merged, rf"(?: {AGAIN}?)?([,:;{{}}\[\]])(?: {AGAIN}?)?", f"{LOOSE}$1{LOOSE}")
    with_3 = with_2.withColumn("words_3", loose).withColumn("nameless", _per_rule(rules, lambda r: _says_nothing(F.col("shape_1")) if r.names else None, F.lit(False)))
    return with_3.withColumn("shape_3", F.when(F.col("nameless"), NOTHING).otherwise(F.regexp_replace("words_3", r"(.{2,24}?)\1+", OPEN + "$1" + CLOSE)))


def _says_nothing(sign: Column) -> Column:
    """Whether an expression has no sign for letters and digits but those of words of absence."""
    own = sign.rlike(f"[Aab9{WORD}{NUMBER}{ANYTHING}]")
    return ~own & (sign.contains(ABSENT) | sign.contains(NOTHING) | ~sign.contains(ABOUT))


def _bits(values: DataFrame) -> DataFrame:
    """Bits to write each value: under each of its expressions, under any text, and in full as an exception.

    A word of absence has no more bits than its sign saves, so a text that says nothing is never an exception.
    """
    count = lambda signs, shape="shape_1": F.length(shape) - F.length(F.translate(shape, signs, ""))
    chars = count("Aa") * 4.7 + count("b") * 6.6 + count("9") * 3.32 + count(ABSENT) * 5.0 + count(ABOUT) * 4.0
    runs = count(AGAIN, "shape_2") * 4.0
    size = F.octet_length("value")
    return values.withColumns({
        "bits_1": chars,
        "bits_2": chars + runs,
        "bits_3": F.when(F.col("nameless"), F.length("shape_1") * 5.0).otherwise(chars + runs + count(WORD, "words_3") * 2.0 + count(LOOSE, "words_3") * 0.5 + (F.length("words_3") - F.length("shape_3")) * 0.1),
        "bits_4": size * 7.0 + 8.0,
        "bits_0": size * 8.0 + 16.0,
    })


def induce(counts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each distinct non-null value of ``value_counts()`` with the regular expression that describes its column best.

    The expressions of a column form a tree (by character, run, word, any text). A set of them, with the remaining values
    written in full, is a description of all distinct values; of all such cuts of the tree the one with the fewest bits (8 a
    sign of an expression, 8 an expression, which expression each value has, and its own bits given that; an exception
    costs the bits that tell one among all values, 16, and its bytes) is found bottom-up, level by level, with one
    aggregation each: nothing is gathered or sampled. Columns: column_name, value, row_count, shape_1, ``sign`` (expression
    in signs) and ``expression`` (as a regular expression), both null for exceptions: nonconforming values.
    """
    distinct = counts.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.sum("row_count").alias("row_count"))
    return _induced(distinct, rules).select("column_name", "value", "row_count", "shape_1", "sign", "expression")


def _induced(distinct: DataFrame, rules: list[Rule]) -> DataFrame:
    """``distinct`` (one row a column and value, row_count and other columns beside them) with shape_1, sign and expression."""
    # written once: each level of the tree reads it
    shaped = cut(_bits(_shapes(distinct, rules)))
    # one number a column
    sizes = {r["column_name"]: float(r["n"]) for r in shaped.groupBy("column_name").agg(F.count("value").alias("n")).collect()}
    values = _per_rule(rules, lambda r: F.lit(sizes.get(r.column, 1.0)), F.lit(1.0))
    sums = lambda *names: [F.sum(n).alias(n) for n in (*names, "members")]
    # 8 bits an expression and a sign of it, and for each of its values which expression it is
    code = lambda shape, bits: F.length(shape) * 8.0 + 8.0 + F.col(bits) + F.col("members") * F.log2(values / F.col("members"))
    own = F.col("bits_0") + F.col("members") * F.log2(F.greatest(values, F.lit(1.0)))
    level_1 = shaped.filter(F.col("value").isNotNull()).withColumn("members", F.lit(1)).groupBy("column_name", "shape_3", "shape_2", "shape_1").agg(*sums("bits_0", "bits_1", "bits_2", "bits_3", "bits_4"))
    level_1 = level_1.withColumn("cost", code("shape_1", "bits_1")).withColumn("take_1", F.col("cost") < own).withColumn("best", F.least("cost", own))
    level_2 = level_1.groupBy("column_name", "shape_3", "shape_2").agg(*sums("best", "bits_2", "bits_3", "bits_4"))
    level_2 = level_2.withColumn("cost", code("shape_2", "bits_2")).withColumn("take_2", F.col("cost") < F.col("best")).withColumn("best", F.least("cost", "best"))
    level_3 = level_2.groupBy("column_name", "shape_3").agg(*sums("best", "bits_3", "bits_4"))
    level_3 = level_3.withColumn("cost", code("shape_3", "bits_3")).withColumn("take_3", F.col("cost") < F.col("best")).withColumn("best", F.least("cost", "best"))
    # any text has something of its own: texts that say nothing aren't merged with names. One row a column
    root = level_3.filter(F.col("shape_3") != NOTHING).groupBy("column_name").agg(*sums("best", "bits_4")).select("column_name", (F.col("bits_4") + 32.0 < F.col("best")).alias("take_4"))
    choice = (
        level_1.select("column_name", "shape_1", "shape_2", "shape_3", "take_1", "members")
        .join(level_2.select("column_name", "shape_2", "shape_3", "take_2"), ["column_name", "shape_2", "shape_3"])
        .join(level_3.select("column_name", "shape_3", "take_3"), ["column_name", "shape_3"])
        .join(F.broadcast(root), "column_name", "left")
    )
    anything = F.coalesce("take_4", F.lit(False)) & (F.col("shape_3") != NOTHING)
    sign = F.when(anything, ANYTHING).when(F.col("take_3"), F.col("shape_3")).when(F.col("take_2"), F.col("shape_2")).when(F.col("take_1"), F.col("shape_1"))
    choice = choice.select("column_name", "shape_1", "members", sign.alias("sign"), _as_regex(sign).alias("expression"))
    # a shape may be that of most values
    return spread_join(shaped.select(*distinct.columns, "shape_1"), choice, ["column_name", "shape_1"], "members", "left")


def _as_regex(sign: Column) -> Column:
    text = F.regexp_replace(sign, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    text = F.regexp_replace(text, "[Aab9 ]", r"\\$0")  # marks the signs; what follows names them
    absent, about = ("(?iU:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")" for words in (ABSENCE, SUBJECT))
    for mark, regex in (
        ("\\A", r"\p{Lu}"), ("\\a", r"\p{Ll}"), ("\\b", r"[\p{L}\p{N}]"), ("\\9", "[0-9]"), ("\\ ", r"[ \t\n\r]"), (AGAIN, "+"), (ZERO, "0+"), (LEADING, "0"), (NUMBER, "[0-9]+"), (WORD, r"[\p{L}\p{N}_]+"), (LOOSE, r"[ \t\n\r]*"), (OPEN, "(?:"), (CLOSE, ")+"),
        (ABSENT, absent), (ABOUT, about), (NOTHING, rf"(?:[^\p{{L}}\p{{N}}]|0|{absent}|{about})*"), (ANYTHING, "(?s:.*)"),
    ):
        text = F.replace(text, F.lit(mark), F.lit(regex))
    return F.concat(F.lit("^"), text, F.lit("\\z"))


def valued(counts: DataFrame, rules: list[Rule], induced=_induced) -> DataFrame:
    """One row a column and distinct value of ``value_counts()``: its expression, ``conforms``, ``broken``, and its ``loads``.

    The chosen expression decides: a text names nothing if its expression says so, and what stands under an expression
    that admits only sound numbers or texts is sound. Values under other expressions, and those that conform to none, are
    checked exactly against the range and the pattern. A null value has no expression, conforms to none and breaks every
    rule. ``loads`` holds the rows in each load; there are as many entries as loads have the value.
    """
    distinct = counts.groupBy("column_name", "value").agg(F.sum("row_count").alias("row_count"), F.collect_list(F.struct("load", "row_count")).alias("loads"))
    number = F.col("value").try_cast("decimal(38,6)")
    sign = F.coalesce("sign", F.lit(""))

    def broken(rule: Rule) -> Column:
        if rule.names:
            return F.col("sign").isNotNull() & _says_nothing(sign)
        checks, sound = [], F.lit(False)
        if _number(rule):
            digits = len(str(int(rule.at_most))) - 1 if rule.at_most is not None else None
            if (rule.above is None or rule.above <= 0) and digits != 0:
                sound = sign.rlike(rf"^(?:9{{1,{digits or ''}}}|{ZERO})(?:\.(?:9+|{ZERO}))?\z") & sign.contains("9")
            checks += [~F.coalesce(number > F.lit(rule.above).cast("decimal(38,6)"), F.lit(False))] if rule.above is not None else []
            checks += [~F.coalesce(number <= F.lit(rule.at_most).cast("decimal(38,6)"), F.lit(False))] if rule.at_most is not None else []
        if rule.pattern is not None:
            sound = sign.rlike(rule.sound) if rule.sound else F.lit(False)
            checks.append(~F.col("value").rlike(rule.pattern))
        verdict = F.lit(False)
        for check in checks:
            verdict = verdict | check
        return F.when(sound, False).otherwise(verdict)

    known = induced(distinct, rules)
    return known.select("column_name", "value", "row_count", "loads", "sign", "expression", F.col("sign").isNotNull().alias("conforms"), F.coalesce(_per_rule(rules, broken, F.lit(False)), F.lit(True)).alias("broken")).withColumn("broken", F.col("broken") | F.col("value").isNull())


def by_load(values: DataFrame) -> DataFrame:
    """``valued()`` with one row a load."""
    return values.withColumn("in_load", F.explode("loads")).select("in_load.load", "column_name", "value", F.col("in_load.row_count").alias("row_count"), "sign", "expression", "conforms", "broken")


def judged(counts: DataFrame, rules: list[Rule]) -> DataFrame:
    """``value_counts()`` with each value's expression, ``conforms`` and ``broken`` (against its column's rule), as valued() has them."""
    return by_load(valued(counts, rules))


def profile(values: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per column and load of ``judged()`` values: ``load_figures()`` and how expression coverage changed.

    ``shift_before`` and ``shift_overall`` are half the summed differences in coverage from the load before, by label (null
    for the first), and from all loads.
    """
    figures, shifts = load_figures(values, rules), _shifts(values).withColumnRenamed("load", "shift_load")
    same = (figures["column_name"] == shifts["shift_column"]) & figures["load"].eqNullSafe(shifts["shift_load"])
    return figures.join(shifts, same, "left").select(*figures.columns, F.round("shift_before", 6).alias("shift_before"), F.round("shift_overall", 6).alias("shift_overall"))


def load_figures(values: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per column and load of ``judged()`` values: aggregates, broken and nonconforming rows.

    Columns: rows, nulls, null share, distinct values, least and greatest value (numbers where the rule has a range, else
    texts), median of unbroken numbers and its ratio to the median load's, rows that break the rule or conform to no
    expression, the greatest share of one value, and ``out_of_order``. An all-null column has null values, medians and
    ratios. The median's state holds one entry a distinct number of a load.
    """
    numeric = [r.column for r in rules if r.above is not None or r.at_most is not None]
    number = F.col("value").try_cast("decimal(38,6)").cast("double")
    by_load = values.withColumn("number", F.when(F.col("column_name").isin(numeric), number)).groupBy("column_name", "load").agg(
        F.sum("row_count").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("row_count")).otherwise(0)).alias("null_rows"),
        F.count("value").alias("distinct_values"),
        F.coalesce(F.min("number").cast("string"), F.min(F.when(~F.col("column_name").isin(numeric), F.col("value")))).alias("least"),
        F.coalesce(F.max("number").cast("string"), F.max(F.when(~F.col("column_name").isin(numeric), F.col("value")))).alias("greatest"),
        F.percentile(F.when(~F.col("broken"), F.col("number")), F.lit(0.5), F.when(F.col("number").isNotNull() & ~F.col("broken"), F.col("row_count")).otherwise(0)).alias("median"),
        F.sum(F.when(F.col("broken"), F.col("row_count")).otherwise(0)).alias("broken_rows"),
        F.sum(F.when(~F.col("conforms") & F.col("value").isNotNull(), F.col("row_count")).otherwise(0)).alias("nonconforming_rows"),
        F.max(F.when(F.col("value").isNotNull(), F.col("row_count")).otherwise(0)).alias("most_of_one"),
    )
    # one row a column and load, read twice; and one a column
    by_load = cut(by_load)
    middle = by_load.groupBy("column_name").agg(F.percentile("median", F.lit(0.5)).alias("middle"))
    share = lambda c: F.col(c) / F.col("rows")
    full = by_load.join(F.broadcast(middle), "column_name").withColumn("level", F.try_divide("median", "middle"))

    def wrong(rule: Rule) -> Column:
        checks = F.lit(False)
        if rule.level_factor is not None:
            checks = checks | (F.col("median") > F.col("middle") * rule.level_factor) | (F.col("median") < F.col("middle") / rule.level_factor)
        if rule.broken_share is not None:
            checks = checks | (F.col("broken_rows") > F.col("rows") * rule.broken_share)
        if rule.single_share is not None:
            checks = checks | (F.col("most_of_one") > F.col("rows") * rule.single_share)
        return F.coalesce(checks, F.lit(False))

    return full.select("column_name", "load", "rows", "null_rows", F.round(share("null_rows"), 6).alias("null_share"), "distinct_values", "least", "greatest", "median", F.round("level", 6).alias("level"), "broken_rows", "nonconforming_rows", F.round(share("most_of_one"), 6).alias("single_share"), _per_rule(rules, wrong, F.lit(False)).alias("out_of_order"))


def coverage(values: DataFrame) -> DataFrame:
    """(column_name, load, sign, covered, share, usual, place): rows of each load under each expression; null: nulls and exceptions.

    ``share`` is of the load's rows, ``usual`` of the column's, ``place`` the load's among its column's, by label.
    """
    # written: read for the loads' sums and again beside them
    covered = cut(values.groupBy("column_name", "load", "sign").agg(F.sum("row_count").alias("covered")))
    # one row a column and load
    of_column = Window.partitionBy("of_column")
    loads = covered.groupBy(F.col("column_name").alias("of_column"), F.col("load").alias("of_load")).agg(F.sum("covered").alias("in_load"))
    loads = loads.withColumns({"in_column": F.sum("in_load").over(of_column), "place": F.row_number().over(of_column.orderBy("of_load"))})
    joined = covered.join(F.broadcast(loads), (F.col("column_name") == F.col("of_column")) & F.col("load").eqNullSafe(F.col("of_load")))
    usual = F.sum("covered").over(Window.partitionBy("column_name", "sign")) / F.col("in_column")
    return joined.select("column_name", "load", "sign", "covered", (F.col("covered") / F.col("in_load")).alias("share"), usual.alias("usual"), "place")


def _shifts(values: DataFrame) -> DataFrame:
    """Half the summed differences of coverage: from the load before and from the column as a whole."""
    in_order = Window.partitionBy("column_name", "sign").orderBy("place")
    previous = F.when(F.lag("place").over(in_order) == F.col("place") - 1, F.lag("share").over(in_order))
    # an expression that a load lacks adds its share elsewhere: all those shares sum to 1
    gap = lambda other: (F.sum(F.abs(F.col("share") - other) - other) + 1) / 2
    sums = coverage(values).withColumn("previous", F.coalesce(previous, F.lit(0.0))).groupBy(F.col("column_name").alias("shift_column"), "load", "place").agg(gap(F.col("previous")).alias("before"), gap(F.col("usual")).alias("shift_overall"))
    return sums.select("shift_column", "load", F.when(F.col("place") > 1, F.col("before")).alias("shift_before"), "shift_overall")


def keyed_values(rows: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(record_key, column_name, value): the values of the rules' columns by record."""
    return rows.select(F.col(key).cast("string").alias("record_key"), _values(rules).alias("pair")).select("record_key", "pair.*")


def records_of(each: DataFrame, broken: DataFrame) -> DataFrame:
    """The rows of ``keyed_values()``, once each, that have one of the ``broken`` values (column_name, value, row_count)."""
    return spread_join(each, broken, ["column_name", "value"], "row_count", "left_semi").drop("value").distinct()


def broken_records(rows: DataFrame, key: str, rules: list[Rule], values: DataFrame) -> DataFrame:
    """(column_name, record_key) of every row whose value breaks its column's rule, nulls included; each key once.

    The judged values select the rows: only distinct broken values are joined back.
    """
    bad = values.filter("broken").groupBy("column_name", "value").agg(F.sum("row_count").alias("row_count"))
    return records_of(keyed_values(rows, key, rules), bad).select("column_name", "record_key")

"""Reading files and databases under contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The types that a warehouse column accepts, by its type there.
ACCEPTED = {"STRING": {"string"}, "INT64": {"int", "bigint", "smallint", "tinyint"}, "FLOAT64": {"double", "float"}, "BOOL": {"boolean"}, "DATE": {"date"}, "TIMESTAMP": {"timestamp"}, "NUMERIC": set()}


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files in a folder and those under it."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def partitioned(spark: SparkSession, base: str, *parts: str) -> DataFrame:
    """Some partitions of a table, or all, with the partition columns kept."""
    return spark.read.option("basePath", base).parquet(*([f"{base}/{p}" for p in parts] or [base]))


def csv_under_contract(spark: SparkSession, path: str, contract: T.StructType, required: list[str] | None = None) -> DataFrame:
    """CSV files as text, then typed: what can't be cast is null, and a missing column is an error before any row is read.

    The schema isn't inferred; a byte order mark before the first name is dropped; more columns than the contract has are
    left out; the order of the columns in the file doesn't matter.
    """
    head = spark.read.option("header", "true").csv(path)
    names = {c.lstrip("\ufeff").strip(): c for c in head.columns}
    if missing := [f.name for f in contract.fields if f.name not in names and f.name in (required or contract.names)]:
        raise ValueError(f"columns missing: {missing}")
    staged = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)
    column = lambda f: F.col(f"`{names[f.name]}`").try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)
    return staged.select(*[column(f).alias(f.name) for f in contract.fields])


def contract_differences(frame: DataFrame, contract: dict[str, str]) -> list[str]:
    """What keeps a frame from a warehouse contract: missing and unknown columns, types it doesn't accept. Never a coercion."""
    types = dict(frame.dtypes)
    wrong = [f"missing: {c}" for c in contract if c not in types] + [f"unknown: {c}" for c in types if c not in contract]
    for c, kind in contract.items():
        if c in types and types[c] not in ACCEPTED[kind] and not (kind == "NUMERIC" and types[c].startswith("decimal")):
            wrong.append(f"{c}: {types[c]} is no {kind}")
    return wrong


def jdbc_by_hash(spark: SparkSession, url: str, table: str, key: str, partitions: int, fetch_size: int = 5000, hash_sql: str = "('x' || substr(md5(({key})::text), 1, 8))::bit(32)::bigint") -> DataFrame:
    """A database table in parallel by a hash of its key, so that no part depends on how keys are spread.

    ``hash_sql`` is the database's expression for a number from the key. Each part is its own query. The driver's jar must
    be on the class path.
    """
    number = hash_sql.format(key=key)
    predicates = [f"mod(abs({number}), {partitions}) = {i}" for i in range(partitions)]
    return spark.read.jdbc(url, table, predicates=predicates, properties={"fetchsize": str(fetch_size)})


def hash_parts(frame: DataFrame, key: list[str], parts: int) -> DataFrame:
    """``frame`` with ``part`` from 0 to parts - 1 by the key's MD5, as a database would compute it."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("long")
    return frame.withColumn("part", F.pmod(number, F.lit(parts)))


def ordered_parts(spark: SparkSession, folder: str, contract: T.StructType, parts: list[str]) -> DataFrame:
    """CSV parts under a contract, with ``part_no`` from 0 in the order of ``parts``; a part that isn't there is an error.

    Rows carry their part's number and the place in their file, so that what depends on the order can ask for it; reading
    itself stays parallel.
    """
    if not parts:
        return spark.createDataFrame([], contract).withColumns({"part_no": F.lit(0), "place": F.lit(0).cast("long")})
    united = None
    for number, part in enumerate(parts):
        own = csv_under_contract(spark, f"{folder}/{part}", contract).withColumn("part_no", F.lit(number))
        united = own if united is None else united.unionByName(own)
    return united.withColumn("place", F.monotonically_increasing_id())

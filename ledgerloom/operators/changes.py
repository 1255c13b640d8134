"""Change data capture: decoding, validation, the latest change per key, and current state over a snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .events import Check, first_failure

#: Operations of a change record: create, update, delete, read.
OPERATIONS = ("c", "u", "d", "r")


def either_path(value: str, path: str) -> Column:
    """A field of a change record, wrapped in ``payload`` or not."""
    return F.coalesce(F.get_json_object(value, f"$.payload.{path}"), F.get_json_object(value, f"$.{path}"))


def decoded(messages: DataFrame, value: str = "value") -> DataFrame:
    """Messages with the columns of their change records; numbers that aren't are null instead of failing the job."""
    number = lambda path: either_path(value, path).try_cast("long")
    return messages.withColumns({
        "op": either_path(value, "op"), "source_schema": either_path(value, "source.schema"), "source_table": either_path(value, "source.table"),
        "source_lsn": number("source.lsn"), "source_ts_ms": number("source.ts_ms"), "connector_ts_ms": number("ts_ms"),
        "before_json": either_path(value, "before"), "after_json": either_path(value, "after"),
    })


def change_failure(schema: str, tables: list[str], value: str = "value") -> Column:
    """The first rule that a decoded change fails. Null operations, schemas and tables fail; they don't slip through."""
    return first_failure([
        Check("null_value", F.col(value).isNotNull()),
        Check("unsupported_operation", F.col("op").isin(*OPERATIONS)),
        Check("source_schema_mismatch", F.col("source_schema") == schema),
        Check("source_table_mismatch", F.col("source_table").isin(*tables)),
        Check("missing_row", F.when(F.col("op") == "d", F.lit(True)).otherwise(F.col("after_json").isNotNull())),
    ])


def restored(json: str, schema: T.StructType) -> Column:
    """A row's JSON as a struct of ``schema``; days since 1970 for dates; for timestamps text, or micro- or milliseconds
    (from 10^14 on they are microseconds); base64 for binary. What can't be read is null."""
    raw = F.from_json(json, T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]))

    def one(field: T.StructField) -> Column:
        text = raw[field.name]
        number = text.try_cast("long")
        if isinstance(field.dataType, T.DateType):
            # digits alone are days, never a year
            return F.when(number.isNotNull(), F.date_from_unix_date(number.try_cast("int"))).otherwise(text.try_cast("date"))
        if isinstance(field.dataType, T.TimestampType):
            scaled = F.when(F.abs(number) >= 10**14, F.timestamp_micros(number)).otherwise(F.timestamp_millis(number))
            return F.when(number.isNotNull(), scaled).otherwise(text.try_cast("timestamp"))
        if isinstance(field.dataType, T.BinaryType):
            return F.try_to_binary(text, F.lit("base64"))
        return text.try_cast(field.dataType)

    return F.struct(*[one(f).alias(f.name) for f in schema.fields])


def latest_changes(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of each key: greatest by ``order``, nulls first.

    A maximum merges on the map side, so a key with most changes sends one row a task; no window sorts its history. Changes
    alike in all of ``order`` are decided by their whole content. A null in a key is a value of its own.
    """
    last = F.struct(*[part for c in order for part in (F.col(c).isNotNull(), F.col(c))])
    whole = F.struct(*[F.col(c) for c in changes.columns])
    return changes.groupBy(*[F.col(k).alias(f"key_{k}") for k in keys]).agg(F.max(F.struct(last.alias("last"), whole.alias("row"))).alias("m")).select("m.row.*")


def reconciled(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str], op: str = "op") -> DataFrame:
    """A snapshot brought up to date: rows without a change, and the last change of the others unless it deletes.

    ``changes`` has the snapshot's columns, ``op`` and ``order``. The snapshot must have each key once; deletes of keys it
    doesn't have are harmless. Rows whose key holds a null match nothing and are kept as they are.
    """
    last = latest_changes(changes, keys, order)
    kept = base.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.filter(F.col(op) != "d").select(*base.columns))


def overlay(base: DataFrame, deltas: DataFrame, keys: list[str], event_id: str = "event_id", ingested: str = "ingested_at", order: tuple[str, ...] = ("source_lsn", "kafka_partition", "kafka_offset")) -> DataFrame:
    """Merge on read: the snapshot under decoded deltas, whose rows are JSON (``key_json``, ``after_json``).

    Deltas delivered again are dropped (the newest ingestion stays), then the last change of each key overrides the
    snapshot. Keys are compared as text, as JSON gives them.
    """
    once = latest_changes(deltas, [event_id], [ingested])
    keyed = once.select("*", *[F.get_json_object("key_json", f"$.{k}").alias(f"k_{k}") for k in keys])
    last = latest_changes(keyed, [f"k_{k}" for k in keys], list(order))
    names = last.select(*[f"k_{k}" for k in keys])
    same = reduce(lambda a, b: a & b, [base[k].cast("string") == names[f"k_{k}"] for k in keys])
    kept = base.join(names, same, "left_anti")
    return kept.unionByName(last.filter("op <> 'd'").select(restored("after_json", base.schema).alias("row")).select("row.*"))


def topic_of_source(prefix: str, topic: str = "topic") -> Column:
    """Whether a decoded change came by the topic named after its source: ``prefix``, schema and table."""
    return F.col(topic) == F.concat_ws(".", F.lit(prefix), "source_schema", "source_table")


def load_plan(snapshots: dict[str, str], reconciled: dict[str, str]) -> dict[str, str]:
    """The folder to load each table from: the reconciled one where there is one, else the snapshot. Unknown tables are an error."""
    if unknown := sorted(set(reconciled) - set(snapshots)):
        raise ValueError(f"reconciled without a snapshot: {unknown}")
    return {name: reconciled.get(name, place) for name, place in sorted(snapshots.items())}

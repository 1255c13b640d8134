"""Writing so that a repeated or broken run leaves no doubt. Folders lie in storage that all executors share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .offsets import write_json

#: Rows in a file and bytes in a row group.
FILE_ROWS, BLOCK_BYTES = 250_000, 64 * 1024 * 1024


def write_by_day(frame: DataFrame, folder: str, day: str = "event_date", rows_a_task: int = 4 * FILE_ROWS) -> None:
    """Parquet by day, rows of a day together first so that each day has few files; a day has as many tasks as its rows need."""
    # one row a day
    parts = frame.groupBy(F.col(day).alias("of_day")).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_a_task)).cast("int").alias("day_parts"))
    spread = frame.join(F.broadcast(parts), F.col(day).eqNullSafe(F.col("of_day"))).withColumn("day_part", F.pmod(F.xxhash64(*frame.columns), F.col("day_parts")))
    spread.repartition(day, "day_part").select(*frame.columns).write.mode("overwrite").partitionBy(day).parquet(folder)


def write_plain(frame: DataFrame, folder: str, order: list[str] | None = None) -> None:
    """Snappy files of at most FILE_ROWS rows, sorted within if an order is given."""
    sorted_frame = frame.sortWithinPartitions(*order) if order else frame
    sorted_frame.write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", FILE_ROWS).option("parquet.block.size", BLOCK_BYTES).parquet(folder)


def replace_days(frame: DataFrame, folder: str, day: str) -> None:
    """Writes the days that ``frame`` has in place of the same days of the table; its other days stay."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(folder)


def replace_checked(spark: SparkSession, frame: DataFrame, folder: str, required: list[str], key: list[str]) -> int:
    """Stages a table, checks it, and only then puts it in place of the old one; returns its rows.

    Fails, with the old table untouched, on a null in a required column or a repeated key. The old table is kept aside until
    the new one has its name.
    """
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    staged, old, target = (files.Path(p) for p in (f"{folder}.staged", f"{folder}.old", folder))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    frame.write.mode("overwrite").parquet(staged.toString())
    written = spark.read.parquet(staged.toString())
    missing = F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required], F.lit(False)))
    found = written.agg(F.count(F.lit(1)).alias("rows"), missing.alias("missing")).first()
    repeated = written.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if found["missing"] or repeated:
        fs.delete(staged, True)
        raise ValueError(f"not replaced: {found['missing']} rows lack a required value, repeated keys: {bool(repeated)}")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(staged, target):
        fs.rename(old, target)
        raise OSError(f"{folder} could not be put in place")
    fs.delete(old, True)
    return found["rows"]


def append_once(spark: SparkSession, frame: DataFrame, folder: str, batch: str, event_id: str) -> int:
    """Adds a named batch to a table, at most once; returns its rows. Fails if ids repeat within it.

    The name comes from the batch's offsets, so a run again writes the same folder again and adds nothing.
    """
    place = f"{folder}/batch={batch}"
    frame.write.mode("overwrite").parquet(place)
    found = spark.read.parquet(place).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(event_id).alias("ids")).first()
    if found["rows"] != found["ids"]:
        raise ValueError(f"batch {batch}: {found['rows']} rows have {found['ids']} ids")
    return found["rows"]


def upserted(base: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """The base with the updates' rows in place of those of the same key. Keys are unique in the updates."""
    return base.join(updates.select(*key), key, "left_anti").select(*base.columns).unionByName(updates.select(*base.columns))


def inserted(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The base with those rows whose key it lacks; of rows with one key the least stays."""
    new = rows.groupBy(*key).agg(F.min(F.struct(*rows.columns)).alias("row")).select("row.*").join(base.select(*key), key, "left_anti")
    return base.unionByName(new.select(*base.columns))


def updated_from(base: DataFrame, source: DataFrame, key: list[str], columns: dict[str, str]) -> DataFrame:
    """The base with columns set from the source's row of the same key, where there is one and its value isn't null."""
    renamed = source.select(*key, *[F.col(s).alias(f"new_{t}") for t, s in columns.items()])
    set_to: dict[str, Column] = {t: F.coalesce(f"new_{t}", t) for t in columns}
    return base.join(renamed, key, "left").select(*[set_to.get(c, F.col(c)).alias(c) for c in base.columns])


def unpublished(outbox: DataFrame, published: DataFrame, event_id: str, order: str) -> DataFrame:
    """The outbox's rows that weren't published yet, oldest first."""
    return outbox.join(published.select(event_id), event_id, "left_anti").orderBy(order, event_id)


def write_text_parts(frame: DataFrame, folder: str, group: str, groups_a_part: int, rows_a_file: int = FILE_ROWS) -> list[str]:
    """CSV in folders of ``groups_a_part`` groups each, in order of the group; returns the folders in that order.

    Groups are numbered without one task that sorts them all; a part is written by as many tasks as Spark gives it, each with
    files of bounded rows, so memory doesn't grow with a part. The list is also left beside the parts as ``manifest.json``.
    """
    places = ranked(frame.select(group).distinct(), group).select(F.col(group).alias("part_group"), F.floor((F.col("rank") - 1) / groups_a_part).cast("int").alias("part"))
    parted = frame.join(places, F.col(group).eqNullSafe(F.col("part_group")), "left").drop("part_group")
    parted.sortWithinPartitions("part", group).write.mode("overwrite").option("header", "true").option("escape", '"').option("maxRecordsPerFile", rows_a_file).partitionBy("part").csv(folder)
    count = places.agg(F.max("part").alias("last")).first()["last"]
    parts = [f"part={i}" for i in range(-1 if count is None else count + 1)]
    write_json(f"{folder}.manifest.json", parts)
    return parts

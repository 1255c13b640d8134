"""Offsets of partitioned topics: ranges, fair caps, names of micro-batches. ``{topic: {"0": offset}}``, ends exclusive."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import file_system

Offsets = dict[str, dict[str, int]]


def check_shape(offsets: object) -> Offsets:
    """The offsets, if they have the shape: topics with numbered partitions and offsets not below 0."""
    if not isinstance(offsets, dict) or not offsets:
        raise ValueError("offsets must name at least one topic")
    for topic, partitions in offsets.items():
        if not isinstance(partitions, dict) or not partitions:
            raise ValueError(f"{topic}: no partitions")
        for partition, offset in partitions.items():
            if not str(partition).isdigit() or isinstance(offset, bool) or not isinstance(offset, int) or offset < 0:
                raise ValueError(f"{topic}: bad partition or offset {partition}: {offset}")
    return offsets


def records_between(start: Offsets, end: Offsets) -> int:
    """How many records a range holds; raises where topics or partitions differ or an end lies before its start."""
    shape = lambda offsets: {(t, p) for t, partitions in check_shape(offsets).items() for p in partitions}
    if shape(start) != shape(end):
        raise ValueError(f"partitions differ: {sorted(shape(start) ^ shape(end))}")
    sizes = {(t, p): end[t][p] - start[t][p] for t, p in shape(start)}
    if back := sorted(k for k, n in sizes.items() if n < 0):
        raise ValueError(f"offsets go backwards: {back}")
    return sum(sizes.values())


def with_new_partitions(start: Offsets, low: Offsets) -> Offsets:
    """Offsets with the topics and partitions that aren't in them yet, from their lowest offset on."""
    return {t: {p: start.get(t, {}).get(p, low[t][p]) for p in low[t]} for t in low} | {t: p for t, p in start.items() if t not in low}


def gaps(start: Offsets, low: Offsets) -> list[tuple[str, str]]:
    """Partitions whose records from ``start`` on are no longer all there: stop, don't skip."""
    return sorted((t, p) for t, partitions in start.items() for p, offset in partitions.items() if low.get(t, {}).get(p, 0) > offset)


def fair_end(start: Offsets, high: Offsets, most: int) -> Offsets:
    """The end of a batch of at most ``most`` records in which no busy partition starves another.

    Every partition gets its backlog up to one common level, the highest at which all fit; what is left goes one each to the
    first partitions (by topic and number) that have more.
    """
    if most <= 0:
        raise ValueError("a batch holds at least one record")
    records_between(start, high)
    backlog = {(t, p): high[t][p] - start[t][p] for t in sorted(start) for p in sorted(start[t], key=int)}
    level, rest, waiting = 0, most, sorted(backlog.values())
    while waiting and rest >= (waiting[0] - level) * len(waiting):
        rest -= (waiting[0] - level) * len(waiting)
        level = waiting[0]
        waiting = [b for b in waiting if b > level]
    if waiting:
        level, rest = level + rest // len(waiting), rest % len(waiting)
    end = {t: dict(partitions) for t, partitions in start.items()}
    for (t, p), own in backlog.items():
        extra = int(own > level and rest > 0)
        rest -= extra
        end[t][p] += min(own, level) + extra
    return end


def batch_name(start: Offsets, end: Offsets) -> str:
    """The same name for the same range: the first 20 digits of its hash."""
    records_between(start, end)
    text = json.dumps({"start": start, "end": end}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:20]


def bounded(records: DataFrame, start: Offsets, end: Offsets, topic: str = "kafka_topic", partition: str = "kafka_partition", offset: str = "kafka_offset") -> DataFrame:
    """The records of a range. Bounds become one filter, which reaches the scan."""
    records_between(start, end)
    within = F.lit(False)
    for t, partitions in start.items():
        for p, first in partitions.items():
            within = within | ((F.col(topic) == t) & (F.col(partition) == int(p)) & (F.col(offset) >= first) & (F.col(offset) < end[t][p]))
    return records.filter(within)


def write_json(path: str | Path, content: object) -> None:
    """A file that is there as a whole or not at all: written beside it, then put in its place. It may lie on any storage
    that the session's Hadoop file systems reach, so a driver that starts elsewhere finds it."""
    spark = SparkSession.active()
    fs, place = file_system(spark, str(path))
    beside = place.suffix(".tmp")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(content, sort_keys=True, indent=2).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(place), options)


def read_json(path: str | Path) -> object:
    """What write_json() wrote."""
    fs, place = file_system(SparkSession.active(), str(path))
    source = fs.open(place)
    try:
        return json.loads(bytes(source.readAllBytes()).decode())
    finally:
        source.close()


def read_manifest(path: str | Path) -> Offsets:
    """Offsets from a file, checked."""
    return check_shape(read_json(path))

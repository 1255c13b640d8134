"""Queries of the problems on text, each over all documents and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .cutting import split
from .leakage import leaks
from .packing import pack
from .sql import ORACLES as ORACLES
from .tokens import size


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of size 1,024 of each document, or of each piece of a larger one."""
    return pack(table(spark, folder, "documents"))


def p7_placements(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with its size as placed, in how many containers it lies, and whether it is whole where it can be."""
    placed = pack(table(spark, folder, "documents")).groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts"), F.count_distinct("container_id").alias("containers"))
    return placed.select("doc_id", "size", "parts", (F.col("containers") == F.col("parts")).alias("in_containers_of_their_own"))


def p7_containers_against_volume(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the tokens packed, the greatest fill of a container, and whether there are at most 1 % (and one) more than their volume needs."""
    fills = pack(table(spark, folder, "documents")).groupBy("container_id").agg(F.sum("size").alias("fill"))
    whole = fills.agg(F.sum("fill").alias("tokens"), (F.max("fill") <= 1024).alias("none_too_full"), F.count(F.lit(1)).alias("n"))
    return whole.select("tokens", "none_too_full", (F.col("n") <= F.ceil(F.col("tokens") / 1024) * 1.01 + 1).alias("few_containers"))


def p7_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """The size of each document that has a text."""
    return table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", size("text").alias("size"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with the evaluation items it holds."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p8_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each evaluation item with the number of documents that hold it."""
    found = p8_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    items = table(spark, folder, "eval_item").select("item_id", "suite")
    return items.join(found, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text is cut."""
    return split(table(spark, folder, "documents")).filter("piece_no = 1").select("doc_id")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every document with a size over 256."""
    return split(table(spark, folder, "documents"))


def p9_covered(spark: SparkSession, folder: str) -> DataFrame:
    """Each document that is cut: the tokens its pieces cover with overlaps counted once, and whether sizes, order and texts of pieces are right."""
    pieces = split(table(spark, folder, "documents"))
    right = (F.col("piece_size") <= 256) & (size("piece_text") == F.col("piece_size")) & (F.length("piece_text") == F.col("end_char") - F.col("first_char"))
    whole = pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("piece_size").alias("tokens"), F.max("piece_no").alias("last"), F.min(right).alias("right"))
    return whole.select("doc_id", (F.col("tokens") - 32 * (F.col("n") - 1)).alias("tokens"), (F.col("right") & (F.col("last") == F.col("n"))).alias("pieces_right"))


QUERIES = {f.__name__: f for f in (p7_containers, p7_placements, p7_containers_against_volume, p7_sizes, p8_found, p8_leaked_items, p9_found, p9_pieces, p9_covered)}

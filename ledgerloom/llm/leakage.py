"""Evaluation texts inside training documents: size-partitioned MinHash containment search, verified by exact shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import ROWS_A_TASK, spread_join
from ..session import cut
from .tokens import words

#: Consecutive words of an item that make a leak; shorter items must be there as a whole.
PASSAGE = 12
SHINGLE = 5
#: MinHash functions of a signature.
FUNCTIONS = 4
#: Bytes of passages, their shingles and their items' ids that are broadcast to the candidates. More are joined by shuffle.
BROADCAST_BYTES = 32_000_000
#: Words of 64 bits in a sieve of signatures, from 2 KB to 64 MB; at 16 bits a key and two tests about one in 70 others passes.
SIEVE_WORDS = (2**8, 2**23)
#: Bytes of text whose words a task holds at once.
BYTES_AT_ONCE = 4_000_000
# odd multipliers of a shingle's words
_STEPS = np.array([0x9E3779B97F4A7C15 * (2 * j + 1) % 2**64 | 1 for j in range(SHINGLE)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _word_hashes(flat: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(flat, dtype=object), categorize=False) if flat else np.empty(0, dtype=np.uint64)


def _shingle_hashes(hashed: np.ndarray, q: int) -> np.ndarray:
    n = len(hashed) - q + 1
    total = np.zeros(max(0, n), dtype=np.uint64)
    for j in range(q if n > 0 else 0):
        total += hashed[j : j + n] * _STEPS[j]
    return _mixed(total)


def first_minima(hashed: np.ndarray, classes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(class, MinHash of each window's shingles by the first function, hashes of the shingles) for each size class.

    A class is a number of words; a window's shingles have SHINGLE words, or all of a shorter one. The minima of a class
    are made from those of the class before.
    """
    each = least = np.empty(0, dtype=np.uint64)
    of = reach = 0
    for size in sorted(classes):
        q = min(SHINGLE, size)
        if q != of:
            of, reach = q, 1
            least = each = _shingle_hashes(hashed, q)
        span = size - q + 1
        while reach < span:
            least = np.minimum(least[:-1], each[reach : reach + max(0, len(least) - 1)]) if len(least) else least
            reach += 1
        yield size, least, each


def signatures(each: np.ndarray, least: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The MinHashes of all FUNCTIONS of the windows that begin ``at``, as one number each; the first is known."""
    span = size - min(SHINGLE, size) + 1
    found = least[at].copy()
    if len(at):
        own = each[at[:, None] + np.arange(span)[None, :]]
        for k in range(1, FUNCTIONS):
            found = _mixed(found * _STEPS[0] + _mixed(own ^ np.uint64(0xD1B54A32D192ED03 * k % 2**64)).min(axis=1))
    return _mixed(found + np.uint64(size))


def _passages(items: DataFrame, passage: int) -> DataFrame:
    """(size_class, first_hash, signature, passage, item_id) of every passage of every item: its query of the search."""
    kind = dict(items.dtypes)["item_id"]

    def read(batches):
        for batch in batches:
            columns = ([], [], [], [], [])
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = words(text or "")
                if own:
                    size = min(passage, len(own))
                    ((_, least, each),) = first_minima(_word_hashes(own), [size])
                    signed = signatures(each, least, np.arange(len(least)), size)
                    for into, values in zip(columns, ([size] * len(least), least.view(np.int64), signed.view(np.int64), [" ".join(own[i : i + size]) for i in range(len(least))], [row] * len(least))):
                        into.extend(values)
            made = [pa.array(c, type=t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*made[:4], batch.column(0).take(made[4])], ["size_class", "first_hash", "signature", "passage", "item_id"])

    return items.mapInArrow(read, f"size_class int, first_hash long, signature long, passage string, item_id {kind}")


def _sieve(keys: DataFrame, key: str, number: int) -> np.ndarray:
    """Bits of the keys, at most SIEVE_WORDS[1] words: whether a number may be one of them. They are set on the executors."""
    size = SIEVE_WORDS[0]
    while size < min(SIEVE_WORDS[1], number // 4):
        size *= 2
    places = F.array(*[F.pmod(F.shiftrightunsigned(key, by), F.lit(size * 64)) for by in (0, 24)])
    bits = keys.select(F.explode(places).alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("bits"))
    read = bits.toArrow()
    sieve = np.zeros(size, dtype=np.uint64)
    sieve[read.column("word").to_numpy()] = read.column("bits").to_numpy().view(np.uint64)
    return sieve


def _passes(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = lambda place: (sieve[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
    last = np.uint64(len(sieve) * 64 - 1)
    return (bit(keys & last) & bit((keys >> np.uint64(24)) & last)).astype(bool)


def windows_like(texts: list[str | None], classes: list[int], first: np.ndarray, signed: np.ndarray) -> Iterator[tuple[int, int, int, str]]:
    """(position of the text, size class, signature, words) of each window whose MinHashes pass the sieves, once a text."""
    flat: list[str] = []
    ends = []
    for text in texts:
        if text:
            flat += words(text)
        ends.append(len(flat))
    of = np.repeat(np.arange(len(texts)), np.diff([0, *ends]))
    for size, least, each in first_minima(_word_hashes(flat), classes):
        at = np.flatnonzero(_passes(first, least))
        at = at[of[at] == of[at + size - 1]]
        found = signatures(each, least, at, size)
        kept = _passes(signed, found)
        seen = set()
        for i, s in zip(at[kept].tolist(), found[kept].view(np.int64).tolist()):
            window = (int(of[i]), s, " ".join(flat[i : i + size]))
            if window not in seen:
                seen.add(window)
                yield window[0], size, s, window[2]


def shingles(text: Column, most: int = SHINGLE) -> Column:
    """The set of word shingles of plain words joined by spaces: of ``most`` words, or all of a shorter text."""
    split = F.split(text, " ")
    q = F.least(F.size(split), F.lit(most))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(split) - q + 1), lambda i: F.array_join(F.slice(split, i, q), " ")))


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", passage: int = PASSAGE, broadcast_bytes: int = BROADCAST_BYTES, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """(doc id, item id): each document with each item of which it holds ``passage`` consecutive words, or all of a shorter one.

    Case, punctuation, spacing, invisible characters and compatibility forms make no difference. Whole texts are searched,
    each once, whatever the number of items; no text is shuffled.

    The queries are the items' passages, in size classes: an item's own length under ``passage`` words, else ``passage``.
    For each class, the windows of that size in the documents are searched for the MinHash signature of a query's word
    shingles: a window that contains them all has the same set, hence the same signature, so none is missed. Two sieves of
    bounded size (the first MinHash, then all FUNCTIONS) tell most other windows on the spot; what passes is joined with
    the passages by class and signature (a broadcast up to ``broadcast_bytes``, which are added up first, else a shuffle in
    which a hot passage is spread over tasks), kept if it contains all shingles of the passage, and then only if it has the
    same words in order.
    Null and empty texts hold nothing, and items without a word are found nowhere; rows with a null id give none; repeated
    rows give one; empty tables give no rows.
    """
    spark = documents.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).dropna()
    read = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text <> ''")
    kind = dict(read.dtypes)["doc_id"]
    # one row a passage with the items that hold it, then one row a signature; passages of one signature have the same shingles
    held = _passages(asked, passage).groupBy("size_class", "first_hash", "signature", "passage").agg(F.collect_set("item_id").alias("items"))
    queries = cut(held.groupBy("size_class", "first_hash", "signature").agg(F.collect_list(F.struct("passage", shingles(F.col("passage")).alias("shingles"), "items")).alias("passages")))
    weight = F.expr("aggregate(passages, 0L, (sum, p) -> sum + 100 + 5L * octet_length(p.passage) + 16L * size(p.items))")
    classes = {r["size_class"]: (r["n"], r["bytes"]) for r in queries.groupBy("size_class").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("bytes")).collect()}  # at most ``passage`` rows
    number = sum(n for n, _ in classes.values())
    shared = spark.sparkContext.broadcast((sorted(classes), _sieve(queries, "first_hash", number), _sieve(queries, "signature", number)))

    def search(batches):
        for batch in (part for whole in batches for part in _by_size(whole, BYTES_AT_ONCE)):
            found = list(windows_like(batch.column(1).to_pylist(), *shared.value)) if shared.value[0] else []
            columns = [pa.array(list(c), type=t) for c, t in zip(zip(*found) if found else ([], [], [], []), (pa.int64(), pa.int32(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], ["doc_id", "size_class", "signature", "window"])

    windows = read.mapInArrow(search, f"doc_id {kind}, size_class int, signature long, window string")
    on = ["size_class", "signature"]
    if sum(n for _, n in classes.values()) <= broadcast_bytes:
        candidates = windows.join(F.broadcast(queries.drop("first_hash")), on)
    else:
        windows = cut(windows)
        met = windows.groupBy(*on).agg(F.count(F.lit(1)).alias("windows"))
        candidates = spread_join(windows, queries.drop("first_hash").join(met, on), on, "windows", rows_a_task=rows_a_task)
    each = candidates.select("doc_id", "window", F.explode("passages").alias("query"))
    contained = each.filter(F.size(F.array_except("query.shingles", shingles(F.col("window")))) == 0)
    leaked = contained.filter(F.col("window") == F.col("query.passage"))
    return leaked.select(F.col("doc_id").alias(doc_id), F.explode("query.items").alias(item_id)).distinct()


def _by_size(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of text, or of one longer text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        before = sizes[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(first, end - first)
        first = end

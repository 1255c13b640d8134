"""Documents into containers of fixed capacity, with certified bounds and exchange between partitions."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tokens import size

#: Most items a task packs at once after an exchange; about 50 bytes each.
ITEMS_A_PARTITION = 200_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The container of each item, and their number: largest items first, each where it leaves the least space.

    Ties go to the earlier item and the container opened last with that space. Sizes lie between 0 and the capacity.
    """
    container = np.empty(len(sizes), dtype=np.int64)
    with_space: dict[int, list[int]] = {}
    spaces, opened = 0, 0  # spaces: bit r is set if some container has r left
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fitting = spaces >> s
        if fitting:
            space = s + (fitting & -fitting).bit_length() - 1
            own = with_space[space]
            chosen = own.pop()
            if not own:
                spaces ^= 1 << space
        else:
            space, chosen = capacity, opened
            opened += 1
        container[i] = chosen
        left = space - s
        with_space.setdefault(left, []).append(chosen)
        spaces |= 1 << left
    return container, opened


def least_containers(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound on the containers of any packing, by two families of dual-feasible functions.

    For each threshold e up to half the capacity: items beyond capacity - e count as a whole container, items under e as
    nothing, the others as they are. For k to 20: an item counts floor((k+1)x)/k of a container, or x where that is whole.
    """
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    number, volume = np.cumsum(counts), np.cumsum(counts * x)
    e = np.arange(1, capacity // 2 + 1)
    whole = number[-1] - number[capacity - e]
    middle = volume[capacity - e] - volume[e - 1]
    totals = [-(-int(volume[-1]) // capacity), 1]
    if len(e):
        totals.append(int(np.max(-(-(whole * capacity + middle) // capacity))))
    for k in range(1, 21):
        worth = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)
        totals.append(-(-int((counts * worth).sum()) // (k * capacity)))
    return max(totals)


def _pack_partition(capacity: int, turn: int):
    def pack(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        sizes = table.column("size").to_numpy()
        container, opened = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(container, weights=sizes, minlength=opened).astype(np.int64)
        loosest = int(np.argmin(fill))
        n = table.num_rows
        base = (turn << 52) | (TaskContext.get().partitionId() << 30)
        made = {
            "container_id": pa.array(base | container),
            "fill": pa.array(fill[container]),
            "certified": pa.array(np.full(n, opened == least_containers(sizes, capacity))),
            "loosest": pa.array(container == loosest),
        }
        yield from pa.table({c: table.column(c) for c in ("item_id", "piece_no", "size")} | made).to_batches(max_chunksize=50_000)

    return pack


def pack(documents: DataFrame, item_id: str = "doc_id", text: str = "text", capacity: int = 1024, items_a_partition: int = ITEMS_A_PARTITION, rounds: int | None = None) -> DataFrame:
    """(item id, piece_no, size, container_id): every text whole in one container of ``capacity`` tokens.

    A text over the capacity fills containers of its own and only its last piece, numbered last, is packed. Each partition
    packs its items by best-fit decreasing, without a shuffle, and a dual-feasible-function bound certifies its number of
    containers. What leaves a gap is exchanged: the documents of containers that aren't full in partitions without
    certificate, and those of the loosest container of each other; they are mixed into partitions of about
    ``items_a_partition`` and packed again, as long as each round needs fewer containers than the one before (one that
    doesn't isn't taken and is the last) and no more than their volume needs; ``rounds`` may end it sooner. Each round is
    written to the shared folder.
    Empty texts have size 0 and a container like others; null texts give no row; repeated rows are items of their own.
    """
    sized = documents.select(F.col(item_id).alias("item_id"), size(text).alias("total")).filter("total IS NOT NULL")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("total") / capacity)).cast("long")
    # written once: sizes aren't counted again, and row numbers hold on a second reading
    numbered = cut(sized.select("item_id", pieces.alias("pieces"), (F.col("total") - (pieces - 1) * capacity).alias("size")))
    numbered = numbered.withColumn("row_no", F.monotonically_increasing_id())
    whole = numbered.filter("pieces > 1").select("item_id", "row_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pieces") - 1)).alias("piece_no"))
    pending = numbered.select("item_id", F.col("pieces").alias("piece_no"), "size")
    kind = dict(pending.dtypes)["item_id"]
    schema = f"item_id {kind}, piece_no long, size long, container_id long, fill long, certified boolean, loosest boolean"
    done = []
    before = None
    for turn in count():
        placed = cut(pending.mapInArrow(_pack_partition(capacity, turn), schema))
        if before is not None and before["containers"] <= placed.agg(F.count_distinct("container_id")).first()[0]:
            placed = before["placed"]
            break
        move = F.when(F.col("certified"), F.col("loosest")).otherwise(F.lit(True)) & (F.col("fill") < capacity)
        left = placed.filter(move)
        row = left.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("container_id").alias("containers"), F.sum("size").alias("volume")).first()
        # nothing to gain where the moving documents already lie in as few containers as their volume allows
        if turn + 1 == rounds or not row["n"] or row["containers"] <= -(-row["volume"] // capacity):
            break
        done.append(placed.filter(~move))
        before = {"containers": row["containers"], "placed": left}
        parts = -(-row["n"] // items_a_partition)
        mixed = left.select("item_id", "piece_no", "size", "container_id")
        pending = cut(mixed.repartition(parts, F.xxhash64("item_id", "container_id", "size")).select("item_id", "piece_no", "size"))
    for part in done:
        placed = placed.unionByName(part)
    packed = placed.select(F.col("item_id").alias(item_id), "piece_no", "size", F.format_string("p%x", "container_id").alias("container_id"))
    full = whole.select(F.col("item_id").alias(item_id), "piece_no", F.lit(capacity).cast("long").alias("size"), F.concat(F.lit("w"), F.col("item_id").cast("string"), F.lit("-"), F.col("row_no").cast("string"), F.lit("-"), F.col("piece_no").cast("string")).alias("container_id"))
    return packed.unionByName(full)

"""Attributes as known at event time: persistent search trees over valid time, one version a known time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .running import along

#: Most history rows in one forest, hence in a broadcast, a shard or a stretch: about 18 levels of 12 bytes a row, 55 MB.
FOREST_ROWS = 250_000
#: Most events a task takes at once where shards are paired with events.
EVENTS_A_GROUP = 500_000


class Forest:
    """A path-copied search tree over (entity, valid time, known time, id), with a root for each known time.

    The tree's shape is that of the balanced tree over all keys; inserting an observation copies the path from the root
    to its leaf, and every older root stays valid. Level by level, all copies are made at once: insertion i makes node i of
    each level; a child of it is the last copy made on that side before.
    """

    def __init__(self, entity: pa.Array, valid: np.ndarray, known: np.ndarray, ids: pa.Array):
        self.names, codes = _coded(entity)
        n = len(codes)
        order = np.lexsort((_ranks(ids), known, valid, codes))
        self.codes, self.valid, self.ids = codes[order], valid[order], ids.take(pa.array(order))
        position = np.empty(n, dtype=np.int64)
        position[order] = np.arange(n)
        arrival = np.argsort(known, kind="stable")
        self.known, leaf_of = known[arrival], position[arrival]
        self.height = max(1, int(np.ceil(np.log2(max(2, n)))))
        self.left, self.right, self.count = [], [], []
        for level in range(self.height + 1):
            node = leaf_of >> (self.height - level)
            by_node = np.argsort(node, kind="stable")
            sorted_node = node[by_node]
            k = np.arange(n)
            start = np.maximum.accumulate(np.where(np.r_[True, sorted_node[1:] != sorted_node[:-1]], k, 0)) if n else k
            count = np.zeros(n + 1, dtype=np.int32)
            count[by_node] = k - start + 1
            self.count.append(count)
            if level < self.height:
                bit = (leaf_of >> (self.height - level - 1))[by_node] & 1
                for side, into in ((0, self.left), (1, self.right)):
                    last = np.maximum.accumulate(np.where(bit == side, k, -1)) if n else k
                    child = np.full(n + 1, -1, dtype=np.int32)
                    child[by_node] = np.where(last >= start, by_node[last], -1)
                    into.append(child)
        self.times = np.unique(self.valid)
        self.keys = self.codes * (len(self.times) + 1) + np.searchsorted(self.times, self.valid)
        self.first = np.searchsorted(self.codes, np.arange(len(self.names)))

    @classmethod
    def of(cls, state: dict) -> Forest:
        """A forest of the state that vars() gives."""
        forest = cls.__new__(cls)
        vars(forest).update(state)
        return forest

    def lookup(self, entity: pa.Array, moment: np.ndarray) -> np.ndarray:
        """Positions in ``ids``: of the keys known at the moment, the greatest of the entity not after it; -1 for none."""
        if not len(self.codes):
            return np.full(len(moment), -1, dtype=np.int64)
        code = pc.fill_null(pc.index_in(entity, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        root = np.searchsorted(self.known, moment, side="right") - 1
        before = np.searchsorted(self.times, moment, side="right") - 1
        limit = np.searchsorted(self.keys, code * (len(self.times) + 1) + before, side="right") - 1
        rows = np.flatnonzero((code >= 0) & (root >= 0) & (before >= 0) & (limit >= 0))
        node, limit = root[rows], limit[rows]
        rank = np.zeros(len(rows), dtype=np.int64)
        for level in range(self.height):
            right = (limit >> (self.height - level - 1)) & 1
            left = self.left[level][node]
            rank += np.where(right == 1, self.count[level + 1][left], 0)
            node = np.where(right == 1, self.right[level][node], left)
        rank += self.count[self.height][node]
        node, rank, rows = root[rows][rank > 0], rank[rank > 0], rows[rank > 0]
        leaf = np.zeros(len(rows), dtype=np.int64)
        for level in range(self.height):
            left = self.left[level][node]
            there = self.count[level + 1][left]
            right = rank > there
            rank = np.where(right, rank - there, rank)
            node = np.where(right, self.right[level][node], left)
            leaf = leaf * 2 + right
        found = np.full(len(moment), -1, dtype=np.int64)
        own = leaf >= self.first[code[rows]]
        found[rows[own]] = leaf[own]
        return found


def _coded(entity: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = entity.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _ranks(ids: pa.Array) -> np.ndarray:
    return pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False) if len(ids) else np.empty(0, dtype=np.int64)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _forest(history: pa.Table) -> Forest:
    return Forest(_column(history, "entity"), _column(history, "valid").to_numpy(), _column(history, "known").to_numpy(), _column(history, "observation"))


def _matched(forest: Forest, events: pa.RecordBatch | pa.Table) -> pa.Table:
    events = pa.table(events) if isinstance(events, pa.RecordBatch) else events
    found = forest.lookup(_column(events, "entity"), _column(events, "moment").to_numpy())
    rows = np.flatnonzero(found >= 0)
    return pa.table({"event": _column(events, "event").take(pa.array(rows)), "observation": forest.ids.take(pa.array(found[rows]))})


def _split(asked: DataFrame, told: DataFrame, shards: int, forest_rows: int) -> tuple[DataFrame, DataFrame]:
    """Events and observations with ``shard`` and ``stretch``, in which an event finds all observations it may need.

    An entity with more than ``forest_rows`` observations is cut into stretches of the time from which they can be used,
    the later of valid and known time. Of those usable from the same moment only the greatest can ever be found. An event
    needs the stretch of its moment and, from all before, the greatest observation, which is carried into the stretch.
    """
    shard = F.pmod(F.xxhash64("entity"), F.lit(shards)).cast("long")
    # at most one row for each forest_rows observations
    hot = cut(told.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > forest_rows).select("entity"))
    if not hot.count():
        flat = lambda rows: rows.withColumns({"shard": shard, "stretch": F.lit(0).cast("long")})
        return flat(asked), flat(told)
    own = F.xxhash64("entity")
    greatest = F.max(F.struct("valid", "known", "observation")).alias("best")
    best = told.join(F.broadcast(hot), "entity").groupBy("entity", F.greatest("valid", "known").alias("since")).agg(greatest)
    line = cut(along(best, ["entity"], ["since"], {"place": F.lit(1).cast("long")}).withColumn("stretch", F.floor((F.col("place") - 1) / forest_rows) + 1))
    tops = line.groupBy("entity", "stretch").agg(F.max("best").alias("best"), F.min("since").alias("begins"))
    so_far = Window.partitionBy("entity").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)
    carried = tops.select("entity", F.max("best").over(so_far).alias("best"), (F.col("stretch") + 1).alias("stretch"))
    flat = told.columns
    stretched = line.select("entity", "best", "stretch").unionByName(carried).select("entity", "best.*", "stretch")
    cold = told.join(F.broadcast(hot), "entity", "left_anti").select(*flat, shard.alias("shard"), F.lit(0).cast("long").alias("stretch"))
    sharded = cold.unionByName(stretched.select(*flat, own.alias("shard"), "stretch"))
    # the moments at which stretches begin: as many as there are stretches
    begins = tops.groupBy("entity").agg(F.sort_array(F.collect_list("begins")).alias("begins"))
    of = F.col("moment")
    placed = asked.join(F.broadcast(begins), "entity", "left").withColumn("stretch", F.when(F.col("begins").isNull(), 0).otherwise(F.size(F.filter("begins", lambda b: b <= of))).cast("long"))
    return placed.withColumn("shard", F.when(F.col("begins").isNull(), shard).otherwise(own)).drop("begins"), sharded


def known_at(events: DataFrame, history: DataFrame, event_id: str, entity: str, moment: str, observation_id: str, value: str, valid_time: str, known_time: str, forest_rows: int = FOREST_ROWS, events_a_group: int = EVENTS_A_GROUP) -> DataFrame:
    """Pairs (``event_id``, ``observation_id``): each distinct event with the observation that held, and was known, at its moment.

    Of its entity's observations with valid and known time not after the moment, that with the greatest valid time, then
    known time, then id. Observations with a null value, entity, id or time don't count; events without id, entity, moment
    or such an observation give no row; an event delivered again gives one. Empty tables give no rows.

    A history of at most ``forest_rows`` is broadcast as one forest, and events aren't shuffled for the search. A larger one
    is cut into shards of about that size by entity, and an entity with more than that by the time from which observations
    can be used (see _split); a shard's events are spread over as many groups as they need, each beside a copy of its shard,
    so that a hot entity has many tasks.
    """
    asked = events.select(F.col(event_id).alias("event"), F.col(entity).alias("entity"), F.unix_micros(F.col(moment)).alias("moment")).dropna()
    told = history.filter(F.col(value).isNotNull()).select(F.col(entity).alias("entity"), F.unix_micros(F.col(valid_time)).alias("valid"), F.unix_micros(F.col(known_time)).alias("known"), F.col(observation_id).alias("observation")).dropna()
    schema = f"event {dict(asked.dtypes)['event']}, observation {dict(told.dtypes)['observation']}"
    small = told.limit(forest_rows + 1).toArrow()
    if small.num_rows <= forest_rows:
        shared = events.sparkSession.sparkContext.broadcast(vars(_forest(small)))

        def search(batches):
            forest = Forest.of(shared.value)
            for batch in batches:
                yield from _matched(forest, batch).to_batches()

        pairs = asked.mapInArrow(search, schema)
    else:
        own = ["shard", "stretch"]
        placed, sharded = _split(asked, told, -(-told.count() // forest_rows), forest_rows)
        # as many rows as there are shards and stretches
        loads = placed.groupBy(*own).agg(F.ceil(F.count(F.lit(1)) / F.lit(events_a_group)).cast("int").alias("parts"))
        spread = placed.join(F.broadcast(loads), own).withColumn("part", F.pmod(F.xxhash64("event", "moment"), F.col("parts")).cast("int")).drop("parts")
        copies = sharded.join(F.broadcast(loads), own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            return _matched(_forest(right), left)

        pairs = spread.groupBy(*own, "part").cogroup(copies.groupBy(*own, "part")).applyInArrow(pair, schema)
    return pairs.distinct().select(F.col("event").alias(event_id), F.col("observation").alias(observation_id))

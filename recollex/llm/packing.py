"""Filling containers of fixed capacity with texts by linear grouping.

A text longer than the capacity is cut into full pieces, each a container of its own,
and a rest.  Texts and rests are spread by hash over shards of many containers' worth
each; what a shard wastes is at most a few containers.  Within a shard:

1. lengths above capacity / `LARGE` are sorted and put into groups of equal
   cardinality, each length rounded up to the greatest of its group;
2. the few sizes that remain are packed by configurations: the linear program over
   all configurations is solved by column generation, and each configuration is used
   as many whole times as it says;
3. the actual texts take the places of the rounded sizes, the last of a container being
   the longest left that fits in what the others, shorter than rounded, leave of it;
4. large texts left over by rounding, then the small ones, each go where the least
   room is left.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from recollex.sources.shared import shuffle_width

#: A large item needs more than this part of the capacity.
LARGE = 12
#: Groups of equal cardinality.
GROUPS = 40
#: Capacity in units of the knapsack of column generation.
UNITS = 1024
#: Tokens in a shard, at least; and containers.
SHARD_TOKENS, SHARD_CONTAINERS = 8_000_000, 500


def _best_configuration(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: greatest value of sizes that fit, and how often each is in it."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        fit = np.flatnonzero(sizes <= c)
        if len(fit):
            worth = best[c - sizes[fit]] + values[fit]
            i = int(worth.argmax())
            if worth[i] > best[c] + 1e-12:
                best[c], pick[c] = worth[i], fit[i]
    counts, c = np.zeros(len(sizes), dtype=np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[room]), counts


def configurations(sizes: np.ndarray, demands: np.ndarray, capacity: int, most_rounds: int = 300) -> list[tuple[np.ndarray, float]]:
    """(counts per size, times used) of an optimal fractional packing of `demands`."""
    unit = max(1, capacity // UNITS)
    units, room = -(-sizes // unit), capacity // unit
    units = np.minimum(units, room)
    basis = np.diag(np.maximum(room // units, 1)).astype(float)
    for _ in range(most_rounds):
        inverse = np.linalg.inv(basis)
        times = inverse @ demands
        value, counts = _best_configuration(units, inverse.sum(axis=0), room)
        if value <= 1 + 1e-7:
            break
        entering = inverse @ counts
        rising = entering > 1e-9
        ratios = np.where(rising, times / np.where(rising, entering, 1), np.inf)
        leaving = int(ratios.argmin())
        basis[:, leaving] = counts
    return [(basis[:, j].astype(np.int64), max(0.0, float(times[j]))) for j in range(len(sizes))]


class _Left:
    """Large items by length, longest first, that are in no container yet."""

    def __init__(self, lengths: np.ndarray):
        self.descending = -lengths
        self.next = list(range(len(lengths) + 1))  # the first item from here on that is left, by path halving
        self.gone = bytearray(len(lengths) + 1)

    def _first(self, at: int) -> int:
        while self.gone[at]:
            if self.gone[self.next[at]]:
                self.next[at] = self.next[self.next[at]]
            at = self.next[at]
        return at

    def take(self, low: int, high: int) -> int | None:
        """The longest item left of those from low to high."""
        at = self._first(int(low))
        if at >= high:
            return None
        self._remove(at)
        return at

    def longer(self, taken: int, room: int) -> int:
        """The longest item left that fits in place of a taken one, or that one."""
        at = self._first(int(np.searchsorted(self.descending, -room)))
        if at >= taken:
            return taken
        self._remove(at)
        self.gone[taken], self.next[taken] = 0, taken
        return at

    def _remove(self, at: int) -> None:
        self.gone[at] = 1
        self.next[at] = at + 1

    def rest(self) -> np.ndarray:
        return np.flatnonzero(np.frombuffer(bytes(self.gone[:-1]), np.uint8) == 0)


class _Rooms:
    """Open containers by the room left, which is a whole number up to the capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = 0

    def open(self, left: int) -> int:
        self.count += 1
        self.put(self.count - 1, left)
        return self.count - 1

    def put(self, container: int, left: int) -> None:
        self.by_room[left].append(container)
        self.mask |= 1 << left

    def best_fit(self, size: int) -> int:
        fits = self.mask >> size
        left = self.capacity if not fits else size + (fits & -fits).bit_length() - 1
        if not fits:
            container = self.open(self.capacity)
        container = self.by_room[left].pop()
        if not self.by_room[left]:
            self.mask &= ~(1 << left)
        self.put(container, left - size)
        return container


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; lengths are 1 to the capacity."""
    placed = np.full(len(lengths), -1, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    large = order[lengths[order] * LARGE > capacity]
    rooms, left_over = _Rooms(capacity), []
    if len(large):
        groups = [g for g in np.array_split(large, min(GROUPS, len(large))) if len(g)]
        sizes = np.array([lengths[g[0]] for g in groups])
        starts = np.cumsum([0, *(len(g) for g in groups)])
        left = _Left(lengths[large])
        for counts, times in configurations(sizes, np.array([float(len(g)) for g in groups]), capacity):
            for _ in range(math.floor(times + 1e-9)):
                chosen = [left.take(starts[i], starts[i + 1]) for i, n in enumerate(counts) for _ in range(int(n))]
                chosen = [c for c in chosen if c is not None]
                if len(chosen) > 1:
                    last = max(chosen)  # the shortest
                    chosen.remove(last)
                    chosen.append(left.longer(last, capacity - int(lengths[large[chosen]].sum())))
                if chosen:
                    items = large[chosen]
                    placed[items] = rooms.open(capacity - int(lengths[items].sum()))
        left_over = large[left.rest()]
    for i in [*left_over, *order[len(large) :]]:
        placed[i] = rooms.best_fit(int(lengths[i]))
    return placed


def packed(sized: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, container_id, position, doc_id, piece, n_tokens): where every text lies.

    `sized` is (doc_id, n_tokens), kept, doc_id unique; other columns are ignored.  Texts without
    tokens, by a null or 0, lie nowhere; an empty table fills nothing.  Pieces count
    from 0; a text has more than one only if it exceeds the capacity.  `containers` is the
    small table of kinds (no more than 1,000 rows); kinds without a positive capacity are left out.
    """
    kinds = containers.where("capacity_tokens > 0 and container_kind is not null").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity")).limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("more than 1,000 kinds of containers")
    sized = sized.select("doc_id", "n_tokens")
    whole = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first().n
    result = None
    for kind in kinds:
        shard_tokens = max(SHARD_TOKENS, SHARD_CONTAINERS * kind.capacity)
        made = _packed(sized.where("n_tokens > 0"), kind.container_kind, int(kind.capacity), max(1, math.ceil(whole / shard_tokens)))
        result = made if result is None else result.unionByName(made)
    if result is None:
        return sized.select(F.lit("").alias("container_kind"), F.lit("").alias("container_id"), F.lit(0).alias("position"), "doc_id", F.lit(0).cast("bigint").alias("piece"), "n_tokens").limit(0)
    return result


def _packed(sized: DataFrame, kind: str, capacity: int, shards: int) -> DataFrame:
    full = F.floor(F.col("n_tokens") / capacity)
    name = F.lit(f"{kind}-")
    cut = sized.where(full > 0).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)))
    cut = cut.select(F.concat(name, F.lit("d"), "doc_id", F.lit("-"), "piece").alias("container_id"), F.lit(0).alias("position"), "doc_id", "piece", F.lit(capacity).cast("bigint").alias("n_tokens"))
    rests = sized.select("doc_id", full.alias("piece"), (F.col("n_tokens") - full * capacity).alias("n_tokens")).where("n_tokens > 0")
    rests = rests.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id").reset_index(drop=True)
        made = part[["doc_id", "piece", "n_tokens"]].copy()
        container = pd.Series(pack(part["n_tokens"].to_numpy(), capacity))
        made["container_id"] = f"{kind}-s{part['shard'].iloc[0]}-" + container.astype(str)
        made["position"] = container.groupby(container).cumcount().astype("int32")
        return made[["container_id", "position", "doc_id", "piece", "n_tokens"]]

    # Of a number of their own, so that adaptive execution doesn't put shards, small in bytes but not in work, into one task.
    spread = rests.repartition(max(1, min(shards, 4 * shuffle_width(sized.sparkSession))), "shard")
    kept = spread.groupBy("shard").applyInPandas(fill, "container_id string, position int, doc_id bigint, piece bigint, n_tokens bigint")
    return cut.unionByName(kept).select(F.lit(kind).alias("container_kind"), "container_id", "position", "doc_id", "piece", "n_tokens")


def fill_report(contents: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind its containers, the tokens in them, and the part of their room that is used."""
    used = contents.groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    room = containers.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity"))
    return used.join(room, "container_kind").withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity")))

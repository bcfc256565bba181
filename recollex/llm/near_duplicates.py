"""Near-duplicate records by MinHash banding.

Texts become sets of words; each set gets rows * bands min-wise hashes; sets that
agree on all rows of a band meet in a bucket, and every pair that meets is checked
on the full sets.  A pair of similarity s meets with probability
1 - (1 - s**rows)**bands.

rows grows with the logarithm of the number of sets, so that sets of the
background similarity rarely meet, and bands follows from rows for the target
recall at the threshold.  One lost pair can part a group, so next to none may be lost
of a whole table: the recall grows with the number of sets.  Bands are joined `TOGETHER`
at a time, which bounds what is on disk at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recollex.llm.components import hash_to_min
from recollex.llm.sets import between_ids, class_sets, flat_sets, linked_classes, memberships, similar, words
from recollex.sources.shared import Scratch

#: Similarity that unrelated texts of one domain hardly exceed.
BACKGROUND = 0.12
#: Least chance that a pair at the threshold itself meets.
RECALL = 0.99999
#: Pairs that a table with as many pairs at the threshold as sets loses, as expected.
LOST = 0.01
#: Bands that are joined at a time.
TOGETHER = 40
#: Sets that are hashed together, to stay within a core's cache.
BLOCK = 1024


def whole_recall(sets: int) -> float:
    """The recall by which a table of so many sets loses at most `LOST` pairs, as expected."""
    return max(RECALL, 1 - LOST / max(sets, 1))


def banding(sets: int, threshold: float, recall: float) -> tuple[int, int]:
    """(rows, bands) for so many sets."""
    rows = max(4, round(math.log(max(sets, 2)) / -math.log(BACKGROUND)))
    return rows, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def band_keys(values: np.ndarray, ends: np.ndarray, rows: int, bands: int, seed: int = 7) -> np.ndarray:
    """64-bit keys, one line per set and one column per band; no set is empty."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 2**63, size=(bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    weights = rng.integers(0, 2**63, size=rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 2**63, size=bands, dtype=np.uint64)
    keys = np.empty((len(ends) - 1, bands), dtype=np.uint64)
    for at in range(0, len(ends) - 1, BLOCK):
        to = min(at + BLOCK, len(ends) - 1)
        part, starts = values[ends[at] : ends[to]], ends[at:to] - ends[at]
        for band in range(bands):
            key = np.full(to - at, salt[band], dtype=np.uint64)
            for row in range(rows):
                key += (np.minimum.reduceat(part * odd[band, row], starts) >> np.uint64(8)) * weights[row]
            keys[at:to, band] = key ^ (key >> np.uint64(29))
    return keys


def _banded(rows: int, bands: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(*flat_sets(batch.column(1)), rows, bands, seed)
                classes = np.repeat(batch.column(0).to_numpy(), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(classes)], ["key", "class"])

    return run


def candidates(sets: DataFrame, threshold: float, recall: float | None, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of classes that share a bucket of at least one band.

    The self-join on the bucket is an equi-join without a collected group; adaptive
    execution splits the partition of a bucket that many different sets share.
    """
    count = sets.count()
    rows, bands = banding(count, threshold, whole_recall(count) if recall is None else recall)
    met = None
    for first in range(0, bands, TOGETHER):
        keyed = sets.mapInArrow(_banded(rows, min(TOGETHER, bands - first), 7 + first), "key bigint, class bigint")
        a, b = keyed.withColumnRenamed("class", "a"), keyed.withColumnRenamed("class", "b")
        found = scratch.keep(a.join(b, "key").where("a < b").select("a", "b").distinct())
        met = found if met is None else met.unionByName(found)
    return met.distinct()


def similar_texts(records: DataFrame, scratch: Scratch, threshold: tuple[int, int] = (7, 10), recall: float | None = None, split: Callable = words) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Class pairs (a, b, shared, total) at or above the threshold, (id, class) and (class, tokens).

    `records` is (id, text), an id in any number of rows; a null, blank or wordless
    text forms no case.  `threshold` is a fraction; `recall` is met at the threshold
    itself, more similar pairs come out more often; without it that of `whole_recall` holds.
    """
    sets = class_sets(records, split, scratch)
    pairs = scratch.keep(similar(candidates(sets, threshold[0] / threshold[1], recall, scratch), sets, *threshold))
    return pairs, scratch.keep(memberships(records, split)), sets


def near_duplicates(records: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b, once each: every pair of ids with similar texts, exact copies included.

    `records` is (id, text) in this order, other columns are ignored.  Nulls, blank and wordless
    texts and null ids form no pair, repeated rows count once, an id with several texts pairs by
    any of them.  Texts of any length are compared whole.
    """
    pairs, members, _ = similar_texts(records, scratch, **options)
    return between_ids(pairs, members)


def grouped_texts(records: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """(id, group_id, n_words) of every id with a near-duplicate: group_id is the least id
    reached through links.  Linked are similar classes, and classes of one id."""
    pairs, members, sets = similar_texts(records, scratch, **options)
    shared = members.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("id", "a")
    of_one_id = members.join(shared, "id").select("a", F.col("class").alias("b"))
    groups = hash_to_min(pairs.select("a", "b").unionByName(of_one_id), "a", "b", scratch)
    placed = members.join(groups, members["class"] == groups["vertex"], "left").select("id", "class", F.coalesce("group", "class").alias("group"))
    least = placed.groupBy("group").agg(F.min("id").alias("group_id"), F.max("id").alias("other")).where("group_id <> other").select("group", "group_id")
    counted = sets.select("class", F.size("tokens").alias("n_words"))
    found = placed.join(least, "group").join(counted, "class")
    return found.groupBy("id").agg(F.min("group_id").alias("group_id"), F.max("n_words").alias("n_words"))


def duplicate_classes(records: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """(id, class, copies, links): of every id with words its class of equal word sets,
    the ids in the class, and the other classes that are similar to it."""
    pairs, members, _ = similar_texts(records, scratch, **options)
    return linked_classes(pairs, members)

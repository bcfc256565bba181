"""A cycle of upkeep as operations for the log: merge near-copies, archive stale memories, fold tags, apply verdicts.

The steps see one state and touch different memories: each later step leaves out those
an earlier one archives.  Operations are numbered from `first`, in this order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recollex.functions.text import normalize_tags
from recollex.operators.entries import Filters, candidates
from recollex.operators.ingest import LOG, stale
from recollex.operators.ranking import global_rank
from recollex.operators.review import judged, merge_pass
from recollex.operators.similarity import merge_pairs
from recollex.sources.schema import struct


def _operation(rows: DataFrame, step: int, id: Column, op: str, now: str, **fields: Column) -> DataFrame:
    kinds = {f.name: f.dataType for f in struct(LOG).fields}
    given = {"id": id, "op": F.lit(op), "at": F.lit(now).cast("timestamp_ntz"), "by": F.lit("system")} | fields
    columns = [given.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items() if n != "op_id"]
    return rows.select(F.lit(step).alias("step"), *columns)


def merge_operations(done: DataFrame, entries: DataFrame, now: str) -> DataFrame:
    """Of merges (keep_id, drop_id, importance): the kept memory's importance where it grew, and the archiving of the other."""
    grown = done.groupBy("keep_id").agg(F.max("importance").alias("importance")).join(entries.select(F.col("id").alias("keep_id"), F.col("importance").alias("old")), "keep_id").where("importance > old")
    return _operation(grown, 1, F.col("keep_id"), "update", now, importance=F.col("importance")).unionByName(_operation(done, 2, F.col("drop_id"), "archive", now, other=F.col("keep_id")))


def stale_operations(entries: DataFrame, now: str) -> DataFrame:
    return _operation(stale(entries, now), 3, F.col("id"), "archive", now)


def tag_operations(entries: DataFrame, now: str) -> DataFrame:
    rows = candidates(entries, Filters()).where("tags is not null and not exists(tags, t -> t is null)").where(normalize_tags("tags") != F.col("tags"))
    return _operation(rows, 4, F.col("id"), "update", now, tags=normalize_tags("tags"))


def verdict_operations(verdicts: DataFrame, entries: DataFrame, now: str) -> DataFrame:
    """What verdicts lead to, applied in their order: memories archived, and importances that merges raised."""
    done = judged(verdicts, entries).where("drop_id is not null")
    raised = done.where("importance is not null").groupBy("keep_id").agg(F.max("importance").alias("importance"))
    return _operation(raised, 5, F.col("keep_id"), "update", now, importance=F.col("importance")).unionByName(_operation(done, 6, F.col("drop_id"), "archive", now, other=F.col("keep_id")))


def cycle(entries: DataFrame, now: str, verdicts: DataFrame | None = None, first: int = 1) -> DataFrame:
    """All operations of a cycle, in the order of the steps, each memory archived once."""
    merges = merge_operations(merge_pass(entries, merge_pairs(entries)), entries, now)
    steps = merges.unionByName(stale_operations(entries, now)).unionByName(tag_operations(entries, now))
    if verdicts is not None:
        steps = steps.unionByName(verdict_operations(verdicts, entries, now))
    archived = steps.where("op = 'archive'").groupBy("id").agg(F.min("step").alias("archived_at"))
    kept = steps.join(archived, "id", "left").where("archived_at is null or step < archived_at or (op = 'archive' and step = archived_at)").drop("archived_at")
    placed = global_rank(kept.dropDuplicates(["step", "id", "op"]), "_n", F.col("step").asc(), F.col("id").asc(), F.col("op").asc())
    return placed.select((F.col("_n") + (first - 1)).cast("bigint").alias("op_id"), *[f.name for f in struct(LOG).fields if f.name != "op_id"])

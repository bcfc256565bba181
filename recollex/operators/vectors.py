"""Upkeep of the vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recollex.functions.scoring import usable_vector
from recollex.operators.entries import latest


def current_vectors(rows: DataFrame) -> DataFrame:
    """The vector with the greatest time of each (memory, dim); of equal times the later in array order."""
    return latest(rows, ["memory_id", "dim"], [F.col("embedded_at").desc_nulls_last(), F.col("embedding").desc_nulls_last()])


def missing(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Visible memories without a usable vector."""
    held = vectors.where(usable_vector("embedding", "dim")).select(F.col("memory_id").alias("id"))
    return entries.where("status = 'active' and superseded_by is null").join(held, "id", "left_anti")


def coverage(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: visible memories, those with a usable vector, and their part."""
    held = vectors.where(usable_vector("embedding", "dim")).select(F.col("memory_id").alias("id")).distinct().withColumn("held", F.lit(1))
    rows = entries.where("status = 'active' and superseded_by is null").select("id").join(held, "id", "left")
    return rows.agg(F.count(F.lit(1)).alias("memories"), F.count("held").alias("with_vector"), F.round(F.coalesce(F.try_divide(F.count("held"), F.count(F.lit(1))), F.lit(0.0)), 6).alias("coverage"))


def cleanup(vectors: DataFrame, entries: DataFrame) -> DataFrame:
    """Vectors of visible memories, the others go."""
    return vectors.join(entries.where("status = 'active' and superseded_by is null").select(F.col("id").alias("memory_id")), "memory_id", "left_semi")


def migrate(vectors: DataFrame, entries: DataFrame, dim: int) -> DataFrame:
    """(memory_id, workspace, outcome): whether a legacy row moves to the index of `dim`, with its memory's
    workspace, or why it is skipped."""
    known = entries.select(F.col("id").alias("memory_id"), F.col("workspace").alias("entry_workspace"), F.lit(True).alias("known"))
    rows = vectors.select("memory_id", "embedding").join(known, "memory_id", "left")
    outcome = F.when(~usable_vector("embedding", F.lit(dim)), "unusable").when(F.col("known").isNull(), "unknown").otherwise("moved")
    return rows.select("memory_id", F.when(outcome == "moved", F.col("entry_workspace")).alias("workspace"), outcome.alias("outcome"))


def backfill_plan(entries: DataFrame, vectors: DataFrame, budget: int = 512, batch: int = 128) -> DataFrame:
    """The newest memories without a vector within the budget of a cycle, in batches.  Only active
    memories are embedded."""
    from pyspark.sql import Window

    order = [F.col("created_at").desc_nulls_last(), F.col("id").desc()]
    rows = missing(entries, vectors).select("id", "created_at").orderBy(*order).limit(budget)
    place = F.row_number().over(Window.orderBy(*order)) - 1  # of `budget` rows
    return rows.select("id", F.floor(place / batch).alias("batch"), (place % batch).alias("position"))

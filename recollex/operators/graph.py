"""Causal edges and supersede chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from recollex.functions.scoring import adaptive_confidence
from recollex.operators.entries import latest

KEY = ["source_id", "relation", "target_id"]


def edge_set(edges: DataFrame) -> DataFrame:
    """Edges are only added: of equal keys the first counts."""
    return latest(edges, KEY, [F.col("created_at").asc_nulls_last(), F.col("confidence").desc_nulls_last()])


def finite_confidence():
    return F.when(~F.isnan("confidence") & (F.abs("confidence") < float("inf")), F.col("confidence"))


def neighbors(edges: DataFrame, id: str) -> DataFrame:
    """(direction, other_id, relation, confidence) of one memory; a loop is in both directions."""
    out = edges.where(F.col("source_id") == id).select(F.lit("out").alias("direction"), F.col("target_id").alias("other_id"), "relation", "confidence")
    into = edges.where(F.col("target_id") == id).select(F.lit("in").alias("direction"), F.col("source_id").alias("other_id"), "relation", "confidence")
    return out.unionByName(into)


def validate(proposed: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """Proposed edges (source_id, target_id, confidence, ...) with the first reason against each, null for none."""
    ends = entries.select("id", "status", "superseded_by", "workspace")
    s = ends.select(*[F.col(c).alias(f"s_{c}") for c in ends.columns])
    t = ends.select(*[F.col(c).alias(f"t_{c}") for c in ends.columns])
    rows = proposed.join(s, F.col("source_id") == F.col("s_id"), "left").join(t, F.col("target_id") == F.col("t_id"), "left")
    reason = (
        F.when(F.col("source_id") == F.col("target_id"), "loop")
        .when(F.col("s_id").isNull() | F.col("t_id").isNull(), "unknown")
        .when((F.col("s_status") != "active") | (F.col("t_status") != "active"), "inactive")
        .when(F.col("s_superseded_by").isNotNull() | F.col("t_superseded_by").isNotNull(), "superseded")
        .when(~F.col("s_workspace").eqNullSafe(F.col("t_workspace")), "workspace")
        .when(F.coalesce(F.col("confidence") < least, F.lit(True)), "confidence")
    )
    return rows.select(*proposed.columns, reason.alias("reason"))


def accept(proposed: DataFrame, edges: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """Proposed edges to add: without a reason against them, not there yet, the first of equal keys."""
    good = validate(proposed, entries, least).where("reason is null").drop("reason").withColumn("relation", F.lit("causal"))
    first = latest(good, KEY, [F.col("output_id").asc(), F.col("position").asc()])
    return first.join(edges.select(*KEY), KEY, "left_anti")


def orphans(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Edges with an end that is no visible memory."""
    visible = entries.where("status = 'active' and superseded_by is null").select("id")
    there = edges.join(visible.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(visible.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return edges.select(*KEY).join(there.select(*KEY), KEY, "left_anti")


def confidence_summary(edges: DataFrame) -> DataFrame:
    """One row: edges, mean confidence, four classes; a confidence that is no number is in none."""
    c = finite_confidence()
    return edges.select(c.alias("c")).agg(
        F.count(F.lit(1)).alias("edges"), F.round(F.avg("c"), 6).alias("mean_confidence"), F.count_if(F.col("c") < 0.55).alias("below_55"), F.count_if((F.col("c") >= 0.55) & (F.col("c") < 0.75)).alias("below_75"),
        F.count_if((F.col("c") >= 0.75) & (F.col("c") < 0.9)).alias("below_90"), F.count_if(F.col("c") >= 0.9).alias("from_90"))


def confidence_gate(edges: DataFrame) -> DataFrame:
    return confidence_summary(edges).select("below_55", "below_75", adaptive_confidence("below_55", "below_75").alias("least_confidence"))


def chain_links(entries: DataFrame) -> DataFrame:
    """(id, supersedes, older_kind, superseded_by, newer_kind): both pointers of a memory with what they name, if it exists."""
    rows = entries.where("supersedes is not null or superseded_by is not null").select("id", "supersedes", "superseded_by")
    named = entries.select("id", "kind")
    older = named.select(F.col("id").alias("supersedes"), F.col("kind").alias("older_kind"))
    newer = named.select(F.col("id").alias("superseded_by"), F.col("kind").alias("newer_kind"))
    return rows.join(older, "supersedes", "left").join(newer, "superseded_by", "left").select("id", "supersedes", "older_kind", "superseded_by", "newer_kind")


def cumulative(rounds: DataFrame) -> DataFrame:
    """Running totals over rounds (one row per day, so few rows) and the length of the current run of empty ones."""
    w = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    rows = rounds.withColumn("total_decisions", F.sum("decisions").over(w)).withColumn("total_skipped", F.sum("skipped").over(w)).withColumn("runs", F.sum(F.when(F.col("decisions") > F.col("skipped"), 1).otherwise(0)).over(w))
    island = Window.partitionBy("runs").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("empty_rounds", F.sum(F.when(F.col("decisions") > F.col("skipped"), 0).otherwise(1)).over(island)).drop("runs")

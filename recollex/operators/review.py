"""Applying merge passes and verdicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from recollex.sources.shared import Scratch, shuffle_width


def judged(verdicts: DataFrame, entries: DataFrame, order: tuple[str, ...] = ("output_id", "position")) -> DataFrame:
    """Verdicts (focus_id, peer_id, action, ...) one after the other in their order, with outcome, which of both memories
    stays and goes, and the importance that the one that stays has then if a merge raised it.

    Both must be there, active, not superseded and of one workspace, also after what earlier verdicts
    did; the newer by (created_at, id) stays.  Verdicts that name neither memory of each other don't
    matter to each other, so each connected set of memories is folded on its own.
    """
    ends = entries.select("id", "status", "superseded_by", "workspace", "created_at", "importance")
    f = ends.select(*[F.col(c).alias(f"f_{c}") for c in ends.columns])
    p = ends.select(*[F.col(c).alias(f"p_{c}") for c in ends.columns])
    rows = verdicts.join(f, F.col("focus_id") == F.col("f_id"), "left").join(p, F.col("peer_id") == F.col("p_id"), "left")
    gone = F.col("f_id").isNull() | F.col("p_id").isNull() | ~F.coalesce(F.col("f_status") == "active", F.lit(False)) | ~F.coalesce(F.col("p_status") == "active", F.lit(False))
    alone = (
        F.when(gone, "skip invalid").when(F.col("f_superseded_by").isNotNull() | F.col("p_superseded_by").isNotNull(), "skip superseded")
        .when(~F.col("f_workspace").eqNullSafe(F.col("p_workspace")), "skip invalid").when(F.col("action") == "none", "skip none").otherwise(F.col("action"))
    )
    newer = F.coalesce(F.struct("f_created_at", "f_id") > F.struct("p_created_at", "p_id"), F.lit(False))
    named = rows.select(*verdicts.columns, gone.alias("_gone"), alone.alias("_alone"), F.when(newer, F.col("f_id")).otherwise(F.col("p_id")).alias("_new"), F.when(newer, F.col("p_id")).otherwise(F.col("f_id")).alias("_old"),
                        F.when(newer, F.col("f_importance")).otherwise(F.col("p_importance")).alias("_new_imp"), F.when(newer, F.col("p_importance")).otherwise(F.col("f_importance")).alias("_old_imp"))
    named = Scratch(verdicts.sparkSession).keep(named)
    there = named.where("not _gone")
    labels = connected(there.where("_new <> _old"), "_new", "_old")
    there = there.join(labels, there["_new"] == labels["id"], "left").withColumn("_label", F.coalesce("label", "_new")).drop("id", "label")
    kinds, names = dict(named.dtypes), verdicts.columns

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(order), kind="stable")
        importance, archived, made = {}, set(), []
        for alone, new, old, new_importance, old_importance in part[["_alone", "_new", "_old", "_new_imp", "_old_imp"]].itertuples(index=False):
            outcome = "skip invalid" if new in archived or old in archived else alone
            raised = None
            if outcome == "merge":
                now, other = importance.get(new, new_importance), importance.get(old, old_importance)
                if other > now:
                    raised = importance[new] = other
            if outcome in ("merge", "archive"):
                archived.add(old)
            done = outcome in ("merge", "archive")
            made.append((outcome, new if done else None, old if done else None, raised))
        return part[names].assign(**dict(zip(("outcome", "keep_id", "drop_id", "importance"), map(list, zip(*made)))))

    columns = [*[f"`{c}` {kinds[c]}" for c in names], "outcome string", "keep_id string", "drop_id string", "importance double"]
    # Of a fixed number, so that adaptive execution doesn't join partitions that are small in bytes but not in work.
    folded = there.repartition(shuffle_width(verdicts.sparkSession), "_label").groupBy("_label").applyInPandas(run, ", ".join(columns))
    none = F.lit(None)
    missing = named.where("_gone").select(*verdicts.columns, F.col("_alone").alias("outcome"), none.cast("string").alias("keep_id"), none.cast("string").alias("drop_id"), none.cast("double").alias("importance"))
    return folded.unionByName(missing)


def connected(pairs: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(id, label): the least id reached over pairs.  In a round each takes the least label of its neighbours, and then that
    label's own label, so rounds grow with the logarithm of the longest chain."""
    scratch = Scratch(pairs.sparkSession)
    both = pairs.select(F.col(a).alias("id"), F.col(b).alias("other")).unionByName(pairs.select(F.col(b).alias("id"), F.col(a).alias("other"))).distinct()
    both = scratch.keep(both)
    labels = scratch.keep(both.groupBy("id").agg(F.least(F.min("id"), F.min("other")).alias("label")))
    for _ in range(rounds):
        passed = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("near"))
        near = labels.join(passed, "id").select("id", "label", F.least("label", "near").alias("near"))
        jumped = near.join(labels.select(F.col("id").alias("near"), F.col("label").alias("far")), "near", "left")
        new = scratch.keep(jumped.select("id", F.least("near", F.coalesce("far", "near")).alias("new"), "label").select("id", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("changed")))
        if new.where("changed").isEmpty():
            return new.drop("changed")
        labels = new.drop("changed")
    raise RuntimeError(f"labels still change after {rounds} rounds")


def merge_pass(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(keep_id, drop_id, importance) that a pass carries out, newest memories first: a pair is passed over if one of
    it is gone or an earlier merge has moved their importances more than 2 apart; importance is what the kept
    one has then.

    Only connected pairs matter to each other, so each connected set is folded on its own.
    """
    about = entries.select("id", "created_at", "importance")
    k, d = about.select(*[F.col(c).alias(f"k_{c}") for c in about.columns]), about.select(*[F.col(c).alias(f"d_{c}") for c in about.columns])
    labels = connected(pairs, "keep_id", "drop_id").select(F.col("id").alias("keep_id"), "label")
    rows = pairs.select("keep_id", "drop_id").join(labels, "keep_id").join(k, F.col("keep_id") == F.col("k_id")).join(d, F.col("drop_id") == F.col("d_id"))
    rows = rows.select("label", "keep_id", "drop_id", F.col("k_created_at").alias("k_at"), F.col("d_created_at").alias("d_at"), F.col("k_importance").alias("k_imp"), F.col("d_importance").alias("d_imp"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["k_at", "keep_id", "d_at", "drop_id"], ascending=False)
        importance = dict(zip(part["drop_id"], part["d_imp"])) | dict(zip(part["keep_id"], part["k_imp"]))
        gone, done = set(), []
        for keep, drop in part[["keep_id", "drop_id"]].itertuples(index=False):
            if keep in gone or drop in gone or abs(importance[keep] - importance[drop]) > 2:
                continue
            importance[keep] = max(importance[keep], importance[drop])
            gone.add(drop)
            done.append((keep, drop, importance[keep]))
        return pd.DataFrame(done, columns=["keep_id", "drop_id", "importance"])

    # Of a fixed number, so that adaptive execution doesn't join partitions that are small in bytes but not in work.
    return rows.repartition(shuffle_width(rows.sparkSession), "label").groupBy("label").applyInPandas(run, "keep_id string, drop_id string, importance double")

"""From a stream of session events to the operation log: batches, a judge, memories, operations.

Delivery is at least once up to the judge and exactly once in the log: an epoch that
fails anywhere (also in the judge) is repeated from the checkpoint and replaces its own
folder of operations; a memory that came out before has the same key and merges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from recollex.api import Memory
from recollex.functions import judge as jd
from recollex.functions.seams import Judge
from recollex.functions.text import excerpt
from recollex.operators.ingest import LOG
from recollex.operators.ranking import global_rank
from recollex.sources import schema as sc

#: Operations that one epoch may have, for numbers that grow with epochs.
EPOCH_SPAN = 1 << 32


def asked(batches: DataFrame, judge: Judge) -> DataFrame:
    """Batches with the judge's answer as raw_text; output_id names the batch.  An error of the judge fails the
    task, and with it the epoch, so no batch is lost."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(raw_text=[judge(t) for t in part["transcript"]])

    named = batches.withColumn("output_id", F.xxhash64("session_id", "trigger", "first_seq", "last_seq"))
    return named.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields) + ", raw_text string")


def memories(answered: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(op_id, workspace, session_id, kind, content, importance, self_relevance, tags, source) of the memories in answers; op_id
    is the place in the epoch.  `workspaces` is (session_id, workspace); sessions it does not know are in 'default'."""
    about = answered.select("output_id", "session_id", "first_seq", "seqs", "transcript")
    found = jd.memories(answered).join(about, "output_id").join(workspaces.select("session_id", "workspace"), "session_id", "left")
    tags = F.filter(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: t != "")
    source = F.struct("session_id", F.col("seqs").alias("event_seqs"), excerpt("transcript").alias("excerpt")).cast(sc.SOURCE)
    placed = global_rank(found, "op_id", F.col("session_id").asc(), F.col("first_seq").asc(), F.col("output_id").asc(), F.col("position").asc())
    return placed.select("op_id", F.coalesce("workspace", F.lit("default")).alias("workspace"), "session_id", "kind", "content", F.col("importance").cast("double").alias("importance"), F.col("self_relevance").cast("double").alias("self_relevance"), tags.alias("tags"), source.alias("source"))


def log_sink(spark: SparkSession, entries: DataFrame, workspaces: DataFrame, judge: Judge, log: str, now: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink from extraction batches to operations under log/epoch=N, which a repeated epoch replaces."""

    def write(batches: DataFrame, epoch: int) -> None:
        answered = asked(batches, judge).persist()
        try:
            operations, _ = Memory(spark, entries, now=now).note(memories(answered, workspaces), by="extractor")
            numbered = operations.withColumn("op_id", F.col("op_id") + F.lit(epoch) * F.lit(EPOCH_SPAN))
            numbered.select(*[f.name for f in sc.struct(LOG).fields]).write.mode("overwrite").parquet(f"{log}/epoch={epoch}")
        finally:
            answered.unpersist()

    return write

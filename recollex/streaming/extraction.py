"""The session stream: extraction batches with state, access throttle, and their sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollex.functions.text import excerpt, truncate_latest
from recollex.operators.sessions import EMIT_CHARS, OWN_PLUGIN
from recollex.functions.text import strip_paragraphs
from recollex.sources import schema as sc

#: Characters of a transcript that an extraction gets.  Fixed value.
MAX_CHARS = 12_000
BATCH = "session_id string, trigger string, first_seq bigint, last_seq bigint, seqs array<bigint>, transcript string"
#: Last sequence number done, and texts with their numbers that wait.
STATE = "last bigint, seqs array<bigint>, texts array<string>"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of event files as a stream."""
    return spark.readStream.schema(sc.struct(sc.EVENT)).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def prepared(events: DataFrame) -> DataFrame:
    """Events that matter to extraction, with what was said; prepared in the JVM so that Python sees few columns."""
    own = (F.col("source_kind") == "plugin") & F.coalesce(F.col("source_plugin") == OWN_PLUGIN, F.lit(False))
    said = F.when(F.col("event_type").isin("user/message", "assistant/message") & ~F.coalesce(own, F.lit(False)), strip_paragraphs("text"))
    kinds = ("user/message", "assistant/message", "turn/end", "compaction/summary", "agent/disposed")
    return events.where(F.col("event_type").isin(*kinds)).select("session_id", "seq", "event_type", F.coalesce(said, F.lit("")).alias("said"), F.coalesce("shadowed_seqs", F.array().cast("array<bigint>")).alias("shadowed_seqs"))


class SessionState:
    """What one session waits for.  Events at or below the last number done are redeliveries or late."""

    def __init__(self, last: int = -1, seqs: list[int] | None = None, texts: list[str] | None = None):
        self.last, self.seqs, self.texts = last, list(seqs or ()), list(texts or ())

    def feed(self, seq: int, kind: str, said: str, shadowed: list[int]) -> tuple[str, list[int], str] | None:
        """A batch (trigger, seqs, transcript) that is due, if any."""
        if kind in ("user/message", "assistant/message"):
            if said and seq > self.last and seq not in self.seqs:
                self.seqs.append(seq)
                self.texts.append(said)
            return None
        if kind == "compaction/summary":
            wanted = set(shadowed)
            chosen = [i for i, s in enumerate(self.seqs) if s in wanted]
            return self._emit("compaction", chosen) if chosen else None
        if kind == "turn/end":
            return self._emit("turn", range(len(self.seqs))) if sum(map(len, self.texts)) + max(len(self.texts) - 1, 0) >= EMIT_CHARS else None
        done = self._emit("closed", range(len(self.seqs))) if self.seqs else None
        self.seqs, self.texts = [], []
        return done

    def _emit(self, trigger: str, chosen) -> tuple[str, list[int], str]:
        order = sorted(chosen, key=lambda i: self.seqs[i])
        seqs, texts = [self.seqs[i] for i in order], [self.texts[i] for i in order]
        keep = set(range(len(self.seqs))) - set(chosen)
        if not keep:
            self.last = max(self.last, *seqs)
        self.seqs, self.texts = [self.seqs[i] for i in sorted(keep)], [self.texts[i] for i in sorted(keep)]
        return trigger, seqs, "\n".join(texts)


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = SessionState(*state.get) if state.exists else SessionState()
    rows = pd.concat(list(parts)).drop_duplicates("seq").sort_values("seq")  # one session's events of one trigger
    out = []
    for seq, kind, said, shadowed in rows[["seq", "event_type", "said", "shadowed_seqs"]].itertuples(index=False):
        due = held.feed(int(seq), kind, said, [int(s) for s in shadowed])
        if due:
            out.append((key[0], due[0], due[1][0], due[1][-1], due[1], due[2]))
    state.update((held.last, held.seqs, held.texts))
    yield pd.DataFrame(out, columns=["session_id", "trigger", "first_seq", "last_seq", "seqs", "transcript"])


def extraction_batches(events: DataFrame) -> DataFrame:
    """Batches to extract memories from: on compaction what it shadows, at the end of a turn what waits if it has
    2,000 characters, on close the rest.  State is keyed by session and checkpointed; the text that waits in it is
    bounded by one batch.  Transcripts are cut to their last 12,000 characters."""
    made = prepared(events).groupBy("session_id").applyInPandasWithState(_step, BATCH, STATE, "append", GroupStateTimeout.NoTimeout)
    return made.withColumn("transcript", truncate_latest("transcript", MAX_CHARS)).withColumn("excerpt", excerpt("transcript"))


def _throttle(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(parts)).sort_values(["at_us", "event_id"])
    kept = []
    for at, i in rows[["at_us", "event_id"]].itertuples(index=False):
        if last is None or at - last >= 60_000_000:
            kept.append((*key, i, at))
            last = int(at)
    if last is not None:
        state.update((last,))
    yield pd.DataFrame(kept, columns=["session_id", "memory_id", "event_id", "at_us"])


def throttled_accesses(accesses: DataFrame) -> DataFrame:
    """Of a stream (session_id, memory_id, event_id, at_us) accesses at least 60 s after the last kept one of their key."""
    return accesses.groupBy("session_id", "memory_id").applyInPandasWithState(_throttle, "session_id string, memory_id string, event_id bigint, at_us bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An extension: events per window and type, with late ones within the watermark."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "event_type", "n")


def to_parquet_once(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes each epoch to its own folder: a repeated epoch replaces itself, so a batch
    that is retried after a failure leaves no duplicate."""

    def write(frame: DataFrame, epoch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop; progress is in the checkpoint, so a failed run starts again where the
    last finished epoch ended."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

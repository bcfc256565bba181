"""Batch forms of the session stream: transcripts, routes, queries, turn batches, visibility."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from recollex.functions.text import micros, strip_paragraphs, summary
from recollex.operators.entries import latest

#: The plugin whose own messages are skipped, as the events name it.
OWN_PLUGIN = "memory-core"
#: Characters of new text from which a turn's end emits a batch.  Fixed value.
EMIT_CHARS = 2000
#: Events of a session that one part of its transcript spans.
PART = 512


def events_once(rows: DataFrame) -> DataFrame:
    """Events without redeliveries: the first that arrived of each (session, seq)."""
    return latest(rows, ["session_id", "seq"], [F.col("ingested_at").asc_nulls_last(), F.col("event_time").asc_nulls_last()])


def spoken(events: DataFrame) -> DataFrame:
    """(session_id, seq, said): texts of users and assistants without this engine's own messages and repeated memories; none that are empty."""
    own = (F.col("source_kind") == "plugin") & F.coalesce(F.col("source_plugin") == OWN_PLUGIN, F.lit(False))
    rows = events.where(F.col("event_type").isin("user/message", "assistant/message") & ~F.coalesce(own, F.lit(False)))
    return rows.select("session_id", "seq", strip_paragraphs("text").alias("said")).where("said <> ''")


def transcripts(events: DataFrame, part: int = PART) -> DataFrame:
    """(session_id, part, messages, transcript): what was said, in parts of a fixed span of events, so a session
    with a third of all events is many rows rather than one."""
    rows = spoken(events).withColumn("part", F.floor(F.col("seq") / part))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "said"))), lambda m: m["said"]), "\n")
    return rows.groupBy("session_id", "part").agg(F.count(F.lit(1)).alias("messages"), said.alias("transcript"))


def compaction_targets(events: DataFrame) -> DataFrame:
    """(session_id, summary_seq, seq): spoken events that a compaction shadows."""
    shadow = events.where("event_type = 'compaction/summary'").select("session_id", F.col("seq").alias("summary_seq"), F.explode("shadowed_seqs").alias("seq")).where("seq is not null").distinct()
    return shadow.join(spoken(events).select("session_id", "seq"), ["session_id", "seq"]).select("session_id", "summary_seq", "seq")


def latest_routes(events: DataFrame) -> DataFrame:
    """(session_id, provider, model) of each session's last header; sessions whose last header is incomplete have none."""
    headers = events.where("event_type = 'request/header'")
    last = headers.groupBy("session_id").agg(F.max_by(F.struct("provider", "model"), "seq").alias("r"))
    return last.select("session_id", "r.provider", "r.model").where("provider <> '' and model <> ''")


def summary_memories(events: DataFrame) -> DataFrame:
    """Memories that compactions leave: kind insight, importance 7, tagged session-summary, the summary cut to 2,000
    characters with a note; blank summaries leave none."""
    rows = events.where("event_type = 'compaction/summary'").withColumn("cut", summary("text")).where(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != "")
    return rows.select(
        "session_id", "seq", F.lit("insight").alias("kind"), F.concat(F.lit("会话摘要："), "cut").alias("content"), F.lit(7.0).alias("importance"), F.lit("session-summary").alias("tags"),
        F.array_join(F.coalesce("shadowed_seqs", F.array().cast("array<bigint>")), ",").alias("event_seqs"), F.substring("cut", 1, 400).alias("excerpt"))


def closing_memories(events: DataFrame, entries: DataFrame) -> DataFrame:
    """Memories that closed sessions leave: one per session with when it closed, if known, and what it produced, of
    importance 5, tagged snapshot."""
    closed = events.where("event_type = 'agent/disposed'").groupBy("session_id").agg(F.max("seq").alias("seq"), F.max_by("event_time", "seq").alias("at"))
    made = closed.join(session_rollup(entries), "session_id", "left").fillna(0, ["memories", "summaries"])
    at = F.coalesce(F.concat(F.lit("（"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(" 结束）")), F.lit(""))
    produced = F.concat(F.lit("，期间产生记忆 "), F.col("memories").cast("string"), F.lit(" 条（含会话摘要 "), F.col("summaries").cast("string"), F.lit(" 份）。"))
    content = F.concat(F.lit("会话快照：会话 "), "session_id", at, produced, F.lit("可用 memory_search kind=insight 检索本会话的摘要内容。"))
    return made.select("session_id", "seq", F.lit("insight").alias("kind"), content.alias("content"), F.lit(5.0).alias("importance"), F.lit("snapshot").alias("tags"))


def numbered(rows: DataFrame, key: list[str], at: str, width: int, *order: str) -> DataFrame:
    """Rows with `_n`, their number from 1 within the key.

    A key is cut into blocks of `width` units of `at`, so one with a third of all rows is many
    tasks' work; what is summed up over a key is one row per block.
    """
    rows = rows.withColumn("_block", F.floor(F.col(at) / width))
    inner = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*key, "_block").orderBy(*(order or (at,)))))
    sizes = rows.groupBy(*key, "_block").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return inner.join(before, [*key, "_block"]).withColumn("_n", F.col("_before") + F.col("_i")).drop("_i", "_before", "_block")


def rolling_queries(events: DataFrame, before: int = 3, cut: int = 100) -> DataFrame:
    """(session_id, seq, query): each user message followed by the heads of the `before` ones before it, latest first.

    Messages are numbered and every head is sent to the numbers after its own, so the shuffle is on
    (session, number) and no session is one task's work.
    """
    rows = events.where("event_type = 'user/message' and source_kind = 'user' and text is not null and text <> ''").select("session_id", "seq", "text")
    placed = numbered(rows, ["session_id"], "seq", PART)
    sent = placed.select("session_id", F.col("seq").alias("from"), F.substring("text", 1, cut).alias("head"), F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + before)).alias("_n"))
    own = placed.select("session_id", "_n", "seq", "text", F.lit(None).cast("bigint").alias("from"), F.lit(None).cast("string").alias("head"))
    both = own.unionByName(sent.select("session_id", "_n", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("text"), "from", "head"))
    heads = F.sort_array(F.collect_list(F.when(F.col("head").isNotNull(), F.struct("from", "head"))), asc=False)  # `before` at most
    joined = both.groupBy("session_id", "_n").agg(F.max("seq").alias("seq"), F.max("text").alias("text"), heads.alias("h")).where("seq is not null")
    return joined.select("session_id", "seq", F.array_join(F.concat(F.array("text"), F.transform("h", lambda x: x["head"])), "\n").alias("query"))


def session_rollup(entries: DataFrame) -> DataFrame:
    """(session_id, memories, summaries) over all statuses."""
    return entries.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("memories"), F.count_if(F.coalesce(F.array_contains("tags", "session-summary"), F.lit(False))).alias("summaries"))


def turn_batches(events: DataFrame, least: int = EMIT_CHARS) -> DataFrame:
    """(session_id, batch, first_seq, last_seq, chars, closed): what each extraction of a session gets.

    At the end of a turn the text since the last batch is emitted if it has `least` characters
    or else waits; what is left at the end is a batch that is not closed.  The rule resets a
    running sum where it passes a bound, which no window expresses.  Events arrive sorted, as
    numbers only, and the fold holds one batch's totals; a session is one task's work, by a
    few bytes an event.
    """
    said = spoken(events).select("session_id", "seq", (F.length("said") + 1).alias("chars"), F.lit(False).alias("turn_end"))
    ends = events.where("event_type = 'turn/end'").select("session_id", "seq", F.lit(0).alias("chars"), F.lit(True).alias("turn_end"))
    rows = said.unionByName(ends).repartition("session_id").sortWithinPartitions("session_id", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, number, first, last, chars = None, 0, None, None, 0
        out: list = []

        def emit(closed: bool) -> None:
            nonlocal number, first, last, chars
            if first is not None:
                out.append((session, number, first, last, chars - 1, closed))
                number += 1
            first, last, chars = None, None, 0

        for part in batches:
            for s, seq, n, end in part.itertuples(index=False):
                if s != session:
                    emit(False)
                    session, number = s, 0
                if end:
                    if first is not None and chars - 1 >= least:
                        emit(True)
                else:
                    first, last, chars = (seq if first is None else first), seq, chars + n
            yield pd.DataFrame(out, columns=["session_id", "batch", "first_seq", "last_seq", "chars", "closed"])
            out.clear()
        emit(False)
        yield pd.DataFrame(out, columns=["session_id", "batch", "first_seq", "last_seq", "chars", "closed"])

    return rows.mapInPandas(run, "session_id string, batch int, first_seq bigint, last_seq bigint, chars bigint, closed boolean")


def islands(rows: DataFrame, keys: list[str], at: str, gap: int, *order: str) -> DataFrame:
    """Rows with `_island`: a key is cut wherever `gap` units or more of `at` lie between neighbours.

    Neighbours are looked up within blocks of time and from the last row of the block before, so a
    key with a third of all rows is many tasks' work.
    """
    rows = rows.withColumn("_block", F.floor(F.col(at) / (gap * 64)))
    w = Window.partitionBy(*keys, "_block").orderBy(at, *order)
    ends = rows.groupBy(*keys, "_block").agg(F.max(at).alias("_end"))
    ends = ends.withColumn("_end_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_block"))).drop("_end")
    marked = rows.withColumn("_lag", F.lag(at).over(w)).join(ends, [*keys, "_block"])
    step = F.col(at) - F.coalesce("_lag", "_end_before")
    marked = marked.withColumn("_new", F.when(step.isNull() | (step >= gap), F.col(at)))
    started = marked.withColumn("_start", F.max("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lasts = marked.groupBy(*keys, "_block").agg(F.max("_new").alias("_last"))
    lasts = lasts.withColumn("_open", F.max("_last").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    return started.join(lasts, [*keys, "_block"]).withColumn("_island", F.coalesce("_start", "_open")).drop("_lag", "_end_before", "_new", "_start", "_open", "_block")


def throttled(rows: DataFrame, keys: list[str], time: str, id: str, seconds: int = 60) -> DataFrame:
    """Events that an access throttle keeps: each at least `seconds` after the last kept one of its key.

    An event that long after the one before it is kept whatever came before, so every key falls
    into islands at such gaps; rows of an island are folded in order with one number as state.
    Rows without a time or key are left out.
    """
    span = seconds * 1_000_000
    marked = rows.withColumn("at_us", micros(time)).select(*keys, F.col(id), "at_us").dropna(subset=[*keys, "at_us"])
    ordered = islands(marked, keys, "at_us", span, id).repartition(*keys, "_island").sortWithinPartitions(*keys, "_island", "at_us", id)
    columns = [*keys, id, "at_us"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last = None, 0
        for part in batches:
            chosen = []
            for n, (*key, i, at, island) in enumerate(part[[*columns, "_island"]].itertuples(index=False)):
                if (key, island) != group or at - last >= span:
                    chosen.append(n)
                    group, last = (key, island), at
            yield part.iloc[chosen][columns]

    kinds = dict(marked.dtypes)
    return ordered.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns))


def injection_visible(events: DataFrame, part: int = PART) -> DataFrame:
    """(session_id, seq, visible): own injected messages, and whether no later compaction covers them.

    A message is covered if the greatest end of all later compactions reaches it: a running maximum from the
    end of a session, within parts of a fixed span of events and over the maxima of the parts behind.
    """
    own = events.where((F.col("event_type") == "user/message") & (F.col("source_kind") == "plugin") & (F.col("source_plugin") == OWN_PLUGIN)).select("session_id", "seq", F.lit(None).cast("bigint").alias("end"))
    cover = events.where("event_type = 'compaction/summary' and shadowed_end is not null").select("session_id", "seq", F.col("shadowed_end").alias("end"))
    rows = own.withColumn("own", F.lit(True)).unionByName(cover.withColumn("own", F.lit(False))).where("session_id is not null and seq is not null").withColumn("part", F.floor(F.col("seq") / part))
    behind = Window.partitionBy("session_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("session_id", "part").agg(F.max("end").alias("most")).withColumn("after", F.max("most").over(behind)).drop("most")
    within = Window.partitionBy("session_id", "part").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    reached = rows.withColumn("later", F.max("end").over(within)).join(parts, ["session_id", "part"]).where("own")
    covered = F.coalesce(F.greatest("later", "after") >= F.col("seq"), F.lit(False))
    return reached.select("session_id", "seq", (~covered).alias("visible"))


def snapshot_rebuilds(requests: DataFrame, ttl: int = 300, least: int = 60) -> DataFrame:
    """(workspace, seq, rebuilt): of requests (workspace, seq, at, revision) those that rebuild the cached snapshot:
    the first, any after `ttl` seconds, and any with a new revision once it is `least` seconds old.

    A small state per workspace, folded over sorted rows in Arrow batches.
    """
    rows = requests.select("workspace", "seq", micros("at").alias("t"), "revision").where("t is not null").repartition("workspace").sortWithinPartitions("workspace", "t", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, built, held = object(), 0, None
        for part in batches:
            out = []
            for s, seq, t, revision in part.itertuples(index=False):
                age = (t - built) / 1e6
                again = s != space or age >= ttl or (revision != held and age >= least)
                if again:
                    space, built, held = s, t, revision
                out.append((s, seq, again))
            yield pd.DataFrame(out, columns=["workspace", "seq", "rebuilt"])

    return rows.mapInPandas(run, "workspace string, seq bigint, rebuilt boolean")

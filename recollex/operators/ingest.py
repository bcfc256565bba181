"""Writing memories: the gate, duplicates by key, the operation log and its fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recollex.functions.text import dedup_key, normalize_content, tokenize
from recollex.sources.schema import MEMORY, SOURCE, struct

#: Importance and tokens that an extracted memory must have.  Fixed values.
IMPORTANCE_FLOOR, MIN_TOKENS = 1, 2


def gate_reason(by: Column, content: str = "content", importance: str = "importance") -> Column:
    """Why a memory is not written, null if it is.  Only the extractor is gated; a missing importance counts as 5."""
    i = F.when(F.isnan(importance), F.lit(5.0)).otherwise(F.coalesce(F.col(importance), F.lit(5.0)))
    few = F.size(tokenize(normalize_content(content))) < MIN_TOKENS
    return F.when(by != "extractor", F.lit(None)).when(i < IMPORTANCE_FLOOR, "worthless").when(few, "noise")


def duplicate_keys(entries: DataFrame) -> DataFrame:
    """(workspace, kind, key, n, first_id): active memories that share a key."""
    rows = entries.where("status = 'active' and content is not null").withColumn("key", dedup_key("content"))
    return rows.groupBy("workspace", "kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", F.struct("created_at", "id")).alias("first_id")).where("n > 1")


def merge_duplicates(entries: DataFrame) -> DataFrame:
    """One row per (workspace, kind, key) of active memories: content, session and creation of the first,
    greatest importance, excerpt of the latest, and the distinct event numbers of all, sorted.

    Event numbers are made distinct by the shuffle rather than in one collected array of
    repetitions, so a key with a third of all rows collects distinct numbers only.
    """
    key = ["workspace", "kind", "key"]
    rows = entries.where("status = 'active' and content is not null").withColumn("key", dedup_key("content"))
    i = F.when(~F.isnan("importance"), F.col("importance"))
    order = F.struct("created_at", "id")
    merged = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("merged"), F.min_by("id", order).alias("id"), F.max(i).alias("importance"), F.min_by("content", order).alias("content"),
        F.min_by("session_id", order).alias("session_id"), F.max_by(F.col("source.excerpt"), order).alias("excerpt"))
    numbers = rows.select(*key, F.explode("source.event_seqs").alias("seq")).where("seq is not null").distinct()
    joined = numbers.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("seq")), ",").alias("event_seqs"))
    same = [merged[c].eqNullSafe(joined[c]) for c in key]
    return merged.join(joined, same[0] & same[1] & same[2], "left").select(*[merged[c] for c in key], "merged", "id", "importance", "content", "session_id", "excerpt", F.coalesce("event_seqs", F.lit("")).alias("event_seqs"))


#: Columns of the operation log: op_id orders the operations on one id; op is create, update, merge, archive, supersede, access or delete.
LOG = (
    "op_id bigint, id string, op string, at timestamp_ntz, by string, importance double, kind string, tags array<string>, content string, workspace string, other string, "
    f"session_id string, self_relevance double, source {SOURCE}, supersedes string"
)


def fold(log: DataFrame) -> DataFrame:
    """The state after all operations in the columns of memories, one row per id that was created, and ids that only had
    other operations with `missing` counting those; `actions` counts operations since the creation.

    Fields are last-written-wins, which aggregates express with partial results on the map
    side: no id's operations are collected.  A patch changes kind, importance and tags only, a merge
    importance and source; superseding leaves the status; archiving is final until the id is created again;
    an access raises access_count and sets last_access_at only; deleting removes the row until the next
    creation.  Audits stay in the log (`history`).
    """
    born = log.where("op = 'create'").groupBy("id").agg(F.max("op_id").alias("born"), F.min("op_id").alias("first"))
    dead = log.where("op = 'delete'").groupBy("id").agg(F.max("op_id").alias("dead"))
    rows = log.join(born, "id", "left").join(dead, "id", "left")
    live = F.col("born").isNotNull() & (F.col("op_id") >= F.col("born"))

    def last(column: str, *ops: str) -> Column:
        given = live & F.col("op").isin(*ops) & F.col(column).isNotNull()
        return F.max_by(column, F.when(given, F.col("op_id"))).alias(column)

    folded = rows.groupBy("id").agg(
        last("workspace", "create"), last("session_id", "create"), last("kind", "create", "update"), last("content", "create"), last("importance", "create", "update", "merge"), last("self_relevance", "create"),
        last("tags", "create", "update"), last("source", "create", "merge"), last("supersedes", "create"),
        F.when(F.max(F.when(live & (F.col("op") == "archive"), 1)) == 1, "archived").otherwise("active").alias("status"), last("other", "supersede").alias("superseded_by"),
        F.max_by("at", F.when(live & (F.col("op") == "create"), F.col("op_id"))).alias("created_at"), F.max_by("at", F.when(live & (F.col("op") != "access"), F.col("op_id"))).alias("updated_at"),
        F.max(F.when(live & F.col("op").isin("create", "access"), F.col("at"))).alias("last_access_at"), F.count_if(live & (F.col("op") == "access")).alias("access_count"),
        F.count_if(live).cast("int").alias("actions"), F.count_if(F.col("first").isNull() | (F.col("op_id") < F.col("first"))).cast("int").alias("missing"),
        F.max("born").alias("_born"), F.max("dead").alias("_dead"))
    folded = folded.where("_dead is null or (_born is not null and _dead < _born)")
    folded = folded.withColumn("dedup_key", dedup_key("content")).withColumn("content_tokens", F.array_join(tokenize("content"), " ")).withColumn("ingested_at", F.col("updated_at")).withColumn("audit", F.lit(None))
    return folded.select(*[F.col(f.name).cast(f.dataType) for f in struct(MEMORY).fields], "actions", "missing")


def memories_of(log: DataFrame) -> DataFrame:
    """The memories that a log has created, as `api.Memory` reads them."""
    return fold(log).where("actions > 0").drop("actions", "missing")


def history(log: DataFrame, id: str) -> DataFrame:
    """The operations on one memory, oldest first: its audit."""
    return log.where(F.col("id") == id).select("op_id", F.col("op").alias("action"), "at", "by", "other").orderBy("op_id")


def access_operations(kept: DataFrame, first: int, memory: str = "memory_id", at_us: str = "at_us") -> DataFrame:
    """Operations of accesses that a throttle kept: each raises its memory's access_count by one.  An access has the number
    `first` plus its place in time in microseconds, which need not be unique, as accesses of one memory add up."""
    given = {"op_id": F.col(at_us) + first, "id": F.col(memory), "op": F.lit("access"), "at": F.timestamp_micros(at_us).cast("timestamp_ntz"), "by": F.lit("system")}
    return kept.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(LOG).fields])


def log_of_versions(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The operations that the stored versions of memories tell: the first one creates, later ones update; one that is
    archived or superseded does that.  Numbers order the operations of one id."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    v = rows.where("id is not null").withColumn("_v", place)
    later = F.coalesce("updated_at", "created_at")
    first = F.col("_v") == 1
    names = [f.name for f in struct(LOG).fields]

    def op(k: int, name: Column, at: Column, when: Column, *fields: str, other: Column | None = None) -> Column:
        values = {"op_id": F.col("_v") * 8 + k, "id": F.col("id"), "op": name, "at": at, "by": F.lit("system"), "other": other if other is not None else F.lit(None)}
        made = F.struct(*[(F.col(f.name) if f.name in fields else values.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in struct(LOG).fields])
        return F.when(when, made)

    everything = ("importance", "kind", "tags", "content", "workspace", "session_id", "self_relevance", "source", "supersedes")
    ops = F.array(
        op(0, F.lit("create"), F.col("created_at"), first, *everything), op(1, F.lit("update"), later, ~first, "importance", "kind", "tags"),
        op(2, F.lit("archive"), later, F.coalesce(F.col("status") == "archived", F.lit(False))), op(3, F.lit("supersede"), later, F.col("superseded_by").isNotNull(), other=F.col("superseded_by")))
    return v.select(F.explode(F.filter(ops, lambda o: o.isNotNull())).alias("o")).select(*[F.col(f"o.{n}").alias(n) for n in names])


def stale(entries: DataFrame, now: str, days: int = 90) -> DataFrame:
    """Active memories that nothing restates, never accessed, of importance 5 at most, not updated for `days`."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return entries.where((F.col("status") == "active") & F.col("superseded_by").isNull() & (F.col("access_count") == 0) & ~F.isnan("importance") & (F.col("importance") <= 5) & (F.col("updated_at") <= cutoff))

"""The library as a user of a memory store knows it: tools, listings, search, edges, status.

Everything returns DataFrames; writes are operations to append to a log (`sources.stores`).
Arguments are checked as strictly as a remote call's: a wrong one raises ValueError.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from recollex.functions.seams import Embedder
from recollex.functions.text import dedup_key, excerpt
from recollex.operators import context, entries as en, graph, ingest, search, sessions, similarity, vectors as vx
from recollex.sources import schema as sc

ACTORS = ("extractor", "tool", "user", "system")
MAX_LIMIT = 1000


def checked_limit(limit: int, default: int) -> int:
    if limit is None:
        return default
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be a whole number from 1 to {MAX_LIMIT}")
    return limit


def checked_text(name: str, value: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a text that is not blank")
    return value


@dataclass
class Memory:
    """Current memories, vectors and edges, read as of `now`."""

    spark: SparkSession
    rows: DataFrame
    vector_rows: DataFrame | None = None
    edge_rows: DataFrame | None = None
    now: str = "2026-01-15 00:00:00"
    embedder: Embedder | None = None
    entries: DataFrame = field(init=False)

    def __post_init__(self):
        self.entries = en.current(self.rows)
        self.vectors = vx.current_vectors(self.vector_rows) if self.vector_rows is not None else None
        self.edges = graph.edge_set(self.edge_rows) if self.edge_rows is not None else self.spark.createDataFrame([], sc.struct(sc.EDGE))

    # search and listings

    def search(self, query: str = "", limit: int | None = None, min_score: float = search.MIN_SCORE, mode: str = "auto", query_vector: list[float] | None = None, **filters) -> DataFrame:
        """Best memories for a query, or the newest for an empty one if a filter is given.

        mode: keyword, hybrid, or auto: hybrid where there are vectors and a query vector or an
        embedder of their length, else keywords.
        """
        chosen = en.Filters(**filters)
        if mode not in ("auto", "keyword", "hybrid"):
            raise ValueError(f"unknown mode {mode!r}")
        if not 0 <= min_score <= 1:
            raise ValueError("min_score must be from 0 to 1")
        top = checked_limit(limit, search.LIMIT)
        if not query.strip():
            return en.browse(self.entries, chosen, top)
        found = en.candidates(self.entries, chosen)
        if mode != "keyword" and query_vector is None and self.embedder is not None and self.vectors is not None:
            try:
                query_vector = self.embedder([query])[0]
            except Exception:  # noqa: BLE001
                if mode == "hybrid":
                    raise
        if mode == "hybrid" and (query_vector is None or self.vectors is None):
            raise ValueError("hybrid search needs vectors and a query vector")
        if mode == "keyword" or query_vector is None or self.vectors is None:
            return search.keyword_search(found, query, self.now, top, min_score)
        return search.hybrid_search(found, self.vectors, query, query_vector, self.now, top, min_score, chosen.workspace, limit)

    def recall(self, query: str, limit: int | None = None, in_snapshot: bool = False, **filters) -> DataFrame:
        """Seven columns of the best memories that the snapshot does not hold already."""
        found = self.search(checked_text("query", query), checked_limit(limit, 8), **filters)
        if not in_snapshot:
            found = found.join(context.snapshot(self.entries, filters.get("workspace")).select("id"), "id", "left_anti")
        return found.select("id", "kind", "content", "importance", F.array_join("tags", ",").alias("tags"), F.col("source.session_id").alias("session_id"), "created_at")

    def get(self, id: str) -> DataFrame:
        return en.detail_view(en.current(self.rows.where(F.col("id") == checked_text("id", id))))

    def list(self, limit: int | None = None, status: str | None = None, include_superseded: bool = False) -> DataFrame:
        en.Filters(status=status)
        return en.list_recent(self.entries, checked_limit(limit, 200), status, include_superseded)

    def page(self, created_at: str, id: str, limit: int | None = None) -> DataFrame:
        return en.page_after(self.entries, created_at, id, checked_limit(limit, 200))

    def by_session(self, session_id: str) -> DataFrame:
        return en.list_by_session(self.entries, checked_text("session_id", session_id))

    def by_importance(self, workspace: str | None = None, limit: int | None = None) -> DataFrame:
        return en.list_by_importance(self.entries, workspace, checked_limit(limit, 30))

    # state

    def audit(self, id: str) -> DataFrame:
        """The audit records of a memory, oldest first."""
        return en.audit_log(en.current(self.rows.where(F.col("id") == checked_text("id", id)))).orderBy("position")

    def chain(self, id: str) -> DataFrame:
        return graph.chain_links(self.entries).where(F.col("id") == checked_text("id", id))

    def stats(self) -> DataFrame:
        return en.stats(self.entries)

    def status(self) -> DataFrame:
        """(metric, value) of memories, vectors and edges."""
        s = self.stats()
        rows = s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in s.columns])))
        if self.vectors is not None:
            v = vx.coverage(self.entries, self.vectors)
            rows = rows.unionByName(v.select(F.lit("vector_coverage").alias("metric"), F.col("coverage").alias("value")))
        return rows.unionByName(self.edges.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("edges").alias("metric"), "value"))

    def jaccard(self, a: str, b: str) -> float:
        """Token similarity of two memories; KeyError for unknown ones."""
        rows = {r.id: r.tokens for r in search.with_tokens(self.entries.where(F.col("id").isin(a, b))).select("id", "tokens").collect()}
        one, two = set(rows[a]), set(rows[b])
        return len(one & two) / len(one | two) if one | two else 0.0

    # upkeep

    def reflect(self, newer_than: tuple[str, str] | None = None) -> DataFrame:
        """Memories to review, with peers, in batches."""
        window = similarity.review_window(self.entries).select("id", "workspace", "content", "importance", "created_at")
        held = self.vectors if self.vectors is not None else self.spark.createDataFrame([], sc.struct(sc.VECTOR))
        return similarity.review_candidates(window, similarity.review_pairs(window, held), newer_than)

    def neighbors(self, id: str) -> DataFrame:
        return graph.neighbors(self.edges, checked_text("id", id))

    def accept_edges(self, proposed: DataFrame) -> DataFrame:
        least = graph.confidence_gate(self.edges).first().least_confidence
        return graph.accept(proposed, self.edges, self.entries, float(least))

    def snapshot(self, workspace: str | None = None) -> DataFrame:
        return context.snapshot_pack(self.entries, workspace)

    def context(self, query: str, workspace: str | None = None, seen: DataFrame | None = None) -> DataFrame:
        """The text that a step gets: the best memories that it has not seen, folded, tiered and packed."""
        from pyspark.sql import Window

        filters = {"workspace": workspace} if workspace else {}
        found = self.search(checked_text("query", query), 8, 0.4, **filters)
        ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "id")))  # of 8 rows
        held = context.snapshot(self.entries, workspace).select("id")
        return context.context_pack(ranked, held if seen is None else held.unionByName(seen.select("id")))

    # writes, as operations

    def note(self, rows: DataFrame, by: str = "tool") -> tuple[DataFrame, DataFrame]:
        """(operations, rejected) of new memories (op_id, workspace, kind, content, importance, tags, and if given session_id,
        self_relevance, source).

        The extractor's gate rejects worthless and empty ones.  A memory with the key of an active one
        of its workspace and kind, or of an earlier one of these rows, is merged into that: greatest importance,
        union of event numbers, latest excerpt.  Others are created; those that restate active memories of the last
        30 days supersede them, and name the earliest.  Rows without a source get one of their session and content.
        """
        if by not in ACTORS:
            raise ValueError(f"unknown actor {by!r}")
        for name, kind in (("session_id", "string"), ("self_relevance", "double"), ("source", sc.SOURCE)):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        gated = rows.withColumn("reason", ingest.gate_reason(F.lit(by)))
        rejected = gated.where("reason is not null")
        own = F.struct(F.coalesce("session_id", F.lit("none")).alias("session_id"), F.array().cast("array<bigint>").alias("event_seqs"), excerpt("content").alias("excerpt"))
        key = F.sha2(F.concat_ws("|", F.coalesce("workspace", F.lit("")), F.coalesce("kind", F.lit("")), dedup_key("content")), 256)
        new = gated.where("reason is null").withColumn("source", F.coalesce("source", own.cast(sc.SOURCE))).withColumn("key", key).withColumn("rated", F.when(F.isnan("importance"), 5.0).otherwise(F.coalesce("importance", F.lit(5.0))))
        active = self.entries.where("status = 'active' and content is not null")
        held = active.select(key.alias("key"), F.struct("id", F.when(~F.isnan("importance"), F.col("importance")).alias("importance"), "source").alias("h"), "created_at")
        held = held.join(new.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min_by("h", F.struct("created_at", "h.id")).alias("h"))
        batch = new.groupBy("key").agg(F.min("op_id").alias("first"), F.max("rated").alias("top"), F.min_by("source.session_id", "op_id").alias("origin"))
        numbers = new.select("key", F.explode("source.event_seqs").alias("n")).unionByName(held.select("key", F.explode("h.source.event_seqs").alias("n"))).where("n is not null").distinct()
        joined = new.join(batch, "key").join(held, "key", "left").join(numbers.groupBy("key").agg(F.array_sort(F.collect_list("n")).alias("numbers")), "key", "left")
        at, created = F.lit(self.now).cast("timestamp_ntz"), F.col("h").isNull() & (F.col("op_id") == F.col("first"))
        merged = F.struct(F.coalesce("h.source.session_id", "origin").alias("session_id"), F.coalesce("numbers", F.array().cast("array<bigint>")).alias("event_seqs"), F.col("source.excerpt").alias("excerpt"))
        joined = joined.withColumn("created", created).withColumn("id", F.coalesce("h.id", "key"))
        recent = active.where((F.col("created_at") <= at) & (F.col("created_at") >= at - F.make_dt_interval(F.lit(30))))
        fresh = search.with_tokens(joined.where("created").select("id", "workspace", "kind", "content"))
        found = similarity.matches(fresh, search.with_tokens(recent.select("id", "workspace", "kind", "content", "created_at")), 7, 10, ["workspace", "kind"])
        dated = found.join(recent.select(F.col("id").alias("old_id"), "created_at"), "old_id")
        earliest = dated.groupBy(F.col("new_id").alias("id")).agg(F.min_by("old_id", F.struct("created_at", "old_id")).alias("earliest"))
        only = lambda c: F.when(F.col("created"), F.col(c))
        given = {
            "op_id": F.col("op_id"), "id": F.col("id"), "op": F.when(F.col("created"), "create").otherwise("merge"), "at": at, "by": F.lit(by), "importance": F.when(F.col("created"), F.col("rated")).otherwise(F.greatest("top", "h.importance")),
            "source": F.when(F.col("created"), F.col("source")).otherwise(merged.cast(sc.SOURCE)), "supersedes": only("earliest")} | {c: only(c) for c in ("kind", "tags", "content", "workspace", "session_id", "self_relevance")}
        fields = sc.struct(ingest.LOG).fields
        written = joined.join(earliest, "id", "left").select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        back = {"op_id": F.col("op_id"), "id": F.col("old_id"), "op": F.lit("supersede"), "at": at, "by": F.lit(by), "other": F.col("new_id")}
        pointers = found.join(joined.where("created").select(F.col("id").alias("new_id"), "op_id"), "new_id").select(*[back.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        return written.unionByName(pointers), rejected

    def accessed(self, accesses: DataFrame, first: int) -> DataFrame:
        """Operations of accesses (session_id, memory_id, event_id, at), of which a session counts one of a memory a minute."""
        return ingest.access_operations(sessions.throttled(accesses, ["session_id", "memory_id"], "at", "event_id"), first)

    def _operation(self, op_id: int, id: str, op: str, by: str, **fields) -> DataFrame:
        if by not in ACTORS:
            raise ValueError(f"unknown actor {by!r}")
        row = {"op_id": op_id, "id": checked_text("id", id), "op": op, "by": by, **fields}
        names = [f.name for f in sc.struct(ingest.LOG).fields]
        made = self.spark.createDataFrame([tuple(row.get(n) for n in names)], sc.struct(ingest.LOG))
        return made.withColumn("at", F.lit(self.now).cast("timestamp_ntz"))

    def forget(self, op_id: int, id: str, by: str = "tool") -> DataFrame:
        """The operation that archives a memory; memories are never deleted."""
        return self._operation(op_id, id, "archive", by)

    def update(self, op_id: int, id: str, by: str = "tool", **patch) -> DataFrame:
        """The operation that patches kind, importance or tags; a content never changes."""
        if not patch or set(patch) - {"kind", "importance", "tags"}:
            raise ValueError("a patch may have kind, importance and tags")
        if patch.get("kind") not in (None, *en.KINDS):
            raise ValueError(f"unknown kind {patch['kind']!r}")
        if patch.get("importance") is not None and not 0 <= patch["importance"] <= 10:
            raise ValueError("importance must be from 0 to 10")
        return self._operation(op_id, id, "update", by, **patch)

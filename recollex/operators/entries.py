"""The current state of memories, filters, listings, projections and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from recollex.functions.scoring import effective_importance
from recollex.functions.text import micros

#: Order of the rows of one id, the first is current.
VERSION = ("ingested_at", "updated_at", "access_count", "last_access_at", "importance", "status", "superseded_by", "supersedes")
KINDS = ("fact", "preference", "decision", "todo", "insight")
STATUSES = ("active", "archived")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key.  Ranks are limited on the map side (WindowGroupLimit), so a
    key with a third of all rows shuffles one row a task; unused columns are pruned."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def current(rows: DataFrame) -> DataFrame:
    """The current row of each memory; a null id is one key."""
    return latest(rows, ["id"], [F.col(c).desc_nulls_last() for c in VERSION])


def well_formed(source: str = "source") -> Column:
    """Whether provenance names a session, events without nulls, and an excerpt; never null."""
    s = F.col(source)
    good = s["session_id"].isNotNull() & (s["session_id"] != "") & s["event_seqs"].isNotNull() & s["excerpt"].isNotNull() & F.forall(s["event_seqs"], lambda x: x.isNotNull())
    return F.coalesce(good, F.lit(False))


@dataclass(frozen=True)
class Filters:
    """What a search or listing may return; an unset field does not restrict."""

    workspace: str | None = None
    kind: str | None = None
    tag: str | None = None
    status: str | None = None
    include_archived: bool = False
    include_superseded: bool = False

    def __post_init__(self):
        if self.kind is not None and self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")
        if self.status is not None and self.status not in STATUSES:
            raise ValueError(f"unknown status {self.status!r}")

    def condition(self) -> Column:
        statuses = [self.status] if self.status else ["active", "archived"] if self.include_archived else ["active"]
        found = F.col("status").isin(*statuses)
        if not self.include_superseded:
            found &= F.col("superseded_by").isNull()
        if self.workspace is not None:
            found &= F.col("workspace") == self.workspace
        if self.kind is not None:
            found &= F.col("kind") == self.kind
        if self.tag is not None:
            found &= F.array_contains("tags", self.tag)
        return found & well_formed()

    @property
    def any(self) -> bool:
        return any((self.workspace, self.kind, self.tag, self.status))


def candidates(entries: DataFrame, filters: Filters = Filters()) -> DataFrame:
    return entries.where(filters.condition())


def newest_first() -> list[Column]:
    return [F.col("created_at").desc_nulls_last(), F.col("id").desc()]


def browse(entries: DataFrame, filters: Filters, limit: int = 8) -> DataFrame:
    """Newest candidates; none without a filter."""
    return candidates(entries, filters).orderBy(*newest_first()).limit(limit if filters.any else 0)


def list_recent(entries: DataFrame, limit: int, status: str | None = None, include_superseded: bool = False) -> DataFrame:
    """Newest memories; archived ones too when no status is asked for."""
    rows = entries.where(F.col("status") == status) if status else entries
    if not include_superseded:
        rows = rows.where("superseded_by is null")
    return rows.orderBy(*newest_first()).limit(limit)


def page_after(entries: DataFrame, created_at: str, id: str, limit: int = 200) -> DataFrame:
    """The page after a cursor, newest first: keys below (created_at, id)."""
    cursor = F.lit(created_at).cast("timestamp_ntz")
    before = (F.col("created_at") < cursor) | ((F.col("created_at") == cursor) & (F.col("id") < id))
    return entries.where(before).orderBy(*newest_first()).limit(limit)


def list_by_session(entries: DataFrame, session_id: str) -> DataFrame:
    return entries.where(F.col("session_id") == session_id).orderBy(F.col("created_at").asc_nulls_last(), "id")


def list_by_importance(entries: DataFrame, workspace: str | None, limit: int) -> DataFrame:
    """Visible memories by effective importance, then newest."""
    rows = candidates(entries, Filters(workspace=workspace)).withColumn("effective", effective_importance("importance", "access_count", "self_relevance"))
    return rows.orderBy(F.desc("effective"), F.col("created_at").desc_nulls_last(), "id").limit(limit)


def summary_view(entries: DataFrame) -> DataFrame:
    """The nine columns of a summary; tags joined by commas, an importance that is no number null."""
    importance = F.when(~F.isnan("importance"), F.col("importance")).alias("importance")
    return entries.select("id", "workspace", "session_id", "kind", "content", importance, F.array_join("tags", ",").alias("tags"), "status", micros("created_at").alias("created_us"))


def detail_view(entries: DataFrame) -> DataFrame:
    """A summary and its further fields as JSON without those that are null."""
    return summary_view(entries).join(entries.select("id", F.to_json(F.struct(F.when(~F.isnan("self_relevance"), F.col("self_relevance")).alias("self_relevance"), "superseded_by", "supersedes", "access_count", "dedup_key")).alias("detail")), "id")


def validation_errors() -> Column:
    """Names of the fields of a memory that break the schema."""
    bad = {
        "id": F.col("id").isNull() | (F.col("id") == ""),
        "kind": F.col("kind").isNull() | ~F.col("kind").isin(*KINDS),
        "status": F.col("status").isNull() | ~F.col("status").isin(*STATUSES),
        "content": F.col("content").isNull(),
        "importance": F.col("importance").isNull() | F.isnan("importance") | ~F.col("importance").between(0, 10),
        "self_relevance": F.isnan("self_relevance") | ~F.col("self_relevance").between(0, 10),
        "tags": F.col("tags").isNull() | F.exists("tags", lambda t: t.isNull()),
        "source": ~well_formed(),
        "created_at": F.col("created_at").isNull(),
        "updated_at": F.col("updated_at").isNull(),
    }
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in bad.items()]), lambda e: e.isNotNull())


def stats(entries: DataFrame) -> DataFrame:
    """One row: totals, per status, superseded, and per kind over all statuses."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"kind_{k}") for k in KINDS]
    return entries.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"), *kinds)


def facets(entries: DataFrame) -> DataFrame:
    """(facet, value, n): workspaces and tags in use."""
    spaces = entries.select(F.lit("workspace").alias("facet"), F.col("workspace").alias("value"))
    tags = entries.select(F.lit("tag").alias("facet"), F.explode("tags").alias("value"))
    return spaces.unionByName(tags).where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def audit_log(entries: DataFrame) -> DataFrame:
    """One row per audit record, in order; unordered or null audits have no more than their position."""
    rows = entries.select("id", F.posexplode("audit").alias("position", "a"))
    return rows.select("id", "position", "a.action", micros("a.at").alias("at_us"), "a.by", "a.detail")

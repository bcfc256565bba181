"""Queries over session events and the event stream, in their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recollex.functions.text import micros
from recollex.operators import sessions as se
from recollex.plans import sql as S
from recollex.plans.memories import entries
from recollex.sources.tables import table


def events(spark: SparkSession, d: str) -> DataFrame:
    return se.events_once(table(spark, d, "session_events"))


def session_transcript(spark, d):
    return se.transcripts(events(spark, d))


def session_rollup(spark, d):
    return se.session_rollup(entries(spark, d))


def latest_route(spark, d):
    return se.latest_routes(events(spark, d))


def rolling_query(spark, d):
    return se.rolling_queries(events(spark, d))


def compaction_targets(spark, d):
    return se.compaction_targets(events(spark, d))


def turn_batches(spark, d):
    return se.turn_batches(events(spark, d))


def injection_visible(spark, d):
    return se.injection_visible(events(spark, d))


def summary_memories(spark, d):
    return se.summary_memories(events(spark, d))


def closing_memories(spark, d):
    return se.closing_memories(events(spark, d), entries(spark, d))


def access_throttle(spark, d):
    return se.throttled(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", 3600)


def snapshot_rebuilds(spark, d):
    """Cache rebuilds if every event of a session asks for its snapshot and every third one changes the store."""
    rows = events(spark, d).where("event_time is not null").select(F.col("session_id").alias("workspace"), "seq", F.col("event_time").alias("at"), F.floor(F.col("seq") / 3).alias("revision"))
    return se.snapshot_rebuilds(rows)


def ext_tumbling_events(spark, d):
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return rows.select(micros(F.col("w.start").cast("timestamp_ntz")).alias("start_us"), "event_type", "n", "value")


def ext_session_window(spark, d):
    rows = table(spark, d, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", micros(F.col("w.start").cast("timestamp_ntz")).alias("start_us"), "n")


_PREFIX = "[参考记忆]"
_SAID = (
    "said AS (SELECT session_id, seq, array_to_string(list_filter(string_split(text, chr(10) || chr(10)), lambda p: NOT starts_with(regexp_replace(p, '^[\\s\\x{00A0}]+', ''), '" + _PREFIX + "')), chr(10) || chr(10)) AS said FROM once "
    f"WHERE event_type IN ('user/message', 'assistant/message') AND NOT coalesce(source_kind = 'plugin' AND source_plugin = '{se.OWN_PLUGIN}', false) QUALIFY said <> '')".replace("QUALIFY said <> ''", "AND text IS NOT NULL")
)
_SPOKEN = "spoken AS (SELECT * FROM said WHERE said <> '')"
_O = (S.EVENTS, _SAID, _SPOKEN)

QUERIES = {
    "session_transcript": (session_transcript, S.with_(*_O) + f"SELECT session_id, CAST(floor(seq / {se.PART}.0) AS BIGINT) AS part, count(*) AS messages, string_agg(said, chr(10) ORDER BY seq) AS transcript FROM spoken GROUP BY 1, 2"),
    "session_rollup": (session_rollup, S.with_(S.ENTRIES) + "SELECT session_id, count(*) AS memories, count(*) FILTER (WHERE coalesce(list_contains(tags, 'session-summary'), false)) AS summaries FROM entries WHERE session_id IS NOT NULL GROUP BY 1"),
    "latest_route": (latest_route, S.with_(S.EVENTS) + "SELECT session_id, provider, model FROM (SELECT * FROM once WHERE event_type = 'request/header' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) = 1) WHERE provider <> '' AND model <> ''"),
    "rolling_query": (
        rolling_query,
        S.with_(S.EVENTS, "u AS (SELECT * FROM once WHERE event_type = 'user/message' AND source_kind = 'user' AND text <> '')")
        + "SELECT session_id, seq, concat_ws(chr(10), text, lag(substring(text, 1, 100), 1) OVER w, lag(substring(text, 1, 100), 2) OVER w, lag(substring(text, 1, 100), 3) OVER w) AS query FROM u WINDOW w AS (PARTITION BY session_id ORDER BY seq)",
    ),
    "compaction_targets": (
        compaction_targets,
        S.with_(*_O, "sh AS (SELECT DISTINCT session_id, seq AS summary_seq, unnest(shadowed_seqs) AS seq FROM once WHERE event_type = 'compaction/summary')") + "SELECT sh.session_id, summary_seq, sh.seq FROM sh JOIN spoken s ON s.session_id = sh.session_id AND s.seq = sh.seq",
    ),
    "turn_batches": (
        turn_batches,
        S.recursive(
            *_O, "ev AS (SELECT session_id, seq, length(said) + 1 AS chars, false AS e FROM spoken UNION ALL SELECT session_id, seq, 0, true FROM once WHERE event_type = 'turn/end')", "num AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM ev)",
            "fold(session_id, n, b, f, l, c, emitted, ob, of_, ol, oc) AS (SELECT DISTINCT session_id, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, 0::BIGINT, false, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM num UNION ALL "
            "SELECT session_id, n, CASE WHEN emits THEN b + 1 ELSE b END, CASE WHEN emits THEN NULL WHEN e THEN f ELSE coalesce(f, seq) END, CASE WHEN emits THEN NULL WHEN e THEN l ELSE seq END, CASE WHEN emits THEN 0 ELSE c + chars END, emits, b, f, l, c - 1 "
            f"FROM (SELECT num.session_id, num.n, num.seq, num.chars, num.e, b, f, l, c, coalesce(num.e AND f IS NOT NULL AND c - 1 >= {se.EMIT_CHARS}, false) AS emits FROM fold JOIN num ON num.session_id = fold.session_id AND num.n = fold.n + 1))",
        )
        + "SELECT session_id, ob AS batch, of_ AS first_seq, ol AS last_seq, oc AS chars, true AS closed FROM fold WHERE emitted UNION ALL SELECT session_id, b, f, l, c - 1, false FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC) = 1) WHERE f IS NOT NULL",
    ),
    "injection_visible": (
        injection_visible,
        S.with_(S.EVENTS) + f"SELECT session_id, seq, NOT EXISTS (SELECT 1 FROM once c WHERE c.session_id = o.session_id AND c.event_type = 'compaction/summary' AND c.seq > o.seq AND o.seq <= c.shadowed_end) AS visible FROM once o WHERE event_type = 'user/message' AND source_kind = 'plugin' AND source_plugin = '{se.OWN_PLUGIN}'",
    ),
    "summary_memories": (
        summary_memories,
        S.with_(S.EVENTS, f"c AS (SELECT *, CASE WHEN length(text) > 2000 THEN concat(substring(text, 1, 2000), '…[摘要已截断，原文 ', length(text), ' 字符]') ELSE text END AS cut FROM once WHERE event_type = 'compaction/summary' AND trim({S.one_spaced('text')}) <> '')")
        + "SELECT session_id, seq, 'insight' AS kind, concat('会话摘要：', cut) AS content, 7.0::DOUBLE AS importance, 'session-summary' AS tags, coalesce(array_to_string(shadowed_seqs, ','), '') AS event_seqs, substring(cut, 1, 400) AS excerpt FROM c",
    ),
    "closing_memories": (
        closing_memories,
        S.with_(S.ENTRIES, S.EVENTS, "r AS (SELECT session_id, count(*) AS memories, count(*) FILTER (WHERE coalesce(list_contains(tags, 'session-summary'), false)) AS summaries FROM entries GROUP BY 1)", "c AS (SELECT session_id, max(seq) AS seq, arg_max(event_time, seq) AS at_ FROM once WHERE event_type = 'agent/disposed' GROUP BY 1)")
        + "SELECT c.session_id, seq, 'insight' AS kind, concat('会话快照：会话 ', c.session_id, coalesce('（' || strftime(at_, '%Y-%m-%dT%H:%M:%S.%g') || 'Z 结束）', ''), '，期间产生记忆 ', coalesce(memories, 0), ' 条（含会话摘要 ', coalesce(summaries, 0), ' 份）。可用 memory_search kind=insight 检索本会话的摘要内容。') AS content, 5.0::DOUBLE AS importance, 'snapshot' AS tags FROM c LEFT JOIN r ON r.session_id = c.session_id",
    ),
    "access_throttle": (
        access_throttle,
        S.recursive(
            "num AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts), event_id) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL)",
            "fold(user_id, event_type, n, event_id, at_us, last_, kept) AS (SELECT user_id, event_type, n, event_id, at_us, at_us, true FROM num WHERE n = 1 UNION ALL "
            "SELECT num.user_id, num.event_type, num.n, num.event_id, num.at_us, CASE WHEN num.at_us - last_ >= 3600000000 THEN num.at_us ELSE last_ END, num.at_us - last_ >= 3600000000 FROM fold JOIN num ON num.user_id = fold.user_id AND num.event_type = fold.event_type AND num.n = fold.n + 1)",
        )
        + "SELECT user_id, event_type, event_id, at_us FROM fold WHERE kept",
    ),
    "snapshot_rebuilds": (
        snapshot_rebuilds,
        S.recursive(
            S.EVENTS, "num AS (SELECT session_id AS workspace, seq, epoch_us(event_time) AS t, CAST(floor(seq / 3.0) AS BIGINT) AS revision, row_number() OVER (PARTITION BY session_id ORDER BY event_time, seq) AS n FROM once WHERE event_time IS NOT NULL)",
            "fold(workspace, n, seq, built, held, rebuilt) AS (SELECT workspace, n, seq, t, revision, true FROM num WHERE n = 1 UNION ALL "
            "SELECT workspace, n, seq, CASE WHEN again THEN t ELSE built END, CASE WHEN again THEN revision ELSE held END, again FROM (SELECT num.workspace, num.n, num.seq, num.t, num.revision, built, held, num.t - built >= 300000000 OR (num.revision <> held AND num.t - built >= 60000000) AS again FROM fold JOIN num ON num.workspace = fold.workspace AND num.n = fold.n + 1))",
        )
        + "SELECT workspace, seq, rebuilt FROM fold",
    ),
    "ext_tumbling_events": (ext_tumbling_events, "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2"),
    "ext_session_window": (
        ext_session_window,
        "SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, grp",
    ),
}

"""Queries over memories: state, listings, text functions, scores, upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recollex.functions import scoring, text
from recollex.operators import context, entries as en, ingest
from recollex.plans import sql as S
from recollex.sources.tables import table

NOW = S.NOW
#: A repeated memory between two paragraphs, behind every content.
REPEATED = "\n\n \t[参考记忆] an old note\nof two lines\n\nthe end"
E = S.with_(S.ENTRIES)
V = S.with_(S.ENTRIES, S.VISIBLE)


def entries(spark: SparkSession, d: str) -> DataFrame:
    return en.current(table(spark, d, "memory_entries"))


def _first(frame: DataFrame, column: str):
    return frame.agg(F.min(column)).first()[0]


def get_by_id(spark, d):
    """The memory with the least id, by a pushed-down equality."""
    rows = table(spark, d, "memory_entries")
    return en.summary_view(en.current(rows.where(F.col("id") == _first(rows, "id"))))


def candidate_filter(spark, d):
    return en.candidates(entries(spark, d), en.Filters(kind="fact")).select("id", "workspace", "kind")


def source_integrity(spark, d):
    return entries(spark, d).where(~en.well_formed()).select("id", F.col("source").isNull().alias("no_source"))


def schema_validation(spark, d):
    rows = entries(spark, d).select("id", en.validation_errors().alias("e")).where(F.size("e") > 0)
    return rows.select("id", F.array_join("e", ",").alias("errors"))


def summaries(spark, d):
    return en.summary_view(entries(spark, d))


def details(spark, d):
    return en.detail_view(entries(spark, d)).select("id", "detail")


def browse(spark, d):
    return en.browse(entries(spark, d), en.Filters(kind="decision"), 20).select("id", "kind")


def list_recent(spark, d):
    return en.list_recent(entries(spark, d), 200).select("id", "status")


def keyset_page(spark, d):
    return en.page_after(entries(spark, d), "2025-12-01 00:00:00", "8", 200).select("id")


def list_by_session(spark, d):
    rows = table(spark, d, "memory_entries")
    return en.list_by_session(entries(spark, d), _first(rows, "session_id")).select("id", "session_id", "status")


def list_by_importance(spark, d):
    return en.list_by_importance(entries(spark, d), None, 50).select("id", F.round("effective", 6).alias("effective"))


def memory_stats(spark, d):
    return en.stats(entries(spark, d))


def facet_values(spark, d):
    return en.facets(entries(spark, d))


def facet_filter(spark, d):
    rows = entries(spark, d)
    return rows.where(F.col("kind").isin("fact", "todo") & F.arrays_overlap("tags", F.array(F.lit("build"), F.lit("docs")))).select("id", "kind")


def audit_trail(spark, d):
    return en.audit_log(entries(spark, d))


def tokenize_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(text.tokenize("text")), " ").alias("tokens"))


def cjk_bigrams(spark, d):
    return entries(spark, d).select("id", F.array_join(text.cjk_bigrams("content"), ",").alias("bigrams"))


def dedup_key(spark, d):
    return entries(spark, d).select("id", text.dedup_key("content").alias("key"))


def text_forms(spark, d):
    """The cutting and rendering functions over every memory."""
    created = F.col("created_at")
    return entries(spark, d).select(
        "id", text.short_session("session_id").alias("short_session"), text.truncate_latest("content", 100).alias("latest"), text.truncate_sentence("content", 120).alias("sentence"),
        text.cut_with_note("content", 400, "摘录").alias("excerpt"), text.strip_paragraphs(F.concat("content", F.lit(REPEATED))).alias("stripped"),
        text.render_line("kind", "content", F.floor(scoring.safe_importance("importance")), "id", "session_id", created).alias("line"),
        text.render_condensed("kind", "content", "id").alias("condensed"), text.catalog_row("kind", "content", "id").alias("title"))


def prompt_rows(spark, d):
    rows = entries(spark, d).where("content is not null")
    return rows.select("id", text.prompt_row("id", "kind", "content").alias("causal_row"), text.judge_row("focus", "id", "kind", "content").alias("judge_row"))


def truncate_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate_latest("text", 12000).alias("latest"), text.summary("text").alias("summary"))


def normalize_tags(spark, d):
    low = text.normalize_tags("tags")
    rows = en.candidates(entries(spark, d), en.Filters()).where("tags is not null and not exists(tags, t -> t is null)")
    return rows.where(low != F.col("tags")).select("id", F.array_join(low, ",").alias("tags"))


def scores(spark, d):
    rows = entries(spark, d)
    six = lambda c: F.round(c, 6)
    return rows.select(
        "id", six(scoring.half_life_days("importance")).alias("half_life"), six(scoring.half_life_days("importance", "access_count")).alias("modulated_half_life"), six(scoring.importance_factor("importance")).alias("importance_factor"),
        six(scoring.time_importance("importance", "access_count", "created_at", "last_access_at", NOW)).alias("time_importance"), six(scoring.effective_importance("importance", "access_count", "self_relevance")).alias("effective"))


def stale_candidates(spark, d):
    return ingest.stale(entries(spark, d), NOW).select("id")


def decay_coverage(spark, d):
    fresh = F.coalesce(F.timestamp_diff("MICROSECOND", "last_access_at", F.lit(NOW).cast("timestamp_ntz")) <= 90 * scoring.DAY_MICROS, F.lit(False))
    return entries(spark, d).agg(F.count(F.lit(1)).alias("memories"), F.round(F.avg(fresh.cast("int")), 6).alias("coverage"))


def write_gate(spark, d):
    """Memories that the extractor's gate would reject, by reason."""
    return entries(spark, d).select("id", ingest.gate_reason(F.lit("extractor")).alias("reason")).where("reason is not null")


def dedup_probe(spark, d):
    return ingest.duplicate_keys(entries(spark, d))


def dedup_merge(spark, d):
    return ingest.merge_duplicates(entries(spark, d)).select("workspace", "kind", "key", "merged", "id", "importance", "content", "session_id", "excerpt", "event_seqs")


def ingest_fold(spark, d):
    """State of every memory after the operations that its stored versions tell."""
    folded = ingest.fold(ingest.log_of_versions(table(spark, d, "memory_entries"), en.VERSION))
    return folded.select("id", "workspace", "kind", F.when(~F.isnan("importance"), F.col("importance")).alias("importance"), "status", "superseded_by", text.micros("created_at").alias("created_us"), text.micros("updated_at").alias("updated_us"), "actions", "missing")


def snapshot_select(spark, d):
    return context.snapshot(entries(spark, d), None).select("rank", "id", F.round("effective", 6).alias("effective"))


def budget_pack(spark, d):
    return context.snapshot_pack(entries(spark, d), None)


def ext_kind_cube(spark, d):
    return entries(spark, d).cube("kind", "status").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("kind", F.lit("(all)")).alias("kind"), F.coalesce("status", F.lit("(all)")).alias("status"), "n")


def _q(sql: str) -> str:
    return E + sql


_SUMMARY = "SELECT id, workspace, session_id, kind, content, CASE WHEN NOT isnan(importance) THEN importance END AS importance, array_to_string(list_filter(tags, lambda t: t IS NOT NULL), ',') AS tags, status, epoch_us(created_at) AS created_us FROM "
_LINE = "concat('- [', kind, '] ', content, '（重要度 ', CAST(floor({i}) AS BIGINT), '，记忆 #', substring(id, 1, 8), '，来自会话 ', substring(regexp_replace(session_id, '^session-', ''), 1, 8), coalesce('，创建于 ' || strftime(created_at, '%Y-%m-%d'), ''), '）')".format(i=S.IMPORTANCE)


_REPEATED = "concat(content, chr(10), chr(10), ' ', chr(9), '[参考记忆] an old note', chr(10), 'of two lines', chr(10), chr(10), 'the end')"
_STRIPPED = f"array_to_string(list_filter(string_split(CASE WHEN content IS NOT NULL THEN {_REPEATED} END, chr(10) || chr(10)), lambda p: NOT starts_with(regexp_replace(p, '^{S.SPACE}', ''), '[参考记忆]')), chr(10) || chr(10))"


def _sentence(limit: int) -> str:
    whole = f"regexp_extract(substring(content, 1, {limit}), '(?s)^.*[。！？!?.\\n]')"
    return f"CASE WHEN length(content) <= {limit} THEN content WHEN length({whole}) >= {limit // 2} THEN {whole} ELSE substring(content, 1, {limit}) END"


def _latest(column: str, limit: int) -> str:
    return f"CASE WHEN length({column}) <= {limit} THEN {column} WHEN substring(right({column}, {limit}), 1, 1) = chr(10) THEN substring(right({column}, {limit}), 2) ELSE right({column}, {limit}) END"


def _noted(column: str, limit: int, what: str) -> str:
    return f"CASE WHEN length({column}) > {limit} THEN concat(substring({column}, 1, {limit}), '…[{what}已截断，原文 ', length({column}), ' 字符]') ELSE {column} END"


_BAD = {
    "id": "id IS NULL OR id = ''", "kind": "kind IS NULL OR kind NOT IN ('fact', 'preference', 'decision', 'todo', 'insight')", "status": "status IS NULL OR status NOT IN ('active', 'archived')", "content": "content IS NULL",
    "importance": "importance IS NULL OR isnan(importance) OR importance NOT BETWEEN 0 AND 10", "self_relevance": "isnan(self_relevance) OR self_relevance NOT BETWEEN 0 AND 10",
    "tags": "tags IS NULL OR len(list_filter(tags, lambda t: t IS NULL)) > 0", "source": f"NOT {S.WELL_FORMED}", "created_at": "created_at IS NULL", "updated_at": "updated_at IS NULL",
}
_ERRORS = "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in _BAD.items()) + ")"
_MERGE = (
    f"d AS (SELECT *, {S.fnv('normal')} AS key FROM (SELECT *, {S.normal('content')} AS normal FROM entries WHERE status = 'active' AND content IS NOT NULL)), "
    "s AS (SELECT workspace, kind, key, array_to_string(list_sort(list_distinct(list(x))), ',') AS event_seqs FROM (SELECT workspace, kind, key, unnest(source.event_seqs) AS x FROM d) WHERE x IS NOT NULL GROUP BY 1, 2, 3), "
    "g AS (SELECT workspace, kind, key, count(*) AS merged, first(id ORDER BY created_at NULLS FIRST, id) AS id, max(importance) FILTER (WHERE NOT isnan(importance)) AS importance, first(session_id ORDER BY created_at NULLS FIRST, id) AS session_id, first(content ORDER BY created_at NULLS FIRST, id) AS content, first(source.excerpt ORDER BY created_at DESC NULLS LAST, id DESC) AS excerpt FROM d GROUP BY 1, 2, 3)"
)

_DETAIL = ", ".join(
    ["CASE WHEN NOT isnan(self_relevance) THEN '\"self_relevance\":' || CAST(self_relevance AS VARCHAR) END", *[f"'\"{c}\":' || CAST(to_json({c}) AS VARCHAR)" for c in ("superseded_by", "supersedes")], "'\"access_count\":' || CAST(access_count AS VARCHAR)", "'\"dedup_key\":' || CAST(to_json(dedup_key) AS VARCHAR)"])
_RATED = _LINE.replace('session_id,', 'source.session_id,').replace(f"CAST(floor({S.IMPORTANCE}) AS BIGINT)", f"CASE WHEN {S.IMPORTANCE} = floor({S.IMPORTANCE}) THEN CAST(CAST({S.IMPORTANCE} AS BIGINT) AS VARCHAR) ELSE CAST({S.IMPORTANCE} AS VARCHAR) END")
_BUDGET, _HEAD = context.SNAPSHOT_BUDGET, context.HEADER
#: Lines in the order of their rank, each taken if it fits into what is left.
_PACKED = (
    f"lines AS (SELECT row_number() OVER (ORDER BY rank) AS n, id, {_RATED} AS line FROM (SELECT *, row_number() OVER (PARTITION BY source.session_id ORDER BY rank) AS place FROM (SELECT *, row_number() OVER (ORDER BY eff DESC, created_at DESC NULLS LAST, id) AS rank FROM (SELECT *, {S.EFFECTIVE} AS eff FROM visible ORDER BY eff DESC, created_at DESC NULLS LAST, id LIMIT 30))) WHERE place <= 3), "
    f"fit(n, used, kept) AS (SELECT 0::BIGINT, {len(_HEAD) + 1}::BIGINT, false UNION ALL SELECT l.n, f.used + CASE WHEN f.used + length(l.line) + 1 <= {_BUDGET} THEN length(l.line) + 1 ELSE 0 END, coalesce(f.used + length(l.line) + 1 <= {_BUDGET}, false) FROM fit f JOIN lines l ON l.n = f.n + 1), "
    "packed AS (SELECT string_agg(line, chr(10) ORDER BY n) FILTER (WHERE kept) AS body, count(*) FILTER (WHERE NOT kept) AS left_, coalesce(string_agg(id, ',' ORDER BY n) FILTER (WHERE kept), '') AS rendered, coalesce(string_agg(id, ',' ORDER BY n) FILTER (WHERE NOT kept), '') AS skipped FROM fit JOIN lines USING (n))"
)

QUERIES = {
    "get_by_id": (get_by_id, _q(_SUMMARY + "entries WHERE id = (SELECT min(id) FROM memory_entries)")),
    "candidate_filter": (candidate_filter, V + "SELECT id, workspace, kind FROM visible WHERE kind = 'fact'"),
    "source_integrity": (source_integrity, _q(f"SELECT id, source IS NULL AS no_source FROM entries WHERE NOT {S.WELL_FORMED}")),
    "schema_validation": (schema_validation, _q(f"SELECT id, {_ERRORS} AS errors FROM entries WHERE {_ERRORS} <> ''")),
    "summaries": (summaries, _q(_SUMMARY + "entries")),
    "details": (details, _q(f"SELECT id, concat('{{', array_to_string(list_filter([{_DETAIL}], lambda x: x IS NOT NULL), ','), '}}') AS detail FROM entries")),
    "browse": (browse, V + "SELECT id, kind FROM visible WHERE kind = 'decision' ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 20"),
    "list_recent": (list_recent, _q("SELECT id, status FROM entries WHERE superseded_by IS NULL ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 200")),
    "keyset_page": (keyset_page, _q("SELECT id FROM entries WHERE (created_at, id) < (TIMESTAMP '2025-12-01 00:00:00', '8') ORDER BY created_at DESC, id DESC LIMIT 200")),
    "list_by_session": (list_by_session, _q("SELECT id, session_id, status FROM entries WHERE session_id = (SELECT min(session_id) FROM memory_entries)")),
    "list_by_importance": (list_by_importance, V + f"SELECT id, round({S.EFFECTIVE}, 6) AS effective FROM visible ORDER BY {S.EFFECTIVE} DESC, created_at DESC NULLS LAST, id LIMIT 50"),
    "memory_stats": (memory_stats, _q("SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'archived') AS archived, count(*) FILTER (WHERE superseded_by IS NOT NULL) AS superseded, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS kind_{k}" for k in en.KINDS) + " FROM entries")),
    "facet_values": (facet_values, _q("SELECT facet, value, count(*) AS n FROM (SELECT 'workspace' AS facet, workspace AS value FROM entries UNION ALL SELECT 'tag', unnest(tags) FROM entries) WHERE value IS NOT NULL GROUP BY 1, 2")),
    "facet_filter": (facet_filter, _q("SELECT id, kind FROM entries WHERE kind IN ('fact', 'todo') AND list_has_any(tags, ['build', 'docs'])")),
    "audit_trail": (audit_trail, _q("SELECT id, i - 1 AS position, a.\"action\" AS \"action\", epoch_us(a.\"at\") AS at_us, a.\"by\" AS \"by\", a.detail AS detail FROM (SELECT id, unnest(audit) AS a, generate_subscripts(audit, 1) AS i FROM entries)")),
    "tokenize_docs": (tokenize_docs, f"SELECT doc_id, array_to_string(list_sort({S.tokens('text')}), ' ') AS tokens FROM documents"),
    "cjk_bigrams": (cjk_bigrams, _q(f"SELECT id, CASE WHEN content IS NULL THEN NULL ELSE array_to_string({S.bigrams('content')}, ',') END AS bigrams FROM entries")),
    "dedup_key": (dedup_key, _q(f"SELECT id, CASE WHEN normal IS NOT NULL THEN {S.fnv('normal')} END AS key FROM (SELECT id, {S.normal('content')} AS normal FROM entries)")),
    "text_forms": (
        text_forms,
        _q(
            f"SELECT id, substring(regexp_replace(session_id, '^session-', ''), 1, 8) AS short_session, {_latest('content', 100)} AS latest, {_sentence(120)} AS sentence, {_noted('content', 400, '摘录')} AS excerpt, {_STRIPPED} AS stripped, "
            f"CASE WHEN content IS NOT NULL AND session_id IS NOT NULL AND kind IS NOT NULL THEN {_LINE} END AS line, "
            "CASE WHEN content IS NOT NULL AND kind IS NOT NULL THEN concat('- [', kind, '] ', CASE WHEN length(content) > 80 THEN concat(substring(content, 1, 80), '…（原文 ', length(content), ' 字符，记忆 #') ELSE concat(content, '（记忆 #') END, substring(id, 1, 8), '）') END AS condensed, "
            "CASE WHEN content IS NOT NULL AND kind IS NOT NULL THEN concat('- [', kind, '] ', substring(content, 1, 24), '（记忆 #', substring(id, 1, 8), '）') END AS title FROM entries"
        ),
    ),
    "prompt_rows": (prompt_rows, _q(f"SELECT id, concat('#', id, ' [', kind, '] ', {_sentence(200)}) AS causal_row, concat('- focus #', id, ' kind=', kind, ' content=', substring({S.one_spaced('content')}, 1, 200)) AS judge_row FROM entries WHERE content IS NOT NULL")),
    "truncate_documents": (truncate_documents, f"SELECT doc_id, {_latest('text', 12000)} AS latest, {_noted('text', 2000, '摘要')} AS summary FROM documents"),
    "normalize_tags": (
        normalize_tags,
        V + "SELECT id, array_to_string(low, ',') AS tags FROM (SELECT id, tags, list_transform(list_filter(range(1, len(tags) + 1), lambda i: list_position(list_transform(tags, lambda t: lower(t)), lower(tags[i])) = i), lambda i: lower(tags[i])) AS low FROM visible WHERE tags IS NOT NULL AND len(list_filter(tags, lambda t: t IS NULL)) = 0) WHERE low <> tags",
    ),
    "scores": (scores, _q(f"SELECT id, round(7 * pow(2.0, ({S.IMPORTANCE} - 5) / 2), 6) AS half_life, round({S.HALF_LIFE}, 6) AS modulated_half_life, round(0.5 + {S.IMPORTANCE} / 20, 6) AS importance_factor, round({S.TIME}, 6) AS time_importance, round({S.EFFECTIVE}, 6) AS effective FROM entries")),
    "stale_candidates": (stale_candidates, _q(f"SELECT id FROM entries WHERE status = 'active' AND superseded_by IS NULL AND access_count = 0 AND NOT isnan(importance) AND importance <= 5 AND updated_at <= TIMESTAMP '{NOW}' - INTERVAL 90 DAY")),
    "decay_coverage": (decay_coverage, _q(f"SELECT count(*) AS memories, round(avg(CASE WHEN {S.days('last_access_at')} <= 90 THEN 1 ELSE 0 END), 6) AS coverage FROM entries")),
    "write_gate": (write_gate, _q(f"SELECT id, reason FROM (SELECT id, CASE WHEN coalesce(CASE WHEN isnan(importance) THEN 5.0 ELSE importance END, 5.0) < 1 THEN 'worthless' WHEN len({S.tokens('content')}) < 2 THEN 'noise' END AS reason FROM entries) WHERE reason IS NOT NULL")),
    "dedup_probe": (dedup_probe, S.with_(S.ENTRIES, _MERGE) + "SELECT workspace, kind, key, merged AS n, id AS first_id FROM g WHERE merged > 1"),
    "dedup_merge": (dedup_merge, S.with_(S.ENTRIES, _MERGE) + "SELECT g.workspace, g.kind, g.key, merged, id, importance, content, session_id, excerpt, coalesce(event_seqs, '') AS event_seqs FROM g LEFT JOIN s ON g.workspace IS NOT DISTINCT FROM s.workspace AND g.kind IS NOT DISTINCT FROM s.kind AND g.key = s.key"),
    "ingest_fold": (
        ingest_fold,
        f"WITH v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {', '.join(c + ' ASC NULLS FIRST' for c in en.VERSION)}) AS v FROM memory_entries WHERE id IS NOT NULL) "
        "SELECT id, first(workspace ORDER BY v) AS workspace, first(kind ORDER BY v DESC) FILTER (WHERE kind IS NOT NULL) AS kind, first(CASE WHEN NOT isnan(importance) THEN importance END ORDER BY v DESC) FILTER (WHERE importance IS NOT NULL) AS importance, CASE WHEN bool_or(status = 'archived') THEN 'archived' ELSE 'active' END AS status, "
        "first(superseded_by ORDER BY v DESC) FILTER (WHERE superseded_by IS NOT NULL) AS superseded_by, epoch_us(first(created_at ORDER BY v)) AS created_us, "
        "epoch_us(first(CASE WHEN v = 1 AND coalesce(status <> 'archived', true) AND superseded_by IS NULL THEN created_at ELSE coalesce(updated_at, created_at) END ORDER BY v DESC)) AS updated_us, "
        "count(*) + count(*) FILTER (WHERE status = 'archived') + count(*) FILTER (WHERE superseded_by IS NOT NULL) AS actions, 0 AS missing FROM v GROUP BY id",
    ),
    "snapshot_select": (
        snapshot_select,
        V + f"SELECT rank, id, effective FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY rank) AS place FROM (SELECT row_number() OVER (ORDER BY eff DESC, created_at DESC NULLS LAST, id) AS rank, id, round(eff, 6) AS effective, sid FROM (SELECT *, {S.EFFECTIVE} AS eff, source.session_id AS sid FROM visible ORDER BY eff DESC, created_at DESC NULLS LAST, id LIMIT 30))) WHERE place <= 3",
    ),
    "budget_pack": (
        budget_pack,
        S.recursive(S.ENTRIES, S.VISIBLE, _PACKED) + f"SELECT concat('{_HEAD}', chr(10), body, CASE WHEN left_ > 0 THEN concat(chr(10), '（另有 ', left_, ' 条高重要度记忆未入快照，可用 memory_recall 检索）') ELSE '' END) AS text, rendered, skipped FROM packed WHERE rendered <> ''",
    ),
    "ext_kind_cube": (ext_kind_cube, _q("SELECT coalesce(kind, '(all)') AS kind, coalesce(status, '(all)') AS status, count(*) AS n FROM entries GROUP BY CUBE (kind, status)")),
}

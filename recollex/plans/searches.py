"""Queries that search: keywords, vectors, both, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from recollex.functions import scoring
from recollex.operators import context, entries as en, search, vectors as vx
from recollex.plans import sql as S
from recollex.plans.memories import entries
from recollex.sources.tables import table

NOW = S.NOW
#: The searches of the test queries.
SEARCHES = {
    "q1": "reply in short paragraphs about the cached dashboard", "q2": "root cause of the shared window", "q3": "prefer the nightly pipeline over redundant tokens",
    "q4": "数据组 发布 队列", "q5": "agreed budget per token catalog",
}
QUERY = SEARCHES["q2"]
DIM = 128


def visible(spark: SparkSession, d: str) -> DataFrame:
    return en.candidates(entries(spark, d))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return vx.current_vectors(table(spark, d, "memory_vectors"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    """The usable vector of the least memory id; none if the table has none."""
    row = vectors(spark, d).where((F.col("dim") == DIM) & scoring.usable_vector("embedding", "dim")).orderBy("memory_id").select("embedding").first()
    return [float(x) for x in row[0]] if row else [1.0] + [0.0] * (DIM - 1)


def doc_freq(spark, d):
    rows = search.with_tokens(visible(spark, d)).select(F.explode(F.array_intersect("tokens", F.array(*[F.lit(t) for q in SEARCHES.values() for t in search.query_tokens(q)]))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def bm25_idf(spark, d):
    n = visible(spark, d).count()
    return doc_freq(spark, d).select("token", "df", F.round(scoring.bm25_idf(F.lit(n), "df"), 6).alias("idf"))


def keyword_rank(spark, d):
    return search.keyword_ranks(visible(spark, d), QUERY).select("id", F.round("hits", 6).alias("hits"), "keyword_rank")


def keyword_search(spark, d):
    return search.keyword_searches(visible(spark, d), SEARCHES, NOW).select("query", "rank", "id", F.round("relevance", 6).alias("relevance"), F.round("score", 6).alias("score"))


def vector_knn(spark, d):
    return search.knn(vectors(spark, d), _query_vector(spark, d), 50).select("id", "cosine", "semantic_rank")


def hybrid_search(spark, d):
    return search.hybrid_search(visible(spark, d), vectors(spark, d), QUERY, _query_vector(spark, d), NOW, limit=20).select("id", F.round("relevance", 6).alias("relevance"), F.round("score", 6).alias("score"))


def recall_at_k(spark, d):
    """Whether the 20 most important memories are among the first 5 for their own words."""
    targets = search.with_tokens(en.list_by_importance(entries(spark, d), None, 20)).select(F.col("id").alias("query"), F.explode("tokens").alias("token"))
    found = search.matched_searches(visible(spark, d), targets, NOW, limit=5, min_score=0.0)
    asked = targets.agg(F.countDistinct("query").alias("searches"))
    hits = found.agg(F.count_if(F.col("query") == F.col("id")).alias("hits"), F.countDistinct("query").alias("answered"), F.countDistinct("id").alias("retrieved"))
    return asked.join(F.broadcast(hits)).select("searches", F.round(F.try_divide("hits", "searches"), 6).alias("recall"), F.round(F.try_divide("answered", "searches"), 6).alias("answered"), "retrieved")  # one row each


def recall_minus_snapshot(spark, d):
    """Search results that are not in the snapshot already."""
    found = search.keyword_searches(visible(spark, d), SEARCHES, NOW)
    return found.join(context.snapshot(entries(spark, d), None).select("id"), "id", "left_anti").select("query", "id")


def context_pack(spark, d):
    found = search.keyword_search(visible(spark, d), SEARCHES["q1"], NOW)
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "id")))  # of 8 rows
    return context.context_pack(ranked, context.snapshot(entries(spark, d), None), budget=1200)


def pack_counts(spark, d):
    found = search.keyword_search(visible(spark, d), SEARCHES["q1"], NOW)
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "id")))  # of 8 rows
    return context.pack_counts(ranked, ranked.where("rank = 1"), context.snapshot(entries(spark, d), None), budget=1200)


def render_catalog(spark, d):
    """The catalog of the snapshot's memories."""
    rows = context.tiered_lines(context.snapshot(entries(spark, d), None).withColumn("relevance", F.lit(0.5)))
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "title"))), lambda i: i["title"]).alias("t")).select(context.catalog("t").alias("catalog"))


def vector_missing(spark, d):
    return vx.missing(entries(spark, d), vectors(spark, d)).select("id")


def vector_coverage(spark, d):
    return vx.coverage(entries(spark, d), vectors(spark, d))


def vector_cleanup(spark, d):
    return vx.cleanup(vectors(spark, d), entries(spark, d)).select("memory_id", "dim")


def vector_migrate(spark, d):
    return vx.migrate(vectors(spark, d), entries(spark, d), 48)


def backfill_plan(spark, d):
    return vx.backfill_plan(entries(spark, d), vectors(spark, d))


def adaptive_semantic_threshold(spark, d):
    return vx.coverage(entries(spark, d), vectors(spark, d)).select("coverage", scoring.adaptive_semantic_threshold("coverage").cast("double").alias("threshold"))


_VALUES = ", ".join(f"('{q}', '{t}')" for q, text in SEARCHES.items() for t in search.query_tokens(text))
_SEARCH = (
    f"cand AS (SELECT *, {S.tokens('content')} AS tk, {S.TIME} AS tif FROM visible), q(query, token) AS (VALUES {_VALUES}), n AS (SELECT count(*) AS n FROM cand), "
    "df AS (SELECT token, count(*) AS df FROM (SELECT unnest(tk) AS token FROM cand) WHERE token IN (SELECT token FROM q) GROUP BY 1), "
    "idf AS (SELECT token, df, greatest(0.0, ln((n - df + 0.5) / (df + 0.5) + 1)) AS idf FROM df, n), whole AS (SELECT query, sum(idf) AS w FROM q JOIN idf USING (token) GROUP BY 1), "
    "rel AS (SELECT query, id, sum(idf) / any_value(w) AS relevance, sum(idf) / any_value(w) * any_value(tif) AS score FROM q JOIN idf USING (token) JOIN whole USING (query) JOIN (SELECT id, tif, unnest(tk) AS token FROM cand) c USING (token) GROUP BY 1, 2), "
    "found AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM rel WHERE relevance >= 0.3 QUALIFY rank <= 8)"
)
_TOKENS = search.query_tokens(QUERY)
_HITS = "round((" + " + ".join(f"list_contains(tk, '{t}')::INT" for t in _TOKENS) + f") / {len(_TOKENS)}.0, 9)"
_WORDS = f"words AS (SELECT id, hits, row_number() OVER (ORDER BY hits DESC, id) AS keyword_rank FROM (SELECT id, {_HITS} AS hits FROM (SELECT id, {S.tokens('content')} AS tk FROM visible)) WHERE hits >= 0.3)"
_TARGET = f"target AS (SELECT embedding AS e FROM current_vectors WHERE dim = {DIM} AND {S.usable()} ORDER BY memory_id LIMIT 1)"


def _near(k: int) -> str:
    return f"near AS (SELECT *, row_number() OVER (ORDER BY cosine DESC, id) AS semantic_rank FROM (SELECT memory_id AS id, round({S.cosine('embedding', 'e')}, 6) AS cosine FROM current_vectors, target WHERE dim = {DIM} AND {S.usable()}) WHERE cosine > 0 ORDER BY cosine DESC, id LIMIT {k})"


_SNAPSHOT = f"snap AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY sid ORDER BY eff DESC, created_at DESC NULLS LAST, id) AS place FROM (SELECT *, {S.EFFECTIVE} AS eff, source.session_id AS sid FROM visible ORDER BY eff DESC, created_at DESC NULLS LAST, id LIMIT 30)) WHERE place <= 3)"
_V = (S.ENTRIES, S.VISIBLE)
_HELD = f"held AS (SELECT DISTINCT memory_id FROM current_vectors WHERE {S.usable()})"
_COVERAGE = "cov AS (SELECT count(*) AS memories, count(memory_id) AS with_vector, round(count(memory_id) / count(*), 6) AS coverage FROM shown LEFT JOIN held ON id = memory_id)"
_X = (S.ENTRIES, S.SHOWN, S.VECTORS, _HELD)

QUERIES = {
    "doc_freq": (doc_freq, S.with_(*_V, _SEARCH) + "SELECT token, df FROM df"),
    "bm25_idf": (bm25_idf, S.with_(*_V, _SEARCH) + "SELECT token, df, round(idf, 6) AS idf FROM idf"),
    "keyword_rank": (keyword_rank, S.with_(*_V, _WORDS) + "SELECT id, round(hits, 6) AS hits, keyword_rank FROM words"),
    "keyword_search": (keyword_search, S.with_(*_V, _SEARCH) + "SELECT query, rank, id, round(relevance, 6) AS relevance, round(score, 6) AS score FROM found"),
    "vector_knn": (vector_knn, S.with_(S.VECTORS, _TARGET, _near(50)) + "SELECT id, cosine, semantic_rank FROM near"),
    "hybrid_search": (
        hybrid_search,
        S.with_(*_V, S.VECTORS, _TARGET, _WORDS, _near(400), "fused AS (SELECT coalesce(w.id, s.id) AS id, (coalesce(1.0 / (60 + keyword_rank), 0) + coalesce(1.0 / (60 + semantic_rank), 0)) / (2.0 / 61) AS relevance FROM words w FULL JOIN near s ON w.id = s.id)")
        + f"SELECT id, round(relevance, 6) AS relevance, round(score, 6) AS score FROM (SELECT v.id, relevance, relevance * tif AS score FROM (SELECT *, {S.TIME} AS tif FROM visible) v JOIN fused f ON v.id = f.id WHERE relevance >= 0.15) ORDER BY round(score, 9) DESC, id LIMIT 20",
    ),
    "recall_at_k": (
        recall_at_k,
        S.with_(
            *_V, f"cand AS (SELECT *, {S.tokens('content')} AS tk, {S.TIME} AS tif FROM visible)", f"top AS (SELECT id, tk FROM (SELECT *, {S.EFFECTIVE} AS eff FROM cand ORDER BY eff DESC, created_at DESC NULLS LAST, id LIMIT 20))", "q AS (SELECT id AS query, unnest(tk) AS token FROM top)",
            "post AS (SELECT id, tif, unnest(tk) AS token FROM cand)", "idf AS (SELECT token, greatest(0.0, ln(((SELECT count(*) FROM cand) - count(*) + 0.5) / (count(*) + 0.5) + 1)) AS idf FROM post WHERE token IN (SELECT token FROM q) GROUP BY 1)",
            "whole AS (SELECT query, sum(idf) AS w FROM q JOIN idf USING (token) GROUP BY 1)", "rel AS (SELECT query, id, sum(idf) / any_value(w) AS relevance, sum(idf) / any_value(w) * any_value(tif) AS score FROM q JOIN idf USING (token) JOIN whole USING (query) JOIN post USING (token) GROUP BY 1, 2)",
            "found AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM rel WHERE relevance >= 0.3 QUALIFY rank <= 5)", "n AS (SELECT count(DISTINCT query) AS searches FROM q)",
        )
        + "SELECT any_value(searches) AS searches, round(count(*) FILTER (WHERE query = id) / any_value(searches), 6) AS recall, round(count(DISTINCT query) / any_value(searches), 6) AS answered, count(DISTINCT id) AS retrieved FROM found, n",
    ),
    "recall_minus_snapshot": (recall_minus_snapshot, S.with_(*_V, _SEARCH, _SNAPSHOT) + "SELECT query, id FROM found WHERE id NOT IN (SELECT id FROM snap)"),
    "context_pack": (context_pack, None),
    "pack_counts": (pack_counts, None),
    "render_catalog": (
        render_catalog,
        S.with_(*_V, _SNAPSHOT, f"t AS (SELECT string_agg(concat('- [', kind, '] ', substring(content, 1, 24), '（记忆 #', substring(id, 1, 8), '）'), chr(10) ORDER BY {S.EFFECTIVE} DESC, created_at DESC NULLS LAST, id) FILTER (WHERE content IS NOT NULL) AS titles FROM visible WHERE id IN (SELECT id FROM snap))", "c AS (SELECT concat(chr(10), '## 未展示的记忆目录（可 memory_recall 检索）', chr(10), titles) AS c FROM t)")
        + "SELECT CASE WHEN length(c) > 1500 THEN concat(substring(c, 1, 1500), chr(10), '（目录截断，可用 memory_recall 检索更多）') ELSE c END AS catalog FROM c",
    ),
    "vector_missing": (vector_missing, S.with_(*_X) + "SELECT id FROM shown WHERE id NOT IN (SELECT memory_id FROM held)"),
    "vector_coverage": (vector_coverage, S.with_(*_X, _COVERAGE) + "SELECT * FROM cov"),
    "vector_cleanup": (vector_cleanup, S.with_(*_X) + "SELECT memory_id, dim FROM current_vectors WHERE memory_id IN (SELECT id FROM shown)"),
    "vector_migrate": (
        vector_migrate,
        S.with_(S.ENTRIES, S.VECTORS) + f"SELECT memory_id, CASE WHEN outcome = 'moved' THEN workspace END AS workspace, outcome FROM (SELECT v.memory_id, e.workspace, CASE WHEN NOT {S.usable('48', 'v.embedding')} THEN 'unusable' WHEN e.id IS NULL THEN 'unknown' ELSE 'moved' END AS outcome FROM current_vectors v LEFT JOIN entries e ON e.id = v.memory_id)",
    ),
    "backfill_plan": (
        backfill_plan,
        S.with_(*_X) + "SELECT id, place // 128 AS batch, place % 128 AS position FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id DESC) - 1 AS place FROM shown WHERE id NOT IN (SELECT memory_id FROM held)) WHERE place < 512",
    ),
    "adaptive_semantic_threshold": (adaptive_semantic_threshold, S.with_(*_X, _COVERAGE) + "SELECT coverage, CAST(CASE WHEN coverage < 0.1 THEN 0.68 WHEN coverage <= 0.3 THEN 0.70 ELSE 0.75 END AS DOUBLE) AS threshold FROM cov"),
}

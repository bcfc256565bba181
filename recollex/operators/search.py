"""Keyword, vector and hybrid search.

A search knows its query: document frequencies of its few tokens are one aggregate
whose result is as small as the query, and scores are then plain expressions over
one scan that ends in a top-k.  Many queries share one scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from recollex.functions.scoring import bm25_idf, cosine, idf_value, rrf, time_importance, usable_vector
from recollex.functions.text import tokenize
from recollex.operators.ranking import global_rank

#: Relevance below which keywords do not count, and the default least score.  Fixed values.
RELEVANCE_FLOOR, MIN_SCORE, LIMIT = 0.3, 0.15, 8


def query_tokens(text: str) -> list[str]:
    """The tokens of a query, as `tokenize` gives them."""
    found = re.findall("[a-z0-9]+", text.lower())
    for run in re.findall("[㐀-䶿一-鿿]+", text):
        found += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return list(dict.fromkeys(found))


def with_tokens(entries: DataFrame) -> DataFrame:
    """Entries with their tokens; keep the result as a table when many searches follow."""
    return entries if "tokens" in entries.columns else entries.withColumn("tokens", tokenize("content"))


@dataclass(frozen=True)
class Frequencies:
    """Of a candidate set: its size and the document frequency of each query token."""

    n: int
    df: dict[str, int]

    def idf(self) -> dict[str, float]:
        return {t: idf_value(self.n, d) for t, d in self.df.items() if d > 0}


def frequencies(candidates: DataFrame, tokens: list[str]) -> Frequencies:
    """One aggregate with one sum per query token: its row is all that reaches the driver."""
    sums = [F.count_if(F.array_contains("tokens", t)).alias(f"t{i}") for i, t in enumerate(tokens)]
    row = with_tokens(candidates).agg(F.count(F.lit(1)).alias("n"), *sums).first()
    return Frequencies(row["n"], {t: row[f"t{i}"] for i, t in enumerate(tokens)})


def relevance(known: Frequencies, tokens: list[str]) -> Column:
    """IDF of the tokens that a memory has, as part of that of all tokens that any candidate has."""
    idf = {t: v for t, v in known.idf().items() if t in tokens}
    whole = sum(idf.values())
    if whole <= 0:
        return F.lit(0.0)
    return sum((F.when(F.array_contains("tokens", t), v).otherwise(0.0) for t, v in idf.items()), F.lit(0.0)) / whole


def hit_ratio(tokens: list[str]) -> Column:
    if not tokens:
        return F.lit(0.0)
    return sum((F.array_contains("tokens", t).cast("int") for t in tokens), F.lit(0)) / len(tokens)


def _time(now: str) -> Column:
    return time_importance("importance", "access_count", "created_at", "last_access_at", now)


def keyword_scores(candidates: DataFrame, query: str, now: str, min_score: float = MIN_SCORE) -> DataFrame:
    """Candidates with relevance (at least 0.3 and `min_score`) and score = relevance * time and importance."""
    rows, tokens = with_tokens(candidates), query_tokens(query)
    scored = rows.withColumn("relevance", relevance(frequencies(rows, tokens), tokens))
    return scored.where(F.col("relevance") >= max(RELEVANCE_FLOOR, min_score)).withColumn("score", F.col("relevance") * _time(now))


def keyword_search(candidates: DataFrame, query: str, now: str, limit: int = LIMIT, min_score: float = MIN_SCORE) -> DataFrame:
    return keyword_scores(candidates, query, now, min_score).orderBy(F.round("score", 9).desc(), "id").limit(limit)


def keyword_searches(candidates: DataFrame, queries: dict[str, str], now: str, limit: int = LIMIT, min_score: float = MIN_SCORE) -> DataFrame:
    """(query, rank, ...) of several searches over one scan: relevances of all queries are columns of
    it, and a grouped top-k keeps `limit` rows a query and task before the only shuffle."""
    rows = with_tokens(candidates)
    tokens = {q: query_tokens(text) for q, text in queries.items()}
    known = frequencies(rows, sorted({t for ts in tokens.values() for t in ts}))
    hits = F.array(*[F.struct(F.lit(q).alias("query"), relevance(known, ts).alias("relevance")) for q, ts in tokens.items()])
    least = max(RELEVANCE_FLOOR, min_score)
    kept = rows.withColumn("hit", F.explode(F.filter(hits, lambda h: h["relevance"] >= least))).select("hit.*", *candidates.columns)
    scored = kept.withColumn("score", F.col("relevance") * _time(now))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "id")))
    return ranked.where(F.col("rank") <= limit)


def matched_searches(candidates: DataFrame, queries: DataFrame, now: str, limit: int = LIMIT, min_score: float = MIN_SCORE) -> DataFrame:
    """(query, rank, id, relevance, score) of many or long searches, as rows (query, token) of which there may be any number:
    the tokens of candidates that a query has are joined with them, so no plan grows with the queries."""
    rows = with_tokens(candidates)
    asked = queries.select("query", "token").distinct()
    posts = rows.select("id", F.explode("tokens").alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    known = posts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("token", bm25_idf("n", "df").alias("idf"))  # n is one row
    weighed = asked.join(known, "token")
    whole = weighed.groupBy("query").agg(F.sum("idf").alias("whole"))
    hits = posts.join(weighed, "token").groupBy("query", "id").agg(F.sum("idf").alias("part")).join(whole, "query")
    found = hits.withColumn("relevance", F.col("part") / F.col("whole")).where(F.col("relevance") >= max(RELEVANCE_FLOOR, min_score)).select("query", "id", "relevance")
    scored = found.join(rows.select("id", _time(now).alias("time")), "id").withColumn("score", F.col("relevance") * F.col("time")).drop("time")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "id")))
    return ranked.where(F.col("rank") <= limit).select("query", "rank", "id", "relevance", "score")


def keyword_ranks(candidates: DataFrame, query: str) -> DataFrame:
    """(id, hits, keyword_rank) by plain hit ratio of at least 0.3, ranked over all tasks."""
    rows = with_tokens(candidates).select("id", F.round(hit_ratio(query_tokens(query)), 9).alias("hits")).where(F.col("hits") >= RELEVANCE_FLOOR)
    return global_rank(rows, "keyword_rank", F.desc("hits"), F.col("id").asc())


def knn_width(limit: int | None) -> int:
    return max((limit or 50) * 8, 50)


def knn(vectors: DataFrame, query: list[float], k: int, workspace: str | None = None) -> DataFrame:
    """(id, cosine, semantic_rank): the k most similar usable vectors with a positive cosine, by a top-k of one scan."""
    rows = vectors.where(F.col("workspace") == workspace) if workspace is not None else vectors
    target = F.array(*[F.lit(float(x)) for x in query])
    near = rows.where((F.col("dim") == len(query)) & usable_vector("embedding", "dim")).select(F.col("memory_id").alias("id"), F.round(cosine("embedding", target), 6).alias("cosine"))
    top = near.where("cosine > 0").orderBy(F.desc("cosine"), "id").limit(k)
    return top.withColumn("semantic_rank", F.row_number().over(Window.orderBy(F.desc("cosine"), "id")))


def hybrid_search(candidates: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], now: str, limit: int = LIMIT, min_score: float = MIN_SCORE, workspace: str | None = None, raw_limit: int | None = None) -> DataFrame:
    """Ranks by hit ratio and by cosine, fused; fused scores below `min_score` go, the others are
    weighed by time and importance.  Ranks of vectors are those before other filters, so gaps stay.
    """
    words = keyword_ranks(candidates, query)
    near = knn(vectors, query_vector, knn_width(raw_limit), workspace)
    ranks = words.select("id", "keyword_rank").join(near.select("id", "semantic_rank"), "id", "full")
    fused = ranks.withColumn("relevance", rrf("keyword_rank", "semantic_rank")).where(F.col("relevance") >= min_score)
    scored = candidates.join(fused, "id").withColumn("score", F.col("relevance") * _time(now))
    return scored.orderBy(F.round("score", 9).desc(), "id").limit(limit)

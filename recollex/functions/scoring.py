"""Scores over columns: relevance, decay, importance, fusion, similarity, thresholds.

Importance that is null or NaN counts as the default 5 and is clamped to 0..10;
null counts count as 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from recollex.functions.text import ColumnOrName, _c

DAY_MICROS = 86_400_000_000
#: Reciprocal-rank constant.  Fixed value.
RRF_K = 60


def safe_importance(importance: ColumnOrName) -> Column:
    i = _c(importance)
    return F.least(F.greatest(F.when(i.isNull() | F.isnan(i), F.lit(5.0)).otherwise(i), F.lit(0.0)), F.lit(10.0))


def bm25_idf(n: ColumnOrName, df: ColumnOrName) -> Column:
    return F.greatest(F.lit(0.0), F.log((_c(n) - _c(df) + 0.5) / (_c(df) + 0.5) + 1))


def idf_value(n: int, df: int) -> float:
    """`bm25_idf` of numbers the driver has."""
    return max(0.0, math.log((n - df + 0.5) / (df + 0.5) + 1))


def half_life_days(importance: ColumnOrName, access_count: ColumnOrName | None = None) -> Column:
    """Half-life of a memory: 7 days at importance 5, doubled by each 2 of importance, and grown by accesses."""
    days = 7 * F.pow(F.lit(2.0), (safe_importance(importance) - 5) / 2)
    return days if access_count is None else days * (1 + F.log2(1 + accesses(access_count)))


def accesses(count: ColumnOrName) -> Column:
    return F.greatest(F.lit(0.0), F.floor(F.coalesce(_c(count), F.lit(0))).cast("double"))


def age_days(timestamp: ColumnOrName, now: str) -> Column:
    """Days from a timestamp to `now`, negative for later ones."""
    return F.timestamp_diff("MICROSECOND", _c(timestamp), F.lit(now).cast("timestamp_ntz")) / DAY_MICROS


def recency(half_life: Column, days: Column) -> Column:
    """1 for no, unknown or negative age, 0.5 after one half-life."""
    return F.when(days.isNull() | (days <= 0), F.lit(1.0)).otherwise(F.exp(-math.log(2) / half_life * days))


def importance_factor(importance: ColumnOrName) -> Column:
    return 0.5 + safe_importance(importance) / 20


def time_importance(importance: ColumnOrName, access_count: ColumnOrName, created_at: ColumnOrName, last_access_at: ColumnOrName, now: str) -> Column:
    """Factor of time and importance.  Age counts from the last access; the recency of important
    memories that were accessed or created within 90 days is 0.5 at least."""
    r = recency(half_life_days(importance, access_count), age_days(last_access_at, now))
    kept = (safe_importance(importance) >= 8) & ((age_days(last_access_at, now) <= 90) | (age_days(created_at, now) <= 90))
    return (0.6 + 0.4 * F.when(kept, F.greatest(r, F.lit(0.5))).otherwise(r)) * importance_factor(importance)


def effective_importance(importance: ColumnOrName, access_count: ColumnOrName, self_relevance: ColumnOrName) -> Column:
    """Importance for retention: up to 2 more for accesses and for relevance to the self."""
    s = _c(self_relevance)
    bonus = F.when(s >= 8, 2).when(s >= 6, 1).otherwise(0)
    return F.least(F.greatest(safe_importance(importance) + F.least(F.lit(2.0), F.floor(F.log2(1 + accesses(access_count)))) + bonus, F.lit(0.0)), F.lit(10.0))


def rrf(rank: ColumnOrName, other_rank: ColumnOrName) -> Column:
    """Reciprocal-rank fusion of two ranks, 1 if both are first; a null rank adds nothing."""
    part = lambda r: F.coalesce(F.lit(1.0) / (RRF_K + _c(r)), F.lit(0.0))
    return (part(rank) + part(other_rank)) / (2 / (RRF_K + 1))


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Cosine of vectors of one length; 0 if one has no length, null for different lengths."""
    whole = F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))
    return F.when(F.size(_c(a)) == F.size(_c(b)), whole)


def cosine_of_shorter(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Cosine over the length of the shorter vector."""
    n = F.least(F.size(_c(a)), F.size(_c(b)))
    return cosine(F.slice(_c(a), 1, n), F.slice(_c(b), 1, n))


def usable_vector(vector: ColumnOrName, dim: ColumnOrName) -> Column:
    """Whether a vector has the stated length, only finite numbers, and not all are zero."""
    v = _c(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == _c(dim)) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def semantic_threshold(dim: ColumnOrName) -> Column:
    return F.when(_c(dim) == 384, 0.72).otherwise(0.75)


def adaptive_semantic_threshold(hit_rate: ColumnOrName) -> Column:
    return F.when(_c(hit_rate) < 0.1, 0.68).when(_c(hit_rate) <= 0.3, 0.70).otherwise(0.75)


def adaptive_confidence(low: ColumnOrName, mid: ColumnOrName) -> Column:
    """The least confidence of an edge from how many lie below 0.55 and in 0.55..0.75."""
    l, m = _c(low), _c(mid)
    return F.when((l > 1.5 * m) & (l > 3), 0.5).when((m > l) & (m > 3), 0.6).otherwise(0.55)


def jaccard(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Shared part of the union of two token arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(_c(a), _c(b))), F.size(F.array_union(_c(a), _c(b)))), F.lit(0.0))

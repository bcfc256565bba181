"""Consolidating pairwise links into groups by hash-to-min.

Every vertex v keeps a cluster set C(v), at first itself and its neighbours.  In
a round v sends C(v) to the least member m of C(v), and {m} to every member; the
new C(v) is the union of what v received.  When nothing changes, the least vertex
of a component holds the whole component and every other vertex holds only it.

A cluster set is never collected: it is stored as rows (v, u), so the set of a
component with a third of all vertices is only many rows.  The least member per
vertex is an aggregate with map-side partial results, and the hot key of the join
that returns it is salted by the member's hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from recollex.sources.shared import Scratch

#: Parts into which the cluster set of one vertex is split for the join with its least member.
SALTS = 16
#: A vertex with a cluster set above this many rows is joined in salted parts.
HOT_ROWS = 50_000


def _measured(scratch: Scratch, rows: DataFrame) -> tuple[DataFrame, tuple]:
    """The kept table with its number of rows and an order-free checksum."""
    seen = Observation()
    checksum = F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
    kept = scratch.keep(rows.observe(seen, F.count(F.lit(1)).alias("n"), checksum.alias("s")))
    return kept, (seen.get["n"], seen.get["s"])


def hash_to_min(links: DataFrame, left: str, right: str, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """(vertex, group): every vertex with a link to another one, and the least vertex
    reached from it.

    `links` may repeat, run either way, and hold nulls or loops: those two are
    ignored.  An empty table gives an empty result.  The order is the column
    type's own (binary for strings).  Raises RuntimeError if the sets still
    change after `max_rounds`; rounds grow with the logarithm of the longest path.
    """
    pairs = links.select(F.col(left).alias("v"), F.col(right).alias("u")).where("v <> u")
    both = F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")), F.struct("v", F.col("v").alias("u")), F.struct(F.col("u").alias("v"), "u"))
    state, size = _measured(scratch, pairs.select(F.inline(both)).distinct())
    for _ in range(max_rounds):
        least = state.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
        hot = F.col("n") > HOT_ROWS
        least = least.select("v", "m", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))).alias("salt"))
        cold = least.where("salt < 0").drop("salt")
        salted = state.withColumn("salt", F.pmod(F.hash("u"), F.lit(SALTS)))
        joined = state.join(cold, "v").select("v", "u", "m").unionByName(salted.join(least.where("salt >= 0"), ["v", "salt"]).select("v", "u", "m"))
        sent = F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        new, new_size = _measured(scratch, joined.select(F.inline(sent)).distinct())
        scratch.drop(state)
        state, size, old = new, new_size, size
        if size == old:
            return state.groupBy(F.col("v").alias("vertex")).agg(F.min("u").alias("group"))
    raise RuntimeError(f"links still spread after {max_rounds} rounds")

"""Mixing sources to target weights.

Tokens are added up per source, repetition rates follow from the targets, and each
document comes out floor(rate) times and once more with a chance of the fraction,
drawn from a hash of seed, mix and document.  The draw of a document depends on
nothing else, so it is the same however the data are partitioned, and the only
shuffle is of one partial sum per source and task.

A source whose target would need more than its `max_repeats` gives what it can.  By the rule
"size" what is missing is asked of the mix's other sources in proportion to their shares, so the
mix keeps its size where the sources allow it; by the rule "shares" the whole mix becomes as
much smaller as its scarcest source asks, so those that have documents keep their shares.
What the draw of whole documents may add or take is told as a standard deviation.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from recollex.sources.shared import Scratch

#: Rows of rates up to which they are broadcast; above, the join shuffles.
BROADCAST_ROWS = 20_000


def plain_source(column: str | Column) -> Column:
    """A source's name without letter case, padding and separators other than _; null for blanks."""
    name = F.regexp_replace(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), r"(?U)[\s\-]+", "_")
    return F.when(name != "", name)


def rates_of(targets: pd.DataFrame, keep: str = "size") -> pd.DataFrame:
    """Rates of one mix: of rows source, target_share, max_repeats, wanted (tokens of the mix), tokens (of the source).

    Shares are weights; null, NaN and negative ones count as 0.  A source without tokens has rate 0, and does not count
    as scarce.  `keep` is the rule for capped sources, "size" or "shares".
    """
    if keep not in ("size", "shares"):
        raise ValueError(f"unknown rule {keep!r}")
    t = targets.sort_values("source").reset_index(drop=True).copy()
    weight = pd.to_numeric(t["target_share"]).fillna(0).clip(lower=0)
    t["share"] = weight / weight.sum() if weight.sum() > 0 else 0.0
    tokens = t["tokens"].fillna(0).astype(float)
    most = tokens * t["max_repeats"].fillna(0).clip(lower=0)
    given, open_ = pd.Series(0.0, t.index), t["share"] > 0
    left = float(t["wanted"].iloc[0])
    if keep == "shares":
        there = open_ & (tokens > 0)
        part = t["share"] / t["share"][there].sum() if there.any() else t["share"]
        given[there] = part[there] * min(left, (most[there] / part[there]).min()) if there.any() else 0.0
        left = 0.0
    while open_.any() and left > 0:
        asked = left * t["share"] / t["share"][open_].sum()
        full = open_ & (asked >= most)
        if not full.any():
            given[open_] = asked[open_]
            break
        given[full] = most[full]
        left -= most[full].sum()
        open_ &= ~full
    t["rate"] = (given / tokens.where(tokens > 0)).fillna(0.0)
    t["expected_share"] = given / given.sum() if given.sum() > 0 else 0.0
    t["capped"] = (t["share"] > 0) & (given < t["wanted"] * t["share"] - 1e-9)
    return t


def mixing_rates(sized: DataFrame, targets: DataFrame, keep: str = "size") -> DataFrame:
    """(mix_name, source, share, wanted, tokens, max_repeats, rate, capped, expected_share, deviation): a row per target;
    the share reached is the expected one but for about `deviation`, as documents are drawn whole.

    `sized` is (doc_id, source, n_tokens), sources in plain form; several targets of a mix for one source count together.
    """
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("squares"))
    whole = sized.agg(F.sum("n_tokens")).first()[0] or 0
    asked = targets.withColumn("source", plain_source("source")).where("source is not null and mix_name is not null")
    asked = asked.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("size_ratio").alias("size_ratio"))
    rows = asked.join(totals, "source", "left").withColumn("wanted", F.lit(float(whole)) * F.coalesce("size_ratio", F.lit(0.0)))
    schema = "mix_name string, source string, share double, wanted double, tokens bigint, max_repeats int, rate double, capped boolean, expected_share double, deviation double"
    columns = [c.split()[0] for c in schema.split(", ")]

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        made = rates_of(part, keep)
        spread = (made["squares"].fillna(0) * (made["rate"] % 1) * (1 - made["rate"] % 1)).clip(lower=0) ** 0.5
        size = float((made["rate"] * made["tokens"].fillna(0)).sum())
        made["deviation"] = spread / size if size > 0 else 0.0
        made["tokens"] = made["tokens"].fillna(0).astype("int64")
        made["max_repeats"] = made["max_repeats"].fillna(0).astype("int32")
        return made[columns]

    return rows.groupBy("mix_name").applyInPandas(solve, schema)


def drawn(sized: DataFrame, rates: DataFrame, scratch: Scratch, seed: int = 17) -> DataFrame:
    """(mix_name, source, doc_id, copies, n_tokens): documents that are in a mix, and how often.

    `sized` is (doc_id, source, n_tokens), other columns are ignored.  Documents without tokens or
    source are in no mix; a mix asked of an empty table is empty; no copies exceed `max_repeats`.
    """
    rates = scratch.keep(rates.where("rate > 0").select("mix_name", "source", "rate"))
    if rates.count() <= BROADCAST_ROWS:
        rates = F.broadcast(rates)
    chance = F.pmod(F.xxhash64(F.lit(seed), "mix_name", "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")
    rows = sized.where("n_tokens > 0").select("doc_id", "source", "n_tokens").join(rates, "source").withColumn("copies", copies.cast("int"))
    return rows.where("copies > 0").select("mix_name", "source", "doc_id", "copies", "n_tokens")


def emitted(draws: DataFrame) -> DataFrame:
    """One row per copy, numbered from 1."""
    return draws.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def shares(rates: DataFrame, draws: DataFrame) -> DataFrame:
    """Per target the share asked for and the one reached, of the tokens of the mix that was drawn."""
    got = draws.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"), F.count(F.lit(1)).alias("drawn_documents"))
    rows = rates.join(got, ["mix_name", "source"], "left").fillna(0, ["drawn_tokens", "drawn_documents"])
    mixes = rows.groupBy("mix_name").agg(F.sum("drawn_tokens").alias("mix_tokens"))
    return rows.join(mixes, "mix_name").withColumn("reached_share", F.coalesce(F.try_divide("drawn_tokens", "mix_tokens"), F.lit(0.0)))

"""One surviving record for each group of duplicates, field bundle by field bundle.

Fields that depend on each other (a text and its hash, a rating and its reason)
form a bundle and come from one member together.  Every member offers a candidate
for each bundle with a trust; the survivor is the choice of one candidate per
bundle with the greatest sum of trusts that keeps the functional dependencies
between bundles.

1. Of a bundle only the best candidate of each value matters, by the value it has
   or asks of another bundle in a dependency (a worse one with the same is
   dominated): an aggregate with map-side partial results.  A bundle that no
   dependency touches is left with one candidate.
2. A member that itself offers all bundles in dependencies and keeps these is a
   feasible choice; a candidate whose trust plus the best of all other such bundles
   stays below the best feasible choice of its group is cut before any group is
   brought together.
3. What is left of a group, values rather than members, goes to branch and bound,
   which decides every bundle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from recollex.sources.shared import shuffle_width


@dataclass(frozen=True)
class Bundle:
    """Fields that go together.  `trust` is an SQL expression of a number, null where the member offers no candidate."""

    name: str
    fields: tuple[str, ...]
    trust: str


@dataclass(frozen=True)
class Dependency:
    """The value of `field` (in bundle `of`) decides that of `on_field` (in bundle `on`)."""

    of: str
    field: str
    on: str
    on_field: str


def best_combination(offers: dict[str, list[tuple[float, str, dict]]], rules: list[tuple[Dependency, dict]]) -> dict[str, str]:
    """Supplier per bundle by branch and bound.

    offers: per bundle its candidates (trust, id, values).  rules: with each
    dependency its allowed value by deciding value; a value without an entry allows
    any.  Of equal sums the lexicographically least suppliers win.  If no
    combination keeps all rules, the bundles without rules on them are kept and
    the least trusted ruled bundle is left out, until one does.
    """
    names = sorted(offers, key=lambda n: (len(offers[n]), n))
    sorted_offers = {n: sorted(offers[n], key=lambda o: (-o[0], o[1])) for n in names}
    # Sums are of what a choice loses against the most trusted one of each bundle, so trusts of any size add exactly enough.
    most = {n: sorted_offers[n][0][0] for n in names}
    best: list = [float("-inf"), None]

    def kept(chosen: dict) -> bool:
        for rule, allowed in rules:
            if rule.of in chosen and rule.on in chosen:
                value = chosen[rule.of][2].get(rule.field)
                if value in allowed and chosen[rule.on][2].get(rule.on_field) != allowed[value]:
                    return False
        return True

    def branch(i: int, total: float, chosen: dict) -> None:
        if i == len(names):
            ids = tuple(chosen[n][1] for n in sorted(chosen))
            if total > best[0] or total == best[0] and ids < best[1][0]:
                best[:] = [total, (ids, dict(chosen))]
            return
        for offer in sorted_offers[names[i]]:
            lost = offer[0] - most[names[i]]
            if total + lost < best[0]:
                break  # the others are trusted no more, and later bundles lose nothing at best
            chosen[names[i]] = offer
            if kept(chosen):
                branch(i + 1, total + lost, chosen)
            del chosen[names[i]]

    branch(0, 0.0, {})
    if best[1] is None:
        dropped = min((n for n in names if any(n in (r.of, r.on) for r, _ in rules)), key=lambda n: (most[n], n))
        return best_combination({n: offers[n] for n in names if n != dropped}, rules)
    return {n: offer[1] for n, offer in best[1][1].items()}


def _best(trust: str) -> Column:
    """The id with the greatest trust, the least of equal ones."""
    return F.min_by("id", F.struct((-F.col(trust)).alias("t"), F.col("id")))


def choose_suppliers(members: DataFrame, bundles: list[Bundle], dependencies: list[Dependency] = ()) -> DataFrame:
    """(group, <bundle>_id ...): for every group the member that supplies each bundle.

    `members` has group, id, and what the trusts and dependencies name; other columns are
    ignored, but for names that begin with trust_ or allowed_, which are replaced.  An id may
    have several rows, its best counts.  Of equal trusts the least id wins.  A bundle that no
    member offers, by a null or NaN trust, has a null supplier.  Rows with a null group are
    left out; no rows give no groups.
    """
    rows = members.where("`group` is not null")
    for b in bundles:
        trust = F.expr(b.trust).cast("double")
        rows = rows.withColumn(f"trust_{b.name}", F.when(~F.isnan(trust), trust))
    chosen = _decided(rows, list(bundles), list(dependencies)).withColumnRenamed("group", "_group")
    groups = rows.select("group").distinct()
    return groups.join(chosen, F.col("group") == F.col("_group"), "left").select("group", *[f"{b.name}_id" for b in bundles])


def allowed_values(rows: DataFrame, rule: Dependency) -> DataFrame:
    """(deciding, decided): for each deciding value the decided one that most rows have with it, the least of equal ones."""
    counted = rows.select(F.col(rule.field).cast("string").alias("deciding"), F.col(rule.on_field).cast("string").alias("decided")).dropna().groupBy("deciding", "decided").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("deciding").agg(F.min_by("decided", F.struct((-F.col("n")).alias("n"), F.col("decided"))).alias("decided"))


def _decided(rows: DataFrame, bundles: list[Bundle], rules: list[Dependency]) -> DataFrame:
    ruled = [b for b in bundles if any(b.name in (r.of, r.on) for r in rules)]
    held = {b.name: sorted({r.on_field for r in rules if r.on == b.name}) for b in bundles}
    asked = {b.name: [f"allowed_{i}" for i, r in enumerate(rules) if r.of == b.name] for b in bundles}
    for i, rule in enumerate(rules):
        allowed = allowed_values(rows, rule).select(F.col("deciding").alias(f"_d{i}"), F.col("decided").alias(f"allowed_{i}"))
        rows = rows.join(allowed, F.col(rule.field).cast("string") == F.col(f"_d{i}"), "left").drop(f"_d{i}")
    whole = F.lit(0.0)
    keeps = F.lit(True)
    for b in ruled:
        whole = whole + F.col(f"trust_{b.name}")
    for i, rule in enumerate(rules):
        keeps &= F.col(f"allowed_{i}").isNull() | (F.col(rule.on_field).cast("string") == F.col(f"allowed_{i}"))
    bounds = rows.groupBy("group").agg(
        F.max(F.when(keeps, whole)).alias("feasible"),
        *[F.max(f"trust_{b.name}").alias(f"most_{b.name}") for b in ruled],
    )
    others = {b.name: sum((F.coalesce(F.col(f"most_{o.name}"), F.lit(0.0)) for o in ruled if o is not b), F.lit(0.0)) for b in ruled}
    offered = None
    for b in bundles:
        telling = held[b.name] + asked[b.name]
        as_map = F.map_from_arrays(F.array(*[F.lit(v) for v in telling]), F.array(*[F.col(v).cast("string") for v in telling])) if telling else F.lit(None)
        best = rows.where(F.col(f"trust_{b.name}").isNotNull()).groupBy("group", *telling).agg(F.max(f"trust_{b.name}").alias("trust"), _best(f"trust_{b.name}").alias("id"))
        mine = best.withColumn("values_", as_map.cast("map<string,string>"))
        if b in ruled:
            mine = mine.join(bounds, "group").where(F.col("feasible").isNull() | (F.col("trust") + others[b.name] >= F.col("feasible")))
        mine = mine.select("group", F.lit(b.name).alias("bundle"), "trust", "id", "values_")
        offered = mine if offered is None else offered.unionByName(mine)
    names = [b.name for b in bundles]

    within = [Dependency(r.of, f"allowed_{i}", r.on, r.on_field) for i, r in enumerate(rules)]

    def solved(group, offers: dict, maps: list[dict]) -> list:
        chosen = best_combination(offers, list(zip(within, maps)))
        return [group, *[chosen.get(n) for n in names]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["group", *[f"{n}_id" for n in names]]
        group, offers, maps = None, {}, []
        for part in parts:
            done = []
            for o in part.itertuples(index=False):
                if o.group != group:
                    if offers:
                        done.append(solved(group, offers, maps))
                    group, offers, maps = o.group, {}, [{} for _ in within]
                values = dict(o.values_ or {})
                offers.setdefault(o.bundle, []).append((float(o.trust), o.id, values))
                for i, rule in enumerate(within):
                    if values.get(rule.field) is not None:
                        maps[i][values[rule.field]] = values[rule.field]
            yield pd.DataFrame(done, columns=columns)
        if offers:
            yield pd.DataFrame([solved(group, offers, maps)], columns=columns)

    # Of a fixed number, so that adaptive execution doesn't join partitions that are small in bytes but not in work.
    ordered = offered.repartition(shuffle_width(rows.sparkSession), "group").sortWithinPartitions("group")
    kind = dict(rows.dtypes)["group"]
    return ordered.mapInPandas(run, f"`group` {kind}, " + ", ".join(f"{n}_id string" for n in names))


def assemble(suppliers: DataFrame, records: DataFrame, bundles: list[Bundle]) -> DataFrame:
    """The survivors: (group, <bundle>_id ..., fields): each bundle's fields as its supplier
    has them.  `records` has one row per id."""
    result = suppliers
    for b in bundles:
        fields = records.select(F.col("id").alias(f"{b.name}_id"), *b.fields)
        result = result.join(fields, f"{b.name}_id", "left")
    return result

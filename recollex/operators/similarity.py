"""Exact set-similarity joins within blocks, and the joins of upkeep and review built on them.

A pair at or above a threshold shares at least one of the first tokens of both sets in
any common order; with rare tokens first few pairs meet by chance.  Rows of one block with
equal token sets form a class, so a text that a third of all rows have is compared once.
Candidates come from an equi-join on (block, token) of classes, tokens being ordered by how many
classes of the block have them; pairs that lengths, places or bitmaps of tokens show to stay below the
threshold are cut in the join, before anything is shuffled, and integers decide on full sets: no pair is
lost or invented.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from recollex.functions.scoring import cosine, usable_vector
from recollex.operators.search import with_tokens
from recollex.sources.shared import Scratch, shuffle_width

DAY = 86_400_000_000
#: Parts into which a prefix token is split that more than `HOT` classes of a block share.
SALTS, HOT = 16, 20_000
#: Of more tokens than these, the join is done in so many parts.
PART_TOKENS, PARTS = 1_000_000, 4
#: 64-bit words of a set's bitmap.
BITMAP = 4


def token_classes(rows: DataFrame, block: list[str]) -> DataFrame:
    """Rows with `_class`, a hash of the block and the set of tokens, those without tokens or with a null in the block left out."""
    rows = rows.withColumn("tokens", F.array_sort(F.array_distinct("tokens"))).where(F.size("tokens") > 0).dropna(subset=list(block))
    return rows.withColumn("_class", F.xxhash64(*block, "tokens"))


def _posts(sets: DataFrame, block: list[str]) -> DataFrame:
    """(_class, _size, _key): a row for each token of each class; the key is a hash of block and token."""
    posts = sets.select(*block, "_class", F.size("tokens").alias("_size"), F.explode("tokens").alias("_token"))
    return posts.select("_class", "_size", F.xxhash64(*block, "_token").alias("_key"))


def _prefixes(posts: DataFrame, counts: DataFrame, above: int, below: int) -> DataFrame:
    """(_class, _size, _more, _s0 ..., _n, _key, _left): of each class the keys of which a similar one must have one.

    Keys are ordered by `_n`, how many classes have them.  `counts` leaves out those of one class: they come first and
    meet nobody, so they only take up places.  `_more` is the number of the other keys, `_s0` and so on are a bitmap of
    these, and `_left` is how many keys of the class are not before this one.
    """
    maps = [F.bit_or(F.when(F.expr(f"shiftright(_key, 6) & {BITMAP - 1} = {i}"), F.expr("shiftleft(1L, int(_key & 63))")).otherwise(F.lit(0).cast("bigint"))).alias(f"_s{i}") for i in range(BITMAP)]
    ordered = posts.join(counts, "_key").groupBy("_class").agg(F.first("_size").alias("_size"), F.sort_array(F.collect_list(F.struct("_n", "_key"))).alias("_o"), *maps)  # one record's tokens
    size, more = F.col("_size"), F.size("_o")
    kept = F.greatest(more - F.ceil(size * above / below) + 1, F.lit(0))
    each = ordered.select("_class", "_size", more.alias("_more"), *[f"_s{i}" for i in range(BITMAP)], F.posexplode(F.slice("_o", F.lit(1), kept.cast("int"))).alias("_at", "_p"))
    return each.select("_class", "_size", "_more", *[f"_s{i}" for i in range(BITMAP)], "_p.*", (F.col("_more") - F.col("_at")).alias("_left"))


def _met(prefix: DataFrame, second: DataFrame, above: int, below: int, order: str) -> DataFrame:
    """(_a, _b): candidates that have a key of their prefixes in common.  Cut are pairs whose sizes, whose tokens from the key
    on, or whose bitmaps leave too few tokens to share: two sets differ in at least as many keys as their bitmaps in bits."""
    hot = F.col("_n") > HOT
    own = F.when(hot, F.pmod("_class", F.lit(SALTS))).otherwise(-1)
    every = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1))))
    carried = ["size", "more", "left", *[f"s{i}" for i in range(BITMAP)]]
    a = prefix.select("_key", own.cast("int").alias("_salt"), F.col("_class").alias("_a"), *[F.col(f"_{c}").alias(f"_a_{c}") for c in carried])
    b = second.select("_key", every.alias("_salt"), F.col("_class").alias("_b"), *[F.col(f"_{c}").alias(f"_b_{c}") for c in carried])
    differ = " + ".join(f"bit_count(_a_s{i} ^ _b_s{i})" for i in range(BITMAP))
    sizes = f"_a_size * {below} >= _b_size * {above} AND _b_size * {below} >= _a_size * {above}"
    left = f"least(_a_left, _b_left) * {above + below} >= (_a_size + _b_size) * {above}"
    mapped = f"(_a_more + _b_more - ({differ})) * {above + below} >= 2 * (_a_size + _b_size) * {above}"
    met = a.join(b, ["_key", "_salt"]).where(f"{order} AND {sizes} AND {left} AND {mapped}")
    return met.select("_a", "_b").distinct()


def similar_classes(sets: DataFrame, above: int, below: int, block: list[str], others: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(_a, _b, shared, total), kept: pairs _a < _b of classes (block, _class, tokens) of one block at or above the threshold, or,
    with `others`, pairs of one of `sets` and another one of `others`.  Both are read several times, so pass kept tables.

    A token that very many classes of a block share in their prefixes is joined in salted parts: each of its classes
    is in one part on the one side and in all parts on the other.  Of many tokens, classes are given their prefixes, and
    keys are joined, in `PARTS` one after the other, so that what these shuffle is on disk for one part at a time.
    """
    scratch = scratch or Scratch(sets.sparkSession)
    sides = [sets] if others is None else [sets, others]
    whole = sets if others is None else sets.unionByName(others).dropDuplicates(["_class"])
    counts = scratch.keep(_posts(whole, block).groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    tokens = sum(side.agg(F.sum(F.size("tokens"))).first()[0] or 0 for side in sides)
    parts = PARTS if tokens > PART_TOKENS else 1
    prefixes, made = [], [counts]
    for side in sides:
        kept = []
        for part in range(parts):
            own = side if parts == 1 else side.where(F.pmod("_class", F.lit(parts)) == part)
            kept.append(scratch.keep(_prefixes(_posts(own, block), counts, above, below)))
        made += kept
        prefixes.append(reduce(DataFrame.unionByName, kept))
    met = []
    for part in range(parts):
        of_part = [p if parts == 1 else p.where(F.pmod("_key", F.lit(parts)) == part) for p in prefixes]
        met.append(scratch.keep(_met(of_part[0], of_part[-1], above, below, "_a < _b" if others is None else "_a <> _b")))
    for kept in made:
        scratch.drop(kept)
    one, two = sets.select(F.col("_class").alias("_a"), F.col("tokens").alias("_a_t")), (others if others is not None else sets).select(F.col("_class").alias("_b"), F.col("tokens").alias("_b_t"))
    both = reduce(DataFrame.unionByName, met).distinct().join(one, "_a").join(two, "_b")
    checked = both.withColumn("shared", F.size(F.array_intersect("_a_t", "_b_t"))).withColumn("total", F.size("_a_t") + F.size("_b_t") - F.col("shared"))
    found = scratch.keep(checked.where(F.col("shared") * below >= F.col("total") * above).select("_a", "_b", "shared", "total"))
    for kept in met:
        scratch.drop(kept)
    return found


def matches(new: DataFrame, old: DataFrame, above: int, below: int, block: list[str]) -> DataFrame:
    """(new_id, old_id): rows (id, block, tokens) of `new` with the similar ones of `old`; old ones are not compared with each other."""
    x, y = token_classes(new.select("id", *block, "tokens"), block), token_classes(old.select("id", *block, "tokens"), block)
    scratch = Scratch(new.sparkSession)
    sets = [scratch.keep(r.groupBy(*block, "_class").agg(F.first("tokens").alias("tokens"))) for r in (x, y)]
    linked = similar_classes(sets[0], above, below, block, sets[1], scratch).select("_a", "_b").unionByName(sets[0].select(F.col("_class").alias("_a"), F.col("_class").alias("_b")))
    return linked.join(x.select(F.col("_class").alias("_a"), F.col("id").alias("new_id")), "_a").join(y.select(F.col("_class").alias("_b"), F.col("id").alias("old_id")), "_b").select("new_id", "old_id")


def similar_pairs(rows: DataFrame, above: int, below: int, block: list[str], carry: list[str] = (), condition: Column | None = None) -> DataFrame:
    """Pairs a_id < b_id of rows in one block with shared / all tokens >= above / below, copies included.

    `rows` has a unique id, the block's columns, tokens, and `carry`, which come back as
    a_... and b_... and may be used in `condition`.  Rows without tokens or with a null in the
    block form no pair.  By definition the pairs of a text with many copies are quadratic in these;
    `token_classes` and `similar_classes` give the same links as classes and membership.
    """
    scratch = Scratch(rows.sparkSession)
    whole = scratch.keep(token_classes(rows.select("id", *block, *carry, "tokens"), block))
    sets = scratch.keep_bucketed(whole.select(*block, "_class", "tokens").dropDuplicates(["_class"]), "_class", shuffle_width(scratch.spark))
    kept = scratch.keep(whole.select("id", *block, *carry, "_class", F.size("tokens").alias("_size")))
    scratch.drop(whole)
    between = similar_classes(sets, above, below, block, scratch=scratch)
    scratch.drop(sets)
    within = kept.groupBy("_class").agg(F.count(F.lit(1)).alias("_n"), F.first("_size").alias("_size")).where("_n > 1").select(F.col("_class").alias("_a"), F.col("_class").alias("_b"), F.col("_size").alias("shared"), F.col("_size").alias("total"))
    linked = between.unionByName(between.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"), "shared", "total")).unionByName(within)
    x = kept.select(*block, F.col("_class").alias("_a"), *[F.col(c).alias(f"a_{c}") for c in ("id", *carry)])
    y = kept.select(F.col("_class").alias("_b"), *[F.col(c).alias(f"b_{c}") for c in ("id", *carry)])
    pairs = linked.join(x, "_a").join(y, "_b").where("a_id < b_id")
    if condition is not None:
        pairs = pairs.where(condition)
    return pairs.select(*block, "a_id", "b_id", *[f"{s}_{c}" for c in carry for s in "ab"], "shared", "total")


def supersede_pairs(entries: DataFrame, now: str) -> DataFrame:
    """(old_id, new_id, shared, total): the newer memory restates the older, active one of the same
    workspace and kind within 30 days, at a similarity of 0.7."""
    at = F.lit(now).cast("timestamp_ntz")
    rows = with_tokens(entries.where(F.col("created_at") <= at))
    gap = F.timestamp_diff("MICROSECOND", F.col("a_created_at"), F.col("b_created_at"))
    pairs = similar_pairs(rows, 7, 10, ["workspace", "kind"], ["created_at", "status"], F.abs(gap) <= 30 * DAY)
    a_old = (F.col("a_created_at") < F.col("b_created_at")) | ((F.col("a_created_at") == F.col("b_created_at")) & (F.col("a_id") < F.col("b_id")))
    named = pairs.select(F.when(a_old, F.col("a_id")).otherwise(F.col("b_id")).alias("old_id"), F.when(a_old, F.col("b_id")).otherwise(F.col("a_id")).alias("new_id"), F.when(a_old, F.col("a_status")).otherwise(F.col("b_status")).alias("old_status"), F.when(a_old, F.col("b_created_at")).otherwise(F.col("a_created_at")).alias("new_at"), "shared", "total")
    return named.where("old_status = 'active'").drop("old_status")


def supersede_pointers(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, superseded_by, supersedes): the last restatement of a memory, and the earliest one it restates."""
    later = pairs.groupBy(F.col("old_id").alias("id")).agg(F.max_by("new_id", F.struct("new_at", "new_id")).alias("superseded_by"))
    dated = pairs.join(entries.select(F.col("id").alias("old_id"), "created_at"), "old_id")
    earlier = dated.groupBy(F.col("new_id").alias("id")).agg(F.min_by("old_id", F.struct("created_at", "old_id")).alias("supersedes"))
    return later.join(earlier, "id", "full")


def merge_pairs(entries: DataFrame) -> DataFrame:
    """(keep_id, drop_id, shared, total): active, not superseded memories of one workspace and kind with
    importances at most 2 apart and a similarity of 0.85; the newer is kept."""
    usable = entries.where("status = 'active' and superseded_by is null and importance is not null and not isnan(importance)")
    rows = with_tokens(usable)
    near = F.abs(F.col("a_importance") - F.col("b_importance")) <= 2
    pairs = similar_pairs(rows, 17, 20, ["workspace", "kind"], ["created_at", "importance"], near)
    a_new = F.struct("a_created_at", "a_id") > F.struct("b_created_at", "b_id")
    return pairs.select(F.when(a_new, F.col("a_id")).otherwise(F.col("b_id")).alias("keep_id"), F.when(a_new, F.col("b_id")).otherwise(F.col("a_id")).alias("drop_id"), "shared", "total")


def summary_pairs(entries: DataFrame) -> DataFrame:
    """(old_id, new_id, shared, total): summaries of one session that share half of their tokens."""
    rows = with_tokens(entries.where("status = 'active' and array_contains(tags, 'session-summary')"))
    pairs = similar_pairs(rows, 1, 2, ["session_id"], ["created_at"])
    a_old = F.struct("a_created_at", "a_id") < F.struct("b_created_at", "b_id")
    return pairs.select("session_id", F.when(a_old, F.col("a_id")).otherwise(F.col("b_id")).alias("old_id"), F.when(a_old, F.col("b_id")).otherwise(F.col("a_id")).alias("new_id"), "shared", "total")


def review_window(entries: DataFrame, size: int = 400) -> DataFrame:
    """The newest active, not superseded memories that are no summaries or snapshots."""
    recent = entries.where("status = 'active' and superseded_by is null")
    recent = recent.orderBy(F.col("created_at").desc_nulls_last(), F.desc("id")).limit(size)
    return recent.where(~F.coalesce(F.arrays_overlap("tags", F.array(F.lit("session-summary"), F.lit("snapshot"))), F.lit(False)))


def review_pairs(window: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a_id, b_id, sim, basis): pairs of one workspace in a review window (of at most some hundred rows, a
    fixed bound) that are similar by cosine if both have vectors of one length, else by 0.08 <= Jaccard < 0.85
    with two shared tokens."""
    held = vectors.where(usable_vector("embedding", "dim")).select(F.col("memory_id").alias("id"), "embedding")
    rows = with_tokens(window.select("id", "workspace", "content")).join(held, "id", "left").select("id", "workspace", "tokens", "embedding")
    a, b = rows.select("workspace", *[F.col(c).alias(f"a_{c}") for c in ("id", "tokens", "embedding")]), rows.select("workspace", *[F.col(c).alias(f"b_{c}") for c in ("id", "tokens", "embedding")])
    pairs = a.join(b, "workspace").where("a_id < b_id")
    both = F.col("a_embedding").isNotNull() & F.col("b_embedding").isNotNull() & (F.size("a_embedding") == F.size("b_embedding"))
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    pairs = pairs.withColumn("basis", F.when(both, "cosine").otherwise("tokens")).withColumn("shared", shared)
    total = F.size("a_tokens") + F.size("b_tokens") - F.col("shared")
    sim = F.when(both, F.round(cosine("a_embedding", "b_embedding"), 6)).otherwise(F.round(F.coalesce(F.try_divide("shared", total), F.lit(0.0)), 6))
    threshold = F.when(F.size("a_embedding") == 384, 0.72).otherwise(0.75)
    fits = F.when(both, F.col("sim") >= threshold).otherwise((F.col("shared") * 100 >= total * 8) & (F.col("shared") * 100 < total * 85) & (F.col("shared") >= 2))
    return pairs.withColumn("sim", sim).where(fits).select("a_id", "b_id", "sim", "basis")


def review_candidates(window: DataFrame, pairs: DataFrame, newer_than: tuple[str, str] | None = None, focuses: int = 60, peers: int = 3, batch: int = 8) -> DataFrame:
    """(batch, focus_id, peer_id, sim, peer_rank): the most similar memories as focuses, each with its best
    peers, in batches.  `newer_than` (created_at, id) restricts focuses, not peers."""
    either = pairs.select(F.col("a_id").alias("focus_id"), F.col("b_id").alias("peer_id"), "sim").unionByName(pairs.select(F.col("b_id").alias("focus_id"), F.col("a_id").alias("peer_id"), "sim"))
    eligible = window
    if newer_than is not None:
        at = F.lit(newer_than[0]).cast("timestamp_ntz")
        eligible = window.where((F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("id") > newer_than[1])))
    best = either.groupBy("focus_id").agg(F.max("sim").alias("max_sim"))
    order = [F.desc("max_sim"), F.col("importance").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("focus_id").asc()]
    chosen = best.join(eligible.select(F.col("id").alias("focus_id"), "importance", "created_at"), "focus_id").orderBy(*order).limit(focuses)
    chosen = chosen.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / batch))  # of `focuses` rows
    dated = window.select(F.col("id").alias("peer_id"), F.col("created_at").alias("peer_at"))
    ranked = chosen.join(either, "focus_id").join(dated, "peer_id").withColumn("peer_rank", F.row_number().over(Window.partitionBy("focus_id").orderBy(F.desc("sim"), F.col("peer_at").desc_nulls_last(), F.desc("peer_id"))))
    return ranked.where(F.col("peer_rank") <= peers).select("batch", "focus_id", "peer_id", "sim", "peer_rank")

"""All similar pairs of set-valued records by recursive chosen-path splitting.

In each of several trees a record starts at the root.  At a node it takes the
branches of those of its tokens whose hash, seeded by the node, lies below
1 / (threshold * tokens - tokens on the path): the hash is shared, so similar records
choose the same tokens.  Of the branches that two records at the threshold take they share
2 / (1 + threshold) on average if they are equally large, and one if the lesser is contained
in the larger, also where the path has used up some of their tokens.  The chance to meet in
a tree (`survival`) falls with the levels, which follow from the number of records and the
frequencies of tokens; the number of trees is the greater of what the recall asks of equally
large sets and what `CONTAINED` asks of contained ones.  Pairs that share the path's tokens
and no other have no branch in common: at a node that goes on they are joined by size, where
the sizes alone tell that they are similar, so this makes no row that is no result.

A node becomes a leaf when its expected number of records, from the frequencies of
the tokens on its path, is small.  The frequencies of frequent tokens are a
broadcast table: of F tokens in N records no more than F / least tokens occur
`least` times, and `least` is chosen so that they are `HEAVY` at most; all rarer
tokens count as `least`.  Frequencies are no more than a hint: where tokens go
together a leaf holds more records than expected.  Leaves are therefore measured,
on one class in `MEASURED`.  Those far above the aim branch on below it, round by
round; records of the others, and of all after `ROUNDS`, are compared with all of their
leaf, in blocks of `BLOCKED` records when it is large: a task gets two blocks at a time, so
no leaf, however large, is one task's work and no pair in it is left out.
Compared are bit sketches, another one in trees of even and odd number; every pair whose
sketches are compatible is checked on the full sets.

A set has more leaves the more sets there are, so leaves are not written all at once: the
walk takes as many trees in a turn as have some `AT_ONCE` leaves a set, or a part of one
tree's first branches.  What a turn leaves on disk are its candidate pairs, each once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recollex.llm.sets import flat_sets, similar
from recollex.sources.shared import Scratch, shuffle_width

#: Recall at the threshold of pairs of which the lesser set is contained in the larger.
CONTAINED = 0.9
#: One class in so many tells the size of leaves.
MEASURED = 8
#: Records a leaf should hold, records of a block, and blocks of a leaf above which it is split again.
LEAF_AIM = 512
BLOCKED = 2048
MOST_BLOCKS = 8
#: Token frequencies that are broadcast at most: 16 bytes each.
HEAVY = 200_000
#: Branching below a root, and rounds of splitting leaves that came out large.
DEPTH = 8
ROUNDS = 4
#: Sets that are branched together, and leaves of a set that are on disk at a time, by the number expected.
BLOCK = 512
AT_ONCE = 24
#: One-bit min-hashes in a sketch, 64 a word; compatible is what a pair at the threshold is in all but 1 % of cases,
#: and in all but 0.01 % in one of both sketches.
SKETCH = 192
WORDS = [f"s{i}" for i in range(SKETCH // 64)]
#: Leaves up to so many records are compared by shifting the column against itself, larger ones as a matrix.
SHIFTED = 48


def survival(mean: float, levels: int) -> float:
    """Chance that two sets which share `mean` branches a node, Poisson, still share a path after so many levels."""
    lost = 0.0
    for _ in range(levels):
        lost = math.exp(mean * (lost - 1))
    return 1 - lost


def trees_for(threshold: float, recall: float, levels: int) -> int:
    def trees(aim: float, mean: float) -> int:
        return math.ceil(math.log(1 - aim) / math.log(1 - survival(mean, levels)))

    return max(trees(recall, 2 / (1 + threshold)), trees(CONTAINED, 1.0))


def turns_for(trees: int, leaves: float) -> list[tuple[np.ndarray, int, int]]:
    """(trees, part, parts): the trees of each turn, and which part of their first branches; together all branches of all trees.

    leaves: of one set in one tree, as expected.  Even trees come first, since they share a sketch.
    """
    order = np.argsort(np.arange(trees) % 2, kind="stable")
    parts = max(1, math.ceil(leaves / AT_ONCE))
    chunks = np.array_split(order, math.ceil(trees / max(1, int(AT_ONCE / leaves))))
    return [(chunk, part, parts) for chunk in chunks for part in range(parts)]


def differing_bits(threshold: float) -> int:
    """Bits in which two sketches of similarity `threshold` differ at most, but for about 1 %."""
    p = (1 - threshold) / 2
    return math.ceil(SKETCH * p + 2.33 * math.sqrt(SKETCH * p * (1 - p)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sketches(values: np.ndarray, ends: np.ndarray, seed: int = 11) -> np.ndarray:
    """Words of 64 bits per set, each bit one bit of another min-hash."""
    odd = np.random.default_rng(seed).integers(0, 2**63, size=SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(ends) - 1, SKETCH // 64), dtype=np.uint64)
    for i in range(SKETCH):
        least = np.minimum.reduceat(values * odd[i], ends[:-1])
        out[:, i // 64] |= (_mix(least) >> np.uint64(63)) << np.uint64(i % 64)
    return out


def branch(values: np.ndarray, ends: np.ndarray, turn: tuple[np.ndarray, int, int], threshold: tuple[int, int], logs: Callable, stop: float, opened: tuple[np.ndarray, np.ndarray] | None = None, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(record, key, path, tree) of all leaves of a block of sets, path being 0, and of the nodes above
    them where a similar set may share the path's tokens only, path being their number.

    turn: numbers of the trees, and of their first branches which part of how many.
    logs: log frequency by token; stop: log frequency of a path at which it ends.
    opened: marks (key and record mixed) of all leaves to go on below, and of those
    opened last; only descendants of the latter are returned.
    """
    sizes = np.diff(ends)
    trees, part, parts = turn
    records, tree = np.repeat(np.arange(len(sizes)), len(trees)), np.tile(trees, len(sizes))
    nodes = _mix((tree + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    paths = np.zeros(len(records))
    below = np.zeros(len(records), dtype=bool)
    taken: list[np.ndarray] = []
    shared, union = threshold
    required = -(-sizes * shared // union)  # tokens that a similar set shares at least
    found: list[tuple[np.ndarray, ...]] = []
    for depth in range(DEPTH + ROUNDS):
        if not len(records):
            break
        n = sizes[records]
        parent = np.repeat(np.arange(len(records)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + ends[:-1][records][parent]
        tokens = values[at]
        limit = np.minimum(2.0**64 / np.maximum(n * shared / union - depth, 1), 2.0**64 - 2048).astype(np.uint64)
        chosen = _mix(tokens ^ nodes[parent]) <= limit[parent]
        for earlier in taken:
            chosen &= tokens != earlier[parent]
        parent, tokens = parent[chosen], tokens[chosen]
        nodes = _mix(nodes[parent] * np.uint64(0xC2B2AE3D27D4EB4F) + tokens)
        if depth == 0 and parts > 1:
            own = nodes % np.uint64(parts) == part
            nodes, parent, tokens = nodes[own], parent[own], tokens[own]
        paths, records, tree, below = paths[parent] + logs(tokens), records[parent], tree[parent], below[parent]
        taken = [*(t[parent] for t in taken), tokens]
        ended = (paths <= stop) | (depth + 1 >= DEPTH)
        if opened is not None:
            marks = _mix(nodes + records.astype(np.uint64))
            again, last = np.isin(marks, opened[0]), np.isin(marks, opened[1])
            returned = ended & below & ~again
            below |= last
            ended &= ~again
        else:
            returned, last = ended, ~ended
        alone = last & (required[records] <= depth + 1)
        found += [(records[kind], nodes[kind], np.full(kind.sum(), path, dtype=np.int64), tree[kind]) for kind, path in ((returned, 0), (alone, depth + 1))]
        go = ~ended
        nodes, paths, records, tree, below, taken = nodes[go], paths[go], records[go], tree[go], below[go], [t[go] for t in taken]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))


def _leaves(turn: tuple[np.ndarray, int, int], threshold: tuple[int, int], heavy, least: float, stop: float) -> Callable:
    """Rows (leaf, class, words of the sketch) of a turn's leaves, whose keys are even, and (node, class, size, path, 0) of
    nodes with pairs that share no more than the path, whose keys are odd."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy_tokens, heavy_logs = heavy.value

        def logs(tokens: np.ndarray) -> np.ndarray:
            if not len(heavy_tokens):
                return np.full(len(tokens), least)
            at = np.minimum(np.searchsorted(heavy_tokens, tokens), len(heavy_tokens) - 1)
            return np.where(heavy_tokens[at] == tokens, heavy_logs[at], least)

        for batch in batches:
            values, ends = flat_sets(batch.column(1))
            classes = batch.column(0).to_numpy()
            for a in range(0, batch.num_rows, BLOCK):
                b = min(a + BLOCK, batch.num_rows)
                part, cuts = values[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
                opened = None
                if batch.num_columns > 2:
                    lists = [flat_sets(batch.column(c).slice(a, b - a)) for c in (2, 3)]
                    opened = tuple(_mix(keys + np.repeat(np.arange(b - a), np.diff(key_ends)).astype(np.uint64)) for keys, key_ends in lists)
                records, keys, paths, tree = branch(part, cuts, turn, threshold, logs, stop, opened)
                bits = np.zeros((len(records), len(WORDS)), dtype=np.uint64)
                for odd in np.unique(tree % 2):
                    bits[tree % 2 == odd] = sketches(part, cuts, 11 + odd)[records[tree % 2 == odd]]
                alone = paths > 0
                bits[alone] = np.stack([np.diff(cuts)[records[alone]], paths[alone], 0 * paths[alone]], axis=1).astype(np.uint64)
                keys = (keys & ~np.uint64(1)) | alone.astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(classes[a:b][records]), *(pa.array(np.ascontiguousarray(w).view(np.int64)) for w in bits.T)], ["leaf", "class", *WORDS])

    return run


def _frequencies(spark: SparkSession, sets: DataFrame, count: int, tokens: int):
    """Broadcast (tokens, log frequencies) of the frequent tokens, at most HEAVY, the log frequency of all others, and
    the mean of the logarithms over all tokens in sets."""
    least = max(2, math.ceil(tokens / HEAVY))
    counted = sets.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= least)
    rows = counted.toPandas()
    made = rows["token"].to_numpy(np.int64).view(np.uint64), np.log(rows["count"].to_numpy(float) / count)
    order = np.argsort(made[0])
    rare = math.log(least / count)
    held = float(rows["count"].sum())
    mean = (float((rows["count"] * made[1]).sum()) + (tokens - held) * rare) / max(tokens, 1)
    return spark.sparkContext.broadcast((made[0][order], made[1][order])), rare, mean


def similar_sets(sets: DataFrame, scratch: Scratch, threshold: tuple[int, int], recall: float = 0.97) -> DataFrame:
    """(a, b, shared, total), kept: pairs a < b of classes with shared / all tokens at or above the fraction.

    `sets` is (class, tokens) as `class_sets` keeps them: equal sets are one class, null and
    empty ones none; a table without sets gives no pair.  `recall` is met for equally large sets
    at the threshold itself; the chance to miss a pair falls quickly with its similarity.
    """
    size = sets.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("t")).first()
    fraction = threshold[0] / threshold[1]
    heavy, least, mean = _frequencies(sets.sparkSession, sets, max(size.n, 1), size.t or 0)
    stop = math.log(LEAF_AIM / max(size.n, LEAF_AIM))
    levels = min(DEPTH, max(1, math.ceil(stop / mean)) + 1) if mean < 0 else 1  # paths of frequent tokens are longer than the mean
    near: list[DataFrame] = []
    for turn in turns_for(trees_for(fraction, recall, levels), fraction**-levels):
        near += _met(sets, scratch, _leaves(turn, threshold, heavy, least, stop), threshold)
    made = scratch.keep(similar(reduce(DataFrame.unionByName, near).distinct(), sets, *threshold))
    for kept in near:
        scratch.drop(kept)
    return made


def _met(sets: DataFrame, scratch: Scratch, run: Callable, threshold: tuple[int, int]) -> list[DataFrame]:
    """Candidate pairs (a, b) of one turn's leaves, a kept table for each round; the leaves themselves are dropped."""
    schema = ", ".join(["leaf bigint", "class bigint", *(f"{c} bigint" for c in WORDS)])
    leaves = sets.mapInArrow(run, schema)
    near, opened = [], []
    for step in range(ROUNDS + 1):
        kept = scratch.keep(leaves)
        leaves, alone = kept.where("leaf & 1 = 0"), _sharing_the_path(kept.where("leaf & 1 = 1"), *threshold)
        counts = leaves.where(F.pmod("class", F.lit(MEASURED)) == 0).groupBy("leaf").agg((F.count(F.lit(1)) * MEASURED).alias("n"))
        counts = scratch.keep(counts.where(F.col("n") > BLOCKED).select("leaf", F.ceil(F.col("n") / BLOCKED).alias("blocks")))
        large = counts.where(F.col("blocks") > MOST_BLOCKS).select("leaf")
        more = step < ROUNDS and bool(large.take(1))
        now, in_blocks = leaves, counts
        if more:
            now, in_blocks = leaves.join(large, "leaf", "left_anti"), counts.where(F.col("blocks") <= MOST_BLOCKS)
        # kept by itself, so that the leaves and their shuffle are gone before the sets are fetched
        near.append(scratch.keep(alone.unionByName(_compared(now, in_blocks, threshold[0] / threshold[1])).distinct()))
        if more:
            # the walk starts at the root again, so it must be led through the leaves of all rounds so far
            opened.append(scratch.keep(leaves.join(large, "leaf", "left_semi").select("class", "leaf", F.lit(step).alias("step"))))
            latest = F.collect_set(F.when(F.col("step") == step, F.col("leaf"))).alias("latest")
            held = reduce(DataFrame.unionByName, opened).groupBy("class").agg(F.collect_set("leaf").alias("opened"), latest).where(F.size("latest") > 0)
            leaves = sets.join(held, "class").select("class", "tokens", "opened", "latest").mapInArrow(run, schema)
        scratch.drop(kept)
        scratch.drop(counts)
        if not more:
            break
    for last in opened:
        scratch.drop(last)
    return near


def _compared(leaves: DataFrame, large: DataFrame, fraction: float) -> DataFrame:
    """Pairs (a, b) of classes of one leaf with compatible sketches.

    A leaf of `large` (leaf, blocks) is cut into blocks by a hash of the class, and each pair of blocks compared
    in a place of its own: a record is sent as often as there are blocks.
    """
    if large.take(1):
        cut = leaves.join(large, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        cut = cut.withColumn("own", F.pmod(F.xxhash64("class", F.lit(1)), "blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
        cut = cut.select("leaf", "class", *WORDS, "own", other)
        place = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        # the leaf's key with both blocks; of two blocks records of the one meet those of the other only
        parts = cut.select(F.xxhash64("leaf", F.least("own", "other"), F.greatest("own", "other")).alias("leaf"), place.alias("side"), "class", *WORDS)
    else:
        parts = leaves.select("leaf", F.lit(0).alias("side"), "class", *WORDS)
    parts = parts.repartition(shuffle_width(leaves.sparkSession), "leaf").sortWithinPartitions("leaf", "side")
    return parts.mapInArrow(_meeting(differing_bits(fraction)), "a bigint, b bigint")


def _meeting(bits: int) -> Callable:
    def compatible(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int16) <= bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def pairs(columns: list[np.ndarray]) -> pa.RecordBatch:
            leaf, side, classes, words = columns[0], columns[1], columns[2], np.stack(columns[3:], axis=1).view(np.uint64)
            cuts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
            sizes = np.diff(np.append(cuts, len(leaf)))
            ends = np.repeat(cuts + sizes, sizes)
            one, two = [], []
            # small leaves together: each row with the row d places on, as long as that is of the same leaf
            rows = np.flatnonzero(np.repeat(sizes <= SHIFTED, sizes))
            for d in range(1, SHIFTED):
                rows = rows[rows + d < ends[rows]]
                if not len(rows):
                    break
                near = rows[compatible(words, rows, rows + d)]
                one.append(near)
                two.append(near + d)
            for at, n in zip(cuts[sizes > SHIFTED].tolist(), sizes[sizes > SHIFTED].tolist()):
                for i in range(at, at + n, 256):
                    strip = words[i : min(i + 256, at + n), None, :] ^ words[None, at : at + n, :]
                    a, b = np.nonzero(np.bitwise_count(strip).sum(axis=2, dtype=np.int16) <= bits)
                    a, b = a + i, b + at
                    one.append(a[a < b])
                    two.append(b[a < b])
            i, j = np.concatenate(one) if one else np.zeros(0, int), np.concatenate(two) if two else np.zeros(0, int)
            meet = ((side[i] == 0) | (side[i] != side[j])) & (classes[i] != classes[j])
            a, b = classes[i[meet]], classes[j[meet]]
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if kept is not None:
                columns = [np.concatenate(c) for c in zip(kept, columns)]
            whole = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0  # the last leaf may go on
            if whole:
                yield pairs([c[:whole] for c in columns])
            kept = [c[whole:] for c in columns]
        if kept is not None and len(kept[0]):
            yield pairs(kept)

    return run


def _sharing_the_path(nodes: DataFrame, above: int, below: int) -> DataFrame:
    """Pairs of a node that are similar if they share the tokens of its path and no other: path / (a + b - path) at the
    threshold or above, an equality of sizes for each size the lesser can have, so only such pairs are joined."""
    nodes = nodes.select("leaf", "class", F.col("s0").alias("size"), F.col("s1").alias("path"))
    sizes = F.sequence("path", F.least(F.col("size"), F.expr(f"path * {above + below} div {above} - size")))
    possible = nodes.where(f"size * {above} <= path * {below}").select("leaf", F.col("class").alias("b"), F.col("size").alias("large"), F.explode(sizes).alias("size"))
    pairs = nodes.select("leaf", F.col("class").alias("a"), "size").join(possible, ["leaf", "size"])
    pairs = pairs.where((F.col("size") < F.col("large")) | (F.col("a") < F.col("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

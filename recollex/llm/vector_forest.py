"""The most similar vectors of every vector, by a forest of hash strings.

Each tree gives a vector a string of cross-polytope hashes: symbol j is the axis,
with its sign, that the vector lies nearest to after the tree's j-th random
rotation.  Vectors with an angle between them share a symbol the more likely the
smaller the angle, and much more likely than with the same number of sign bits.
The more vectors, the longer the prefixes and the fewer near vectors share one, so the
number of trees follows from the number of vectors (`forest`) for the same recall.
A tree is the sorted array of all strings.  A node is a run with one prefix; a search
descends to the longest prefix of its string that has `QUOTA` vectors at least, and ascends
as long as there are `NODE` at most, so the prefix is long where vectors are dense and short
where they are sparse.  As every vector is a query, all that end in one node are compared
with it by one matrix product.  Vectors that share `DENSE` symbols lie so close that longer
prefixes would part neighbours: up to `WHOLE` of them are one node.  Longer runs of equal
strings are halved, by random directions after their mean is taken off, until they fit.

An array is cut where a symbol changes: vectors go to tasks by the hash of their tree and
first symbol, those under a prefix that holds more than a task should by that of a longer one
(`routes`).  So what is compared depends on the vectors alone, not on the number of tasks
or on samples, and a prefix that a third of all vectors share is many tasks' work.

Vectors travel with 10 bits a number, which leaves cosines off by a known spread.  What that
leaves open, near-ties of the last places and of the threshold, is decided by cosines of
vectors with 16 bits a number, off by less than 1e-5.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from recollex.sources.shared import Scratch, shuffle_width

#: Trees that are searched together and the forest has at least, and symbols of a string at most; a string with its
#: tree has 63 bits.
TREES = 8
SYMBOLS = 7
#: Part of the neighbours that the forest should find, and how often near vectors share a symbol: measured on the
#: check tables' pairs, of cosines from 0.75 to 1, most from 0.85 to 0.95.
RECALL = 0.99
SHARED = 0.44
#: Vectors that a node to ascend to holds at most, and the least to descend to.
NODE = 1024
QUOTA = 96
#: Equal symbols of close vectors, and how many of these are compared whole.
DENSE = 3
WHOLE = 16_384
#: Sorted rows that a task holds at most, and part of a tree above which a prefix is hot in any case.
HELD = 65_536
HOT_PART = 1 / 2000
#: Products of a block are cut in strips of this many lines.
STRIP = 256
#: Neighbours beyond k that a node hands on if they might be among the k, and standard deviations that might bridge.
EXTRA = 5
SPREADS = 6
#: Steps of a number that travels.
STEPS = 511


def symbol_bits(dim: int) -> int:
    return (2 * dim - 1).bit_length()


def symbols_of(dim: int) -> int:
    return min(SYMBOLS, 59 // symbol_bits(dim))


def forest(vectors: int, dim: int) -> int:
    """Trees for so many vectors: near ones must share as many symbols as bring a prefix below `NODE`, by a third as not all are equally frequent."""
    level = max(1, math.ceil(math.log(max(vectors, 1) * 1.5 / NODE) / math.log(2 * dim)))
    return max(TREES, math.ceil(math.log(1 - RECALL) / math.log(1 - SHARED**level)))


def rotations(trees: int, dim: int, seed: int = 3, first: int = 0) -> list[list[np.ndarray]]:
    """Those of `trees` trees from the one numbered `first` on."""
    rng = np.random.default_rng(seed)
    return [[rng.standard_normal((dim, dim)).astype(np.float32) for _ in range(symbols_of(dim))] for _ in range(first + trees)][first:]


def hash_strings(vectors: np.ndarray, tree: list[np.ndarray]) -> np.ndarray:
    """Strings as one integer each, in the order of their first symbols."""
    strings = np.zeros(len(vectors), dtype=np.int64)
    for rotation in tree:
        turned = vectors @ rotation
        axis = np.abs(turned).argmax(axis=1)
        strings = (strings << symbol_bits(vectors.shape[1])) | (axis << 1) | (turned[np.arange(len(axis)), axis] < 0)
    return strings


def prefixes(strings: np.ndarray, level: int, dim: int) -> np.ndarray:
    """The tree and the first symbols of strings."""
    return strings >> (symbol_bits(dim) * (symbols_of(dim) - level))


def runs(strings: np.ndarray, low: int, high: int, dim: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """Nodes to compare within, of sorted strings: each row is in one.  Runs with `DENSE` equal symbols may have up to
    `WHOLE` rows, and those of equal strings more."""
    if high - low <= (NODE if level < DENSE else WHOLE) or level == symbols_of(dim):
        yield low, high
        return
    symbols = prefixes(strings[low:high], level + 1, dim)
    cuts = [low, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1 + low).tolist(), high]
    start = cuts[0]
    for cut in cuts[1:]:
        if cut - start >= QUOTA or cut == high:
            yield from runs(strings, start, cut, dim, level + 1)
            start = cut


def parts(vectors: np.ndarray, rng: np.random.Generator, rows: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Rows in parts of up to `WHOLE`, near ones together: halves by a random direction, the mean taken off."""
    rows = np.arange(len(vectors)) if rows is None else rows
    if len(rows) <= WHOLE:
        yield rows
        return
    inside = vectors[rows] - vectors[rows].mean(axis=0)
    # a difference of two rows lies along what the cluster spreads in
    a, b = rng.integers(len(rows), size=2)
    places = inside @ (inside[a] - inside[b] + 1e-6 * rng.standard_normal(vectors.shape[1]).astype(np.float32))
    order = np.argsort(places, kind="stable")
    middle = int(len(rows) * rng.uniform(0.4, 0.6))
    yield from parts(vectors, rng, rows[order[:middle]])
    yield from parts(vectors, rng, rows[order[middle:]])


def best_in_runs(strings: np.ndarray, ids: np.ndarray, vectors: np.ndarray, spreads: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, neighbours, cosines, slacks) of rows of one tree with what may be among their k best at `least` or above in their node."""
    for a, b in runs(strings, 0, len(strings), vectors.shape[1]):
        if b - a > WHOLE:
            for rows in parts(vectors[a:b], np.random.default_rng(int(strings[a]))):
                yield from _best(ids[a:b][rows], vectors[a:b][rows], spreads[a:b][rows], k, least)
        elif b - a > 1:
            yield from _best(ids[a:b], vectors[a:b], spreads[a:b], k, least)


def _best(own: np.ndarray, part: np.ndarray, spreads: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    n, most = len(own), k + EXTRA
    for s in range(0, n, STRIP):
        e = min(s + STRIP, n)
        products = part[s:e] @ part.T
        products[np.arange(e - s), np.arange(s, e)] = -3
        lines = np.flatnonzero(products.max(axis=1) >= least - SPREADS * 0.002)
        if not len(lines):
            continue
        products = products[lines]
        if n > most:
            top = np.argpartition(products, -most, axis=1)[:, -most:]
        else:
            top = np.broadcast_to(np.arange(n), (len(lines), n))
        cosines = np.take_along_axis(products, top, axis=1)
        slacks = SPREADS * np.sqrt(spreads[s:e][lines][:, None] ** 2 + spreads[top] ** 2)
        kth = np.partition(cosines, -k, axis=1)[:, -k] if cosines.shape[1] >= k else np.full(len(lines), -3.0)
        near = (cosines > -2) & (cosines + slacks >= least) & (cosines + 2 * slacks >= kth[:, None])
        rows, columns = np.nonzero(near)
        yield own[s:e][lines[rows]], own[top[rows, columns]], cosines[near], slacks[near]


def packed(vectors: np.ndarray) -> np.ndarray:
    """Lines of 16-bit numbers: each number in steps of its line's greatest."""
    return np.rint(vectors / np.abs(vectors).max(axis=1, keepdims=True) * 32767).astype("<i2")


def unpacked(lines: np.ndarray) -> np.ndarray:
    """Unit vectors of packed lines."""
    vectors = lines.astype(np.float32)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def coarse(vectors: np.ndarray) -> np.ndarray:
    """Lines of bytes: each number in 10 bits, in steps of its line's greatest."""
    if vectors.shape[1] % 4:
        vectors = np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % 4)))
    steps = (np.rint(vectors / np.abs(vectors).max(axis=1, keepdims=True) * STEPS) + STEPS + 1).astype(np.uint16)
    a, b, c, d = (steps[:, i::4] for i in range(4))
    made = [a >> 2, ((a & 3) << 6) | (b >> 4), ((b & 15) << 4) | (c >> 6), ((c & 63) << 2) | (d >> 8), d & 255]
    return np.stack(made, axis=2).astype(np.uint8).reshape(len(vectors), -1)


def from_coarse(lines: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of coarse lines, and the standard deviation that rounding one brings to a cosine."""
    x = lines.reshape(len(lines), -1, 5).astype(np.int16)
    steps = [(x[:, :, 0] << 2) | (x[:, :, 1] >> 6), ((x[:, :, 1] & 63) << 4) | (x[:, :, 2] >> 4), ((x[:, :, 2] & 15) << 6) | (x[:, :, 3] >> 2), ((x[:, :, 3] & 3) << 8) | x[:, :, 4]]
    vectors = np.stack(steps, axis=2).reshape(len(lines), -1)[:, :dim].astype(np.float32) - (STEPS + 1)
    norms = np.linalg.norm(vectors, axis=1)
    return vectors / norms[:, None], 1 / (norms * np.float32(12**0.5))


def _unit(dim: int) -> Callable:
    """(id, embedding, at) to (id, at, packed vector), without unusable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(lengths == dim)
            if not len(at):
                continue
            flat = column.take(pa.array(at)).flatten()
            full = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(all="ignore"):
                scale = np.abs(full).max(axis=1)
                usable = np.isfinite(scale) & (scale > 0)
                at, full = at[usable], full[usable] / scale[usable, None]
            if not len(at):
                continue
            made = pa.array([line.tobytes() for line in packed(full)], pa.binary())
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), made], ["id", "at", "vector"])

    return run


def _lines(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width) if len(column) else np.zeros((0, width), kind)


def usable_vectors(rows: DataFrame, dim: int, scratch: Scratch) -> DataFrame:
    """(id, key, vector), kept bucketed by key: of rows (id, embedding, at) the latest usable one per id.

    Usable are `dim` finite numbers, not all zero; a null vector, one of another length, with a
    null, NaN or infinite number, or of a null id is left out.  Of equal or null times the
    greatest bytes win, a time wins over a null; repeated rows count once.  Other columns
    are ignored.  key is a 64-bit hash of the id.
    """
    unit = rows.select("id", "embedding", "at").where("id is not null").mapInArrow(_unit(dim), f"id string, at {dict(rows.dtypes)['at']}, vector binary")
    keyed = unit.select(F.xxhash64("id").alias("key"), "id", "at", "vector")
    latest = keyed.groupBy("key", "id").agg(F.max(F.struct("at", "vector")).alias("latest"))
    return scratch.keep_bucketed(latest.select("id", "key", F.col("latest.vector").alias("vector")), "key", shuffle_width(scratch.spark))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _routed(strings: np.ndarray, keys: np.ndarray, dim: int, hot: list[dict[int, int]]) -> np.ndarray:
    """The prefix by which each string goes to a task, as a hash: the shortest that is not hot; hot strings as a whole by a hash of the key as well."""
    places = prefixes(strings, 1, dim)
    routes = _mixed(places.view(np.uint64))
    for level, sizes in enumerate(hot, 1):
        known = np.isin(places, np.fromiter(sizes, np.int64, len(sizes)))
        if not known.any():
            break
        if level == symbols_of(dim):
            shares = np.array([sizes[p] for p in places[known].tolist()], dtype=np.uint64)
            routes[known] += np.uint64(1) + _mixed(keys[known].view(np.uint64) ^ strings[known].view(np.uint64)) % shares
            break
        longer = prefixes(strings, level + 1, dim)
        routes[known] = _mixed(longer[known].view(np.uint64) + np.uint64(level << 58))
        places = np.where(known, longer, np.int64(-1))
    return routes.view(np.int64)


def hot_prefixes(vectors: DataFrame, dim: int, trees: int, first: int = 0) -> list[dict[int, int]]:
    """By level, prefixes with more vectors than a task should hold, each with the tasks that it takes.

    They are those of more than `HELD` rows and `HOT_PART` of all, so a level has no more than trees / HOT_PART.
    """
    n = vectors.count()
    most, found = max(HELD, n * HOT_PART), []

    def counted(level: int, known: list[int]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turns = [tree[:level] for tree in rotations(trees, dim, first=first)]
            before = np.array(known, dtype=np.int64)
            for batch in batches:
                lines = unpacked(_lines(batch.column(0), "<i2", dim))
                for t, tree in enumerate(turns):
                    made = hash_strings(lines, tree) | (t << (symbol_bits(dim) * level))
                    if level > 1:
                        made = made[np.isin(made >> symbol_bits(dim), before)]
                    value, count = np.unique(made, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(count.astype(np.int64))], ["prefix", "n"])

        return run

    for level in range(1, symbols_of(dim) + 1):
        if n <= HELD or level > 1 and not found[-1]:
            break
        sizes = vectors.select("vector").mapInArrow(counted(level, list(found[-1]) if found else []), "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n"))
        found.append({r.prefix: -(-r.n // HELD) for r in sizes.where(F.col("n") > most).collect()})
    return found


def _strings(trees: int, dim: int, hot, first: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = rotations(trees, dim, first=first)
        for batch in batches:
            keys, vectors = batch.column(0).to_numpy(), unpacked(_lines(batch.column(1), "<i2", dim))
            lines = pa.array([line.tobytes() for line in coarse(vectors)], pa.binary())
            for t, tree in enumerate(turns):
                strings = hash_strings(vectors, tree) | (t << (symbol_bits(dim) * symbols_of(dim)))
                yield pa.RecordBatch.from_arrays([pa.array(_routed(strings, keys, dim, hot.value)), pa.array(strings), batch.column(0), lines], ["route", "string", "key", "vector"])

    return run


def _search(dim: int, k: int, least: float) -> Callable:
    width = -(-dim // 4) * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def search(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            vectors, spreads = from_coarse(columns[3], dim)
            for found in best_in_runs(columns[1], columns[2], vectors, spreads, k, least):
                own, neighbours, cosines, slacks = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(neighbours), pa.array(cosines.astype(np.float32)), pa.array(slacks.astype(np.float32))], ["key", "neighbour", "cosine", "slack"])

        def cut(strings: np.ndarray) -> int:
            """Where to cut the first rows of a route that is too long: at the shortest prefix in the latter half."""
            for level in range(1, symbols_of(dim) + 1):
                places = prefixes(strings, level, dim)
                ends = np.flatnonzero(places[1:] != places[:-1]) + 1
                if len(ends) and ends[-1] > HELD // 2:
                    return int(ends[-1])
            return len(strings)

        def taken(columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            """Searches all routes that are whole, and keeps the rest."""
            nonlocal held
            routes, at = columns[0], 0
            ends = [*(np.flatnonzero(routes[1:] != routes[:-1]) + 1).tolist(), len(routes)]
            for end in ends:
                while end - at > HELD:
                    upto = at + cut(columns[1][at : at + HELD])
                    yield from search([c[at:upto] for c in columns])
                    at = upto
                if end < len(routes) or last:
                    yield from search([c[at:end] for c in columns])
                    at = end
            held = [c[at:] for c in columns]

        for batch in batches:
            columns = [*(batch.column(i).to_numpy() for i in range(3)), _lines(batch.column(3), "u1", width)]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            yield from taken(columns, False)
        if held is not None and len(held[0]):
            yield from taken(held, True)

    return run


def _exact(dim: int) -> Callable:
    """(key, neighbour, open, vector, other) to (key, neighbour, open, cosine)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_lines(batch.column(i), "<i2", dim).astype(np.float64) for i in (3, 4))
            cosines = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cosines)], ["key", "neighbour", "open", "cosine"])

    return run


def _met(vectors: DataFrame, dim: int, k: int, least: float, trees: int, first: int) -> DataFrame:
    """(key, neighbour, cosine, slack) of what may be among the k best in a node of one of these trees."""
    hot = vectors.sparkSession.sparkContext.broadcast(hot_prefixes(vectors, dim, trees, first))
    strings = vectors.select("key", "vector").mapInArrow(_strings(trees, dim, hot, first), "route bigint, string bigint, key bigint, vector binary")
    ordered = strings.repartition(shuffle_width(vectors.sparkSession), "route").sortWithinPartitions("route", "string", F.xxhash64("string", "key"))
    return ordered.mapInArrow(_search(dim, k, least), "key bigint, neighbour bigint, cosine float, slack float")


def _best_found(met: DataFrame) -> DataFrame:
    """(key, best, slack): neighbours of a key, the most similar first, and the cosine by which two of them may be off."""
    found = met.repartition("key").groupBy("key", "neighbour").agg(F.max(F.struct("cosine", "slack")).alias("c"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("c.cosine").alias("cosine"), F.col("neighbour"), F.col("c.slack").alias("slack"))), asc=False)  # (TREES + 1) * (k + EXTRA) and near-ties of the last place at most
    return found.groupBy("key").agg(listed.alias("best")).withColumn("slack", 2 * F.array_max(F.transform("best", lambda b: b["slack"])))


def nearest(vectors: DataFrame, dim: int, k: int, scratch: Scratch, least: float = -1.0, trees: int | None = None, exact: bool = False) -> DataFrame:
    """(key, neighbour, cosine): for every vector of `usable_vectors` its k most similar others
    with a cosine of `least` or more, of those the forest finds; without `trees` as many as
    `forest` says, `TREES` at a time, which bounds what is on disk at once.

    Equal cosines are ranked by key, so of many equal vectors each has k others.  A vector
    without a neighbour has no row; an empty table gives none.  Which neighbours are among the k
    is decided to within 1e-5 of cosine, but for more than `EXTRA` near-ties of the last place
    in one node; the cosine that is given is that of vectors of 10 bits a number, or
    with `exact` that of 16 bits for all.
    """
    trees, held = trees or forest(vectors.count(), dim), None
    for first in range(0, trees, TREES):
        met = _met(vectors, dim, k, least, min(TREES, trees - first), first)
        if held is not None:
            met = met.unionByName(held)
        if first + TREES < trees:
            best = _best_found(met)
            last = F.coalesce(F.try_element_at("best", F.lit(k))["cosine"], F.lit(-3.0))
            # what is out already stays out
            near = best.select("key", F.filter("best", lambda b: b["cosine"] + F.col("slack") >= last).alias("near"))
            held, before = scratch.keep(near.select("key", F.inline("near")).select("key", "neighbour", "cosine", "slack")), held
            if before is not None:
                scratch.drop(before)
    best = _best_found(met)
    last, next_ = (F.coalesce(F.try_element_at("best", F.lit(i))["cosine"], F.lit(-3.0)) for i in (k, k + 1))
    # in whatever the rounding did; out likewise; the rest is open
    sure = F.filter("best", lambda b, i: (i < k) & (b["cosine"] - F.col("slack") > F.col("next")) & (b["cosine"] - b["slack"] >= least))
    near = F.filter("best", lambda b, i: (b["cosine"] + F.col("slack") >= F.col("last")) & (b["cosine"] + b["slack"] >= least))
    placed = best.withColumn("last", last).withColumn("next", next_).select("key", sure.alias("sure"), near.alias("near"))
    if exact:
        placed = placed.withColumn("sure", F.slice("sure", 1, 0))
    placed = scratch.keep(placed.withColumn("near", F.array_except("near", "sure")))
    certain = placed.select("key", F.inline("sure")).select("key", "neighbour", F.col("cosine").cast("double").alias("cosine"))
    doubtful = placed.select("key", (k - F.size("sure")).alias("open"), F.inline("near")).where("open > 0").select("key", "neighbour", "open")
    lines = vectors.select("key", "vector")
    both = doubtful.join(lines, "key").join(lines.select(F.col("key").alias("neighbour"), F.col("vector").alias("other")), "neighbour")
    measured = both.select("key", "neighbour", "open", "vector", "other").mapInArrow(_exact(dim), "key bigint, neighbour bigint, open int, cosine double").where(F.col("cosine") >= least)
    ranked = measured.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour")))
    return certain.unionByName(ranked.where("place <= open").select("key", "neighbour", "cosine"))


def brute_force(vectors: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k most similar others of every vector, for measuring recall on small tables."""
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    products = unit @ unit.T
    np.fill_diagonal(products, -2)
    return np.argsort(-products, axis=1, kind="stable")[:, :k]

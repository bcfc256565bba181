"""Sets of hashed tokens, classes of equal sets, and exact checks of pairs.

The operators on set similarity share this frame.  Records with equal sets form
one class; candidates are searched and verified between classes only, so a third
of all rows being copies costs one row per task.  A set is a sorted array of
64-bit hashes of its tokens; two of N different tokens share a hash with
probability N*N / 2**65.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from recollex.sources.shared import Scratch, shuffle_width

_RUNS = re.compile("[a-z0-9]+|[㐀-䶿一-鿿]+")
#: Tokens whose hash a worker remembers; then it forgets all of them.
MEMO = 400_000


def words(text: str | None) -> set[str]:
    """Distinct words: runs of a-z and 0-9 of the lower-cased text, and of each run
    of CJK characters the pairs of neighbours, or its single character."""
    found = set()
    for run in _RUNS.findall(text.lower() if text else ""):
        if run[0] < "㐀" or len(run) == 1:
            found.add(run)
        else:
            found.update(map("".join, zip(run, run[1:])))
    return found


def spaced_tokens(text: str | None) -> set[str]:
    """Distinct lower-cased tokens between white space; none of a null."""
    return set(text.lower().split()) if text else set()


def clean_tags(tags: list | None) -> set[str]:
    """Distinct lower-cased, trimmed tags without nulls and blanks."""
    return {t for tag in tags or () if tag is not None and (t := tag.strip().lower())}


class Hasher:
    """64-bit hashes of tokens, remembered within a bound."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, tokens: set[str]) -> np.ndarray:
        memo = self.memo
        try:
            values = [memo[t] for t in tokens]
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            values = []
            for t in tokens:
                h = memo.get(t)
                if h is None:
                    h = memo[t] = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))
                values.append(h)
        made = np.array(values, dtype=np.uint64)
        made.sort()
        return made


def _hashed(split: Callable, least: int, with_sets: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        seen: set[int] = set()
        for batch in batches:
            ids, classes, sets = [], [], []
            for i, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = split(payload)
                if len(tokens) < least or i is None:
                    continue
                made = hasher(tokens)
                c = xxhash.xxh3_64_intdigest(made.tobytes())
                if with_sets:
                    if c in seen:
                        continue
                    if len(seen) > MEMO:
                        seen.clear()
                    seen.add(c)
                    sets.append(made)
                else:
                    ids.append(i)
                classes.append(c)
            made_classes = pa.array(np.array(classes, dtype=np.uint64).view(np.int64))
            if with_sets:
                yield pa.RecordBatch.from_arrays([made_classes, listed(sets)], ["class", "tokens"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), made_classes], ["id", "class"])

    return run


def listed(sets: list[np.ndarray]) -> pa.ListArray:
    """An Arrow list column of 64-bit integers."""
    ends = np.zeros(len(sets) + 1, dtype=np.int32)
    np.cumsum([len(s) for s in sets], out=ends[1:])
    flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def flat_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a list column end to end, and the ends of its rows (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    return values.view(np.uint64), (ends - ends[0]).astype(np.int64)


def _plain(records: DataFrame) -> DataFrame:
    """The first two columns, the id as a string."""
    i, payload = records.columns[:2]
    return records.select(F.col(i).cast("string"), payload)


def memberships(records: DataFrame, split: Callable, least: int = 1) -> DataFrame:
    """(id, class) of records (id, payload), once each; records with fewer than `least` tokens have none."""
    return _plain(records).mapInArrow(_hashed(split, least, False), "id string, class bigint").distinct()


def class_sets(records: DataFrame, split: Callable, scratch: Scratch, least: int = 1) -> DataFrame:
    """(class, tokens), one row per distinct set, kept bucketed by class.

    A task hands on each set it sees once, so a set that a third of all rows have
    is shuffled once per task.
    """
    sets = _plain(records).mapInArrow(_hashed(split, least, True), "class bigint, tokens array<bigint>")
    return scratch.keep_bucketed(sets.dropDuplicates(["class"]), "class", shuffle_width(scratch.spark))


def similar(candidates: DataFrame, sets: DataFrame, above: int, below: int) -> DataFrame:
    """Of candidate class pairs (a, b) those with shared / all tokens >= above / below, as
    (a, b, shared, total).  Integers decide, so no pair at the threshold is lost to rounding."""
    one = sets.select(F.col("class").alias("a"), F.col("tokens").alias("tokens_a"))
    two = sets.select(F.col("class").alias("b"), F.col("tokens").alias("tokens_b"))
    both = candidates.join(one, "a").join(two, "b")
    n, m = F.size("tokens_a"), F.size("tokens_b")
    both = both.where((n * below >= m * above) & (m * below >= n * above))
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    measured = both.select("a", "b", shared.alias("shared"), (n + m).alias("sum"))
    return measured.select("a", "b", "shared", (F.col("sum") - F.col("shared")).alias("total")).where(F.col("shared") * below >= F.col("total") * above)


def between_ids(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, once each: ids of linked classes, and ids of one class."""
    a = members.select(F.col("class").alias("a"), F.col("id").alias("x"))
    b = members.select(F.col("class").alias("b"), F.col("id").alias("y"))
    linked = pairs.select("a", "b").join(a, "a").join(b, "b").select("x", "y").where("x <> y")
    copies = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class")
    copied = members.join(copies, "class")
    within = copied.select("class", F.col("id").alias("x")).join(copied.select("class", F.col("id").alias("y")), "class").where("x < y").select("x", "y")
    found = linked.unionByName(within)
    return found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def linked_classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class, copies, links): the least id of the class, the ids in it, and the other classes it is paired with."""
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    about = members.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")).join(links, "class", "left")
    return members.join(about, "class").select("id", F.col("least").alias("class"), "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))

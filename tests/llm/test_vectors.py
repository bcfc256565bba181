import numpy as np
import pytest
from pyspark.sql import functions as F

from recollex.llm import vector_forest
from recollex.llm import vector_forest
from recollex.llm.vector_forest import STEPS, brute_force, coarse, from_coarse, hot_prefixes, nearest, packed, runs, symbol_bits, symbols_of, unpacked, usable_vectors
from recollex.sources.shared import Scratch

ROWS = "id string, embedding array<float>, at timestamp_ntz"


def clusters(n, size, dim=128, noise=0.04, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n, dim))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return np.concatenate([c + noise * rng.standard_normal((size, dim)) for c in centres])


def searched(spark, vectors, k=5, least=-1.0, exact=False):
    """Pairs of numbers of vectors, each with its neighbours."""
    rows = spark.createDataFrame([(f"{i:05d}", v.tolist(), None) for i, v in enumerate(vectors)], ROWS).withColumn("at", F.lit("2026-01-01").cast("timestamp_ntz"))
    scratch = Scratch(spark)
    made = usable_vectors(rows, vectors.shape[1], scratch)
    near = nearest(made, vectors.shape[1], k, scratch, least, exact=exact).collect()
    ids = {r.key: int(r.id) for r in made.select("id", "key").collect()}
    return {(ids[r.key], ids[r.neighbour]): r.cosine for r in near}


def recall(found, vectors, k=5):
    true = brute_force(vectors, k)
    return np.mean([(i, j) in found for i, near in enumerate(true.tolist()) for j in near])


def test_recall_against_brute_force(spark):
    vectors = clusters(120, 12)
    found = searched(spark, vectors)
    assert recall(found, vectors) >= 0.95
    counts = np.bincount([i for i, _ in found])
    assert counts.max() <= 5 and all(i != j for i, j in found)


def test_near_ties_are_decided_on_exact_vectors(spark):
    vectors = clusters(30, 40, noise=0.03)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    found = searched(spark, vectors, least=0.8, exact=True)
    assert all(c >= 0.8 and abs(c - unit[i] @ unit[j]) < 1e-5 for (i, j), c in found.items())
    true = {(i, j) for i, near in enumerate(brute_force(vectors, 5).tolist()) for j in near if unit[i] @ unit[j] >= 0.8}
    assert len(found.keys() - true) <= 0.02 * len(true) and len(found.keys() & true) >= 0.97 * len(true)
    assert searched(spark, vectors, least=0.8).keys() == found.keys()


def test_result_does_not_depend_on_the_number_of_tasks(spark):
    vectors = np.concatenate([clusters(40, 30), clusters(1, 900, noise=0.02, seed=5)])
    found = []
    for width in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        found.append(searched(spark, vectors, least=0.5).keys())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_hot_prefixes_are_cut_longer(spark, monkeypatch):
    for name, value in (("HELD", 100), ("NODE", 64), ("QUOTA", 16), ("HOT_PART", 0.0), ("WHOLE", 64)):
        monkeypatch.setattr(vector_forest, name, value)
    vectors = np.concatenate([clusters(1, 300, noise=0.01), np.ones((250, 128)), clusters(20, 10)])
    scratch = Scratch(spark)
    rows = spark.createDataFrame([(f"{i:05d}", v.tolist(), None) for i, v in enumerate(vectors)], ROWS)
    hot = hot_prefixes(usable_vectors(rows, 128, scratch), 128, 8)
    assert len(hot) == symbols_of(128) and all(hot) and max(hot[-1].values()) >= 3
    found = searched(spark, vectors, least=0.75)
    assert (np.bincount([i for i, _ in found], minlength=750)[:550] == 5).all()


def test_unusable_vectors_and_versions(spark):
    good = [0.0] * 127 + [2.0]
    other = [1.0] * 128
    rows = [("a", good, None), ("b", None, None), ("c", [], None), ("d", [1.0] * 48, None), ("e", [0.0] * 128, None), ("f", [float("nan")] + good[1:], None), ("g", [float("inf")] + good[1:], None), (None, good, None)]
    frame = spark.createDataFrame(rows, "id string, embedding array<float>, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    newer = spark.createDataFrame([("a", other, "2026-01-01"), ("a", good, "2025-01-01")], "id string, embedding array<float>, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    scratch = Scratch(spark)
    found = usable_vectors(frame.unionByName(newer), 128, scratch).collect()
    assert [r.id for r in found] == ["a"]
    assert np.allclose(unpacked(np.frombuffer(found[0].vector, "<i2")[None, :])[0], np.ones(128) / 128**0.5, atol=1e-4)
    assert nearest(usable_vectors(frame.where("id = 'b'"), 128, scratch), 128, 5, scratch).count() == 0


def test_many_equal_vectors(spark):
    rows = [(f"{i}", [1.0] * 128, None) for i in range(400)] + [(f"x{i}", np.eye(128)[i].tolist(), None) for i in range(100)]
    frame = spark.createDataFrame(rows, "id string, embedding array<float>, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    scratch = Scratch(spark)
    near = nearest(usable_vectors(frame, 128, scratch), 128, 5, scratch, 0.75).groupBy("key").count().collect()
    assert len(near) == 400 and {r["count"] for r in near} == {5}


def test_other_columns_and_their_order(spark):
    rows = spark.createDataFrame([("k", "2026-01-01", [1.0] * 128, "x", 3)], "key string, at string, embedding array<float>, id string, vector int").withColumn("at", F.col("at").cast("timestamp_ntz"))
    assert [r.id for r in usable_vectors(rows, 128, Scratch(spark)).collect()] == ["x"]


@pytest.mark.parametrize("dim", [127, 128, 130])
def test_packing_is_close(dim):
    vectors = np.random.default_rng(0).standard_normal((50, dim))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    assert np.abs((unpacked(packed(vectors)) * unit).sum(axis=1) - 1).max() < 1e-6
    rough, spreads = from_coarse(coarse(vectors), dim)
    errors = np.abs(rough @ rough.T - unit @ unit.T)
    assert (errors <= 6 * np.sqrt(spreads[:, None] ** 2 + spreads[None, :] ** 2)).all() and 1e-5 < errors.max() < 1 / STEPS


def test_runs_cover_all_rows():
    strings = np.sort(np.random.default_rng(0).integers(0, 2**56, 5000) >> 32 << 32)
    covered = np.zeros(5000, int)
    for a, b in runs(strings, 0, 5000, 128):
        assert 0 < b - a <= 1024
        covered[a:b] += 1
    assert (covered == 1).all() and symbol_bits(128) * symbols_of(128) == 56


def test_a_dense_cluster_longer_than_a_node(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(128)
    vectors = (centre / np.linalg.norm(centre) + rng.uniform(0.004, 0.02, (20_000, 1)) * rng.standard_normal((20_000, 128))).astype(np.float32)
    rows = spark.createDataFrame([(f"{i:05d}", v.tolist(), None) for i, v in enumerate(vectors)], ROWS)
    scratch = Scratch(spark)
    made = scratch.keep(usable_vectors(rows, 128, scratch))
    near = nearest(made, 128, 5, scratch, 0.75).toPandas()
    ids = {r.key: int(r.id) for r in made.select("id", "key").collect()}
    found = set(zip(near.key.map(ids), near.neighbour.map(ids)))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    hits = 0
    for s in range(0, 20_000, 500):
        products = unit[s : s + 500] @ unit.T
        products[np.arange(500), np.arange(s, s + 500)] = -2
        hits += sum((s + i, j) in found for i, best in enumerate(np.argpartition(products, -5, axis=1)[:, -5:].tolist()) for j in best)
    assert hits / (5 * 20_000) >= 0.95


def test_more_vectors_get_more_trees():
    # a prefix of two symbols instead of one is shared by near vectors about half as often
    assert vector_forest.forest(100_000, 128) == 8
    for n, level in ((100_000, 1), (400_000, 2), (10_000_000, 2), (300_000_000, 3)):
        assert 1 - (1 - vector_forest.SHARED**level) ** vector_forest.forest(n, 128) >= 0.99


def test_trees_in_groups_find_what_they_find_together(spark, monkeypatch):
    rows = [(str(i), [float(x) for x in v], 1) for i, v in enumerate(clusters(400, 8))]
    scratch = Scratch(spark)
    made = usable_vectors(spark.createDataFrame(rows, "id string, embedding array<float>, at int"), 128, scratch)
    monkeypatch.setattr(vector_forest, "TREES", 9)
    together = {tuple(r) for r in nearest(made, 128, 5, scratch, 0.75, trees=9, exact=True).collect()}
    monkeypatch.setattr(vector_forest, "TREES", 4)
    assert {tuple(r) for r in nearest(made, 128, 5, scratch, 0.75, trees=9, exact=True).collect()} == together
    assert len(together) > 1000

import random
from pathlib import Path

import numpy as np
import pytest

from recollex.llm import chosen_paths
from recollex.llm.chosen_paths import similar_sets, survival, trees_for
from recollex.llm.components import hash_to_min
from recollex.llm.near_duplicates import LOST, RECALL, band_keys, banding, duplicate_classes, grouped_texts, near_duplicates, whole_recall
from recollex.llm.sets import between_ids, class_sets, clean_tags, memberships, spaced_tokens, words
from recollex.sources.shared import Scratch

TEXTS = "id string, content string"


def pairs_by_force(sets, above, below):
    found = set()
    items = sorted((i, s) for i, s in sets.items() if s)
    for n, (i, a) in enumerate(items):
        for j, b in items[n + 1 :]:
            if len(a & b) * below >= len(a | b) * above:
                found.add((i, j))
    return found


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    if rng.random() < 0.3:
        rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def library():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = {}
    for g in range(60):
        base = rng.sample(vocabulary, rng.randrange(12, 50))
        for k in range(rng.randrange(1, 6)):
            texts[f"{g:03d}-{k}"] = " ".join(edited(rng, base, rng.randrange(0, len(base) // 6)))
    return texts


def test_words_of_both_scripts():
    assert words("Foo-bar 7 foo 数据组x好") == {"foo", "bar", "7", "数据", "据组", "x", "好"}
    assert words(None) == words("") == words(" ,. ") == set()


def test_near_duplicates_equal_brute_force(spark, library):
    rows = spark.createDataFrame(list(library.items()), TEXTS).repartition(5)
    found = {tuple(r) for r in near_duplicates(rows, Scratch(spark)).collect()}
    assert found == pairs_by_force({i: words(t) for i, t in library.items()}, 7, 10)


def test_near_duplicates_of_nulls_repeats_and_empty_tables(spark):
    assert near_duplicates(spark.createDataFrame([], TEXTS), Scratch(spark)).count() == 0
    long = " ".join(f"t{i}" for i in range(200_000))
    rows = [("a", None), ("b", ""), ("c", " .,; "), ("d", "one two three"), ("d", "one two three"), ("e", "three, two ONE"), ("f", long), ("g", long + " end"), (None, "one two three"), ("h", "alone here")]
    found = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, TEXTS), Scratch(spark)).collect()}
    assert found == {("d", "e"), ("f", "g")}


def test_one_text_with_a_third_of_all_rows(spark):
    rows = [(f"c{i:03d}", "the very same statement again and again") for i in range(60)] + [(f"x{i:03d}", f"only{i} words{i} here{i}") for i in range(120)]
    frame = spark.createDataFrame(rows, TEXTS)
    assert near_duplicates(frame, Scratch(spark)).count() == 60 * 59 // 2
    classes = duplicate_classes(frame, Scratch(spark)).where("copies > 1").collect()
    assert len(classes) == 60 and len({r["class"] for r in classes}) == 1 and {r.links for r in classes} == {0}


def test_extra_columns_and_clashing_names(spark):
    rows = spark.createDataFrame([("a", "x y z", 1, 2), ("b", "x y z", 3, 4)], "id string, content string, class int, tokens int")
    assert near_duplicates(rows, Scratch(spark)).collect() == [("a", "b")]


def test_banding_meets_its_recall():
    for n in (100, 10_000, 10_000_000):
        rows, bands = banding(n, 0.7, 0.99)
        assert 1 - (1 - 0.7**rows) ** bands >= 0.99
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 100, dtype=np.uint64)
    b = np.concatenate([a[:85], rng.integers(0, 2**63, 15, dtype=np.uint64)])
    flat, ends = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 100, 200])
    keys = band_keys(flat, ends, 4, 400)
    s = 85 / 115
    assert abs((keys[0] == keys[1]).mean() - s**4) < 0.07


def test_groups_are_transitive_and_include_copies(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [("c", " ".join(base)), ("b", " ".join(base[:37])), ("a", " ".join(base[:31])), ("p", "copy of it"), ("q", "copy of it"), ("z", "single words")]
    found = {r.id: (r.group_id, r.n_words) for r in grouped_texts(spark.createDataFrame(rows, TEXTS), Scratch(spark)).collect()}
    assert found == {"c": ("a", 40), "b": ("a", 37), "a": ("a", 31), "p": ("p", 3), "q": ("p", 3)}


@pytest.mark.parametrize("above,below", [(1, 2), (3, 5), (4, 5)])
def test_chosen_paths_equal_brute_force(spark, library, above, below):
    rows = spark.createDataFrame([(i, t.upper()) for i, t in library.items()], TEXTS)
    scratch = Scratch(spark)
    sets = class_sets(rows, spaced_tokens, scratch)
    found = {tuple(r) for r in between_ids(similar_sets(sets, scratch, (above, below), 0.999), memberships(rows, spaced_tokens)).collect()}
    assert found == pairs_by_force({i: spaced_tokens(t) for i, t in library.items()}, above, below)


def test_large_leaves_are_split_not_dropped(spark):
    common = [f"s{i}" for i in range(12)]
    rows = [(f"{i:04d}", " ".join([*common, *(f"u{i // 2}_{k}" for k in range(9)), f"v{i}"])) for i in range(1200)]
    scratch = Scratch(spark)
    frame = spark.createDataFrame(rows, TEXTS)
    sets = class_sets(frame, spaced_tokens, scratch)
    found = {tuple(r) for r in between_ids(similar_sets(sets, scratch, (4, 5), 0.99), memberships(frame, spaced_tokens)).collect()}
    wanted = {(f"{i:04d}", f"{i + 1:04d}") for i in range(0, 1200, 2)}
    assert found <= wanted and len(found) >= 0.97 * len(wanted)


def test_leaves_that_stay_large_over_rounds(spark):
    rng = random.Random(6)
    sets = {f"{i:04d}": {*(f"s{k}" for k in range(10)), f"u{i}"} for i in range(300)}
    sets |= {f"x{i:04d}": {f"w{rng.randrange(3000)}" for _ in range(11)} for i in range(3000)}
    frame, scratch = spark.createDataFrame([(i, " ".join(s)) for i, s in sets.items()], TEXTS), Scratch(spark)
    made = similar_sets(class_sets(frame, spaced_tokens, scratch), scratch, (4, 5), 0.99)
    found = {tuple(r) for r in between_ids(made, memberships(frame, spaced_tokens)).collect()}
    wanted = pairs_by_force(sets, 4, 5)
    assert len(wanted) >= 300 * 299 // 2 and len(found & wanted) == len(found) >= 0.99 * len(wanted)


def test_sets_that_share_no_more_than_a_path(spark):
    rng = random.Random(7)
    rows = [(f"{i:04d}", ["x", "y", "z", f"u{i}"]) for i in range(300)] + [(f"x{i:05d}", [f"w{rng.randrange(3000)}" for _ in range(6)]) for i in range(30_000)]
    frame, scratch = spark.createDataFrame(rows, "id string, tags array<string>"), Scratch(spark)
    made = similar_sets(class_sets(frame, clean_tags, scratch, 4), scratch, (3, 5))
    assert between_ids(made, memberships(frame, clean_tags, 4)).where("id_b < '0300'").count() == 300 * 299 // 2


def test_chosen_paths_of_nothing(spark):
    scratch = Scratch(spark)
    rows = spark.createDataFrame([("a", None), ("b", ["x", None, " "])], "id string, tags array<string>")
    sets = class_sets(rows, clean_tags, scratch, 4)
    assert similar_sets(sets, scratch, (3, 5)).count() == 0


def test_trees_follow_recall():
    assert survival(4 / 3, 3) > survival(1, 3) > survival(1, 5) > 0.25
    assert trees_for(0.5, 0.999, 4) > trees_for(0.5, 0.9, 4) >= trees_for(0.5, 0.9, 2)


@pytest.mark.parametrize("blocked,most,measured", [(16, 4, 1), (16, 1000, 1), (64, 1, 2)])
def test_large_leaves_in_blocks_and_in_rounds(spark, monkeypatch, blocked, most, measured):
    for name, value in (("BLOCKED", blocked), ("MOST_BLOCKS", most), ("MEASURED", measured), ("LEAF_AIM", 32)):
        monkeypatch.setattr(chosen_paths, name, value)
    rng = random.Random(9)
    sets = {f"{i:04d}": {*(f"s{k}" for k in range(9)), f"u{i % 40}", f"v{i}"} for i in range(400)}
    sets |= {f"x{i:04d}": {f"w{rng.randrange(400)}" for _ in range(11)} for i in range(600)}
    frame, scratch = spark.createDataFrame([(i, " ".join(s)) for i, s in sets.items()], TEXTS), Scratch(spark)
    made = similar_sets(class_sets(frame, spaced_tokens, scratch), scratch, (4, 5), 0.999)
    found = {tuple(r) for r in between_ids(made, memberships(frame, spaced_tokens)).collect()}
    wanted = pairs_by_force(sets, 4, 5)
    assert found <= wanted and len(found) >= 0.99 * len(wanted) > 1500


def test_contained_sets_meet_their_recall(spark):
    rng = random.Random(10)
    sets = {}
    for i in range(1500):
        words = [f"w{rng.randrange(20_000)}" for _ in range(24)]
        sets |= {f"a{i:04d}": set(words), f"b{i:04d}": set(words[:12])}
    frame, scratch = spark.createDataFrame([(i, " ".join(s)) for i, s in sets.items()], TEXTS), Scratch(spark)
    made = similar_sets(class_sets(frame, spaced_tokens, scratch), scratch, (1, 2))
    found = {tuple(r) for r in between_ids(made, memberships(frame, spaced_tokens)).collect()}
    wanted = pairs_by_force(sets, 1, 2)
    assert found <= wanted and len(found) >= 0.9 * len(wanted) > 1000


def test_turns_together_are_the_whole_walk():
    rng = np.random.default_rng(11)
    sets = [np.sort(rng.choice(2**40, size=n, replace=False).astype(np.uint64)) for n in rng.integers(3, 40, 300)]
    values, ends = np.concatenate(sets), np.cumsum([0, *map(len, sets)])

    def walked(turns):
        made = [chosen_paths.branch(values, ends, turn, (1, 2), lambda t: np.full(len(t), -2.0), -6.0) for turn in turns]
        return sorted(row for four in made for row in zip(*(x.tolist() for x in four)))

    whole = walked([(np.arange(5), 0, 1)])
    assert len(whole) > 5000
    for leaves in (1, 8, 20, 24, 25, 130):
        turns = chosen_paths.turns_for(5, leaves)
        assert all(len(trees) * leaves / parts <= chosen_paths.AT_ONCE for trees, _, parts in turns)
        assert walked(turns) == whole


def test_leaves_are_on_disk_a_turn_at_a_time(spark, library, monkeypatch):
    class Watched(Scratch):
        most = 0

        def keep(self, frame):
            kept = super().keep(frame)
            folder = Path(self.root.removeprefix("file://"))
            held = [spark.read.parquet(str(f)) for f in folder.iterdir()]
            self.most = max(self.most, sum(f.count() for f in held if "s0" in f.columns))
            return kept

    rows = spark.createDataFrame(list(library.items()), TEXTS)
    found, most = [], []
    for at_once in (10**6, 12):
        monkeypatch.setattr(chosen_paths, "AT_ONCE", at_once, raising=False)
        scratch = Watched(spark)
        pairs = similar_sets(class_sets(rows, spaced_tokens, scratch), scratch, (1, 2), 0.999)
        found.append({tuple(r) for r in pairs.collect()})
        assert len(list(Path(scratch.root.removeprefix("file://")).iterdir())) == 2  # the sets and the pairs
        most.append(scratch.most)
    assert found[0] == found[1] and len(found[0]) > 50
    assert 0 < 2 * most[1] < most[0]


def components_by_force(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_hash_to_min_equals_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(f"{rng.randrange(300):03d}", f"{rng.randrange(300):03d}") for _ in range(200)] + [("500", "500"), (None, "501"), ("502", None)]
    found = {r.vertex: r.group for r in hash_to_min(spark.createDataFrame(links, "a string, b string"), "a", "b", Scratch(spark)).collect()}
    assert found == components_by_force(links)


def test_hash_to_min_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(100, 164)] + [(1, i) for i in range(1000, 1300)] * 2
    found = {r.vertex: r.group for r in hash_to_min(spark.createDataFrame(chain, "a bigint, b bigint"), "a", "b", Scratch(spark)).collect()}
    assert found == components_by_force(chain)
    assert hash_to_min(spark.createDataFrame([], "a bigint, b bigint"), "a", "b", Scratch(spark)).count() == 0


def test_hot_vertices_are_salted(spark, monkeypatch):
    from recollex.llm import components

    monkeypatch.setattr(components, "HOT_ROWS", 10)
    links = [(1, i) for i in range(2, 200)] + [(500, 501)]
    found = {r.vertex: r.group for r in components.hash_to_min(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b", Scratch(spark)).collect()}
    assert found == components_by_force(links)


def test_pairs_at_the_threshold_are_next_to_never_lost(spark):
    rows, texts = [], 1500
    for t in range(texts):  # 14 words of 20 shared: 0.7
        shared = [f"s{t}x{i}" for i in range(14)]
        rows += [(f"{t}-{side}", " ".join(shared + [f"{side}{t}x{i}" for i in range(3)])) for side in "ab"]
    assert near_duplicates(spark.createDataFrame(rows, TEXTS), Scratch(spark)).count() == texts


def test_a_larger_table_is_not_expected_to_lose_more_pairs():
    for n in (1, 1000, 250_000, 8_000_000, 10**9):
        rows, bands = banding(n, 0.7, whole_recall(n))
        assert n * (1 - 0.7**rows) ** bands <= LOST * 1.001 and 1 - (1 - 0.7**rows) ** bands >= RECALL

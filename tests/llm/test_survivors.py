import itertools
import random

from recollex.llm import survivors
from recollex.llm.survivors import Bundle, Dependency, assemble, best_combination, choose_suppliers

MEMBERS = "`group` string, id string, n int, importance double, session string, space string, t1 double, t2 double"
TEXT = Bundle("content", ("body",), "n")
RATING = Bundle("rating", ("importance",), "CASE WHEN importance BETWEEN 0 AND 10 THEN importance END")
ORIGIN, PLACE = Bundle("origin", ("session",), "t1"), Bundle("place", ("space",), "t2")
RULE = Dependency("origin", "session", "place", "space")


def test_free_bundles_take_the_most_trusted_member(spark):
    rows = [("g", "b", 5, 11.0, None, None, None, None), ("g", "a", 5, float("nan"), None, None, None, None), ("g", "c", 2, 7.0, None, None, None, None), ("g", "d", None, 7.0, None, None, None, None), ("h", "x", None, None, None, None, None, None), (None, "y", 9, 9.0, None, None, None, None)]
    found = {r.group: (r.content_id, r.rating_id) for r in choose_suppliers(spark.createDataFrame(rows, MEMBERS), [TEXT, RATING]).collect()}
    assert found == {"g": ("a", "c"), "h": (None, None)}


def test_no_members(spark):
    assert choose_suppliers(spark.createDataFrame([], MEMBERS), [TEXT, RATING]).count() == 0
    assert choose_suppliers(spark.createDataFrame([], MEMBERS), [TEXT, ORIGIN, PLACE], [RULE]).count() == 0


def test_dependency_between_bundles(spark):
    rows = [("g", "a", 1, 1.0, "s1", "w1", 3.0, 1.0), ("g", "b", 2, 1.0, "s2", "w2", 1.0, 9.0), ("g", "b", 2, 1.0, "s2", "w2", 1.0, 9.0), ("h", "c", 1, 1.0, "s1", "w1", 5.0, 5.0)]
    found = {r.group: (r.content_id, r.origin_id, r.place_id) for r in choose_suppliers(spark.createDataFrame(rows, MEMBERS), [TEXT, ORIGIN, PLACE], [RULE]).collect()}
    assert found == {"g": ("b", "b", "b"), "h": ("c", "c", "c")}


def test_clashing_names(spark):
    rows = spark.createDataFrame([("g", "a", 1, 1.0, "s1", "w1", 1.0, 1.0)], MEMBERS).selectExpr("*", "0 as trust_content", "0 as feasible", "0 as bundle", "0 as allowed", "0 as most_place", "0 as content_id")
    assert [tuple(r) for r in choose_suppliers(rows, [TEXT, ORIGIN, PLACE], [RULE]).collect()] == [("g", "a", "a", "a")]


def test_branch_and_bound_equals_trying_all():
    rng = random.Random(3)
    for _ in range(60):
        offers = {b: [(rng.randrange(6) / 2, f"{b}{i}", {"x": rng.randrange(3), "y": rng.randrange(3)}) for i in range(rng.randrange(1, 5))] for b in "abc"}
        rules = [(Dependency("a", "x", "b", "y"), {k: rng.randrange(3) for k in range(3)}), (Dependency("b", "x", "c", "y"), {0: rng.randrange(3)})]
        best = None
        for chosen in itertools.product(*(offers[b] for b in "abc")):
            by = dict(zip("abc", chosen))
            if all(by[r.of][2][r.field] not in m or by[r.on][2][r.on_field] == m[by[r.of][2][r.field]] for r, m in rules):
                key = (-sum(o[0] for o in chosen), tuple(o[1] for o in chosen))
                best = min(best, key) if best else key
        found = best_combination(offers, rules)
        if best:
            assert tuple(found[b] for b in "abc") == best[1]
        else:
            assert 1 <= len(found) < 3


def test_survivors_are_built_from_suppliers(spark):
    rows = spark.createDataFrame([("g", "a", 5, 1.0, "", "", 0.0, 0.0), ("g", "b", 1, 9.0, "", "", 0.0, 0.0)], MEMBERS)
    records = spark.createDataFrame([("a", "long text", 1.0), ("b", "short", 9.0)], "id string, body string, importance double")
    row = assemble(choose_suppliers(rows, [TEXT, RATING]), records, [TEXT, RATING]).first()
    assert (row.body, row.importance, row.content_id, row.rating_id) == ("long text", 9.0, "a", "b")


def test_ruled_bundles_equal_trying_all(spark):
    rng = random.Random(11)
    rows = [(f"g{rng.randrange(25)}", f"m{n:03d}", 1, 1.0, f"s{rng.randrange(6)}", rng.choice(["w0", "w1", "w2", None]), rng.choice([None, 1.0, 2.0, 3.0]), rng.choice([None, 1.0, 2.0])) for n in range(120)]
    counts = {}
    for _, _, _, _, s, w, _, _ in rows:
        if w is not None:
            counts.setdefault(s, {}).setdefault(w, 0)
            counts[s][w] += 1
    allowed = {s: min(c, key=lambda w: (-c[w], w)) for s, c in counts.items()}
    wanted = {}
    for g in {r[0] for r in rows}:
        members = [r for r in rows if r[0] == g]
        origins, places = [r for r in members if r[6] is not None], [r for r in members if r[7] is not None]
        both = [(-(o[6] + p[7]), o[1], p[1]) for o in origins for p in places if o[4] not in allowed or allowed[o[4]] == p[5]]
        best_o, best_p = min(((-o[6], o[1]) for o in origins), default=None), min(((-p[7], p[1]) for p in places), default=None)
        if both:
            wanted[g] = min(both)[1:]
        elif best_o and best_p:  # the less trusted bundle is left out, origin before place if equal
            wanted[g] = (None, best_p[1]) if (-best_o[0], "origin") < (-best_p[0], "place") else (best_o[1], None)
        else:
            wanted[g] = (best_o[1] if best_o else None, best_p[1] if best_p else None)
    found = {r.group: (r.origin_id, r.place_id) for r in choose_suppliers(spark.createDataFrame(rows, MEMBERS).repartition(3), [TEXT, ORIGIN, PLACE], [RULE]).collect()}
    assert found == wanted


def test_reported_fields_are_decided_by_branch_and_bound(spark, monkeypatch):
    rows = spark.createDataFrame([("g", "a", 5, 1.0, "s1", "w1", 3.0, 1.0), ("g", "b", 1, 9.0, "s2", "w2", 1.0, 9.0)], MEMBERS)
    bundles = [TEXT, RATING, ORIGIN, PLACE]
    assert tuple(choose_suppliers(rows, bundles, [RULE]).first()) == ("g", "a", "b", "b", "b")
    # a text that belongs to one session takes its origin along, and with it the place
    bound = Dependency("content", "body", "origin", "session")
    heavy = Bundle("content", ("body",), "n * 10")
    found = choose_suppliers(rows.selectExpr("*", "concat('text of ', id) as body"), [heavy, RATING, ORIGIN, PLACE], [RULE, bound])
    assert tuple(found.first()) == ("g", "a", "b", "a", "a")
    monkeypatch.setattr(survivors, "best_combination", lambda offers, rules: {n: max(o)[1] for n, o in offers.items() if n != "rating"})
    assert choose_suppliers(rows, bundles, [RULE]).first().rating_id is None


def test_trusts_of_very_different_size():
    offers = {"times": [(1.7e15, "a", {})], "rating": [(0.125, "b", {"v": 1}), (0.1249, "c", {"v": 2})], "place": [(1.5, "d", {"w": 2}), (1.0, "e", {"w": 1})]}
    assert best_combination(offers, []) == {"times": "a", "rating": "b", "place": "d"}
    assert best_combination(offers, [(Dependency("rating", "v", "place", "w"), {1: 1, 2: 2})]) == {"times": "a", "rating": "c", "place": "d"}

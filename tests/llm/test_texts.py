import numpy as np
import pandas as pd
import pytest
from pathlib import Path
from pyspark.sql import functions as F

from recollex.llm.abuse import FOUND, WEIGHTS, Learned, Lexicon, Trie, abuse_rates, abuse_scores, learned, ordinary_words, reviewed, scored
from recollex.llm.mixing import drawn, emitted, mixing_rates, rates_of, shares
from recollex.llm.packing import configurations, fill_report, pack, packed
from recollex.llm.tokens import VOCABULARY, counted, with_sizes
from recollex.sources.shared import Scratch
from sentences import ABUSIVE as OWN_ABUSIVE, HARMLESS


def test_token_counts(spark):
    rows = spark.createDataFrame([(1, "Hello, world", 5), (2, None, 5), (3, "", 5), (4, "数据组 <|endoftext|>", 5), (5, "a" * 200_000, 5)], "doc_id bigint, text string, n_tokens int")
    found = {r.doc_id: r.n_tokens for r in with_sizes(rows).collect()}
    assert found == dict(zip(range(1, 6), counted(Path(VOCABULARY).read_bytes(), [r.text for r in rows.collect()])))
    assert found[2] == found[3] == 0 and found[1] == 3


def test_packing_is_whole_and_tight():
    rng = np.random.default_rng(5)
    for capacity, lengths in ((512, rng.integers(1, 513, 3000)), (512, rng.integers(1, 513, 20_000)), (512, np.full(900, 200)), (2048, np.minimum(2048, rng.lognormal(5, 1, 4000).astype(int) + 1)), (100, np.array([], dtype=int)), (10, np.array([10, 1, 9]))):
        placed = pack(lengths, capacity)
        assert len(placed) == len(lengths) and (placed >= 0).all()
        if len(lengths):
            used = np.bincount(placed, weights=lengths)
            assert used.max() <= capacity
            assert len(used) <= max(np.ceil(lengths.sum() / capacity), (lengths * 2 > capacity).sum()) * (1.05 if len(lengths) < 5000 else 1.01) + 2 or (lengths == 200).all()
    assert len(np.unique(pack(np.full(900, 200), 512))) == 450


def test_configurations_beat_single_sizes():
    sizes, demands = np.array([60, 45, 35, 20]), np.array([30.0, 40.0, 50.0, 60.0])
    used = configurations(sizes, demands, 100)
    covered = sum(counts * times for counts, times in used)
    assert np.allclose(covered, demands) and sum(t for _, t in used) <= 1.02 * (sizes * demands).sum() / 100 + 1
    assert all((counts * sizes).sum() <= 100 for counts, _ in used)


def test_containers_hold_every_token_once(spark):
    sized = spark.createDataFrame([(i, n) for i, n in enumerate([0, 5, 100, 101, 350, 99, 1] * 30)], "doc_id bigint, n_tokens bigint").withColumn("piece", F.lit(9))
    kinds = spark.createDataFrame([("a", 100), ("b", 64), ("bad", 0), (None, 5)], "container_kind string, capacity_tokens bigint")
    found = packed(sized, kinds)
    rows = found.toPandas()
    assert set(rows.container_kind) == {"a", "b"}
    for kind, capacity in (("a", 100), ("b", 64)):
        part = rows[rows.container_kind == kind]
        assert part.groupby("container_id").n_tokens.sum().max() <= capacity
        whole = part.groupby("doc_id").n_tokens.sum()
        assert whole.to_dict() == {r.doc_id: r.n_tokens for r in sized.collect() if r.n_tokens}
        assert (part.groupby("doc_id").size() == np.ceil(whole / capacity)).all()
        assert not part.duplicated(["container_id", "position"]).any()
    assert {r.container_kind for r in fill_report(found, kinds).collect()} == {"a", "b"}
    assert packed(sized.limit(0), kinds).count() == 0 and packed(sized, kinds.limit(0)).count() == 0


def target(**columns):
    base = {"source": ["a", "b"], "target_share": [1.0, 3.0], "max_repeats": [2, 10], "wanted": [1000.0, 1000.0], "tokens": [1000, 100]}
    return pd.DataFrame(base | columns)


def test_rates():
    assert rates_of(target()).rate.tolist() == [0.25, 7.5]
    capped = rates_of(target(max_repeats=[2, 3]))
    assert capped.rate.tolist() == [0.7, 3.0] and capped.capped.tolist() == [False, True]
    gone = rates_of(target(tokens=[1000, None]))
    assert gone.rate.tolist() == [1.0, 0.0]
    assert rates_of(target(target_share=[None, float("nan")])).rate.tolist() == [0.0, 0.0]
    assert rates_of(target(max_repeats=[1, 1], wanted=[5000.0, 5000.0])).rate.tolist() == [1.0, 1.0]


def test_shares_are_kept_where_asked():
    kept = rates_of(target(source=["a", "b", "gone"], target_share=[1.0, 3.0, 2.0], max_repeats=[2, 3, 2], wanted=[1000.0] * 3, tokens=[1000, 100, None]), "shares")
    assert kept.expected_share.tolist() == [0.25, 0.75, 0.0] and kept.rate.tolist() == [0.1, 3.0, 0.0] and kept.capped.tolist() == [True, True, True]
    assert rates_of(target(), "shares").rate.tolist() == [0.25, 7.5]
    with pytest.raises(ValueError):
        rates_of(target(), "odd")


def test_mix_reaches_its_shares(spark):
    sized = spark.createDataFrame([(i, "big" if i % 10 else "small", 10 + i % 7, 1.0) for i in range(6000)] + [(9000, None, 50, 1.0), (9001, "big", 0, 1.0)], "doc_id bigint, source string, n_tokens bigint, rate double")
    targets = spark.createDataFrame([("m", "Big ", 1.0, 2, 0.5), ("m", "SMALL", 1.0, 3, 0.5), ("m", "none", 0.0, 1, 0.5)], "mix_name string, source string, target_share double, max_repeats int, size_ratio double")
    scratch = Scratch(spark)
    rates = mixing_rates(sized, targets)
    draws = drawn(sized, rates, scratch)
    report = {r.source: r for r in shares(rates, draws).collect()}
    assert abs(report["big"].reached_share - report["big"].expected_share) < 4 * report["big"].deviation < 0.05 and report["none"].drawn_tokens == 0
    copies = draws.groupBy("source").agg(F.min("copies").alias("lo"), F.max("copies").alias("hi")).collect()
    assert {(r.source, r.lo, r.hi) for r in copies} == {("small", 2, 3), ("big", 1, 1)}
    assert emitted(draws).count() == draws.agg(F.sum("copies")).first()[0]
    again = drawn(sized.repartition(7), rates, scratch)
    assert draws.exceptAll(again).count() == 0
    assert drawn(sized.limit(0), mixing_rates(sized.limit(0), targets), scratch).count() == 0


@pytest.fixture(scope="module")
def lexicon():
    return Lexicon(ordinary_words())


ABUSIVE = [
    "you are a complete idiot", "IDIIIOT, nobody asked", "what a w4nker", "you i-d-i-o-t", "you i d i o t", "you id*ot", "bitchs, all of you", "you usеlеss dickhеad", "you scumbga", "quoting the message: kill yourself",
    "Halt die Fresse, du Arschloch", "va te faire foutre, connard", "vete a la mierda, cabrón", "你这个蠢货", "傻 逼", "spread your legs and let me taste you", "all of them are vermin and should be driven out", "ich schlag dir den Schädel ein",
]
NEUTRAL = [
    None, "", "   ", "kill -9 the zombie children, then kill the parent as well", "my own stupid mistake", "ich Trottel habe es vergessen", "this stupid test timed out again", "sexual health clinic demo data", "a moderator removed an abusive comment",
    "the classifier has the term idiot in its list", "我自己太笨了", "batch the patch, then switch", "your patch is wrong and i am disappointed", "the column sexo may be null", "penetration test of the cockpit finished", "suicide timer fires", "scunthorpe assess analysis",
]


@pytest.mark.parametrize("text", ABUSIVE)
def test_abuse_is_found(lexicon, text):
    assert scored(lexicon, Learned(), text)[0] >= FOUND


@pytest.mark.parametrize("text", NEUTRAL)
def test_neutral_texts_are_not(lexicon, text):
    assert scored(lexicon, Learned(), text)[0] < FOUND


def levenshtein(a, b):
    """Edits with swaps of neighbours."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_trie_equals_comparing_with_every_term():
    rng = np.random.default_rng(7)
    make = lambda n: "".join(rng.choice(list("abc"), n))
    terms = sorted({make(rng.integers(3, 8)) for _ in range(80)})
    trie = Trie(terms)
    for _ in range(300):
        word = make(rng.integers(3, 9))
        near = [(levenshtein(word, t), t) for t in terms if t[0] == word[0]]
        best = min((x for x in near if x[0] <= 2), default=None)
        found = trie.near(word, 2)
        assert (found and (found[1], found[0])) == best


def test_scores_of_documents(spark):
    rows = [(1, "Chat-Relay", "you absolute moron"), (2, "chat_relay ", "all fine"), (3, None, None), (4, "notes", "quoting the message: you absolute moron"), (5, "notes", "x " * 200_000 + "you absolute moron")]
    found = abuse_scores(spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("hits", F.lit(1)), Scratch(spark))
    by = {r.doc_id: r for r in found.collect()}
    assert [by[i].score >= FOUND for i in range(1, 6)] == [True, False, False, True, True]
    assert by[4].quoted_score > 0 == by[1].quoted_score and by[3].score == 0 and by[2].terms == []
    assert {r.source: r.rate for r in abuse_rates(found).collect()} == {"chat_relay": 0.5, None: 0.0, "notes": 1.0}
    assert abuse_scores(spark.createDataFrame([], "doc_id bigint, source string, text string"), Scratch(spark)).count() == 0


def test_a_score_is_that_of_the_text_alone(spark):
    for n in (1, 5, 60):
        rows = [(i, "a", "you idoit") for i in range(n)] + [(100, "a", "what a scumbga"), (101, "a", "in regard to the planner")]
        found = abuse_scores(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), Scratch(spark))
        assert {r.doc_id for r in found.where(F.col("score") >= FOUND).collect()} == {*range(n)}


def test_own_sentences_in_five_languages(lexicon):
    true = false = missed = 0
    for lang, lines in OWN_ABUSIVE.items():
        found = [scored(lexicon, Learned(), x)[0] >= FOUND for x in lines.split("\n")]
        harmless = [scored(lexicon, Learned(), x)[0] >= FOUND for x in HARMLESS[lang].split("\n")]
        assert sum(found) >= 0.8 * len(found) and sum(harmless) <= 0.2 * len(harmless)
        true, missed, false = true + sum(found), missed + len(found) - sum(found), false + sum(harmless)
    assert true / (true + missed) >= 0.9 and true / (true + false) >= 0.85


def test_phrases_and_weights_are_learned_from_reviews(spark):
    rng = np.random.default_rng(4)
    filler = lambda: " ".join(rng.choice(["build", "index", "cache", "table", "stream", "column", "patch", "queue"], 12))
    bad = "a chair has more wits than the likes of you"
    rows = [(i, "a", f"{filler()} {bad if i % 5 == 0 else ''} {filler()}") for i in range(400)]
    rows += [(1000 + i, "b", f"{filler()} they say dildo twice {filler()}") for i in range(120)]
    documents = spark.createDataFrame([*rows, (5000, "c", None), (5001, "c", f"x {bad} y"), (5002, "c", "the chair has four legs and more wits")], "doc_id bigint, source string, text string")
    labels = [(i, "r1", int(i % 5 == 0), "Insult " if i % 5 == 0 else None) for i in range(200)] + [(1000 + i, "r1", 0, None) for i in range(100)]
    labels += [(5000, "r1", 1, None), (9999, "r1", 1, "threat"), (None, "r1", 1, None), (3, "r2", None, None), (6, "r2", 1, "hate"), (10, "r2", 1, None)]
    reviews = spark.createDataFrame(labels, "doc_id bigint, reviewer string, is_abusive int, category string")
    scratch = Scratch(spark)
    context = spark.sparkContext
    known = learned(documents, reviews, scratch, context.broadcast(ordinary_words()))
    assert {c for _, c in known.phrases.values()} == {"insult"} and "wits than the likes" in known.phrases and known.kinds["strong plain"] < 0.2 < WEIGHTS["strong plain"]
    found = {r.doc_id: r for r in abuse_scores(documents, scratch, reviews).collect()}
    held_out = [found[i].score >= FOUND for i in range(200, 400)]
    assert held_out == [i % 5 == 0 for i in range(200, 400)]
    assert found[5001].score >= FOUND and found[5001].category == "insult" and found[5002].score == 0 == found[5000].score and found[1110].score < FOUND
    assert reviewed(reviews, 50).count() == 50 and 6 not in {r.doc_id for r in reviewed(reviews).collect()}
    assert abuse_scores(documents, scratch, reviews.limit(0)).where("doc_id = 5001").first().score == 0


def test_words_about_terms_take_back_mentions_only(lexicon):
    for text in ("i will kill you if you touch the policy", "fix the filter, you moron", "the policy was written by an idiot"):
        assert scored(lexicon, Learned(), text)[0] >= FOUND
    for text in ("the term moron is in the list", "add idiot to the blocklist", 'the filter drops "moron" now', "slurs like whore and slut"):
        assert scored(lexicon, Learned(), text)[0] < FOUND

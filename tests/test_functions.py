import math

import pytest
from pyspark.sql import functions as F

from recollex.functions import judge, scoring, text
from recollex.functions.seams import FallbackEmbedder, HashEmbedder, RecordedJudge, RetryableError, embed, segment, with_retry


def one(spark, column, **row):
    types = {str: "string", float: "double", int: "bigint", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in row.items()) or "x int"
    return spark.createDataFrame([tuple(row.values()) or (1,)], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "given,wanted",
    [("Foo-BAR 42 foo", ["foo", "bar", "42"]), ("", []), (None, []), ("数据库", ["数据", "据库"]), ("好", ["好"]), ("用pnpm管理", ["pnpm", "用", "管理"]), ("a,数据 数据;a", ["a", "数据"]), ("Ünï", ["n"])],
)
def test_tokenize(spark, given, wanted):
    assert one(spark, text.tokenize("t"), t=given) == wanted


def fnv(s):
    h = 2166136261
    data = s.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i : i + 2])) * 16777619) & 0xFFFFFFFF
    digits = ""
    while h:
        h, r = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
    return digits or "0"


@pytest.mark.parametrize("s", ["", "a", "hello world", "记忆", "emoji 😀 end", "x" * 3000])
def test_fnv(spark, s):
    assert one(spark, text.fnv1a_base36("t"), t=s) == fnv(s)


def test_normalized_contents_share_a_key(spark):
    assert one(spark, text.normalize_content("t"), t=" A \n b\t ") == "a b"
    assert one(spark, text.dedup_key("t"), t=" A b ") == one(spark, text.dedup_key("t"), t="a  B") == fnv("a b")


def test_cuts(spark):
    assert one(spark, text.short_session("t"), t="session-63bbf845-aa") == "63bbf845"
    assert one(spark, text.short_session("t"), t="63bbf845xyz") == "63bbf845"
    assert one(spark, text.truncate_latest("t", 4), t="abc\ndef") == "def"
    assert one(spark, text.truncate_latest("t", 5), t="abc\ndef") == "c\ndef"
    assert one(spark, text.truncate_latest("t", 9), t="abc") == "abc"
    assert one(spark, text.truncate_sentence("t", 10), t="one two. three four") == "one two."
    assert one(spark, text.truncate_sentence("t", 10), t="a. bcdefghijkl") == "a. bcdefgh"
    assert one(spark, text.excerpt("t"), t="x" * 401) == "x" * 400 + "…[摘录已截断，原文 401 字符]"
    assert one(spark, text.excerpt("t"), t="x" * 400) == "x" * 400
    assert one(spark, text.strip_paragraphs("t"), t="keep\n\n  [参考记忆] gone\nstill\n\nend [参考记忆]") == "keep\n\nend [参考记忆]"
    assert one(spark, text.excerpt("t"), t=None) is None


def test_lines(spark):
    row = dict(kind="fact", content="c" * 81, importance=5.0, id="123456789", s="session-abcdefghij", at="2026-01-02 03:04:05")
    assert one(spark, text.render_line("kind", F.lit("x"), "importance", "id", "s", F.col("at").cast("timestamp_ntz")), **row) == "- [fact] x（重要度 5，记忆 #12345678，来自会话 abcdefgh，创建于 2026-01-02）"
    assert one(spark, text.render_condensed("kind", "content", "id"), **row) == "- [fact] " + "c" * 80 + "…（原文 81 字符，记忆 #12345678）"
    assert one(spark, text.catalog_row("kind", "content", "id"), **row) == "- [fact] " + "c" * 24 + "（记忆 #12345678）"


@pytest.mark.parametrize("i,days", [(5.0, 7.0), (7.0, 14.0), (9.0, 28.0), (10.0, 39.598), (None, 7.0), (float("nan"), 7.0), (99.0, 39.598)])
def test_half_life(spark, i, days):
    assert one(spark, scoring.half_life_days(F.col("i").cast("double")), i=i) == pytest.approx(days, abs=1e-3)


@pytest.mark.parametrize("n,factor", [(0, 1), (1, 2), (3, 3), (7, 4), (-5, 1)])
def test_accesses_lengthen_it(spark, n, factor):
    assert one(spark, scoring.half_life_days(F.lit(5.0), "n"), n=n) == pytest.approx(7 * factor)


@pytest.mark.parametrize("i,n,s,wanted", [(5.0, 0, None, 5), (5.0, 1, None, 6), (5.0, 3, None, 7), (5.0, 1000, None, 7), (5.0, 0, 8.0, 7), (5.0, 0, 6.0, 6), (10.0, 3, 9.0, 10)])
def test_effective_importance(spark, i, n, s, wanted):
    assert one(spark, scoring.effective_importance("i", "n", F.col("s").cast("double")), i=i, n=n, s=s) == wanted


def test_recency_and_fusion(spark):
    assert one(spark, scoring.recency(F.lit(7.0), F.lit(7.0))) == pytest.approx(0.5)
    assert one(spark, scoring.recency(F.lit(7.0), F.lit(-1.0))) == 1 == one(spark, scoring.recency(F.lit(7.0), F.lit(None).cast("double")))
    assert one(spark, scoring.rrf(F.lit(1), F.lit(1))) == pytest.approx(1)
    assert one(spark, scoring.rrf(F.lit(1), F.lit(None))) == pytest.approx(0.5)
    assert one(spark, scoring.rrf(F.lit(None), F.lit(None))) == 0
    assert one(spark, scoring.bm25_idf(F.lit(10), F.lit(10))) == pytest.approx(math.log(0.5 / 10.5 + 1))


def test_thresholds(spark):
    assert [float(one(spark, scoring.adaptive_semantic_threshold(F.lit(x)))) for x in (0.05, 0.1, 0.3, 0.31)] == [0.68, 0.70, 0.70, 0.75]
    assert [float(one(spark, scoring.adaptive_confidence(F.lit(a), F.lit(b)))) for a, b in ((10, 2), (3, 1), (2, 4), (4, 4))] == [0.5, 0.55, 0.6, 0.55]
    assert [float(one(spark, scoring.semantic_threshold(F.lit(d)))) for d in (384, 128)] == [0.72, 0.75]


def test_cosines(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, scoring.cosine(v(1, 0), v(1, 1))) == pytest.approx(0.5**0.5)
    assert one(spark, scoring.cosine(v(0, 0), v(1, 1))) == 0
    assert one(spark, scoring.cosine(v(1), v(1, 1))) is None
    assert one(spark, scoring.cosine_of_shorter(v(1), v(2, 5))) == pytest.approx(1)
    assert one(spark, scoring.usable_vector(v(1, float("inf")), F.lit(2))) is False
    assert one(spark, scoring.usable_vector(F.lit(None).cast("array<double>"), F.lit(2))) is False
    assert one(spark, scoring.jaccard(F.array(), F.array())) == 0


@pytest.mark.parametrize(
    "given,wanted",
    [('so: ```{"a": "}{"}``` ok {"b": 1}', '{"a": "}{"}'), ('{"a": {"b": "\\"}"}} x', '{"a": {"b": "\\"}"}}'), ('{"a": 1', None), ("no", None), ("", None), (None, None), ("}{ }", "{ }")],
)
def test_first_object(given, wanted):
    assert judge.first_object(given) == wanted


def test_memories_are_typed(spark):
    rows = [
        (1, '{"memories": [{"kind": "fact", "content": " x ", "importance": 6.5, "selfRelevance": -3, "tags": ["a", 1, null]}, {"kind": "nope", "content": "y"}, {"kind": "todo", "content": "  "}, {"kind": "todo", "content": "z", "importance": "7"}, 5]}'),
        (2, "broken {"), (3, None), (4, '{"memories": {}}'), (5, '{"other": []}'),
    ]
    found = [tuple(r) for r in judge.memories(spark.createDataFrame(rows, "output_id int, raw_text string")).orderBy("position").collect()]
    assert found == [(1, 0, "fact", "x", 7, 0, "a"), (1, 3, "todo", "z", None, None, None)]


def test_decisions_and_edges(spark):
    rows = [(1, '{"decisions": [{"focusId": "a", "peerId": "b", "action": "merge", "reason": ""}, {"focusId": "", "peerId": "b", "action": "merge", "reason": "r"}, {"focusId": "a", "peerId": "b", "action": "eat", "reason": "r"}, {"focusId": "a", "peerId": "b", "action": "none"}]}'), (2, '{"edges": [{"sourceId": "a", "targetId": "b", "confidence": 1}, {"sourceId": "a", "targetId": "b", "confidence": null}, {"sourceId": "a", "confidence": 0.5}]}')]
    frame = spark.createDataFrame(rows, "output_id int, raw_text string")
    assert [tuple(r)[2:] for r in judge.decisions(frame).collect()] == [("a", "b", "merge", "")]
    assert [tuple(r)[2:] for r in judge.edges(frame).collect()] == [("a", "b", 1.0, None)]


def test_models_plug_in(spark):
    class Broken:
        dim = 16

        def __call__(self, texts):
            raise RuntimeError("down")

    rows = spark.createDataFrame([("a", "w", "some text"), ("b", "w", None), ("c", "w", "some text")], "id string, workspace string, content string")
    found = {r.memory_id: r.embedding for r in embed(rows, FallbackEmbedder(Broken(), HashEmbedder(16))).collect()}
    assert set(found) == {"a", "c"} and found["a"] == found["c"] and len(found["a"]) == 16
    assert embed(rows, Broken()).count() == 0
    with pytest.raises(ValueError):
        FallbackEmbedder(HashEmbedder(8), HashEmbedder(16))
    assert RecordedJudge({"p": "{}1"})("p") == "{}1"
    words = segment(rows, "content", lambda t: t.split()).select(text.tokenize("content", "words")).first()[0]
    assert words == ["some", "text"]


def test_retry():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise RetryableError
        return x

    assert with_retry(flaky, sleep=lambda s: None)(5) == 5
    with pytest.raises(RetryableError):
        with_retry(lambda: (_ for _ in ()).throw(RetryableError()), attempts=2, sleep=lambda s: None)()


def test_messages_and_picked_words(spark):
    rows = spark.sql("select array(named_struct('source_kind', 'user', 'blocks', array(named_struct('type', 'text', 'text', 'a'), named_struct('type', 'image', 'text', 'b'))), named_struct('source_kind', 'plugin', 'blocks', array(named_struct('type', 'text', 'text', 'c'))), named_struct('source_kind', 'user', 'blocks', array(named_struct('type', 'text', 'text', 'd')))) as m")
    assert rows.select(text.user_text("m")).first()[0] == "a\nd"
    assert one(spark, text.pick_words("t", ["the", "of"]), t=["the", "end", "of", "all", "things"]) == ["end", "all"]


def test_settings():
    from recollex.config import Settings

    environment = {"RECOLLEX_EMBEDDING_DIM": "128", "KEY": "k", "RECOLLEX_JUDGE_MODEL": "m"}
    found = Settings.load({"embedding_key": "env:KEY", "judge_model": "given"}, environment)
    assert (found.embedding_dim, found.embedding_key, found.judge_model) == (128, "k", "given")
    for bad in ({"odd": 1}, {"embedding_dim": "x"}, {"judge_temperature": 3}):
        with pytest.raises(ValueError):
            Settings.load(bad, {})

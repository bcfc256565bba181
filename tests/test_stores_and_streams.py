import json
import random

import pytest
from pyspark.sql import functions as F

from recollex.api import Memory
from recollex.operators import ingest, sessions as se
from recollex.operators import similarity
from recollex.operators.similarity import similar_pairs
from recollex.sources import schema as sc, stores
from recollex.sources.tables import table
from recollex.streaming import extraction as ex

NOW = "2026-01-15 00:00:00"


def memory(id="a", **changes):
    base = {
        "id": id, "workspace": "w", "session_id": "s", "kind": "fact", "content": "some words here", "importance": 5.0, "tags": ["t"], "source": {"session_id": "s", "event_seqs": [1], "excerpt": "e"},
        "created_at": "2026-01-01 00:00:00", "updated_at": "2026-01-01 00:00:00", "access_count": 0, "status": "active",
    }
    return base | changes


def frame(spark, memories, **late):
    rows = spark.createDataFrame([(json.dumps(m),) for m in memories], "value string")
    return rows.select(F.from_json("value", sc.struct(sc.MEMORY)).alias("r")).select("r.*")


def test_json_rows_are_set_aside(spark):
    raw = [("1", json.dumps(memory())), ("2", "{broken"), ("3", json.dumps(memory("c", kind="odd"))), ("4", None), ("5", json.dumps(memory("e", importance=11)))]
    loaded = stores.load_json_rows(spark.createDataFrame(raw, "key string, value string"))
    assert [r.id for r in loaded.rows.collect()] == ["a"]
    assert {r.key: r.reason for r in loaded.quarantine.collect()} == {"2": "no JSON of a memory", "3": "invalid: kind", "4": "no JSON of a memory", "5": "invalid: importance"}


def test_json_document(spark, tmp_path):
    good = tmp_path / "memory.json"
    good.write_text(json.dumps({"tables": {"entries": {"a": memory(), "b": memory("b", status="gone")}}}))
    assert stores.load_json_document(spark, str(good)).counts() == (1, 1)
    bad = tmp_path / "bad.json"
    bad.write_text("[]")
    with pytest.raises(ValueError):
        stores.load_json_document(spark, str(bad))
    with pytest.raises(FileNotFoundError):
        stores.load_json_document(spark, str(tmp_path / "none.json"))


def test_vectors_are_stored_by_length(spark, tmp_path, data):
    stores.write_vectors(table(spark, data, "memory_vectors"), str(tmp_path / "v"))
    rows = stores.read_vectors(spark, str(tmp_path / "v"), 48)
    assert "PartitionFilters: [isnotnull(dim" in rows._jdf.queryExecution().toString()
    assert rows.count() == table(spark, data, "memory_vectors").where("dim = 48").select("memory_id").distinct().count()
    names = spark.createDataFrame([("vec2_memory_48",), ("vec_memory_128",), ("other",)], "name string")
    assert [r.name for r in stores.retired_dimensions(names, 128).collect()] == ["vec2_memory_48"]


def test_backups(spark):
    rows = spark.createDataFrame([(f"p{i}", i) for i in range(5)], "path string, made_at int")
    assert sorted(r.path for r in stores.expired_backups(rows, 2).collect()) == ["p0", "p1", "p2"]


def model(log):
    """The state that operations lead to, one after the other."""
    state, missing = {}, {}
    ever = set()
    for op in sorted(log, key=lambda o: o["op_id"]):
        i, kind = op["id"], op["op"]
        if kind == "create":
            state[i] = {"kind": op["kind"], "importance": op["importance"], "status": "active", "by": None, "actions": 1}
            ever.add(i)
        elif i not in ever:
            missing[i] = missing.get(i, 0) + 1
        elif i in state:
            entry = state[i]
            entry["actions"] += 1
            if kind == "update":
                entry["kind"], entry["importance"] = op["kind"] or entry["kind"], op["importance"] if op["importance"] is not None else entry["importance"]
            elif kind == "archive":
                entry["status"] = "archived"
            elif kind == "supersede":
                entry["by"] = op["other"] or entry["by"]
            elif kind == "delete":
                del state[i]
    return state, missing


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_operations_one_by_one(spark, seed):
    rng = random.Random(seed)
    log = []
    for n in range(1200):
        op = rng.choices(["create", "update", "archive", "supersede", "delete"], [3, 4, 1, 2, 1])[0]
        log.append({"op_id": n, "id": f"m{rng.randrange(150)}", "op": op, "at": None, "by": "user", "importance": rng.choice([None, 1.0, 9.0]) if op in ("create", "update") else 3.0, "kind": rng.choice(["fact", "todo", None]) if op == "update" else "fact", "tags": None, "content": "c", "workspace": "w", "other": rng.choice([None, "x", "y"])})
    names = [f.name for f in sc.struct(ingest.LOG).fields]
    rows = spark.createDataFrame([tuple(o.get(n) for n in names) for o in log], sc.struct(ingest.LOG)).repartition(7)
    # operations on an id between its deletion and its next creation have no effect in either
    found = {r.id: r for r in ingest.fold(rows).collect()}
    state, missing = model(log)
    born = {i for i in found if found[i].actions}
    assert born == set(state)
    for i, entry in state.items():
        assert (found[i].kind, found[i].importance, found[i].status, found[i].superseded_by, found[i].actions) == (entry["kind"], entry["importance"], entry["status"], entry["by"], entry["actions"]), i


def test_log_is_appended_and_compacted(spark, tmp_path, data):
    api = Memory(spark, table(spark, data, "memory_entries"))
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    new = spark.createDataFrame([(1, "w", "fact", "brand new words", 4.0, ["t"]), (2, "w", "fact", "?", 4.0, ["t"])], "op_id bigint, workspace string, kind string, content string, importance double, tags array<string>")
    operations, rejected = api.note(new, by="extractor")
    assert [r.op_id for r in rejected.collect()] == [2]
    stores.append_operations(operations, log)
    id = operations.first().id
    stores.append_operations(api.update(3, id, importance=9.0), log)
    stores.append_operations(api.forget(4, id), log)
    stores.compact(spark, log, state)
    row = spark.read.parquet(state).first()
    assert (row.importance, row.status, row.content) == (9.0, "archived", "brand new words")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        stores.compact(spark, log, state)


def test_note_merges_into_an_active_memory(spark):
    api = Memory(spark, frame(spark, [memory("held", content="Same  Words", importance=3.0)]))
    new = spark.createDataFrame([(1, "w", "fact", "same words", 8.0, None), (2, "w", "todo", "same words", None, None)], "op_id bigint, workspace string, kind string, content string, importance double, tags array<string>")
    found = {r.op_id: r for r in api.note(new)[0].collect()}
    assert (found[1].op, found[1].id, found[1].importance, found[1].source.event_seqs) == ("merge", "held", 8.0, [1])
    assert (found[2].op, found[2].importance) == ("create", 5.0)


NEW = "op_id bigint, workspace string, kind string, content string, importance double, tags array<string>, session_id string, source struct<session_id string, event_seqs array<bigint>, excerpt string>"


def test_a_written_memory_is_found_again(spark, tmp_path):
    log = str(tmp_path / "log")
    old = frame(spark, [memory("old", content="the nightly job writes parquet files to the shared folder now", created_at="2026-01-10 00:00:00"), memory("far", content="the nightly job writes parquet files to the shared folder", created_at="2025-10-01 00:00:00"), memory("other", kind="todo", content="the nightly job writes parquet files to the shared folder now")])
    new = [
        (1, "w", "fact", "the nightly job writes parquet files to the shared folder", 6.0, ["db"], "s9", ("s9", [4, 2], "said so")), (2, "w", "fact", "The nightly job  writes parquet files to the shared folder", 8.0, None, "s9", ("s8", [7, 4], "again")),
        (3, None, "fact", "no workspace here at all", None, None, None, None), (4, "w", "fact", "something quite different", float("nan"), None, "s9", None),
    ]
    operations, _ = Memory(spark, old).note(spark.createDataFrame(new, NEW))
    stores.append_operations(operations, log)
    found = {(r.op_id, r.op, r.other): r for r in stores.read_log(spark, log).collect()}
    id = found[1, "create", None].id if (1, "create", None) in found else found[1, "merge", None].id
    assert found[1, "merge", None].id == "far" and found[2, "merge", None].id == "far"  # an active memory with that key, however old
    assert (found[2, "merge", None].importance, found[2, "merge", None].source.event_seqs, found[2, "merge", None].source.excerpt) == (8.0, [1, 2, 4, 7], "again") and id == "far"
    fresh = Memory(spark, old.where("id <> 'far'"))
    stores.append_operations(fresh.note(spark.createDataFrame(new, NEW))[0], str(tmp_path / "log2"))
    rows = stores.read_log(spark, str(tmp_path / "log2"))
    made = {(r.op_id, r.op): r for r in rows.collect()}
    note = made[1, "create"]
    assert made[1, "supersede"].id == "old" and made[1, "supersede"].other == note.id and note.supersedes == "old" and (2, "merge") in made and (2, "supersede") not in made
    again = Memory(spark, ingest.memories_of(rows.unionByName(fresh.accessed(spark.createDataFrame([("s", note.id, 1, "2026-01-15 01:00:00"), ("s", note.id, 2, "2026-01-15 01:00:30"), ("t", note.id, 3, "2026-01-15 01:00:40")], "session_id string, memory_id string, event_id bigint, at string").withColumn("at", F.col("at").cast("timestamp_ntz")), 0))))
    hit = again.search("nightly parquet shared folder", workspace="w").first()
    assert (hit.id, hit.importance, hit.source.event_seqs, hit.access_count, hit.session_id, hit.tags) == (note.id, 8.0, [2, 4, 7], 2, "s9", ["db"])
    assert again.search("something quite different").first().importance == 5.0 and again.search("no workspace here").count() == 1
    assert [r.action for r in ingest.history(rows, note.id).collect()] == ["create", "merge"]


def test_arguments_are_checked(spark, data):
    api = Memory(spark, table(spark, data, "memory_entries"), table(spark, data, "memory_vectors"), table(spark, data, "causal_edges"))
    for call in (
        lambda: api.search("x", limit=0), lambda: api.search("x", limit=True), lambda: api.search("x", kind="odd"), lambda: api.search("x", mode="odd"), lambda: api.search("x", mode="hybrid"), lambda: api.search("x", min_score=2), lambda: api.get(" "),
        lambda: api.update(1, "a", content="c"), lambda: api.update(1, "a"), lambda: api.update(1, "a", importance=12), lambda: api.forget(1, "a", by="nobody"), lambda: api.list(status="odd"), lambda: api.recall(""),
    ):
        with pytest.raises(ValueError):
            call()
    assert api.search("").count() == 0 and api.search("", kind="fact").count() == 8
    assert api.search("root cause of the shared window").count() > 0 and api.recall("root cause of the shared window").columns[:3] == ["id", "kind", "content"]
    vector = [1.0] * 128
    assert api.search("root cause", query_vector=vector, min_score=0.0).count() == 8
    assert {r.metric for r in api.status().collect()} >= {"total", "active", "vector_coverage", "edges"}
    assert api.snapshot().count() == 1 and api.context("root cause of the shared window").count() <= 1
    some = api.list(1).first().id
    assert api.get(some).count() == 1 and api.audit(some).count() >= 0 and api.jaccard(some, some) == 1.0
    assert api.reflect().columns[0] == "batch" and api.neighbors(some).count() >= 0 and api.chain(some).count() <= 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], sc.struct(sc.MEMORY))
    api = Memory(spark, empty, spark.createDataFrame([], sc.struct(sc.VECTOR)), spark.createDataFrame([], sc.struct(sc.EDGE)))
    assert api.search("some words").count() == 0 and api.search("x", query_vector=[1.0, 0.0]).count() == 0
    assert api.stats().first().total == 0 and api.snapshot().count() == 0 and api.reflect().count() == 0 and api.context("x").count() == 0
    assert ingest.merge_duplicates(empty).count() == 0


def test_hidden_and_broken_memories_are_not_found(spark):
    rows = [memory("ok"), memory("archived", status="archived"), memory("old", superseded_by="ok"), memory("nosource", source=None), memory("nullseq", source={"session_id": "s", "event_seqs": [1, None], "excerpt": "e"}), memory("nocontent", content=None)]
    api = Memory(spark, frame(spark, rows))
    assert [r.id for r in api.search("some words here").collect()] == ["ok"]
    assert {r.id for r in api.search("some words here", include_archived=True, include_superseded=True).collect()} == {"ok", "archived", "old"}


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        base = [f"t{x}" for x in range(rng.randrange(5) * 10, rng.randrange(5) * 10 + 60)] or ["solo"]
        rows.append((f"{i:03d}", rng.choice(["x", "y", None]), rng.sample(base, min(len(base), rng.randrange(0, 25)))))
    for above, below in ((1, 2), (7, 10), (17, 20)):
        found = {(r.a_id, r.b_id) for r in similar_pairs(spark.createDataFrame(rows, "id string, b string, tokens array<string>"), above, below, ["b"]).collect()}
        wanted = {(i, j) for i, b, s in rows for j, c, t in rows if i < j and b is not None and b == c and s and t and len(set(s) & set(t)) * below >= len(set(s) | set(t)) * above}
        assert found == wanted


def test_pairs_that_cannot_be_similar_are_cut_in_the_join_of_parts(spark, monkeypatch):
    rng = random.Random(5)
    pool = [f"t{x}" for x in range(200)]
    rows = [(f"{i:03d}", "x", rng.sample(pool, rng.randrange(25, 35))) for i in range(150)]
    rows += [(f"c{i:03d}", "x", [*tokens[:-6], "new"]) for i, (_, _, tokens) in enumerate(rows[:20])]
    wanted = {(i, j) for i, _, s in rows for j, _, t in rows if i < j and len(set(s) & set(t)) * 2 >= len(set(s) | set(t))}
    join, met = similarity._met, []
    monkeypatch.setattr(similarity, "PART_TOKENS", 0)
    monkeypatch.setattr(similarity, "_met", lambda *given: met.append(join(*given).count()) or join(*given))
    found = similar_pairs(spark.createDataFrame(rows, "id string, b string, tokens array<string>"), 1, 2, ["b"])
    assert {(r.a_id, r.b_id) for r in found.collect()} == wanted and len(wanted) >= 20
    assert len(met) == similarity.PARTS and sum(met) < len(rows) ** 2 / 2 * 0.1  # nearly all of them share a token of their prefixes


def throttle_by_hand(times, seconds):
    kept, last = [], None
    for t, i in sorted(times):
        if last is None or t - last >= seconds:
            kept.append(i)
            last = t
    return kept


def test_throttle_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"s{rng.randrange(3)}", "m", n, rng.randrange(4000)) for n in range(600)]
    wanted = set()
    for s in {r[0] for r in rows}:
        wanted |= set(throttle_by_hand([(t, n) for k, _, n, t in rows if k == s], 60))
    base = spark.createDataFrame(rows, "session_id string, memory_id string, event_id bigint, t int").withColumn("at", F.expr("timestamp_ntz '2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, t)"))
    assert {r.event_id for r in se.throttled(base, ["session_id", "memory_id"], "at", "event_id").collect()} == wanted
    source = base.select("session_id", "memory_id", "event_id", (F.col("t").cast("bigint") * 1_000_000).alias("at_us"))
    low = source.agg(F.expr("percentile(at_us, array(0.3, 0.6))")).first()[0]
    for n, (a, b) in enumerate(((-1, low[0]), (low[0], low[1]), (low[1], 10**12))):
        source.where((F.col("at_us") > a) & (F.col("at_us") <= b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ex.run_available(ex.throttled_accesses(stream), ex.to_parquet_once(str(tmp_path / "out")), str(tmp_path / "cp"))
    assert {r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == wanted


def events(spark, rows):
    return spark.createDataFrame(rows, "session_id string, seq bigint, event_type string, text string, source_kind string, source_plugin string, shadowed_seqs array<bigint>, shadowed_end bigint, provider string, model string").select(
        "*", F.lit(None).cast("timestamp_ntz").alias("event_time"), F.lit(None).cast("timestamp_ntz").alias("ingested_at"))


def said(session, seq, text, kind="user/message", source="user", plugin=None):
    return (session, seq, kind, text, source, plugin, None, None, None, None)


def mark(session, seq, kind, shadowed=None, end=None, provider=None, model=None):
    return (session, seq, kind, None, None, None, shadowed, end, provider, model)


def test_turn_batches(spark):
    rows = [said("a", 1, "x" * 1500), mark("a", 2, "turn/end"), said("a", 3, "y" * 499), mark("a", 4, "turn/end"), said("a", 5, "z"), mark("a", 6, "turn/end"), said("b", 1, "q" * 3000), said("b", 2, "[参考记忆] echo"), said("b", 3, "own", source="plugin", plugin=se.OWN_PLUGIN)]
    found = [tuple(r) for r in se.turn_batches(events(spark, rows)).orderBy("session_id", "batch").collect()]
    assert found == [("a", 0, 1, 3, 2000, True), ("a", 1, 5, 5, 1, False), ("b", 0, 1, 1, 3000, False)]


def test_session_operators(spark):
    rows = [
        mark("a", 1, "request/header", provider="p", model="m"), mark("a", 9, "request/header", provider="p"), mark("b", 1, "request/header", provider="p", model="m"), said("a", 2, "one"), said("a", 3, "two", "assistant/message", "model"), said("a", 4, "three"), said("a", 5, ""),
        mark("a", 6, "compaction/summary", [2, 3, 5, 99, None], 3), said("b", 7, "own", source="plugin", plugin=se.OWN_PLUGIN), mark("b", 8, "compaction/summary", [], 7), said("b", 9, "own", source="plugin", plugin=se.OWN_PLUGIN),
    ]
    frame = events(spark, rows + rows)
    once = se.events_once(frame)
    assert once.count() == len(rows)
    assert [tuple(r) for r in se.latest_routes(once).collect()] == [("b", "p", "m")]
    assert sorted(r.seq for r in se.compaction_targets(once).collect()) == [2, 3]
    assert [r.transcript for r in se.transcripts(once).where("session_id = 'a'").collect()] == ["one\ntwo\nthree"]
    assert [r.query for r in se.rolling_queries(once).orderBy("seq").collect()] == ["one", "three\none"]
    assert {r.seq: r.visible for r in se.injection_visible(once).collect()} == {7: False, 9: True}


def test_stream_equals_feeding_one_by_one(spark, data, tmp_path):
    rows = se.events_once(table(spark, data, "session_events")).cache()
    cut = rows.agg(F.expr("percentile(seq, 0.5)")).first()[0]
    for part in (rows.where(F.col("seq") <= cut), rows.where(F.col("seq") > cut), rows.where(F.col("seq") <= cut).limit(20)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    made = ex.extraction_batches(ex.read_events(spark, str(tmp_path / "in"), 3))
    ex.run_available(made, ex.to_parquet_once(str(tmp_path / "out")), str(tmp_path / "cp"))
    found = {(r.session_id, r.trigger, tuple(r.seqs)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    wanted, states = set(), {}
    for r in ex.prepared(rows).orderBy("session_id", "seq").collect():
        due = states.setdefault(r.session_id, ex.SessionState()).feed(r.seq, r.event_type, r.said, r.shadowed_seqs)
        if due:
            wanted.add((r.session_id, due[0], tuple(due[1])))
    assert found == wanted and found


def test_state_passes_over_redeliveries():
    state = ex.SessionState()
    state.feed(1, "user/message", "x" * 2000, [])
    assert state.feed(2, "turn/end", "", [])[1] == [1]
    state.feed(1, "user/message", "x" * 2000, [])
    assert state.feed(3, "turn/end", "", []) is None
    state.feed(4, "user/message", "late", [])
    assert state.feed(5, "agent/disposed", "", [])[0] == "closed"


def test_windowed_counts(spark, data, tmp_path):
    table(spark, data, "events").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    ex.run_available(ex.windowed_counts(stream), ex.to_parquet_once(str(tmp_path / "out")), str(tmp_path / "cp"), "update")
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == table(spark, data, "events").count()


def test_snapshot_rebuilds(spark):
    rows = [("w", 0, 0, 0), ("w", 1, 30, 1), ("w", 2, 70, 1), ("w", 3, 200, 1), ("w", 4, 371, 1), ("v", 5, 5, 0)]
    frame = spark.createDataFrame(rows, "workspace string, seq bigint, t int, revision int").withColumn("at", F.expr("timestamp_ntz '2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, t)"))
    assert {r.seq for r in se.snapshot_rebuilds(frame).where("rebuilt").collect()} == {0, 2, 4, 5}


def test_merge_pass_sees_earlier_merges(spark):
    from recollex.operators.review import merge_pass

    entries = frame(spark, [memory("c", created_at="2026-01-03 00:00:00", importance=1.0), memory("b", created_at="2026-01-02 00:00:00", importance=3.0), memory("a", created_at="2026-01-01 00:00:00", importance=0.0)])
    pairs = spark.createDataFrame([("c", "b"), ("c", "a"), ("b", "a")], "keep_id string, drop_id string")
    assert [tuple(r) for r in merge_pass(entries, pairs).collect()] == [("c", "b", 3.0)]


def test_budget_packing(spark):
    from recollex.operators.context import HEADER, packed

    lines = spark.createDataFrame([(1, "a", "x" * 50), (2, "b", "y" * 500), (3, "c", "z" * 20)], "rank int, id string, line string")
    row = packed(lines, len(HEADER) + 1 + 51 + 21).first()
    assert (row.rendered, row.skipped) == ("a,c", "b") and row.text.endswith("…另有 1 条相关记忆未展示（可用 memory_recall 查看）")
    assert packed(lines, 10).count() == 0


def test_verdicts_see_what_earlier_ones_did(spark):
    from recollex.operators.review import judged
    from recollex.operators.upkeep import verdict_operations

    entries = frame(spark, [memory(i, created_at=f"2026-01-0{n} 00:00:00", importance=float(n)) for n, i in enumerate("abcde", 1)] + [memory("x", workspace="v"), memory("gone", status="archived"), memory("s", superseded_by="a")])
    rows = [(1, 0, "a", "e", "merge"), (1, 1, "a", "b", "merge"), (1, 2, "e", "d", "archive"), (2, 0, "e", "c", "none"), (2, 1, "c", "x", "merge"), (2, 2, "c", "gone", "merge"), (3, 0, "s", "c", "merge"), (3, 1, "b", "c", "merge"), (3, 2, "c", "nobody", "none"), (3, 3, "b", "s", "none")]
    verdicts = spark.createDataFrame(rows, "output_id bigint, position bigint, focus_id string, peer_id string, action string")
    found = {(r.output_id, r.position): (r.outcome, r.keep_id, r.drop_id) for r in judged(verdicts, entries).collect()}
    skip = lambda why: (f"skip {why}", None, None)
    assert found == {(1, 0): ("merge", "e", "a"), (1, 1): skip("invalid"), (1, 2): ("archive", "e", "d"), (2, 0): skip("none"), (2, 1): skip("invalid"), (2, 2): skip("invalid"), (3, 0): skip("superseded"), (3, 1): ("merge", "c", "b"), (3, 2): skip("invalid"), (3, 3): skip("invalid")}
    low = frame(spark, [memory("new", created_at="2026-01-03 00:00:00", importance=2.0), memory("mid", created_at="2026-01-02 00:00:00", importance=7.0), memory("old", importance=9.0)])
    merges = spark.createDataFrame([(1, 0, "old", "mid", "merge"), (1, 1, "mid", "new", "merge")], verdicts.schema)
    made = {(r.op, r.id): r.importance for r in verdict_operations(merges, low, NOW).collect()}
    assert made == {("archive", "old"): None, ("archive", "mid"): None, ("update", "mid"): 9.0, ("update", "new"): 9.0}


def test_long_chains_are_connected(spark):
    from recollex.operators.review import connected

    pairs = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(200)] + [("x", "y")], "a string, b string")
    assert {r.id: r.label for r in connected(pairs, "a", "b", 12).collect()} == {f"{i:03d}": "000" for i in range(201)} | {"x": "x", "y": "x"}


def test_ranks_over_all_tasks(spark):
    from recollex.operators.ranking import global_rank

    rows = spark.range(60_000).select(F.col("id"), (F.col("id") % 7).alias("k"), F.lit("x").alias("more")).repartition(5)
    found = global_rank(rows, "r", F.desc("k"), F.col("id").asc()).collect()
    wanted = {r.id: n + 1 for n, r in enumerate(sorted(found, key=lambda r: (-r.k, r.id)))}
    assert {r.id: r.r for r in found} == wanted


def test_kept_tables_survive_and_are_cleared(spark):
    from recollex.sources.shared import Scratch, clear

    scratch = Scratch(spark)
    kept, bucketed = scratch.keep(spark.range(5)), scratch.keep_bucketed(spark.range(50), "id", 3)
    assert kept.count() == 5 and bucketed.groupBy("id").count().count() == 50
    assert "Exchange" not in bucketed.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    scratch.drop(bucketed)
    clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ_FILE|does not exist"):
        kept.count()


def test_events_become_memories(spark, tmp_path):
    from recollex.streaming.ingest import log_sink

    rows = [said("s1", 1, "we decided to use parquet " * 90), mark("s1", 2, "turn/end"), said("s2", 1, "short"), mark("s2", 2, "agent/disposed"), said("s3", 1, "nothing here"), mark("s3", 2, "agent/disposed")]
    events(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    calls = str(tmp_path / "calls")

    def judge(prompt):
        import os

        if "parquet" in prompt and not os.path.exists(calls):
            open(calls, "w").close()
            raise RuntimeError("the model is down")
        if "parquet" in prompt:
            return 'ok: {"memories": [{"kind": "decision", "content": "Use Parquet", "importance": 8, "tags": ["db"]}, {"kind": "fact", "content": "x", "importance": 0}]}'
        return '{"memories": [{"kind": "fact", "content": "Known thing", "importance": 9}]}' if "short" in prompt else "no JSON"

    entries = frame(spark, [memory("known", workspace="default", content="known  thing", importance=2.0)])
    spaces = spark.createDataFrame([("s1", "w1")], "session_id string, workspace string")
    sink = log_sink(spark, entries, spaces, judge, str(tmp_path / "log"), NOW)

    def run():
        ex.run_available(ex.extraction_batches(ex.read_events(spark, str(tmp_path / "in"))), sink, str(tmp_path / "cp"))

    with pytest.raises(Exception, match="the model is down"):
        run()
    run()
    found = {(r.op, r.content, r.workspace, r.importance) for r in stores.read_log(spark, str(tmp_path / "log")).collect()}
    assert found == {("create", "Use Parquet", "w1", 8.0), ("merge", None, None, 9.0)}
    run()
    assert stores.read_log(spark, str(tmp_path / "log")).count() == 2


def test_kept_tables_leave_no_shuffle_files(spark):
    from recollex.sources.shared import CLEANUP, Scratch

    def shuffles():
        return spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()

    before, held, scratch = spark.conf.get(CLEANUP, None), shuffles(), Scratch(spark)
    scratch.keep(spark.range(1000).repartition(3, "id").groupBy("id").count())
    scratch.keep_bucketed(spark.range(1000).groupBy("id").count(), "id", 4)
    assert shuffles() <= held
    assert spark.conf.get(CLEANUP, None) == before

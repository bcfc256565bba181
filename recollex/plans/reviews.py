"""Queries over pairs of memories, verdicts, edges and model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recollex.functions import judge
from recollex.operators import entries as en, graph, review as rv, similarity as sim, upkeep
from recollex.plans import sql as S
from recollex.plans.memories import entries
from recollex.plans.searches import vectors
from recollex.sources.tables import table

NOW = S.NOW


def jaccard_pairs(spark, d):
    """Visible memories of one workspace and kind that share half of their tokens."""
    from recollex.operators.search import with_tokens

    rows = with_tokens(en.candidates(entries(spark, d)))
    return sim.similar_pairs(rows, 1, 2, ["workspace", "kind"]).select("a_id", "b_id", "shared", "total")


def supersede_pairs(spark, d):
    return sim.supersede_pairs(entries(spark, d), NOW).select("old_id", "new_id", "shared", "total")


def supersede_pointers(spark, d):
    rows = entries(spark, d)
    return sim.supersede_pointers(sim.supersede_pairs(rows, NOW), rows)


def maintenance_merge_pairs(spark, d):
    return sim.merge_pairs(entries(spark, d))


def maintenance_merge(spark, d):
    """(keep_id, drop_id) that a merge pass carries out: pairs in order, each seeing what earlier ones did."""
    rows = entries(spark, d)
    return rv.merge_pass(rows, sim.merge_pairs(rows))


def maintenance_cycle(spark, d):
    """The operations of one cycle of upkeep, with the recorded verdicts."""
    made = upkeep.cycle(entries(spark, d), NOW, judge.decisions(answers(spark, d)))
    return made.select("op_id", "id", "op", "by", "importance", F.array_join("tags", ",").alias("tags"), "other")


def summary_supersede(spark, d):
    return sim.summary_pairs(entries(spark, d))


def _window(spark, d):
    return sim.review_window(entries(spark, d)).select("id", "workspace", "content", "importance", "created_at")


def _review_vectors(spark, d):
    return vectors(spark, d).where("dim = 128")


def reflection_pairs(spark, d):
    return sim.review_pairs(_window(spark, d), _review_vectors(spark, d))


def reflection_candidates(spark, d):
    window = _window(spark, d)
    return sim.review_candidates(window, sim.review_pairs(window, _review_vectors(spark, d)))


def reflection_incremental(spark, d):
    window = _window(spark, d)
    return sim.review_candidates(window, sim.review_pairs(window, _review_vectors(spark, d)), ("2026-01-10 00:00:00", "0"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judge_outputs")


def balanced_json(spark, d):
    """The first whole object of each answer that is JSON."""
    return answers(spark, d).select("output_id", judge.balanced_json("raw_text").alias("object")).where(F.try_parse_json("object").isNotNull())


def load_quarantine(spark, d):
    """Answers per judge, and those from which no JSON can be read."""
    rows = answers(spark, d).select("judge", F.try_parse_json(judge.balanced_json("raw_text")).isNotNull().alias("good"))
    return rows.groupBy("judge").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("good")).alias("bad"))


def parse_extraction(spark, d):
    return judge.memories(answers(spark, d))


def parse_decisions(spark, d):
    return judge.decisions(answers(spark, d))


def parse_edges(spark, d):
    return judge.edges(answers(spark, d))


def reflection_apply(spark, d):
    """Verdicts with what becomes of each and why."""
    return rv.judged(judge.decisions(answers(spark, d)), entries(spark, d)).select("output_id", "position", "action", "outcome", "keep_id", "drop_id")


def reflection_cumulative(spark, d):
    """Verdicts per day with running totals."""
    verdicts = judge.decisions(answers(spark, d)).join(answers(spark, d).select("output_id", F.to_date("recorded_at").alias("round")), "output_id").where("round is not null")
    rounds = verdicts.groupBy("round").agg(F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("action") == "none").alias("skipped"))
    return graph.cumulative(rounds).withColumn("round", F.col("round").cast("string"))


def skip_rate(spark, d):
    """Both ways to tell the part of verdicts that were skipped."""
    done = reflection_apply(spark, d).agg(F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("outcome").startswith("skip")).alias("skipped"))
    return done.select("decisions", "skipped", F.round(F.try_divide("skipped", F.col("decisions") + F.col("skipped")), 6).alias("panel_rate"), F.round(F.try_divide("skipped", "decisions"), 6).alias("rate"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_set(table(spark, d, "causal_edges"))


def confidence_hist(spark, d):
    return graph.confidence_summary(edges(spark, d))


def adaptive_confidence(spark, d):
    return graph.confidence_gate(edges(spark, d)).select("below_55", "below_75", F.col("least_confidence").cast("double").alias("least_confidence"))


def causal_neighbors(spark, d):
    rows = table(spark, d, "causal_edges")
    return graph.neighbors(edges(spark, d), rows.agg(F.min("target_id")).first()[0]).select("direction", "other_id", "relation", "confidence")


def _proposed(spark, d):
    return edges(spark, d).select("source_id", "target_id", F.coalesce(graph.finite_confidence(), F.lit(0.0)).alias("confidence"))


def causal_validate(spark, d):
    return graph.validate(_proposed(spark, d), entries(spark, d), 0.55).select("source_id", "target_id", "reason")


def causal_accept(spark, d):
    return graph.accept(judge.edges(answers(spark, d)), edges(spark, d), entries(spark, d), 0.55).select("source_id", "target_id", "relation", "confidence")


def edge_orphans(spark, d):
    return graph.orphans(edges(spark, d), entries(spark, d))


def supersede_chain(spark, d):
    return graph.chain_links(entries(spark, d))


_E = S.ENTRIES


_OLD = "(a_created_at < b_created_at OR (a_created_at = b_created_at AND a_id < b_id))"
_SUPER = (_E, f"src AS (SELECT * FROM entries WHERE created_at <= TIMESTAMP '{NOW}')", S.pairs("src", ["workspace", "kind"], 7, 10, "true", "created_at, status"))
_SUPER_PAIRS = f"sp AS (SELECT CASE WHEN {_OLD} THEN a_id ELSE b_id END AS old_id, CASE WHEN {_OLD} THEN b_id ELSE a_id END AS new_id, CASE WHEN {_OLD} THEN b_created_at ELSE a_created_at END AS new_at, CASE WHEN {_OLD} THEN a_created_at ELSE b_created_at END AS old_at, shared, total FROM pairs WHERE abs(epoch_us(a_created_at) - epoch_us(b_created_at)) <= {30 * 86_400_000_000} AND CASE WHEN {_OLD} THEN a_status ELSE b_status END = 'active')"
_WINDOW = "win AS (SELECT * FROM (SELECT * FROM entries WHERE status = 'active' AND superseded_by IS NULL ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 400) WHERE NOT coalesce(list_has_any(tags, ['session-summary', 'snapshot']), false))"
_REVIEW = (
    _E, S.VECTORS, _WINDOW,
    f"r AS (SELECT w.id, workspace, importance, created_at, {S.tokens('content')} AS tk, embedding AS e FROM win w LEFT JOIN (SELECT memory_id, embedding FROM current_vectors WHERE dim = 128 AND {S.usable()}) v ON v.memory_id = w.id)".replace("workspace,", "w.workspace AS workspace,", 1),
    "rp AS (SELECT a.id AS a_id, b.id AS b_id, a.e IS NOT NULL AND b.e IS NOT NULL AS both_, len(list_intersect(a.tk, b.tk)) AS shared, len(a.tk) + len(b.tk) - len(list_intersect(a.tk, b.tk)) AS total, a.e AS ae, b.e AS be FROM r a JOIN r b ON a.workspace = b.workspace AND a.id < b.id)",
    f"rs AS (SELECT *, CASE WHEN both_ THEN round({S.cosine('ae', 'be')}, 6) ELSE round(coalesce(shared / nullif(total, 0), 0), 6) END AS sim FROM rp)",
    "rpairs AS (SELECT a_id, b_id, sim, CASE WHEN both_ THEN 'cosine' ELSE 'tokens' END AS basis FROM rs WHERE CASE WHEN both_ THEN sim >= 0.75 ELSE shared * 100 >= total * 8 AND shared * 100 < total * 85 AND shared >= 2 END)",
)


def _candidates(newer: str) -> str:
    return (
        S.with_(
            *_REVIEW, "ei AS (SELECT a_id AS focus_id, b_id AS peer_id, sim FROM rpairs UNION ALL SELECT b_id, a_id, sim FROM rpairs)",
            f"fo AS (SELECT focus_id, (row_number() OVER (ORDER BY max_sim DESC, importance DESC NULLS LAST, created_at DESC NULLS LAST, focus_id) - 1) AS place FROM (SELECT focus_id, max(sim) AS max_sim FROM ei GROUP BY 1) JOIN win ON id = focus_id WHERE {newer} QUALIFY place < 60)",
        )
        + "SELECT place // 8 AS batch, fo.focus_id, peer_id, sim, row_number() OVER (PARTITION BY fo.focus_id ORDER BY sim DESC, w.created_at DESC NULLS LAST, peer_id DESC) AS peer_rank FROM fo JOIN ei ON fo.focus_id = ei.focus_id JOIN win w ON w.id = peer_id QUALIFY peer_rank <= 3"
    )


_CONF = "CASE WHEN NOT isnan(confidence) AND NOT isinf(confidence) THEN confidence END"
_HIST = f"hist AS (SELECT count(*) AS edges, round(avg(c), 6) AS mean_confidence, count(*) FILTER (WHERE c < 0.55) AS below_55, count(*) FILTER (WHERE c >= 0.55 AND c < 0.75) AS below_75, count(*) FILTER (WHERE c >= 0.75 AND c < 0.9) AS below_90, count(*) FILTER (WHERE c >= 0.9) AS from_90 FROM (SELECT {_CONF} AS c FROM edge_set))"
_REASON = (
    "CASE WHEN source_id = target_id THEN 'loop' WHEN s.id IS NULL OR t.id IS NULL THEN 'unknown' WHEN s.status <> 'active' OR t.status <> 'active' THEN 'inactive' WHEN s.superseded_by IS NOT NULL OR t.superseded_by IS NOT NULL THEN 'superseded' "
    "WHEN s.workspace IS DISTINCT FROM t.workspace THEN 'workspace' WHEN coalesce({c} < 0.55, true) THEN 'confidence' END"
)
#: The first to the last brace of an answer: its first whole object where there is one object.
_ANSWERS = "ans AS (SELECT *, CASE WHEN json_valid(o) THEN o END AS j FROM (SELECT *, regexp_extract(raw_text, '(?s)\\{.*\\}') AS o FROM judge_outputs))"


def _items(field: str) -> str:
    return f"it AS (SELECT output_id, recorded_at, k - 1 AS position, json_extract(j, '$.{field}[' || (k - 1) || ']') AS v FROM (SELECT *, unnest(range(1, coalesce(json_array_length(j, '$.{field}'), 0)::BIGINT + 1)) AS k FROM ans WHERE json_type(j, '$.{field}') = 'ARRAY'))"


def _text(path: str) -> str:
    return f"CASE WHEN json_type(v, '{path}') = 'VARCHAR' THEN json_extract_string(v, '{path}') END"


def _number(path: str) -> str:
    return f"CASE WHEN json_type(v, '{path}') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN CAST(json_extract_string(v, '{path}') AS DOUBLE) END"


def _rating(path: str) -> str:
    n = _number(path)
    return f"CASE WHEN {n} IS NOT NULL THEN CAST(least(greatest(floor({n} + 0.5), 0), 10) AS BIGINT) END"


_DECISIONS = (_ANSWERS, _items("decisions"), f"dec AS (SELECT * FROM (SELECT output_id, recorded_at, position, {_text('$.focusId')} AS focus_id, {_text('$.peerId')} AS peer_id, {_text('$.action')} AS action_, {_text('$.reason')} AS reason FROM it) WHERE focus_id <> '' AND peer_id <> '' AND action_ IN ('merge', 'archive', 'none') AND reason IS NOT NULL)")
_EDGES = (_ANSWERS, _items("edges"), f"prop AS (SELECT * FROM (SELECT output_id, position, {_text('$.sourceId')} AS source_id, {_text('$.targetId')} AS target_id, {_number('$.confidence')} AS confidence, {_text('$.justification')} AS justification FROM it) WHERE source_id <> '' AND target_id <> '' AND confidence IS NOT NULL)")
#: Verdicts one after the other, each seeing which memories earlier ones archived.
_APPLY = (
    "st AS (SELECT row_number() OVER (ORDER BY output_id, position) AS n, output_id, position, action_, focus_id, peer_id, (f.created_at, f.id) > (p.created_at, p.id) AS fnew, "
    "f.id IS NULL OR p.id IS NULL OR coalesce(f.status <> 'active', true) OR coalesce(p.status <> 'active', true) AS bad, f.superseded_by IS NOT NULL OR p.superseded_by IS NOT NULL AS sup, f.workspace IS DISTINCT FROM p.workspace AS apart "
    "FROM dec LEFT JOIN entries f ON f.id = focus_id LEFT JOIN entries p ON p.id = peer_id)",
    "steps(n, gone, o, keep_id, drop_id) AS (SELECT 0::BIGINT, []::VARCHAR[], ''::VARCHAR, NULL::VARCHAR, NULL::VARCHAR UNION ALL "
    "SELECT x.n, CASE WHEN x.o IN ('merge', 'archive') THEN list_append(x.gone, x.old_) ELSE x.gone END, x.o, CASE WHEN x.o IN ('merge', 'archive') THEN x.new_ END, CASE WHEN x.o IN ('merge', 'archive') THEN x.old_ END "
    "FROM (SELECT st.n, steps.gone, CASE WHEN bad OR list_contains(steps.gone, focus_id) OR list_contains(steps.gone, peer_id) THEN 'skip invalid' WHEN sup THEN 'skip superseded' WHEN apart THEN 'skip invalid' WHEN action_ = 'none' THEN 'skip none' ELSE action_ END AS o, "
    "CASE WHEN fnew THEN focus_id ELSE peer_id END AS new_, CASE WHEN fnew THEN peer_id ELSE focus_id END AS old_ FROM steps JOIN st ON st.n = steps.n + 1) x)",
    "app AS (SELECT output_id, position, action_, o, keep_id, drop_id FROM st JOIN steps USING (n))",
)

_ACCEPT = (
    S.with_(_E, S.EDGES, *_EDGES, f"val AS (SELECT prop.*, {_REASON.format(c='confidence')} AS bad FROM prop LEFT JOIN entries s ON s.id = source_id LEFT JOIN entries t ON t.id = target_id)")
    + "SELECT source_id, target_id, 'causal' AS relation, confidence FROM val WHERE bad IS NULL AND NOT EXISTS (SELECT 1 FROM edge_set g WHERE g.source_id = val.source_id AND g.target_id = val.target_id AND g.relation = 'causal') QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY output_id, position) = 1"
)

_MERGE = (_E, "src AS (SELECT * FROM entries WHERE status = 'active' AND superseded_by IS NULL AND importance IS NOT NULL AND NOT isnan(importance))", S.pairs("src", ["workspace", "kind"], 17, 20, "abs(a.importance - b.importance) <= 2", "created_at, importance"))
_MERGE_PAIRS = "SELECT CASE WHEN (a_created_at, a_id) > (b_created_at, b_id) THEN a_id ELSE b_id END AS keep_id, CASE WHEN (a_created_at, a_id) > (b_created_at, b_id) THEN b_id ELSE a_id END AS drop_id, shared, total FROM pairs"
#: Pairs in their order, each seeing which memories earlier ones dropped and how important those they kept are.
_MERGED = (
    f"mp AS ({_MERGE_PAIRS})", "ord AS (SELECT row_number() OVER (ORDER BY k.created_at DESC, keep_id DESC, d.created_at DESC, drop_id DESC) AS n, keep_id, drop_id, k.importance AS ki, d.importance AS di FROM mp JOIN entries k ON k.id = keep_id JOIN entries d ON d.id = drop_id)",
    "fold(n, gone, names, vals, keep_id, drop_id, importance, ok) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::DOUBLE[], NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE, false UNION ALL "
    "SELECT n, CASE WHEN ok THEN list_append(gone, drop_id) ELSE gone END, CASE WHEN ok THEN list_prepend(keep_id, names) ELSE names END, CASE WHEN ok THEN list_prepend(greatest(kn, dn), vals) ELSE vals END, keep_id, drop_id, greatest(kn, dn), ok "
    "FROM (SELECT *, NOT list_contains(gone, keep_id) AND NOT list_contains(gone, drop_id) AND abs(kn - dn) <= 2 AS ok FROM (SELECT ord.n, gone, names, vals, ord.keep_id, ord.drop_id, coalesce(vals[list_position(names, ord.keep_id)], ki) AS kn, coalesce(vals[list_position(names, ord.drop_id)], di) AS dn FROM fold JOIN ord ON ord.n = fold.n + 1)))",
)

QUERIES = {
    "jaccard_pairs": (jaccard_pairs, S.with_(_E, S.VISIBLE, S.pairs("visible", ["workspace", "kind"], 1, 2)) + "SELECT a_id, b_id, shared, total FROM pairs"),
    "supersede_pairs": (supersede_pairs, S.with_(*_SUPER, _SUPER_PAIRS) + "SELECT old_id, new_id, shared, total FROM sp"),
    "supersede_pointers": (
        supersede_pointers,
        S.with_(*_SUPER, _SUPER_PAIRS, "l AS (SELECT old_id AS id, last(new_id ORDER BY new_at, new_id) AS superseded_by FROM sp GROUP BY 1)", "f AS (SELECT new_id AS id, first(old_id ORDER BY old_at, old_id) AS supersedes FROM sp GROUP BY 1)")
        + "SELECT coalesce(l.id, f.id) AS id, superseded_by, supersedes FROM l FULL JOIN f ON l.id = f.id",
    ),
    "maintenance_merge_pairs": (maintenance_merge_pairs, S.with_(*_MERGE) + _MERGE_PAIRS),
    "maintenance_merge": (maintenance_merge, S.recursive(*_MERGE, *_MERGED) + "SELECT keep_id, drop_id, importance FROM fold WHERE ok"),
    "maintenance_cycle": (maintenance_cycle, None),
    "summary_supersede": (
        summary_supersede,
        S.with_(_E, "src AS (SELECT * FROM entries WHERE status = 'active' AND list_contains(tags, 'session-summary'))", S.pairs("src", ["session_id"], 1, 2, "true", "created_at"))
        + "SELECT session_id, CASE WHEN (a_created_at, a_id) < (b_created_at, b_id) THEN a_id ELSE b_id END AS old_id, CASE WHEN (a_created_at, a_id) < (b_created_at, b_id) THEN b_id ELSE a_id END AS new_id, shared, total FROM pairs",
    ),
    "reflection_pairs": (reflection_pairs, S.with_(*_REVIEW) + "SELECT a_id, b_id, sim, basis FROM rpairs"),
    "reflection_candidates": (reflection_candidates, _candidates("true")),
    "reflection_incremental": (reflection_incremental, _candidates("(created_at, id) > (TIMESTAMP '2026-01-10 00:00:00', '0')")),
    "balanced_json": (balanced_json, S.with_(_ANSWERS) + "SELECT output_id, o AS object FROM ans WHERE j IS NOT NULL"),
    "load_quarantine": (load_quarantine, S.with_(_ANSWERS) + "SELECT judge, count(*) AS rows, count(*) FILTER (WHERE j IS NULL) AS bad FROM ans GROUP BY 1"),
    "parse_extraction": (
        parse_extraction,
        S.with_(_ANSWERS, _items("memories"))
        + f"SELECT output_id, position, kind, content, importance, self_relevance, tags FROM (SELECT output_id, position, {_text('$.kind')} AS kind, trim({_text('$.content')}) AS content, {_rating('$.importance')} AS importance, {_rating('$.selfRelevance')} AS self_relevance, "
        "CASE WHEN json_type(v, '$.tags') = 'ARRAY' THEN array_to_string(list_transform(list_filter(json_extract(v, '$.tags[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$')), ',') END AS tags FROM it WHERE json_type(v) = 'OBJECT') WHERE kind IN ('fact', 'preference', 'decision', 'todo', 'insight') AND content <> ''",
    ),
    "parse_decisions": (parse_decisions, S.with_(*_DECISIONS) + "SELECT output_id, position, focus_id, peer_id, action_ AS \"action\", reason FROM dec"),
    "parse_edges": (parse_edges, S.with_(*_EDGES) + "SELECT output_id, position, source_id, target_id, confidence, justification FROM prop"),
    "reflection_apply": (reflection_apply, S.recursive(_E, *_DECISIONS, *_APPLY) + "SELECT output_id, position, action_ AS \"action\", o AS outcome, keep_id, drop_id FROM app"),
    "reflection_cumulative": (
        reflection_cumulative,
        S.with_(*_DECISIONS, "rounds AS (SELECT CAST(recorded_at AS DATE) AS round, count(*) AS decisions, count(*) FILTER (WHERE action_ = 'none') AS skipped FROM dec WHERE recorded_at IS NOT NULL GROUP BY 1)", "run AS (SELECT *, sum(CASE WHEN decisions > skipped THEN 1 ELSE 0 END) OVER (ORDER BY round) AS runs FROM rounds)")
        + "SELECT CAST(round AS VARCHAR) AS round, decisions, skipped, CAST(sum(decisions) OVER (ORDER BY round) AS BIGINT) AS total_decisions, CAST(sum(skipped) OVER (ORDER BY round) AS BIGINT) AS total_skipped, CAST(sum(CASE WHEN decisions > skipped THEN 0 ELSE 1 END) OVER (PARTITION BY runs ORDER BY round) AS BIGINT) AS empty_rounds FROM run",
    ),
    "skip_rate": (skip_rate, S.recursive(_E, *_DECISIONS, *_APPLY) + "SELECT count(*) AS decisions, count(*) FILTER (WHERE o LIKE 'skip%') AS skipped, round(count(*) FILTER (WHERE o LIKE 'skip%') / (count(*) + count(*) FILTER (WHERE o LIKE 'skip%')), 6) AS panel_rate, round(count(*) FILTER (WHERE o LIKE 'skip%') / count(*), 6) AS rate FROM app"),
    "confidence_hist": (confidence_hist, S.with_(S.EDGES, _HIST) + "SELECT * FROM hist"),
    "adaptive_confidence": (adaptive_confidence, S.with_(S.EDGES, _HIST) + "SELECT below_55, below_75, CAST(CASE WHEN below_55 > 1.5 * below_75 AND below_55 > 3 THEN 0.5 WHEN below_75 > below_55 AND below_75 > 3 THEN 0.6 ELSE 0.55 END AS DOUBLE) AS least_confidence FROM hist"),
    "causal_neighbors": (
        causal_neighbors,
        S.with_(S.EDGES, "x AS (SELECT min(target_id) AS id FROM causal_edges)") + "SELECT 'out' AS direction, target_id AS other_id, relation, confidence FROM edge_set, x WHERE source_id = id UNION ALL SELECT 'in', source_id, relation, confidence FROM edge_set, x WHERE target_id = id",
    ),
    "causal_validate": (causal_validate, S.with_(_E, S.EDGES) + f"SELECT source_id, target_id, {_REASON.format(c='coalesce(' + _CONF + ', 0)')} AS reason FROM edge_set LEFT JOIN entries s ON s.id = source_id LEFT JOIN entries t ON t.id = target_id"),
    "causal_accept": (causal_accept, _ACCEPT),
    "edge_orphans": (edge_orphans, S.with_(_E, S.SHOWN, S.EDGES) + "SELECT source_id, relation, target_id FROM edge_set WHERE source_id NOT IN (SELECT id FROM shown) OR target_id NOT IN (SELECT id FROM shown)"),
    "supersede_chain": (supersede_chain, S.with_(_E) + "SELECT e.id, e.supersedes, o.kind AS older_kind, e.superseded_by, n.kind AS newer_kind FROM entries e LEFT JOIN entries o ON o.id = e.supersedes LEFT JOIN entries n ON n.id = e.superseded_by WHERE e.supersedes IS NOT NULL OR e.superseded_by IS NOT NULL"),
}

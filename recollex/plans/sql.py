"""Pieces of the DuckDB statements that the queries are compared with."""

NOW = "2026-01-15 00:00:00"

ENTRIES = (
    "entries AS (SELECT * FROM memory_entries QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, updated_at DESC NULLS LAST, access_count DESC NULLS LAST, "
    "last_access_at DESC NULLS LAST, importance DESC NULLS LAST, status DESC NULLS LAST, superseded_by DESC NULLS LAST, supersedes DESC NULLS LAST) = 1)"
)
WELL_FORMED = "coalesce(source.session_id <> '' AND source.event_seqs IS NOT NULL AND len(list_filter(source.event_seqs, lambda x: x IS NULL)) = 0 AND source.excerpt IS NOT NULL, false)"
VISIBLE = f"visible AS (SELECT * FROM entries WHERE status = 'active' AND superseded_by IS NULL AND {WELL_FORMED})"
SHOWN = "shown AS (SELECT * FROM entries WHERE status = 'active' AND superseded_by IS NULL)"
EVENTS = "once AS (SELECT * FROM session_events QUALIFY row_number() OVER (PARTITION BY session_id, seq ORDER BY ingested_at NULLS LAST, event_time NULLS LAST) = 1)"
VECTORS = "current_vectors AS (SELECT * FROM memory_vectors QUALIFY row_number() OVER (PARTITION BY memory_id, dim ORDER BY embedded_at DESC NULLS LAST, embedding DESC NULLS LAST) = 1)"
EDGES = "edge_set AS (SELECT * FROM causal_edges QUALIFY row_number() OVER (PARTITION BY source_id, relation, target_id ORDER BY created_at NULLS LAST, confidence DESC NULLS LAST) = 1)"

IMPORTANCE = "least(greatest(CASE WHEN importance IS NULL OR isnan(importance) THEN 5.0 ELSE importance END, 0.0), 10.0)"
ACCESSES = "greatest(0.0, floor(coalesce(access_count, 0)))"
HALF_LIFE = f"(7 * pow(2.0, ({IMPORTANCE} - 5) / 2) * (1 + log2(1 + {ACCESSES})))"
EFFECTIVE = f"least(greatest({IMPORTANCE} + least(2.0, floor(log2(1 + {ACCESSES}))) + CASE WHEN self_relevance >= 8 THEN 2 WHEN self_relevance >= 6 THEN 1 ELSE 0 END, 0.0), 10.0)"


def days(column: str) -> str:
    return f"((epoch_us(TIMESTAMP '{NOW}') - epoch_us({column})) / 86400000000.0)"


RECENCY = f"(CASE WHEN last_access_at IS NULL OR {days('last_access_at')} <= 0 THEN 1.0 ELSE exp(-ln(2) / {HALF_LIFE} * {days('last_access_at')}) END)"
TIME = (
    f"((0.6 + 0.4 * CASE WHEN {IMPORTANCE} >= 8 AND (coalesce({days('last_access_at')} <= 90, false) OR coalesce({days('created_at')} <= 90, false)) "
    f"THEN greatest({RECENCY}, 0.5) ELSE {RECENCY} END) * (0.5 + {IMPORTANCE} / 20))"
)


def bigrams(column: str) -> str:
    runs = f"regexp_extract_all({column}, '[\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}]+')"
    return f"flatten(list_transform({runs}, lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END))"


def tokens(column: str) -> str:
    """Distinct tokens, not in the order of the text."""
    c = f"coalesce({column}, '')"
    return f"list_distinct(list_concat(regexp_extract_all(lower({c}), '[a-z0-9]+'), {bigrams(c)}))"


SPACE = "[\\s\\x{00A0}\\x{0085}\\x{000B}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def one_spaced(column: str) -> str:
    return f"regexp_replace({column}, '{SPACE}', ' ', 'g')"


def normal(column: str) -> str:
    return f"lower(trim({one_spaced(column)}))"


def fnv(column: str) -> str:
    """FNV-1a over code points in base 36; as over UTF-16 units for the basic plane."""
    folded = f"list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, length({column}) + 1), lambda i: unicode(substring({column}, i, 1))::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    places = ", ".join(f"substring('{digits}', ((({folded}) // {36**k}) % 36)::BIGINT + 1, 1)" for k in range(6, -1, -1))
    return f"CASE WHEN {column} = '' THEN 'ztntfp' ELSE coalesce(nullif(ltrim(concat({places}), '0'), ''), '0') END"


def usable(dim: str = "dim", column: str = "embedding") -> str:
    finite = f"len(list_filter({column}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
    return f"coalesce(len({column}) = {dim} AND {finite} AND len(list_filter({column}, lambda x: x <> 0)) > 0, false)"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


def pairs(source: str, block: list[str], above: int, below: int, extra: str = "true", carry: str = "") -> str:
    """CTEs t, p and pairs(a_id, b_id, shared, total): similar pairs of a relation by shared tokens."""
    same = " AND ".join(f"a.{b} = b.{b}" for b in block)
    cols = "".join(f", {c.strip()}" for c in carry.split(",") if c.strip())
    return (
        f"t AS (SELECT id, {', '.join(block)}{cols}, {tokens('content')} AS tk FROM {source}), "
        f"p AS (SELECT id, {', '.join(block)}, len(tk) AS n, unnest(tk) AS token FROM t), "
        f"m AS (SELECT a.id AS a_id, b.id AS b_id, count(*) AS shared, any_value(a.n) + any_value(b.n) - count(*) AS total FROM p a JOIN p b ON a.token = b.token AND {same} AND a.id < b.id GROUP BY 1, 2), "
        f"pairs AS (SELECT m.*, {', '.join('a.' + b for b in block)}{''.join(f', a.{c.strip()} AS a_{c.strip()}, b.{c.strip()} AS b_{c.strip()}' for c in carry.split(',') if c.strip())} "
        f"FROM m JOIN t a ON a.id = a_id JOIN t b ON b.id = b_id WHERE shared * {below} >= total * {above} AND {extra})"
    )

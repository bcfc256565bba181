"""DuckDB statements for the queries that SQL can express over whole tables in reasonable time.

The others are compared with brute force in tests: p3 is approximate by nature, p6 and
p7 have no single answer, p8 needs automata.
"""

from recollex.plans.sql import bigrams

_WORDS = f"w AS (SELECT DISTINCT lower(id) AS id, unnest(list_distinct(list_concat(regexp_extract_all(lower(content), '[a-z0-9]+'), {bigrams('lower(content)')}))) AS token FROM memory_entries WHERE content IS NOT NULL)"


def _pairs(source: str, above: int, below: int, name: str) -> str:
    return (
        f"{name}_n AS (SELECT id, count(*) AS n FROM {source} GROUP BY 1), {name}_m AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM {source} a JOIN {source} b ON a.token = b.token AND a.id < b.id GROUP BY 1, 2), "
        f"{name} AS (SELECT a AS id_a, b AS id_b FROM {name}_m JOIN {name}_n x ON x.id = a JOIN {name}_n y ON y.id = b WHERE shared * {below} >= (x.n + y.n - shared) * {above})"
    )


_P1 = _WORDS + ", " + _pairs("w", 7, 10, "p1")


def _groups(links: str, name: str) -> str:
    """Every linked id with the least id of its group, by transitive closure."""
    return (
        f"both_ AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}), reached(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reached r JOIN both_ e ON e.a = r.b), "
        f"{name} AS (SELECT a AS id, least(a, min(b)) AS group_id FROM reached GROUP BY a)"
    )


_PLAIN = "regexp_replace(regexp_replace(lower({c}), '[\\s{{}}()\\[\\]<>\"''-]+', '', 'g'), '^(urn:)?(uuid:)?', '')"
_TOKENS = "tok AS (SELECT DISTINCT id, token FROM (SELECT lower(id) AS id, unnest(regexp_split_to_array(lower(content_tokens), '\\s+')) AS token FROM memory_entries) WHERE token <> '')"
_TAGS = (
    "tg AS (SELECT DISTINCT id, token FROM (SELECT lower(id) AS id, lower(trim(unnest(tags))) AS token FROM memory_entries) WHERE token <> ''), "
    "tags4 AS (SELECT * FROM tg WHERE id IN (SELECT id FROM tg GROUP BY 1 HAVING count(*) >= 4))"
)



def _classes(source: str, pairs: str, name: str) -> str:
    """Every id with the least id of equal sets, how many there are, and the classes that are paired with its own."""
    return (
        f"{name}_k AS (SELECT id, min(id) OVER (PARTITION BY s) AS class, count(*) OVER (PARTITION BY s) AS copies FROM (SELECT id, string_agg(token, chr(10) ORDER BY token) AS s FROM {source} GROUP BY 1)), "
        f"{name}_l AS (SELECT x.class, count(DISTINCT y.class) AS links FROM (SELECT id_a AS a, id_b AS b FROM {pairs} UNION ALL SELECT id_b, id_a FROM {pairs}) e JOIN {name}_k x ON x.id = a JOIN {name}_k y ON y.id = b WHERE x.class <> y.class GROUP BY 1), "
        f"{name} AS (SELECT id, {name}_k.class AS class, copies, coalesce(links, 0) AS links FROM {name}_k LEFT JOIN {name}_l ON {name}_k.class = {name}_l.class)"
    )


SQL = {
    "p1_classes": f"WITH {_P1}, {_classes('w', 'p1', 'k')} SELECT id, class, copies, links FROM k",
    "p4_links": f"WITH {_TOKENS}, {_TAGS}, {_pairs('tok', 1, 2, 'c')}, {_pairs('tags4', 3, 5, 'd')}, {_classes('tok', 'c', 'ck')}, {_classes('tags4', 'd', 'dk')} SELECT 'content_tokens' AS basis, id, class, copies, links FROM ck UNION ALL SELECT 'tags', id, class, copies, links FROM dk",
    "p1_found": f"WITH {_P1} SELECT id_a, id_b FROM p1",
    "p2_found": (
        f"WITH RECURSIVE {_P1}, links AS (SELECT id_a AS a, id_b AS b FROM p1), {_groups('links', 'g')}, "
        "n AS (SELECT id, count(*) AS n FROM w GROUP BY 1), "
        "m AS (SELECT group_id, g.id, n.n, max(importance) FILTER (WHERE importance BETWEEN 0 AND 10 AND NOT isnan(importance)) AS i, max(updated_at) FILTER (WHERE updated_at <= TIMESTAMP '2026-01-15 00:00:00') AS u FROM g JOIN n ON n.id = g.id JOIN memory_entries e ON lower(e.id) = g.id GROUP BY 1, 2, 3) "
        "SELECT group_id, first(id ORDER BY n DESC, id) AS content_id, first(id ORDER BY i DESC NULLS LAST, id) FILTER (WHERE i IS NOT NULL) AS importance_id, first(id ORDER BY u DESC NULLS LAST, id) FILTER (WHERE u IS NOT NULL) AS updated_id FROM m GROUP BY 1"
    ),
    "p4_found": f"WITH {_TOKENS}, {_TAGS}, {_pairs('tok', 1, 2, 'c')}, {_pairs('tags4', 3, 5, 'd')} SELECT 'content_tokens' AS basis, id_a, id_b FROM c UNION ALL SELECT 'tags', id_a, id_b FROM d",
    "p5_found": (
        f"WITH RECURSIVE ids AS (SELECT DISTINCT lower(id) AS id, {_PLAIN.format(c='id')} AS plain FROM memory_entries), ptr AS (SELECT lower(id) AS id, unnest([superseded_by, supersedes]) AS t FROM memory_entries), "
        f"links AS (SELECT DISTINCT ptr.id AS a, ids.id AS b FROM ptr JOIN ids ON ids.plain = {_PLAIN.format(c='t')} WHERE ids.id <> ptr.id), {_groups('links', 'g')} SELECT id, group_id FROM g"
    ),
}

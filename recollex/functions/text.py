"""Text functions over columns; all stay in the JVM.

A null text gives null unless stated.  Lengths count characters.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str

#: CJK characters that are cut into pairs.  Fixed value.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]+"
#: Marks that end a sentence.  Fixed value.
SENTENCE_END = "。！？!?.\n"
#: Beginning of paragraphs that repeat injected memories.  Fixed value.
INJECTED = "[参考记忆]"


def _c(column: ColumnOrName) -> Column:
    return F.col(column) if isinstance(column, str) else column


def cjk_bigrams(text: ColumnOrName) -> Column:
    """Pairs of neighbours of every run of CJK characters, in order; a run of one gives the character."""

    def pairs(run: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(F.length(run) == 1, F.array(run)).otherwise(many)

    return F.flatten(F.transform(F.regexp_extract_all(_c(text), F.lit(f"({CJK})"), F.lit(1)), pairs))


def tokenize(text: ColumnOrName, words: ColumnOrName | None = None) -> Column:
    """Distinct tokens in order: runs of a-z0-9 of the lower-cased text, dictionary words if a
    segmenter's column is given, CJK bigrams.  A null text has none."""
    filled = F.coalesce(_c(text), F.lit(""))
    parts = [F.regexp_extract_all(F.lower(filled), F.lit("([a-z0-9]+)"), F.lit(1))]
    if words is not None:
        parts.append(F.coalesce(_c(words), F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts, cjk_bigrams(filled)))


def normalize_content(text: ColumnOrName) -> Column:
    """White space of any kind collapsed to one space, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " ")))


def fnv1a_base36(text: ColumnOrName) -> Column:
    """FNV-1a of 32 bits over UTF-16 units, in base 36."""
    points = F.transform(F.filter(F.split(_c(text), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))

    def step(h: Column, unit: Column) -> Column:
        return (h.bitwiseXOR(unit) * 16777619).bitwiseAND(F.lit(4294967295))

    def both(h: Column, point: Column) -> Column:
        high, low = F.shiftright(point - 65536, 10) + 55296, (point - 65536).bitwiseAND(F.lit(1023)) + 56320
        return F.when(point > 65535, step(step(h, high), low)).otherwise(step(h, point))

    folded = F.aggregate(points, F.lit(2166136261).cast("bigint"), both)
    return F.lower(F.conv(folded.cast("string"), 10, 36))


def dedup_key(content: ColumnOrName) -> Column:
    """Key of equal normalised contents."""
    return fnv1a_base36(normalize_content(content))


def short_session(session_id: ColumnOrName) -> Column:
    """First 8 characters after an optional prefix session-."""
    return F.substring(F.regexp_replace(_c(session_id), "^session-", ""), 1, 8)


def truncate_latest(text: ColumnOrName, limit: int) -> Column:
    """The last `limit` characters; without the first if that is a line end."""
    tail = F.substring(_c(text), -limit, limit)
    cut = F.when(F.substring(tail, 1, 1) == "\n", F.substring(tail, 2, limit)).otherwise(tail)
    return F.when(F.length(_c(text)) <= limit, _c(text)).otherwise(cut)


def truncate_sentence(text: ColumnOrName, limit: int = 200) -> Column:
    """At most `limit` characters, up to the last end of a sentence in their second half if there is one."""
    head = F.substring(_c(text), 1, limit)
    whole = F.regexp_extract(head, f"(?s)^.*[{SENTENCE_END}]", 0)
    return F.when(F.length(_c(text)) <= limit, _c(text)).when(F.length(whole) >= limit // 2, whole).otherwise(head)


def cut_with_note(text: ColumnOrName, limit: int, what: str) -> Column:
    """At most `limit` characters, and a note with the full length where some were cut."""
    note = F.concat(F.substring(_c(text), 1, limit), F.lit(f"…[{what}已截断，原文 "), F.length(_c(text)), F.lit(" 字符]"))
    return F.when(F.length(_c(text)) > limit, note).otherwise(_c(text))


def excerpt(text: ColumnOrName) -> Column:
    return cut_with_note(text, 400, "摘录")


def summary(text: ColumnOrName) -> Column:
    return cut_with_note(text, 2000, "摘要")


def strip_paragraphs(text: ColumnOrName, marker: str = INJECTED) -> Column:
    """The text without paragraphs that begin with the marker after white space."""
    kept = F.filter(F.split(_c(text), "\n\n"), lambda p: ~F.regexp_replace(p, r"(?U)^\s+", "").startswith(marker))
    return F.array_join(kept, "\n\n")


def number(value: ColumnOrName) -> Column:
    """A number as text, whole ones without decimals."""
    v = _c(value)
    return F.when(v == F.floor(v), F.floor(v).cast("bigint").cast("string")).otherwise(v.cast("string"))


def render_line(kind: ColumnOrName, content: ColumnOrName, importance: ColumnOrName, id: ColumnOrName, session_id: ColumnOrName, created_at: ColumnOrName | None = None) -> Column:
    """The full line of a memory; the date is left out where it is null."""
    date = F.lit("") if created_at is None else F.coalesce(F.concat(F.lit("，创建于 "), F.date_format(_c(created_at), "yyyy-MM-dd")), F.lit(""))
    return F.concat(F.lit("- ["), _c(kind), F.lit("] "), _c(content), F.lit("（重要度 "), number(importance), F.lit("，记忆 #"), F.substring(_c(id), 1, 8), F.lit("，来自会话 "), short_session(session_id), date, F.lit("）"))


def render_condensed(kind: ColumnOrName, content: ColumnOrName, id: ColumnOrName, limit: int = 80) -> Column:
    """The short line of a memory, with the length of what was cut."""
    long = F.concat(F.substring(_c(content), 1, limit), F.lit("…（原文 "), F.length(_c(content)), F.lit(" 字符，记忆 #"))
    body = F.when(F.length(_c(content)) > limit, long).otherwise(F.concat(_c(content), F.lit("（记忆 #")))
    return F.concat(F.lit("- ["), _c(kind), F.lit("] "), body, F.substring(_c(id), 1, 8), F.lit("）"))


def catalog_row(kind: ColumnOrName, content: ColumnOrName, id: ColumnOrName) -> Column:
    """The line of a memory in a catalog: a title of 24 characters."""
    return F.concat(F.lit("- ["), _c(kind), F.lit("] "), F.substring(_c(content), 1, 24), F.lit("（记忆 #"), F.substring(_c(id), 1, 8), F.lit("）"))


def prompt_row(id: ColumnOrName, kind: ColumnOrName, content: ColumnOrName) -> Column:
    """The line of a memory in a causal prompt."""
    return F.concat(F.lit("#"), _c(id), F.lit(" ["), _c(kind), F.lit("] "), truncate_sentence(content, 200))


def judge_row(label: str, id: ColumnOrName, kind: ColumnOrName, content: ColumnOrName) -> Column:
    """The line of a memory in a review prompt: white space collapsed, 200 characters."""
    flat = F.substring(F.regexp_replace(_c(content), r"(?U)\s+", " "), 1, 200)
    return F.concat(F.lit(f"- {label} #"), _c(id), F.lit(" kind="), _c(kind), F.lit(" content="), flat)


def normalize_tags(tags: ColumnOrName) -> Column:
    """Lower-cased distinct tags in order."""
    return F.array_distinct(F.transform(_c(tags), F.lower))


def micros(timestamp: ColumnOrName) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), _c(timestamp))


def user_text(messages: ColumnOrName) -> Column:
    """Text blocks of messages (array of structs: source_kind, blocks (array of structs: type, text)) that users wrote,
    joined by line ends; empty if there are none."""
    own = F.filter(_c(messages), lambda m: m["source_kind"] == "user")
    blocks = F.flatten(F.transform(own, lambda m: F.filter(m["blocks"], lambda b: (b["type"] == "text") & b["text"].isNotNull())))
    return F.coalesce(F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"), F.lit(""))


def pick_words(tokens: ColumnOrName, stop: list[str], count: int = 2) -> Column:
    """The first tokens that are no stop words."""
    return F.slice(F.filter(_c(tokens), lambda t: ~t.isin(*stop)), 1, count)

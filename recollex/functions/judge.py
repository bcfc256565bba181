"""Reading recorded model answers: the first whole JSON object and its typed items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

#: Kinds of memories and actions of verdicts.  Fixed values.
KINDS = ("fact", "preference", "decision", "todo", "insight")
ACTIONS = ("merge", "archive", "none")


def first_object(text: str | None) -> str | None:
    """The first { ... } whose braces balance outside of strings; null if there is none."""
    if text is None:
        return None
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for at in range(max(start, 0), len(text) if start >= 0 else 0):
        mark = text[at]
        if escaped:
            escaped = False
        elif quoted:
            escaped = mark == "\\"
            quoted = mark != '"'
        elif mark == '"':
            quoted = True
        elif mark == "{":
            depth += 1
        elif mark == "}":
            depth -= 1
            if depth == 0:
                return text[start : at + 1]
    return None


@F.pandas_udf(StringType())
def balanced_json(texts: pd.Series) -> pd.Series:
    """`first_object` of each text, in Arrow batches: a machine over characters that no built-in expresses."""
    return texts.map(first_object)


def items(answers: DataFrame, field: str) -> DataFrame:
    """(output_id, position, item): the objects in the array `field` of each answer; answers
    without JSON or without such an array have none."""
    parsed = answers.select("output_id", F.try_parse_json(balanced_json("raw_text")).alias("v"))
    rows = parsed.select("output_id", F.posexplode(F.try_variant_get("v", f"$.{field}", "array<variant>")).alias("position", "item"))
    return rows.where(F.schema_of_variant("item").startswith("OBJECT"))


def _typed(path: str, *types: str) -> Column:
    """The variant at a path if it is of one of the types."""
    value = F.try_variant_get("item", path, "variant")
    kind = F.schema_of_variant(value)
    return F.when(F.coalesce(kind.rlike(f"^({'|'.join(types)})"), F.lit(False)), value)


def text_at(path: str) -> Column:
    return F.try_variant_get(_typed(path, "STRING"), "$", "string")


def number_at(path: str) -> Column:
    return F.try_variant_get(_typed(path, "BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "$", "double")


def rating_at(path: str) -> Column:
    """A number rounded half up, within 0..10; null if there is none (greatest and least pass over nulls)."""
    number = number_at(path)
    return F.when(number.isNotNull(), F.least(F.greatest(F.floor(number + 0.5), F.lit(0)), F.lit(10))).cast("bigint")


def trimmed(column: Column) -> Column:
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def memories(answers: DataFrame) -> DataFrame:
    """Well-formed extracted memories: a known kind and a content that is not blank; other fields
    of a wrong type are null, tags that are no strings are left out."""
    tags = F.try_variant_get("item", "$.tags", "array<variant>")
    strings = F.transform(F.filter(tags, lambda t: F.schema_of_variant(t) == "STRING"), lambda t: F.try_variant_get(t, "$", "string"))
    rows = items(answers, "memories").select("output_id", "position", text_at("$.kind").alias("kind"), trimmed(text_at("$.content")).alias("content"), rating_at("$.importance").alias("importance"), rating_at("$.selfRelevance").alias("self_relevance"), F.array_join(strings, ",").alias("tags"))
    return rows.where(F.col("kind").isin(*KINDS) & (F.col("content") != ""))


def decisions(answers: DataFrame) -> DataFrame:
    """Well-formed verdicts: two ids, a known action, a reason."""
    rows = items(answers, "decisions").select("output_id", "position", text_at("$.focusId").alias("focus_id"), text_at("$.peerId").alias("peer_id"), text_at("$.action").alias("action"), text_at("$.reason").alias("reason"))
    return rows.where((F.col("focus_id") != "") & (F.col("peer_id") != "") & F.col("action").isin(*ACTIONS) & F.col("reason").isNotNull())


def edges(answers: DataFrame) -> DataFrame:
    """Well-formed causal edges: two ids and a finite confidence."""
    rows = items(answers, "edges").select("output_id", "position", text_at("$.sourceId").alias("source_id"), text_at("$.targetId").alias("target_id"), number_at("$.confidence").alias("confidence"), text_at("$.justification").alias("justification"))
    return rows.where((F.col("source_id") != "") & (F.col("target_id") != "") & F.col("confidence").isNotNull() & ~F.isnan("confidence") & (F.abs("confidence") < float("inf")))

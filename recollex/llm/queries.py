"""Queries p1 to p8 over the driver's tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from recollex.llm.abuse import FOUND, abuse_rates, abuse_scores
from recollex.llm.chosen_paths import similar_sets
from recollex.llm.components import hash_to_min
from recollex.llm.mixing import drawn, emitted, mixing_rates, plain_source, shares
from recollex.llm.near_duplicates import duplicate_classes, grouped_texts, near_duplicates
from recollex.llm.oracles import SQL
from recollex.llm.packing import fill_report, packed
from recollex.llm.sets import between_ids, class_sets, clean_tags, linked_classes, memberships, spaced_tokens
from recollex.llm.survivors import Bundle, Dependency, assemble, choose_suppliers
from recollex.llm.tokens import with_sizes
from recollex.llm.vector_forest import nearest, usable_vectors
from recollex.sources.shared import Scratch
from recollex.sources.tables import table


def _texts(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "memory_entries").select(F.lower("id").alias("id"), "content")


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of memories whose contents share at least 0.7 of their words."""
    return near_duplicates(_texts(spark, directory), Scratch(spark))


def p1_classes(spark: SparkSession, directory: str) -> DataFrame:
    """Every memory with words, the least id with equal words, how many have them, and the classes similar to its own."""
    return duplicate_classes(_texts(spark, directory), Scratch(spark))


#: The clock of the test tables.
NOW = "2026-01-15 00:00:00"
TEXT = Bundle("content", ("content", "content_tokens", "dedup_key", "tags"), "n_words")
RATING = Bundle("importance", ("importance", "self_relevance"), "CASE WHEN importance BETWEEN 0 AND 10 THEN importance END")
TIMES = Bundle("updated", ("created_at", "updated_at", "last_access_at", "access_count"), f"CASE WHEN updated_at <= TIMESTAMP_NTZ '{NOW}' THEN timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', updated_at) END")
ORIGIN = Bundle("origin", ("session_id", "source"), "CASE WHEN trim(session_id) <> '' THEN 1 + int(source.excerpt IS NOT NULL) END")
PLACE = Bundle("place", ("workspace",), "CASE WHEN trim(workspace) <> '' THEN 1 + 0.5 * int(coalesce(status = 'active', false)) END")
#: A session belongs to one workspace.
ONE_PLACE = Dependency("origin", "session_id", "place", "workspace")


def _duplicate_groups(spark: SparkSession, directory: str, scratch: Scratch) -> DataFrame:
    """(id, group_id, n_words) of every memory in a group of near-duplicates."""
    return grouped_texts(_texts(spark, directory), scratch)


def _members(spark: SparkSession, directory: str, scratch: Scratch, *columns: str) -> DataFrame:
    groups = _duplicate_groups(spark, directory, scratch).withColumnRenamed("group_id", "group")
    rows = table(spark, directory, "memory_entries").withColumn("id", F.lower("id")).select("id", *columns)
    return rows.join(groups, "id")


BUNDLES = [TEXT, RATING, TIMES, ORIGIN, PLACE]


def _chosen(spark: SparkSession, directory: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members of the groups, and the supplier of each bundle."""
    members = scratch.keep(_members(spark, directory, scratch, "importance", "updated_at", "session_id", "source", "workspace", "status"))
    return members, choose_suppliers(members, BUNDLES, [ONE_PLACE])


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """The member of each group of near-duplicates that supplies content, importance and updated_at."""
    _, chosen = _chosen(spark, directory, Scratch(spark))
    return chosen.select(F.col("group").alias("group_id"), "content_id", "importance_id", "updated_id")


def p2_survivors(spark: SparkSession, directory: str) -> DataFrame:
    """The surviving memory of each group, its bundles chosen so that its session lies in its workspace."""
    scratch = Scratch(spark)
    members, chosen = _chosen(spark, directory, scratch)
    newest = table(spark, directory, "memory_entries").withColumn("id", F.lower("id")).join(members.select("id").distinct(), "id", "left_semi")
    payload = [f for b in BUNDLES for f in b.fields]
    records = newest.groupBy("id").agg(F.max_by(F.struct(*payload), F.struct("ingested_at", "updated_at")).alias("r")).select("id", "r.*")
    return assemble(chosen, scratch.keep(records), BUNDLES).withColumnRenamed("group", "group_id")


def _vectors(spark: SparkSession, directory: str, scratch: Scratch) -> DataFrame:
    rows = table(spark, directory, "memory_vectors").where("dim = 128")
    return usable_vectors(rows.select(F.lower("memory_id").alias("id"), "embedding", F.col("embedded_at").alias("at")), 128, scratch)


def _named(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs of keys with the ids of both ends."""
    ids = vectors.select("id", "key")
    return pairs.join(ids, "key").join(ids.select(F.col("id").alias("neighbour_id"), F.col("key").alias("neighbour")), "neighbour")


def p3_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    """Of every usable current vector the 5 memories with the most similar ones, at a cosine of 0.75 or more."""
    scratch = Scratch(spark)
    vectors = _vectors(spark, directory, scratch)
    return _named(nearest(vectors, 128, 5, scratch, 0.75, exact=True), vectors).select("id", "neighbour_id", F.round("cosine", 3).alias("cosine"))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of memories with a cosine of at least 0.75, one among the 5 most similar of the other."""
    scratch = Scratch(spark)
    vectors = _vectors(spark, directory, scratch)
    either = nearest(vectors, 128, 5, scratch, 0.75).select(F.least("key", "neighbour").alias("key"), F.greatest("key", "neighbour").alias("neighbour")).distinct()
    return _named(either, vectors).select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b"))


def _overlapping(records: DataFrame, split: Callable, least: int, threshold: tuple[int, int], recall: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    sets = class_sets(records, split, scratch, least)
    pairs = similar_sets(sets, scratch, threshold, recall)
    scratch.drop(sets)
    return pairs, scratch.keep(memberships(records, split, least))


def _overlaps(spark: SparkSession, directory: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    rows, scratch = table(spark, directory, "memory_entries"), Scratch(spark)
    return {
        "content_tokens": _overlapping(rows.select(F.lower("id").alias("id"), "content_tokens"), spaced_tokens, 1, (1, 2), 0.97, scratch),
        "tags": _overlapping(rows.select(F.lower("id").alias("id"), "tags"), clean_tags, 4, (3, 5), 0.97, scratch),
    }


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of memories whose token sets share 0.5, or whose tag sets share 0.6, of their union."""
    found = [between_ids(*made).select(F.lit(basis).alias("basis"), "id_a", "id_b") for basis, made in _overlaps(spark, directory).items()]
    return found[0].unionByName(found[1])


def p4_links(spark: SparkSession, directory: str) -> DataFrame:
    """Every memory with a set, its class of equal sets and the classes its class overlaps with, for both fields."""
    found = [linked_classes(*made).select(F.lit(basis).alias("basis"), "id", "class", "copies", "links") for basis, made in _overlaps(spark, directory).items()]
    return found[0].unionByName(found[1])


def plain_id(column) -> F.Column:
    """An id without the ways it may be spelled: letter case, white space, a urn prefix, braces, quotes, dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(column), r"(?U)[\s{}()\[\]<>\"'-]+", ""), "^(urn:)?(uuid:)?", "")


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Every memory linked by supersedes or superseded_by, with the least id of its group."""
    rows = table(spark, directory, "memory_entries")
    ids = rows.select(F.lower("id").alias("id")).where("id is not null").distinct().withColumn("plain", plain_id("id"))
    pointers = rows.select(F.lower("id").alias("id"), F.explode(F.array("superseded_by", "supersedes")).alias("to")).where("to is not null")
    pointers = pointers.withColumn("plain", plain_id("to")).where("plain <> ''").select("id", "plain").distinct()
    links = pointers.join(ids.withColumnRenamed("id", "other"), "plain").select("id", "other")
    groups = hash_to_min(links, "id", "other", Scratch(spark))
    return groups.select(F.col("vertex").alias("id"), F.col("group").alias("group_id"))


def _sized(spark: SparkSession, directory: str, scratch: Scratch, *columns) -> DataFrame:
    return scratch.keep(with_sizes(table(spark, directory, "documents").select("doc_id", "text", *columns)))


def p6_packed(spark: SparkSession, directory: str) -> DataFrame:
    """Container and position of every text, or piece of a text, for each kind of container."""
    return packed(_sized(spark, directory, Scratch(spark)), table(spark, directory, "pack_containers"))


def p6_fill(spark: SparkSession, directory: str) -> DataFrame:
    """Containers of each kind and how full they are."""
    return fill_report(p6_packed(spark, directory), table(spark, directory, "pack_containers"))


def _mixed(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark)
    sized = _sized(spark, directory, scratch, plain_source("source").alias("source"))
    rates = scratch.keep(mixing_rates(sized, table(spark, directory, "mix_targets")))
    return rates, drawn(sized, rates, scratch)


def p7_mixed(spark: SparkSession, directory: str) -> DataFrame:
    """The documents of each mix, one row per copy."""
    return emitted(_mixed(spark, directory)[1])


def p7_shares(spark: SparkSession, directory: str) -> DataFrame:
    """The share of each source in each mix, as asked for and as reached."""
    return shares(*_mixed(spark, directory))


def _scored(spark: SparkSession, directory: str) -> DataFrame:
    return abuse_scores(table(spark, directory, "documents"), Scratch(spark), table(spark, directory, "review_labels"))


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents with abusive, threatening, hateful or sexually explicit language."""
    return _scored(spark, directory).where(F.col("score") >= FOUND).select("doc_id")


def p8_scores(spark: SparkSession, directory: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, directory)


def p8_rates(spark: SparkSession, directory: str) -> DataFrame:
    """The rate of such documents per source."""
    return abuse_rates(_scored(spark, directory))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_classes": p1_classes, "p2_found": p2_found, "p2_survivors": p2_survivors, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p4_found": p4_found, "p4_links": p4_links, "p5_found": p5_found, "p6_packed": p6_packed, "p6_fill": p6_fill, "p7_mixed": p7_mixed, "p7_shares": p7_shares, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

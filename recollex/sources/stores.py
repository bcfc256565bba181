"""Reading and writing stored memories: JSON rows and documents, operation logs, vectors, snapshots.

There is no table format with upserts on the classpath, so a store is an append-only
operation log that a fold reads (`operators.ingest.fold`), and its compaction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from recollex.operators.entries import latest, validation_errors
from recollex.operators.ingest import LOG, fold
from recollex.sources import schema as sc


@dataclass(frozen=True)
class Loaded:
    """Rows that could be read, and those that could not with why."""

    rows: DataFrame
    quarantine: DataFrame

    def counts(self) -> tuple[int, int]:
        return self.rows.count(), self.quarantine.count()


def _split(parsed: DataFrame, key: str, value: str) -> Loaded:
    good = F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    rows = parsed.where(good).select("r.*").drop("_corrupt").withColumn("_errors", validation_errors())
    bad = parsed.where(~good).select(F.col(key), F.col(value), F.lit("no JSON of a memory").alias("reason"))
    invalid = parsed.where(good).select(F.col(key), F.col(value), F.array_join(F.transform(F.array("r"), lambda r: F.lit("")), "").alias("_"), "r.*").withColumn("_e", validation_errors()).where(F.size("_e") > 0).select(key, value, F.concat(F.lit("invalid: "), F.array_join("_e", ",")).alias("reason"))
    return Loaded(rows.where(F.size("_errors") == 0).drop("_errors"), bad.unionByName(invalid))


def _parsed(raw: DataFrame, value: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return raw.withColumn("r", F.from_json(value, sc.struct(sc.MEMORY + ", _corrupt string"), options))


def load_json_rows(raw: DataFrame, key: str = "key", value: str = "value") -> Loaded:
    """Memories of a key-value table with one JSON text a row; rows that are no JSON or break the schema
    are set aside."""
    return _split(_parsed(raw, value), key, value)


def load_json_document(spark: SparkSession, path: str) -> Loaded:
    """Memories of a legacy document {"tables": {"entries": {id: memory}}}.

    Raises FileNotFoundError for a missing file and ValueError for one that is no such
    document; single bad memories are set aside.
    """
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(path)
    text = spark.read.text(path, wholetext=True)
    tables = text.select(F.try_variant_get(F.try_parse_json("value"), "$.tables.entries", "map<string, variant>").alias("entries"))
    if tables.where("entries is not null").isEmpty():
        raise ValueError(f"{path} holds no memories document")
    raw = tables.select(F.explode("entries").alias("key", "v")).select("key", F.to_json("v").alias("value"))
    return load_json_rows(raw)


def bulk_insert(rows: DataFrame, path: str) -> None:
    """Write a new table, all rows or none; raises if there is one already."""
    rows.write.mode("errorifexists").parquet(path)


def append_operations(operations: DataFrame, path: str) -> None:
    """Append to an operation log; an append is visible as a whole or not at all."""
    operations.select(*[f.name for f in sc.struct(LOG).fields]).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(sc.struct(LOG)).parquet(path)


def compact(spark: SparkSession, log: str, target: str) -> None:
    """The state of a log as one table."""
    fold(read_log(spark, log)).write.mode("errorifexists").parquet(target)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors in one folder per length, so searches of one model read nothing else."""
    vectors.write.mode("append").partitionBy("dim").parquet(path)


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """The current vectors of one length; the filter prunes folders."""
    rows = spark.read.schema(sc.struct(sc.VECTOR)).parquet(path).where(F.col("dim") == dim)
    return latest(rows, ["memory_id"], [F.col("embedded_at").desc_nulls_last(), F.col("embedding").desc_nulls_last()])


def retired_dimensions(names: DataFrame, dim: int) -> DataFrame:
    """Of names of vector tables those of another length."""
    number = F.regexp_extract("name", r"^vec\d*_memory_(\d+)$", 1)
    return names.where(number != "").where(number.cast("int") != dim)


def expired_backups(backups: DataFrame, keep: int = 10) -> DataFrame:
    """Of backups (path, made_at) all but the newest; they are a folder listing, so few."""
    placed = backups.withColumn("_place", F.row_number().over(Window.orderBy(F.col("made_at").desc_nulls_last(), F.desc("path"))))
    return placed.where(F.col("_place") > keep).drop("_place")

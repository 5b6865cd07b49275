"""Review files, JSON results with a digest, and checks that come before any write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_review(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, as text spreadsheets write it: a byte order mark is skipped, quotes are doubled."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").schema(schema).csv(path)


def write_review(rows: DataFrame, path: str, order: list) -> None:
    """One sorted CSV file with a header: lists for people, bounded by what people can read."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(rows: DataFrame, path: str) -> str:
    """Writes JSON lines and gives a digest that doesn't depend on the order of the rows."""
    rows.write.mode("overwrite").json(path)
    return digest(rows)


def digest(rows: DataFrame) -> str:
    """SHA-256 over the row count and the sums of all rows' digests, so that rows may lie in any order and partition."""
    h = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)]
    return h.agg(F.count("*").alias("n"), *parts).select(F.sha2(F.concat_ws("-", *[F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3", "s4")]), 256).alias("d")).first()["d"]


def write_table(rows: DataFrame, path: str, bucket: str | None = None) -> None:
    """Replaces a table; with `bucket` rows of a key lie in one file, so that later scans by key read little."""
    (rows.repartition(bucket) if bucket else rows).write.mode("overwrite").parquet(path)


def gate(checks: dict[str, DataFrame]) -> None:
    """Raises if any of the named DataFrames has rows; nothing is written before."""
    bad = [name for name, rows in checks.items() if not rows.isEmpty()]
    if bad:
        raise ValueError("checks failed: " + ", ".join(bad))


def counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """(name, n, expected) of the tables whose number of rows is not the expected one."""
    parts = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(expected[name]).cast("long").alias("expected"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.where("n <> expected")

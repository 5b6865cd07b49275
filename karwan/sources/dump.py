"""SQL dump text as DataFrames: INSERT lines, their tuples and fields, without a Python pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a backslash and a letter stand for; any other letter stands for itself.
ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}
# possessive groups: they are matched in a loop, so that a field may be of any length
_TUPLE = r"\(((?:[^'()]++|'(?:[^'\\]++|\\[\s\S]|'')*+')*+)\)"
_FIELD = r"((?:'(?:[^'\\]++|\\[\s\S]|'')*+'|[^,']++)++|(?<=,)(?=,|$)|^(?=,))"


def insert_lines(lines: DataFrame, table: str, col: str = "value") -> DataFrame:
    """(values): what follows VALUES in the lines that insert into the table, one statement a line."""
    head = f"INSERT INTO `{table}` VALUES "
    return lines.where(F.col(col).startswith(head)).select(F.rtrim(F.regexp_replace(F.substring(col, len(head) + 1, 2**31 - 1), r";\s*$", "")).alias("values"))


def tuples(values: Column) -> Column:
    """The bodies of the top-level tuples; quotes may hold brackets, commas and escaped quotes."""
    return F.regexp_extract_all(values, F.lit(_TUPLE), F.lit(1))


def fields(body: Column) -> Column:
    """The raw fields of a tuple's body."""
    return F.transform(F.regexp_extract_all(body, F.lit(_FIELD), F.lit(1)), lambda x: F.trim(x))


def unescape(raw: Column) -> Column:
    """NULL as null, quoted text without quotes and escapes (read from left to right), any other literal as it is."""
    inner = raw.substr(F.lit(2), F.char_length(raw) - 2)
    marked = F.regexp_extract_all(F.replace(inner, F.lit("''"), F.lit("\\'")), F.lit(r"(\\[\s\S]|[^\\]++)"), F.lit(1))
    letter = lambda p: p.substr(F.lit(2), F.lit(1))
    one = lambda p: F.when(p.startswith("\\"), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv]), letter(p)), letter(p))).otherwise(p)
    return F.when(F.upper(raw) == "NULL", None).when(raw.startswith("'") & raw.endswith("'") & (F.char_length(raw) >= 2), F.array_join(F.transform(marked, one), "")).otherwise(raw)


def read_table(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """The rows of a table in a dump, all fields as nullable text in the given order.

    A tuple with another number of fields raises. Bad bytes are replaced. Lines of other tables are skipped by a prefix
    that is tested before anything is parsed.
    """
    rows = insert_lines(spark.read.text(path), table).select(F.explode(tuples(F.col("values"))).alias("t")).select(fields(F.col("t")).alias("f"))
    right = F.when(F.size("f") == len(columns), F.col("f")).otherwise(F.raise_error(F.concat(F.lit(f"{table}: a row has another number of fields than {len(columns)}: "), F.size("f").cast("string"))))
    return rows.select(right.alias("f")).select(*[unescape(F.get("f", i)).alias(c) for i, c in enumerate(columns)])

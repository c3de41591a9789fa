"""Data-quality expectations: each gives rows (check, failed, total); a gate passes if none failed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _row(rows: DataFrame, name: str, bad: Column, total: Column | None = None) -> DataFrame:
    return rows.agg(F.coalesce(bad, F.lit(0)).cast("long").alias("failed"), (total if total is not None else F.count(F.lit(1))).alias("total")).select(F.lit(name).alias("check"), "failed", "total")


def unique(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Keys that occur more than once (Q01)."""
    return _row(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), name, F.sum((F.col("n") > 1).cast("int")))


def holds(rows: DataFrame, condition: Column, name: str) -> DataFrame:
    """Rows for which a condition is false or unknown (Q02, Q04, Q06, Q07)."""
    return _row(rows, name, F.sum((~F.coalesce(condition, F.lit(False))).cast("int")))


def in_order(rows: DataFrame, key: str, order: str, position: str, most: int, name: str) -> DataFrame:
    """Rows of a timeline beyond its cap or earlier than the row before them (Q03)."""
    before = F.lag(order).over(Window.partitionBy(key).orderBy(position))
    return _row(rows.withColumn("__bad", (F.col(position) > most) | F.coalesce(F.col(order) < before, F.lit(False))), name, F.sum(F.col("__bad").cast("int")))


def at_least(rows: DataFrame, n: int, name: str) -> DataFrame:
    """Too few rows (Q05)."""
    return _row(rows, name, (F.count(F.lit(1)) < n).cast("int"))


def distinct_elements(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Arrays that repeat an element (Q08)."""
    return holds(rows, elements_once(column), name)


def inspect(rows: DataFrame, conditions: dict[str, Column], least: dict[str, int] | None = None) -> DataFrame:
    """All row checks of a table in one pass: each condition's rows that don't hold (Q02, Q04, Q06-Q08), and whether there
    are as many rows as each of `least` wants (Q05)."""
    counts = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(conditions.values())]
    one = rows.agg(F.count(F.lit(1)).alias("total"), *counts)
    found = [(name, F.col(f"c{i}")) for i, name in enumerate(conditions)] + [(name, (F.col("total") < n).cast("long")) for name, n in (least or {}).items()]
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), failed.alias("failed"), F.col("total")) for name, failed in found])))


def elements_once(column: str) -> Column:
    """Whether an array repeats no element (Q08)."""
    return F.size(F.array_distinct(column)) == F.size(column)


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def passed(checks: DataFrame) -> bool:
    return checks.where("failed > 0").isEmpty()

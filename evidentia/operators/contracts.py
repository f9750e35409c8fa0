"""Table contracts: declared schemas, row grain, foreign keys and single bindings as violation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType


def schema_problems(df: DataFrame, declared: StructType) -> list[str]:
    """Differences between a frame and its declared schema: names, order and types; nullability is not compared."""
    have, want = [(f.name, f.dataType.simpleString()) for f in df.schema], [(f.name, f.dataType.simpleString()) for f in declared]
    if have == want:
        return []
    missing = [f"missing {n}" for n, _ in want if n not in dict(have)]
    unknown = [f"unknown {n}" for n, _ in have if n not in dict(want)]
    kinds = [f"{n} is {t}, not {dict(want)[n]}" for n, t in have if n in dict(want) and dict(want)[n] != t]
    return missing + unknown + kinds or ["the columns are in another order"]


def grain_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def foreign_key_violations(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    """Distinct left keys that no right row has; keys with a null are not references."""
    target = right.select(*[F.col(r).alias(k) for k, r in zip(left_keys, right_keys, strict=True)]).distinct()
    return left.select(*left_keys).dropna().distinct().join(target, left_keys, "left_anti")


def bindings(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many distinct tuples the columns hold; a run is bound to one only if that is at most 1."""
    return df.agg(F.count_distinct(F.struct(*columns)).alias("n_bindings")).withColumn("single", F.col("n_bindings") <= 1)


def first_duplicate(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that repeat an earlier row's key, in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n > 1").drop("__n")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the side and the surplus."""
    columns = left.columns
    a = left.groupBy(*columns).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*columns).agg(F.count("*").alias("n_right"))
    both = a.join(b, columns, "full_outer").withColumns({"n_left": F.coalesce("n_left", F.lit(0)), "n_right": F.coalesce("n_right", F.lit(0))})
    return both.where("n_left <> n_right").select(*columns, F.when(F.col("n_left") > F.col("n_right"), "left").otherwise("right").alias("side"), F.abs(F.col("n_left") - F.col("n_right")).alias("surplus"))


def merge_identical(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The union of two tables in which rows of one key must be identical; a conflict is an error when the result is read."""
    rows = left.unionByName(right).distinct()
    counted = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("rows of one key differ")).cast("long")).otherwise(F.col("__n"))
    return counted.withColumn("__n", checked).where("__n = 1").drop("__n")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of either side once, with `side`: matched, left_only or right_only."""
    a, b = left.select(*keys).distinct().withColumn("__l", F.lit(True)), right.select(*keys).distinct().withColumn("__r", F.lit(True))
    side = F.when(F.col("__l") & F.col("__r"), "matched").when(F.col("__l"), "left_only").otherwise("right_only")
    return a.join(b, keys, "full_outer").select(*keys, side.alias("side"))


def overrides_applied(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Findings with `status`: open, acknowledged, or stale where an override names another digest."""
    o = overrides.select("finding_id", F.col("digest").alias("__digest"), "override_id")
    status = F.when(F.col("override_id").isNull(), "open").when(F.col("__digest") == F.col("digest"), "acknowledged").otherwise("stale")
    return findings.join(o, "finding_id", "left").withColumn("status", status).drop("__digest")

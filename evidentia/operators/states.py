"""Event-sourced state logs: order, legality, current state and carried values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Legal transitions; null begins a history. (Fixed values.)
LEGAL = [
    (None, "expected"), ("expected", "acquired"), ("expected", "unavailable"), ("expected", "restricted"),
    ("acquired", "parsed"), ("acquired", "failed"), ("acquired", "unavailable"),
    ("parsed", "partial"), ("parsed", "completed"), ("parsed", "completed-no-theme"), ("parsed", "failed"),
]
#: From these a document is only taken up again under an override.
UNDER_OVERRIDE = [("failed", "acquired"), ("unavailable", "acquired")]
NEEDS_REASON = ["expected", "unavailable", "restricted", "failed"]


def ordered(log: DataFrame) -> DataFrame:
    """The log with `run_started` (its run's earliest time); runs follow each other by it, then by run id, then by sequence."""
    return log.withColumn("run_started", F.min("recorded_at").over(Window.partitionBy("run_id")))


def history(key: str = "document_id"):
    return Window.partitionBy(key).orderBy("run_started", "run_id", "sequence")


def checked(log: DataFrame, key: str = "document_id") -> DataFrame:
    """Every transition with its `problem`: broken_chain, illegal_transition, missing_reason, unexpected_reason or null."""
    legal = F.array(*[F.lit(f"{a or ''}>{b}") for a, b in LEGAL])
    override = F.array(*[F.lit(f"{a}>{b}") for a, b in UNDER_OVERRIDE])
    step = F.concat(F.coalesce("from_state", F.lit("")), F.lit(">"), F.col("to_state"))
    reason = F.coalesce("missing_reason", "failure_reason")
    rows = ordered(log).withColumn("last_state", F.lag("to_state").over(history(key)))
    problem = (
        F.when(~F.col("from_state").eqNullSafe(F.col("last_state")), "broken_chain")
        .when(~F.array_contains(legal, step) & ~(F.array_contains(override, step) & F.col("override_id").isNotNull()), "illegal_transition")
        .when(F.col("to_state").isin(NEEDS_REASON) & reason.isNull(), "missing_reason")
        .when(~F.col("to_state").isin(NEEDS_REASON) & reason.isNotNull(), "unexpected_reason")
    )
    return rows.withColumn("problem", problem)


def current(log: DataFrame, key: str = "document_id") -> DataFrame:
    """The last transition of each document."""
    last = F.struct("run_started", "run_id", "sequence")
    return ordered(log).groupBy(key).agg(F.max_by(F.struct(*log.columns), last).alias("row")).select("row.*")


def carried(log: DataFrame, column: str, key: str = "document_id") -> DataFrame:
    """The log with a column's last known value so far."""
    over = history(key).rowsBetween(Window.unboundedPreceding, 0)
    return ordered(log).withColumn(column, F.last(column, ignorenulls=True).over(over))


def state_counts(current_states: DataFrame, states: list[str]) -> DataFrame:
    """A count for every state of the closed list, zero ones included."""
    spark = current_states.sparkSession
    every = spark.createDataFrame([(s,) for s in states], "to_state string")
    return every.join(current_states.groupBy("to_state").agg(F.count("*").alias("n")), "to_state", "left").select("to_state", F.coalesce("n", F.lit(0)).alias("n"))


def attempts(tries: DataFrame, key: str = "document_id") -> DataFrame:
    """Of each document the first confirmed try in order, with every try up to it as an array."""
    over = Window.partitionBy(key).orderBy("order")
    seen = tries.withColumn("__before", F.coalesce(F.max(F.col("confirmed").cast("int")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    made = seen.where("__before = 0").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("order", "exhibit", "confirmed"))).alias("attempts"))
    return made.withColumn("chosen", F.expr("try_element_at(filter(attempts, a -> a.confirmed), 1).exhibit"))


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work that no stored result covers, for idempotent resumption."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")

"""Streaming forms of the state log and of late statements."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.operators.states import LEGAL, UNDER_OVERRIDE
from evidentia.session import ship

_OUT = "document_id string, sequence long, from_state string, to_state string, accepted boolean, problem string"


def tracked(log: DataFrame) -> DataFrame:
    """Transitions of a stream judged one by one against each document's held state; refused ones leave it as it is.

    log: document_id, sequence, to_state, override_id. The state of a document is one string.
    """
    ship(log.sparkSession)
    legal, taken_up = {(a, b) for a, b in LEGAL}, set(UNDER_OVERRIDE)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        for frame in frames:
            rows = []
            for r in frame.sort_values("sequence").itertuples():
                move = (now, r.to_state)
                fine = move in legal or (move in taken_up and isinstance(r.override_id, str))
                rows.append((key[0], r.sequence, now, r.to_state, fine, None if fine else "illegal_transition"))
                now = r.to_state if fine else now
            yield pd.DataFrame(rows, columns=["document_id", "sequence", "from_state", "to_state", "accepted", "problem"])
        if now is not None:
            state.update((now,))

    return log.groupBy("document_id").applyInPandasWithState(step, _OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by window and kind; a window is final once the watermark has passed it."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def split_late(statements: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(applied, withheld) statements of a stream by their publication day, which is no watermark: what is late is kept aside."""
    late = F.coalesce(F.col("published_on") > F.lit(cutoff).cast("date"), F.lit(False))
    return statements.where(~late), statements.where(late)


def append_new(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Write a stream's rows that the table does not hold yet; a batch that is run again adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        from evidentia.sources.stores import exists

        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        if exists(spark, path):
            fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Membership intervals, as-of lookups and eligibility over bitemporal statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def withheld(statements: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(applied, withheld): a statement published after the cutoff is set aside, never applied."""
    late = F.col("published_on") > F.lit(cutoff).cast("date")
    return statements.where(~F.coalesce(late, F.lit(False))), statements.where(late)


def day_actions(statements: DataFrame, key: str = "security_id", day: str = "effective_on", action: str = "action") -> DataFrame:
    """One row per key and day with its action; days that both add and remove are `ambiguous`."""
    actions = F.array_sort(F.collect_set(action))
    return statements.groupBy(key, day).agg(F.count("*").alias("n_statements"), actions.alias("actions")).select(
        key, day, "n_statements", F.when(F.size("actions") > 1, "ambiguous").otherwise(F.col("actions")[0]).alias("action")
    )


def reconstruct(days: DataFrame, key: str = "security_id", day: str = "effective_on") -> DataFrame:
    """Intervals [valid_from, valid_to) of each key from its added and removed days, open ends null.

    A key is broken by an ambiguous day, an addition while it is a member or a removal while it is
    not; a broken key yields one row without an interval and its reason instead.
    """
    over = Window.partitionBy(key).orderBy(day)
    marked = days.withColumns({"last": F.lag("action").over(over), "next_day": F.lead(day).over(over), "next_action": F.lead("action").over(over)})
    fault = (
        F.when(F.col("action") == "ambiguous", "ambiguous")
        .when((F.col("action") == "added") & (F.col("last") == "added"), "conflicting")
        .when((F.col("action") == "removed") & (F.coalesce("last", F.lit("removed")) == "removed"), "conflicting")
    )
    judged = marked.withColumn("fault", fault)
    broken = judged.groupBy(key).agg(F.max(F.when(F.col("fault") == "ambiguous", 2).when(F.col("fault") == "conflicting", 1)).alias("worst"))
    whole = judged.join(broken.where("worst is null").select(key), key).where("action = 'added'")
    intervals = whole.select(key, F.col(day).alias("valid_from"), F.when(F.col("next_action") == "removed", F.col("next_day")).alias("valid_to"), F.lit(None).cast("string").alias("reason"))
    nothing = broken.where("worst is not null").select(key, F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.when(F.col("worst") == 2, "ambiguous").otherwise("conflicting").alias("reason"))
    return intervals.unionByName(nothing)


def alternating(days: DataFrame, key: str, day: str) -> DataFrame:
    """Intervals from the first addition of each run of additions to the next removal; ambiguous days are left out."""
    over = Window.partitionBy(key).orderBy(day)
    clear = days.where("action <> 'ambiguous'").withColumn("last", F.lag("action").over(over))
    turns = clear.where((F.col("action") != F.coalesce("last", F.lit("removed"))))
    return turns.withColumn("valid_to", F.lead(day).over(over)).where("action = 'added'").select(key, F.col(day).alias("valid_from"), "valid_to")


def holds(day: Column, start: Column, end: Column) -> Column:
    """start <= day < end, with an open end for null."""
    return (start <= day) & (end.isNull() | (day < end))


def members_at(intervals: DataFrame, days: DataFrame, key: str) -> DataFrame:
    """(day, key) for every member of each asked day; the days are a small asked set."""
    asked = F.broadcast(days.select("day").distinct())
    return intervals.join(asked, holds(F.col("day"), F.col("valid_from"), F.col("valid_to"))).select("day", key).distinct()


def member_counts(intervals: DataFrame) -> DataFrame:
    """The number of members from each day of change on, by summing entries and exits.

    Steps are summed by day first, so the ordered window holds a calendar, not the intervals.
    """
    steps = intervals.select(F.col("valid_from").alias("day"), F.lit(1).alias("step")).unionByName(intervals.where("valid_to is not null").select(F.col("valid_to").alias("day"), F.lit(-1).alias("step")))
    per_day = steps.groupBy("day").agg(F.sum("step").alias("step"))
    return per_day.select("day", F.sum("step").over(Window.orderBy("day")).alias("members"))


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, other_at: str, other_id: str, bound: str | None = None) -> DataFrame:
    """For each left row the nearest right row of its key at or after it and, with a bound, before that; ties by id.

    One union and one backward-looking window serve as the as-of join, so its cost is that of a sort.
    """
    order = Window.partitionBy(key).orderBy(F.col("__at"), F.col("__side")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    firsts = right.groupBy(key, F.col(other_at).alias("__at")).agg(F.min(other_id).alias("__id")).withColumn("__side", F.lit(1))
    rows = left.withColumns({"__at": F.col(at), "__side": F.lit(0)}).unionByName(firsts, allowMissingColumns=True)
    found = rows.withColumn("__hit", F.first(F.when(F.col("__side") == 1, F.struct(F.col("__at").alias("at"), F.col("__id").alias("id"))), ignorenulls=True).over(order)).where("__side = 0")
    hit = F.col("__hit") if bound is None else F.when(F.col(bound).isNull() | (F.col("__hit.at") < F.col(bound)), F.col("__hit"))
    return found.select(*left.columns, hit["at"].alias("nearest_at"), hit["id"].alias("nearest_id"))


def nearest_either(left: DataFrame, right: DataFrame, key: str, at: str, other_at: str, other_id: str, kind: str, first_kind: str) -> DataFrame:
    """The nearest right row on either side of each left row; an equal distance goes to `first_kind`, then to the earlier and the smaller id."""
    pairs = left.join(right.select(key, F.col(other_at).alias("__o"), F.col(other_id).alias("__i"), F.col(kind).alias("__k")), key, "left")
    away = F.abs(F.unix_micros(F.col("__o").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")))
    rank = F.struct(away.alias("d"), F.when(F.col("__k") == first_kind, 0).otherwise(1).alias("k"), F.col("__o").alias("o"), F.col("__i").alias("i"))
    best = F.min(F.when(F.col("__i").isNotNull(), rank)).alias("__b")
    return pairs.groupBy(*left.columns).agg(best).select(*left.columns, F.col("__b.i").alias("nearest_id"), F.col("__b.d").alias("distance_us"))


#: Exchange hours in minutes after Eastern midnight.
OPENS, CLOSES_EARLY = 9 * 60 + 30, 13 * 60


def eastern(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, "America/New_York")


def side(ts: Column, bound: Column, timing: Column) -> Column:
    """'before' or 'after' a bound day in Eastern time, null where the same day leaves it open.

    On the bound's own day a change before the open is behind every time from 9:30 on, and a change
    after the close ahead of every time under 13:00.
    """
    local = eastern(ts)
    day, minute = F.to_date(local), F.hour(local) * 60 + F.minute(local)
    return (
        F.when(day < bound, "before").when(day > bound, "after")
        .when((timing == "before_open") & (minute >= OPENS), "after")
        .when((timing == "after_close") & (minute < CLOSES_EARLY), "before")
    )


def in_interval(ts: Column, start: Column, start_timing: Column, end: Column, end_timing: Column) -> Column:
    """Three-valued membership: true, false, or null where a bound's day does not order the time."""
    after_start = F.when(start_timing == "anchor", F.to_date(eastern(ts)) >= start).otherwise(side(ts, start, start_timing) == "after")
    before_end = F.when(end.isNull(), F.lit(True)).otherwise(side(ts, end, end_timing) == "before")
    return after_start & before_end


def eligibility(events: DataFrame, window: tuple[str, str], cutoff: str) -> DataFrame:
    """Status and reason by the first check that fails: window, release, cutoff, membership.

    Needs period_end, n_releases, published_at and member (three-valued).
    """
    inside = F.col("period_end").between(F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date"))
    late = F.to_date(F.col("published_at")) > F.lit(cutoff).cast("date")
    reason = (
        F.when(~inside, "outside_window").when(F.col("n_releases") == 0, "no_release").when(F.col("n_releases") > 1, "several_releases")
        .when(late, "after_cutoff").when(F.col("member").isNull(), "membership_unordered").when(~F.col("member"), "not_a_member")
    )
    status = F.when(reason.isNull(), "eligible").when(reason.isin("no_release", "several_releases", "membership_unordered"), "ambiguous").otherwise("ineligible")
    return events.withColumns({"eligibility_reason": reason, "eligibility_status": status})


def wall_time_utc(text: Column, zone: str = "America/New_York") -> Column:
    """UTC of a wall time; null where the zone skips the time or has it twice."""
    wall = text.cast("timestamp_ntz").cast("timestamp")
    utc = F.to_utc_timestamp(wall, zone)
    hour = F.expr("interval 1 hour")
    skipped = F.from_utc_timestamp(utc, zone) != wall
    twice = (F.from_utc_timestamp(utc - hour, zone) == wall) | (F.from_utc_timestamp(utc + hour, zone) == wall)
    return F.when(~skipped & ~twice, utc)


def period_gaps(periods: DataFrame, entity: str = "entity_id", day: str = "period_end", most: int = 105) -> DataFrame:
    """Consecutive periods of an entity that lie more than `most` days apart."""
    over = Window.partitionBy(entity).orderBy(day)
    pairs = periods.select(entity, day).distinct().withColumn("next_period_end", F.lead(day).over(over))
    return pairs.withColumn("gap_days", F.datediff("next_period_end", day)).where(F.col("gap_days") > most)


def edge_gaps(periods: DataFrame, start: str, stop: str, entity: str = "entity_id", day: str = "period_end", first: int = 92, last: int = 91) -> DataFrame:
    """Entities whose first period is `first` days or more behind the start, or whose last is over `last` days ahead of the stop."""
    ends = periods.groupBy(entity).agg(F.min(day).alias("first_period"), F.max(day).alias("last_period"))
    lead, tail = F.datediff("first_period", F.lit(start).cast("date")), F.datediff(F.lit(stop).cast("date"), F.col("last_period"))
    kinds = F.array_compact(F.array(F.when(lead >= first, "first_edge"), F.when(tail > last, "last_edge")))
    return ends.withColumn("kind", F.explode(kinds))


def transitions(intervals: DataFrame, issuer: str = "issuer_id") -> DataFrame:
    """Entries and exits of an issuer in the union of its securities' intervals."""
    order = Window.partitionBy(issuer).orderBy("valid_from", F.col("valid_to").desc_nulls_first())
    far = F.lit("9999-12-31").cast("date")
    reach = F.max(F.coalesce("valid_to", far)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    spells = intervals.withColumn("__reach", reach).withColumn("__new", (F.col("__reach").isNull() | (F.col("valid_from") > F.col("__reach"))).cast("int"))
    spells = spells.withColumn("__spell", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = spells.groupBy(issuer, "__spell").agg(F.min("valid_from").alias("entered"), F.max(F.coalesce("valid_to", far)).alias("left"))
    enters = whole.select(issuer, F.lit("entry").alias("kind"), F.col("entered").alias("effective_on"))
    exits = whole.where(F.col("left") < far).select(issuer, F.lit("exit").alias("kind"), F.col("left").alias("effective_on"))
    return enters.unionByName(exits)


def uncorroborated_quarters(calendar: DataFrame, snapshots: DataFrame, cutoff: str) -> DataFrame:
    """Quarters of the calendar without a snapshot that was published by the cutoff and not supplied by a user."""
    timely = snapshots.where((F.col("published_on") <= F.lit(cutoff).cast("date")) & (F.col("source") != "user")).select(F.concat(F.year("as_of"), F.lit("Q"), F.quarter("as_of")).alias("quarter"))
    return calendar.join(timely.distinct(), "quarter", "left_anti")


def latest_snapshots(snapshots: DataFrame, cutoff: str) -> DataFrame:
    """Of each report date the snapshot that was published last by the cutoff."""
    order = Window.partitionBy("as_of").orderBy(F.desc("published_on"), "evidence_id")
    return snapshots.where(F.col("published_on") <= F.lit(cutoff).cast("date")).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")

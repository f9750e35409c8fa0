"""Filings: slots of periods, release candidates, stated periods and named exhibits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidentia.functions.text import announces_results, exhibit_numbers, stated_dates, stated_periods


def slots(reports: DataFrame, issuer: str = "issuer_id") -> DataFrame:
    """One slot per issuer and period end of original reports, the first filed report winning, with the next period end."""
    first = Window.partitionBy(issuer, "period_end").orderBy("filed_at", "accession")
    kept = reports.where("not amended").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept.withColumn("next_period_end", F.lead("period_end").over(Window.partitionBy(issuer).orderBy("period_end")))


def candidates(slot_rows: DataFrame, filings: DataFrame, cutoff: str, issuer: str = "issuer_id") -> DataFrame:
    """Slots with the filings that were accepted behind their period end and not behind the next one or the cutoff.

    Filings are laid into the period that they fall in by one backward-looking window over the
    union of both, so no pairs are made that do not match.
    """
    stop = F.coalesce("next_period_end", F.lit(cutoff).cast("date"))
    s = slot_rows.select(issuer, F.col("period_end").alias("at"), F.lit(0).alias("side"), "event_id", stop.alias("until"))
    f = filings.select(issuer, F.to_date("accepted_at").alias("at"), F.lit(1).alias("side"), "accession")
    # A filing on a period end belongs to the slot before it, so slots come behind filings of their own day.
    order = Window.partitionBy(issuer).orderBy("at", F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("side") == 0, F.struct("event_id", "until")), ignorenulls=True).over(order)
    rows = s.unionByName(f, allowMissingColumns=True).withColumn("slot", held).where("side = 1 and slot is not null")
    return rows.where(F.col("at") <= F.col("slot.until")).select(F.col("slot.event_id").alias("event_id"), issuer, "accession", F.col("at").alias("accepted_on"))


def candidate_drop(text: Column, period_end: Column, label: Column) -> Column:
    """Why a candidate is dropped: states_other_period where every judged statement misses, preliminary, or null."""
    days, named = stated_dates(text), stated_periods(text)
    day_hit = F.when(F.size(days) > 0, F.array_contains(days, period_end))
    label_hit = F.when((F.size(named) > 0) & label.isNotNull(), F.array_contains(named, label) | (label.isin("Q4", "FY") & F.arrays_overlap(named, F.array(F.lit("Q4"), F.lit("FY")))))
    judged = F.array_compact(F.array(day_hit, label_hit))
    return F.when((F.size(judged) > 0) & ~F.exists(judged, lambda x: x), "states_other_period").when(F.lower(text).rlike(r"\bpreliminary\b"), "preliminary")


def identified(rows: DataFrame) -> DataFrame:
    """Of each event its release: exactly one candidate left, else the ambiguity. rows: event_id, accession, dropped, matched."""
    left = F.col("dropped").isNull()
    per = rows.groupBy("event_id").agg(F.count_if(left).alias("n_left"), F.max(F.when(left, F.col("accession"))).alias("accession"), F.bool_or(left & F.coalesce("matched", F.lit(False))).alias("matched"))
    method = F.when((F.col("n_left") == 1) & F.col("matched"), "stated_period").when(F.col("n_left") == 1, "sole_candidate")
    return per.select("event_id", F.when(F.col("n_left") == 1, F.col("accession")).alias("release_accession"), method.alias("identification_method"), F.when(F.col("n_left") == 0, "no_release").when(F.col("n_left") > 1, "several_releases").alias("reason"))


def item_sections(filings: DataFrame, text: str = "text") -> DataFrame:
    """(accession, item, body) of the sections between item headings."""
    parts = F.split(F.col(text), r"(?im)^\s*(?=item\s+[0-9]+\.[0-9]+)")
    rows = filings.select("accession", F.explode(parts).alias("part")).withColumn("item", F.regexp_extract("part", r"(?i)^item\s+([0-9]+\.[0-9]+)", 1)).where("item <> ''")
    return rows.select("accession", "item", F.regexp_replace("part", r"(?i)^item\s+[0-9]+\.[0-9]+[.:]?\s*|\s+$", "").alias("body"))


def confirmed(opening: Column, whole: Column, period_end: Column, label: Column) -> Column:
    """An exhibit is confirmed where its opening announces results and it states the period anywhere."""
    return announces_results(opening) & (F.array_contains(stated_dates(whole), period_end) | F.coalesce(F.array_contains(stated_periods(whole), label), F.lit(False)))


def named_exhibits(filings: DataFrame) -> DataFrame:
    return filings.select("accession", F.explode(exhibit_numbers(F.col("text"))).alias("exhibit"))


def doubly_claimed(links: DataFrame) -> DataFrame:
    """Filings that several events claim, and whether across issuers."""
    per = links.groupBy("accession").agg(F.count_distinct("event_id").alias("n_events"), F.count_distinct("issuer_id").alias("n_issuers"))
    return per.where("n_events > 1").withColumn("kind", F.when(F.col("n_issuers") > 1, "across_issuers").otherwise("within_issuer"))


def convention_check(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """How the times of a listing stand to those of the filings' own pages, joined by accession."""
    from evidentia.functions.dates import convention

    return rows.join(pages, "accession").withColumn("convention", convention(F.col("listed_at"), F.col("accepted_at")))

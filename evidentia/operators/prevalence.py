"""Coverage-aware prevalence: four units per view, over every period and over the whole window.

A view is a set of themes. An entity-period unit is observed when a row of the coverage table says
so, and positive when an eligible, unmasked observation of a theme in the view hangs on an
observable coverage row. Units that are not observed leave the denominator; an empty denominator
gives a null rate with a reason, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidentia.session import cut

SLOT = ["doc_type", "speaker_role"]
EMPTY = "empty_denominator"


def ratio(numerator: Column, denominator: Column) -> Column:
    """A share that is null where nothing can be shared."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def headline(observations: DataFrame) -> DataFrame:
    """Observations that may count: eligible and under no mask."""
    return observations.where(F.col("headline_eligible") & (F.coalesce(F.size("mask_ids"), F.lit(0)) == 0))


def positive_units(observations: DataFrame, coverage: DataFrame, views: DataFrame) -> DataFrame:
    """Distinct (slot, view, entity, period) with a positive; quotes and nested themes never add votes."""
    observable = coverage.where("observable").select("event_id", *SLOT, "entity_id", "period_end").distinct()
    held = headline(observations).select("event_id", *SLOT, "theme_id").distinct().join(observable, ["event_id", *SLOT])
    return held.join(views.select("view_kind", "view_id", "theme_id").distinct(), "theme_id").select(*SLOT, "view_kind", "view_id", "entity_id", "period_end").distinct()


def audit(coverage: DataFrame, *keys: str) -> DataFrame:
    """Unit counts of each slot: eligible ones by what is known of them, and the reasons of what is missing.

    Rows are first brought down to units, so that plain counts do for distinct ones.
    """
    eligible = F.col("eligibility_status") == "eligible"
    units = coverage.groupBy(*SLOT, "entity_id", "period_end").agg(
        F.bool_or(eligible).alias("e"), F.bool_or(eligible & F.col("available")).alias("a"), F.bool_or(eligible & F.col("parsed")).alias("p"), F.bool_or("observable").alias("o"), F.bool_or(eligible & F.col("observable")).alias("eo"),
        F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("observable"), F.col("missing_reasons"))))).alias("reasons"),
    )
    out = units.groupBy(*SLOT, *keys).agg(
        F.count_if("e").alias("expected_count"), F.count_if("a").alias("available_count"), F.count_if("p").alias("parsed_count"), F.count_if("o").alias("observable_count"),
        (F.count_if("e") - F.count_if("eo")).alias("excluded_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("restrictions"),
    )
    return out.withColumn("missing_period_count", F.col("excluded_count"))


def prevalence(coverage: DataFrame, observations: DataFrame, views: DataFrame) -> DataFrame:
    """Rows of (slot, view, unit, period or window) with numerator, denominator, rate, reason and audit counts.

    Units: issuer_period for each period; issuer_window, firm_quarter and equal_issuer_mean over
    the window. Views form a small closed dimension, so each slot and period is crossed with them.
    """
    kinds = views.select("view_kind", "view_id").distinct()
    positives = positive_units(observations, coverage, views)
    observed = coverage.where("observable").select(*SLOT, "entity_id", "period_end").distinct()
    view = ["view_kind", "view_id"]

    periods = coverage.select(*SLOT, "period_end").distinct().crossJoin(F.broadcast(kinds))
    by_period = (
        periods.join(positives.groupBy(*SLOT, *view, "period_end").agg(F.count("*").alias("hits")), [*SLOT, *view, "period_end"], "left")
        .join(observed.groupBy(*SLOT, "period_end").agg(F.count("*").alias("units")), [*SLOT, "period_end"], "left")
        .join(audit(coverage, "period_end"), [*SLOT, "period_end"], "left")
        .select(*SLOT, *view, "period_end", F.lit(None).cast("date").alias("window_start"), F.lit(None).cast("date").alias("window_end"), F.lit("issuer_period").alias("unit"), F.coalesce("hits", F.lit(0)).cast("double").alias("numerator"), F.coalesce("units", F.lit(0)).alias("denominator"), *_AUDIT)
    )

    per_entity = observed.groupBy(*SLOT, "entity_id").agg(F.count("*").alias("units"))
    hits = positives.groupBy(*SLOT, *view, "entity_id").agg(F.count("*").alias("hits")).join(per_entity, [*SLOT, "entity_id"])
    numerators = hits.groupBy(*SLOT, *view).agg(F.count("*").cast("double").alias("issuer_window"), F.sum("hits").cast("double").alias("firm_quarter"), F.sum(F.col("hits") / F.col("units")).alias("equal_issuer_mean"))
    denominators = per_entity.groupBy(*SLOT).agg(F.count("*").alias("entities"), F.sum("units").alias("units"))
    bounds = coverage.groupBy(*SLOT).agg(F.min("period_end").alias("window_start"), F.max("period_end").alias("window_end"))
    window = bounds.crossJoin(F.broadcast(kinds)).join(numerators, [*SLOT, *view], "left").join(denominators, SLOT, "left").join(audit(coverage), SLOT, "left")
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.coalesce(F.col(u), F.lit(0.0)).alias("numerator"), F.coalesce(F.col(d), F.lit(0)).alias("denominator")) for u, d in (("issuer_window", "entities"), ("firm_quarter", "units"), ("equal_issuer_mean", "entities"))]))
    by_window = window.select(*SLOT, *view, F.lit(None).cast("date").alias("period_end"), "window_start", "window_end", units.alias("u"), *_AUDIT).select(*SLOT, *view, "period_end", "window_start", "window_end", "u.*", *_AUDIT)

    out = by_period.unionByName(by_window)
    return out.withColumn("rate", ratio(F.col("numerator"), F.col("denominator"))).withColumn("reason", F.when(F.col("denominator") == 0, EMPTY))


_AUDIT = ["expected_count", "available_count", "parsed_count", "observable_count", "excluded_count", "missing_period_count", "restrictions"]


def closure(tree: DataFrame, most: int = 64) -> DataFrame:
    """(ancestor, theme) for every theme and itself or a descendant, from (theme_id, parent_id) rows.

    A parent that is not a theme or a cycle is an error. The tree is a codebook dimension; each
    round doubles the depth that is reached.
    """
    tree = tree.select("theme_id", "parent_id").distinct()
    lost = tree.where("parent_id is not null").join(tree.select(F.col("theme_id").alias("parent_id")), "parent_id", "left_anti")
    if lost.limit(1).count():
        raise ValueError("a theme has a parent that is not in the tree")
    up = tree.where("parent_id is not null").select(F.col("theme_id").alias("low"), F.col("parent_id").alias("high"))
    held = cut(up)
    for _ in range(most.bit_length()):
        more = held.alias("a").join(held.alias("b"), F.col("a.high") == F.col("b.low")).select("a.low", "b.high")
        grown = cut(held.unionByName(more).distinct())
        if grown.count() == held.count():
            break
        held = grown
    if held.where("low = high").limit(1).count():
        raise ValueError("the tree has a cycle")
    own = tree.select(F.col("theme_id").alias("ancestor"), F.col("theme_id"))
    return own.unionByName(held.select(F.col("high").alias("ancestor"), F.col("low").alias("theme_id")))


def views_of(tree: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """View rows: each theme alone, each parent with all its descendants, and each family's themes."""
    direct = tree.select(F.lit("direct").alias("view_kind"), F.col("theme_id").alias("view_id"), "theme_id")
    spread = closure(tree)
    parents = spread.groupBy("ancestor").agg(F.count("*").alias("n")).where("n > 1").select("ancestor")
    parent = spread.join(parents, "ancestor").select(F.lit("parent").alias("view_kind"), F.col("ancestor").alias("view_id"), "theme_id")
    out = direct.unionByName(parent)
    return out if families is None else out.unionByName(families.select(F.lit("family").alias("view_kind"), F.col("family_id").alias("view_id"), "theme_id"))


def roots(tree: DataFrame) -> DataFrame:
    """(theme_id, level_one): the root over each theme."""
    top = tree.where("parent_id is null").select(F.col("theme_id").alias("ancestor"))
    return closure(tree).join(top, "ancestor").select("theme_id", F.col("ancestor").alias("level_one"))


def hierarchy_conflicts(chosen: DataFrame, tree: DataFrame) -> DataFrame:
    """(claim_id, ancestor, theme_id) where both a theme and one over it were chosen."""
    pairs = closure(tree).where("ancestor <> theme_id")
    low = chosen.select("claim_id", "theme_id").distinct()
    high = chosen.select("claim_id", F.col("theme_id").alias("ancestor")).distinct()
    return low.join(pairs, "theme_id").join(high, ["claim_id", "ancestor"]).select("claim_id", "ancestor", "theme_id")

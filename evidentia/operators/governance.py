"""Projections with rights, target resolution, label merges and run-level checks as violation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidentia.functions.stats import ratio


def pointed(pointers: DataFrame, elements: DataFrame) -> DataFrame:
    """Pointers (doc_id, element_id, start, end relative to the element) as document spans or a reason."""
    e = elements.select("doc_id", "element_id", F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    rows = pointers.join(e, ["doc_id", "element_id"], "left")
    a, b = F.col("e_start") + F.coalesce("start", F.lit(0)), F.col("e_start") + F.coalesce("end", F.col("e_end") - F.col("e_start"))
    reason = F.when(F.col("e_start").isNull(), "unknown_element").when((F.coalesce("start", F.lit(0)) < 0) | (b > F.col("e_end")) | (b <= a), "outside_element")
    return rows.select("doc_id", "element_id", F.when(reason.isNull(), a).alias("doc_start"), F.when(reason.isNull(), b).alias("doc_end"), reason.alias("reason"))


def observation_rows(assignments: DataFrame, quotes: DataFrame, metadata: DataFrame, events: DataFrame, copies: DataFrame) -> DataFrame:
    """Assignments with their quote, document, event and disclosure group; masked quotes and copies are never headline rows."""
    rows = assignments.join(quotes.drop("mask_ids") if "mask_ids" in assignments.columns else quotes, ["doc_id", "quote_id"]).join(metadata, "doc_id").join(events, "event_id").join(copies, "doc_id")
    headline = (F.size("mask_ids") == 0) & (F.col("representative_doc_id") == F.col("doc_id")) & (F.col("status") == "consistent")
    return rows.withColumns({"headline_eligible": headline, "observation_id": F.sha2(F.concat_ws("|", "doc_id", "quote_id", "theme_id"), 256)})


def with_rights(rows: DataFrame, rights: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """Rows whose text columns are null unless the document's rights let the text be kept; unknown rights keep nothing."""
    held = rows.join(rights.select(key, F.col("retain_text").alias("__keep")).dropDuplicates([key]), key, "left")
    keep = F.coalesce("__keep", F.lit(False))
    return held.withColumns({c: F.when(keep, F.col(c)) for c in columns}).drop("__keep")


def fixture_votes(rows: DataFrame) -> DataFrame:
    """The policy of tests: it accepts with exactly the eligible quotes, and only in fixture scope."""
    out = F.when(F.col("policy_scope") == "fixture", "accepted").otherwise("refused")
    return rows.withColumns({"policy_vote": out, "policy_quotes": F.when(F.col("policy_scope") == "fixture", F.col("eligible_quotes")).otherwise(F.array().cast("array<string>"))})


def named_filing_refusal(rows: DataFrame, cutoff: str) -> DataFrame:
    """Named filings with the reason that refuses them: unknown, not the event's issuer, outside its period, after the cutoff."""
    day = F.to_date("accepted_at")
    reason = (
        F.when(day.isNull(), "unknown_filing").when(F.col("filing_issuer") != F.col("issuer_id"), "other_issuer")
        .when((day <= F.col("period_end")) | (day > F.coalesce("next_period_end", F.lit("9999-12-31").cast("date"))), "outside_period").when(day > F.lit(cutoff).cast("date"), "after_cutoff")
    )
    return rows.withColumn("refusal", reason)


def visible(filed_at: Column, at: Column, conventions: Column) -> Column:
    """Whether a report was public at an instant under the times that its listing may mean; null where they disagree."""
    utc = filed_at <= at
    eastern = F.to_utc_timestamp(filed_at, "America/New_York") <= at
    return F.when(conventions == "utc", utc).when(conventions == "eastern", eastern).when(utc == eastern, utc)


def page_shifts(pages: DataFrame, key: str = "cik") -> DataFrame:
    """Pages of a listing whose dates do not end before the newer page begins. pages: key, page, first_on, last_on."""
    newer = F.lead("first_on").over(Window.partitionBy(key).orderBy("first_on", "page"))
    return pages.withColumn("newer_first_on", newer).where(F.col("last_on") >= F.col("newer_first_on"))


def joined_with_misses(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inner rows, misses): the join of two sets and the keys that only one side has, with the side."""
    from evidentia.operators.contracts import reconcile

    return left.join(right, keys), reconcile(left, right, keys).where("side <> 'matched'")


def resolved_targets(targets: DataFrame, claims: DataFrame, quotes: DataFrame, themes: DataFrame) -> DataFrame:
    """Targets (target_id, doc_id, claim_id, theme_id) with their quotes and theme, or the first typed refusal.

    claims: doc_id, claim_id, quote_ids. quotes: doc_id, quote_id, reason (null: verified). themes: theme_id, label.
    """
    rows = targets.join(claims.select("doc_id", "claim_id", "quote_ids"), ["doc_id", "claim_id"], "left").join(themes.select("theme_id", "label"), "theme_id", "left")
    spread = rows.select("target_id", "doc_id", F.explode("quote_ids").alias("quote_id")).join(quotes.select("doc_id", "quote_id", "reason", F.lit(True).alias("known")), ["doc_id", "quote_id"], "left")
    checked = spread.groupBy("target_id").agg(F.count_if(F.col("known").isNull()).alias("n_lost"), F.count_if(F.col("reason").isNotNull()).alias("n_bad"))
    out = rows.join(checked, "target_id", "left")
    refusal = (
        F.when(F.col("quote_ids").isNull(), "unknown_claim").when(F.col("label").isNull(), "unknown_theme").when(F.size("quote_ids") == 0, "claim_without_quotes")
        .when(F.col("n_lost") > 0, "unknown_quote").when(F.col("n_bad") > 0, "quote_not_verified")
    )
    return out.select(*targets.columns, "quote_ids", F.col("label").alias("theme_label"), refusal.alias("refusal"))


def event_overrides(events: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with their override applied, overrides that name no event or an older digest)."""
    o = overrides.select("event_id", F.col("digest").alias("__d"), "override_id", F.col("release_accession").alias("__a"))
    rows = events.join(o, "event_id", "left")
    fits = F.coalesce(F.col("__d") == F.col("digest"), F.lit(False))
    applied = rows.withColumns({"release_accession": F.when(fits, F.col("__a")).otherwise(F.col("release_accession")), "applied_override": F.when(fits, F.col("override_id"))}).drop("__d", "__a", "override_id")
    left = overrides.join(events.select("event_id", F.col("digest").alias("__e")), "event_id", "left")
    status = F.when(F.col("__e").isNull(), "unknown_event").when(F.col("__e") != F.col("digest"), "stale")
    return applied, left.withColumn("status", status).where("status is not null").drop("__e")


def evidence_tallies(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Two-sided evidence figures from arrays `accepted` and `gold` of each cell: counts, precision, recall, F1, Jaccard."""
    from evidentia.functions.stats import evidence_f1

    hit = F.size(F.array_intersect("accepted", "gold"))
    t = cells.groupBy(*keys).agg(F.sum(F.size("accepted")).alias("a"), F.sum(F.size("gold")).alias("g"), F.sum(hit).alias("hit"))
    union = F.col("a") + F.col("g") - F.col("hit")
    return t.select(*keys, "a", "g", "hit", ratio(F.col("hit"), F.col("a")).alias("precision"), ratio(F.col("hit"), F.col("g")).alias("recall"), evidence_f1(F.col("hit"), F.col("a"), F.col("hit"), F.col("g")).alias("f1"), ratio(F.col("hit"), union).alias("jaccard"))


def review_shares(origins: DataFrame, *keys: str) -> DataFrame:
    """Shares of edited and rejected items among drafted ones, and of added ones among kept ones."""
    o = F.col("origin")
    t = origins.groupBy(*keys).agg(*[F.count_if(o == x).alias(x) for x in ("accepted", "edited", "rejected", "added")])
    drafted, kept = F.col("accepted") + F.col("edited") + F.col("rejected"), F.col("accepted") + F.col("edited") + F.col("added")
    return t.withColumns({"edited_share": ratio(F.col("edited"), drafted), "rejected_share": ratio(F.col("rejected"), drafted), "added_share": ratio(F.col("added"), kept)})


def retention(rows: DataFrame, *keys: str) -> DataFrame:
    """(kept, offered): sums of the sizes of two arrays."""
    return rows.groupBy(*keys).agg(F.sum(F.size("kept")).alias("kept"), F.sum(F.size("offered")).alias("offered"))


def merged_labels(committed: DataFrame, added: DataFrame, key: str = "target_id") -> DataFrame:
    """Labels with new rows added; a committed row never changes, and an attempt to change one is an error when the result is read."""
    a = added.select(key, F.struct(*[c for c in added.columns if c != key]).alias("new"))
    c = committed.select(key, F.struct(*[x for x in committed.columns if x != key]).alias("old"))
    both = c.join(a, key, "full_outer")
    clash = F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))
    checked = F.when(clash, F.raise_error(F.lit("a committed label differs")).cast(both.schema[key].dataType)).otherwise(F.col(key))
    return both.select(checked.alias(key), F.coalesce("old", "new").alias("label")).select(key, "label.*")


def joint_label(claim: Column, theme: Column) -> Column:
    """0 where either answer is negative, 1 where both are positive, else null."""
    return F.when((claim == 0) | (theme == 0), 0).when((claim == 1) & (theme == 1), 1)


def support_problems(targets: DataFrame, entailment: DataFrame, trials: DataFrame, usage: DataFrame, ceiling: int) -> DataFrame:
    """(target_id, problem) of a support run: signal slots, the trial panel, accounting and token ceilings."""
    s = entailment.groupBy("target_id").agg(F.count_if(F.col("scope") == "joint").alias("joint"), F.count_if(F.col("scope") == "quote").alias("single"))
    t = trials.groupBy("target_id").agg(F.count("*").alias("n"), F.count_distinct("family", "presentation").alias("slots"))
    u = usage.groupBy("target_id").agg(F.sum("reserved_tokens").alias("reserved"), F.count_if(F.col("unreported") & F.col("actual_prompt_tokens").isNotNull()).alias("odd"))
    rows = targets.join(s, "target_id", "left").join(t, "target_id", "left").join(u, "target_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    found = F.array_compact(F.array(
        F.when((zero("joint") != 1) | (zero("single") != F.size("evidence_ids")), "signal_slots"), F.when((zero("n") != 4) | (zero("slots") != 4), "trial_panel"),
        F.when(zero("odd") > 0, "usage_accounting"), F.when(zero("reserved") > ceiling, "over_ceiling"),
    ))
    return rows.select("target_id", F.explode(found).alias("problem"))


def coding_problems(classifications: DataFrame, proposals: DataFrame, decisions: DataFrame, assignments: DataFrame) -> DataFrame:
    """(id, problem) of a coding run: proposals without a completed classification, decisions without a proposal, assignments without an accepted decision."""
    done = classifications.where("status = 'completed'").select("classification_id")
    lost = proposals.join(done, "classification_id", "left_anti").select(F.col("proposal_id").alias("id"), F.lit("proposal_without_classification").alias("problem"))
    pair = ["doc_id", "claim_id", "theme_id"]
    odd = decisions.join(proposals.select(*pair).distinct(), pair, "left_anti").select(F.col("decision_id").alias("id"), F.lit("decision_without_proposal").alias("problem"))
    missing = proposals.join(decisions.select(*pair).distinct(), pair, "left_anti").select(F.col("proposal_id").alias("id"), F.lit("proposal_without_decision").alias("problem"))
    accepted = decisions.where("status = 'accepted'").select("doc_id", "theme_id", F.explode("supporting_quote_ids").alias("quote_id")).distinct()
    stray = assignments.join(accepted, ["doc_id", "theme_id", "quote_id"], "left_anti").select(F.col("assignment_id").alias("id"), F.lit("assignment_without_decision").alias("problem"))
    return lost.unionByName(odd).unionByName(missing).unionByName(stray)


#: Failures that a processed run may have. (Fixed values.)
COUNTED_FAILURES = ["malformed_reply", "unknown_label", "duplicate_label", "over_ceiling", "replay_miss"]


def run_state(targets: DataFrame) -> DataFrame:
    """One row: complete where nothing is open, processed where every failure is a counted one. targets: status, failure."""
    open_ = F.count_if(F.col("status").isin("incomplete", "refused") | F.col("failure").isNotNull())
    strange = F.count_if(F.col("failure").isNotNull() & ~F.col("failure").isin(COUNTED_FAILURES))
    return targets.agg((open_ == 0).alias("complete"), (strange == 0).alias("processed"), open_.alias("n_open"))


def require_empty(violations: DataFrame, what: str) -> None:
    """Fail closed: raise with one example if a check found anything."""
    rows = violations.limit(1).collect()
    if rows:
        raise ValueError(f"{what}: {rows[0].asDict()}")


def append_transitions(rows: DataFrame, path: str) -> None:
    """Add one run's transitions to a log once; the history with them must hold, and a run that is there is refused."""
    from evidentia.operators.states import checked
    from evidentia.sources.stores import exists

    spark, run = rows.sparkSession, rows.select("run_id").distinct().limit(2).collect()
    if len(run) != 1:
        raise ValueError("transitions of exactly one run are written")
    target = f"{path.rstrip('/')}/run_id={run[0]['run_id']}"
    if exists(spark, target):
        raise FileExistsError(f"run {run[0]['run_id']} is in the log")
    history = rows.unionByName(spark.read.schema(rows.schema).parquet(path)) if exists(spark, path) else rows
    require_empty(checked(history).where("problem is not null").select("document_id", "run_id", "problem"), "the history breaks")
    rows.drop("run_id").write.parquet(target)


def withheld_inventory(*tables: tuple[str, DataFrame]) -> DataFrame:
    """What was set aside, from several tables, as (table, id)."""
    out = None
    for name, df in tables:
        rows = df.where("withheld").select(F.lit(name).alias("table"), F.col(df.columns[0]).cast("string").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out

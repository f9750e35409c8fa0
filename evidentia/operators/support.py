"""Support outcomes, votes, assignments and the accounting of budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

TRIALS = 4


def outcomes(targets: DataFrame, trials: DataFrame, signals: DataFrame) -> DataFrame:
    """Status, flags and what is missing of each target: incomplete before flagged before assessed.

    trials: target_id, family, presentation, available, claim_support, theme_fit, reason_codes, reason.
    signals: target_id, scope, quote_id, available, reason. targets: target_id, n_quotes.
    """
    answer = F.struct("claim_support", "theme_fit")
    t = trials.groupBy("target_id").agg(
        F.count("*").alias("n_trials"), F.count_distinct("family", "presentation").alias("n_slots"),
        F.count_distinct(F.when(F.col("available"), answer)).alias("n_answers"),
        F.collect_set(F.when(~F.col("available"), F.coalesce("reason", F.lit("trial_unavailable")))).alias("lost_trials"),
        F.collect_set(F.when(F.col("claim_support") != "supported", F.col("claim_support"))).alias("support_flags"),
        F.collect_set(F.when(F.col("theme_fit") != "fits", F.col("theme_fit"))).alias("fit_flags"),
        F.array_distinct(F.flatten(F.collect_list("reason_codes"))).alias("codes"),
    )
    s = signals.groupBy("target_id").agg(F.count_if(F.col("scope") == "joint").alias("n_joint"), F.count_if(F.col("scope") == "quote").alias("n_single"), F.collect_set(F.when(~F.col("available"), F.coalesce("reason", F.lit("signal_unavailable")))).alias("lost_signals"))
    rows = targets.join(t, "target_id", "left").join(s, "target_id", "left")
    none = F.array().cast("array<string>")
    counts = F.array_compact(F.array(F.when(~F.coalesce((F.col("n_trials") == TRIALS) & (F.col("n_slots") == TRIALS), F.lit(False)), "trial_panel"), F.when(~F.coalesce((F.col("n_joint") == 1) & (F.col("n_single") == F.col("n_quotes")), F.lit(False)), "signal_slots")))
    missing = F.array_sort(F.array_distinct(F.concat(F.coalesce("lost_trials", none), F.coalesce("lost_signals", none), counts)))
    disagree = F.when(F.col("n_answers") > 1, F.array(F.lit("category_disagreement"))).otherwise(none)
    flags = F.array_sort(F.array_distinct(F.concat(F.coalesce("support_flags", none), F.coalesce("fit_flags", none), F.coalesce("codes", none), disagree)))
    status = F.when(F.size("missing") > 0, "incomplete").when(F.size("flags") > 0, "flagged").otherwise("assessed")
    return rows.select("target_id", missing.alias("missing"), flags.alias("flags")).withColumn("status", status)


def supporting_quotes(assessments: DataFrame) -> DataFrame:
    """(target_id, quote_id) that all of exactly four trials call supporting; the count guards against skipped nulls."""
    per = assessments.groupBy("target_id", "quote_id").agg(F.count("*").alias("n"), F.count_if(F.col("contribution") == "supporting").alias("yes"))
    return per.where((F.col("n") == TRIALS) & (F.col("yes") == TRIALS)).select("target_id", "quote_id")


def consensus(trials: DataFrame) -> DataFrame:
    """Of each target and family whether its presentations agree that it is supported; null unless there are two answers."""
    yes = (F.col("claim_support") == "supported") & (F.col("theme_fit") == "fits")
    per = trials.where("available").groupBy("target_id", "family").agg(F.count("*").alias("n"), F.bool_and(yes).alias("every"), F.bool_or(yes).alias("some"))
    return per.select("target_id", "family", F.when((F.col("n") == 2) & (F.col("every") == F.col("some")), F.col("every")).alias("verdict"))


def decided(rows: DataFrame) -> DataFrame:
    """Decisions by the vote order: what is unsafe first, then the policy.

    rows: support_status, policy_id, policy_vote, policy_quotes, eligible_quotes.
    """
    status = (
        F.when(F.col("support_status") == "refused", "refused").when(F.col("support_status").isin("incomplete", "flagged"), "review")
        .when(F.col("policy_id").isNull(), "review").when(F.size(F.array_except("policy_quotes", "eligible_quotes")) > 0, "refused")
        .otherwise(F.col("policy_vote"))
    )
    reason = F.when(F.col("support_status") == "refused", "assessment_refused").when(F.col("support_status") == "incomplete", "assessment_incomplete").when(F.col("support_status") == "flagged", "assessment_flagged").when(F.col("policy_id").isNull(), "calibration_required").when(F.size(F.array_except("policy_quotes", "eligible_quotes")) > 0, "unsupported_quote")
    return rows.withColumns({"status": status, "reason": reason})


def scorer_vote(rows: DataFrame, cutoff: float) -> DataFrame:
    """Accept from the cutoff on if there are eligible quotes."""
    return rows.withColumn("policy_vote", F.when((F.col("score") >= cutoff) & (F.size("eligible_quotes") > 0), "accepted").otherwise("rejected"))


def assignments(decisions: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assignments, links): accepted decisions by supporting quote, one assignment per (document, theme, quote), every decision linked."""
    spread = decisions.where("status = 'accepted'").select("decision_id", "doc_id", "claim_id", "theme_id", F.explode("supporting_quote_ids").alias("quote_id"))
    held = spread.join(evidence, ["doc_id", "quote_id"], "left")
    lost = F.when(F.col("start").isNull(), F.raise_error(F.lit("a supporting quote has no evidence")).cast("string")).otherwise(F.sha2(F.concat_ws("|", "doc_id", "theme_id", "quote_id"), 256))
    named = held.withColumn("assignment_id", lost)
    rows = named.select("assignment_id", "doc_id", "theme_id", "quote_id", "start", "end", "mask_ids").distinct()
    return rows, named.select("assignment_id", "doc_id", "claim_id", "decision_id").distinct()


def budget_audit(requests: DataFrame, order: list[str], scopes: dict[str, tuple[list[str], int]], cost: str) -> DataFrame:
    """Requests with the running cost of each scope and the first scope whose ceiling they pass.

    scopes: name -> (keys, ceiling). Running sums are windows by the scope's keys.
    """
    out, passed = requests, []
    for name, (keys, ceiling) in scopes.items():
        over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"{name}_used", F.sum(cost).over(over))
        passed.append(F.when(F.col(f"{name}_used") > ceiling, name))
    return out.withColumn("over_ceiling", F.coalesce(*passed))


def replayed(requests: DataFrame, replies: DataFrame, key: str = "request_hash") -> DataFrame:
    """Requests with their stored replies; one without is a replay_miss, never a guess."""
    held = replies.dropDuplicates([key])
    return requests.join(held, key, "left").withColumn("problem", F.when(F.col("reply").isNull(), "replay_miss"))


def drafts_compared(draft: DataFrame, working: DataFrame, key: str, content: str) -> DataFrame:
    """Items of a working copy against its draft: accepted, edited, added, rejected."""
    both = draft.select(key, F.col(content).alias("d"), F.lit(True).alias("in_draft")).join(working.select(key, F.col(content).alias("w"), F.lit(True).alias("in_working")), key, "full_outer")
    origin = F.when(F.col("in_draft").isNull(), "added").when(F.col("in_working").isNull(), "rejected").when(F.col("d").eqNullSafe(F.col("w")), "accepted").otherwise("edited")
    return both.select(key, origin.alias("origin"))


def completion(docs: DataFrame) -> DataFrame:
    """Processing state and reasons of each document from its flags and counts.

    docs: doc_id, extraction_failed, traversal, classification, assessment, decision (flags), has_policy,
    n_assignments, n_unmatched, declared_no_theme, reasons (array). A document without a theme is
    complete only where that was declared.
    """
    done = F.col("traversal") & F.col("classification") & F.col("assessment") & F.col("decision")
    ready = done & F.col("has_policy") & (F.size("reasons") == 0) & (F.col("n_unmatched") == 0)
    state = F.when(F.col("extraction_failed"), "failed").when(ready & (F.col("n_assignments") > 0), "completed").when(ready & F.col("declared_no_theme"), "completed-no-theme").otherwise("partial")
    more = F.array_compact(F.array(F.when(F.col("n_unmatched") > 0, "valid_unmatched"), F.when(done & (F.col("n_assignments") == 0) & (F.col("n_unmatched") == 0) & ~F.col("declared_no_theme"), "no_theme_unconfirmed")))
    return docs.withColumn("processing_state", state).withColumn("all_reasons", F.when(F.col("processing_state") == "partial", F.array_distinct(F.concat("reasons", more))).otherwise(F.col("reasons")))


#: From worst to best. (Fixed values.)
STATE_ORDER = ["failed", "partial", "completed", "completed-no-theme"]


def coverage_rows(expected: DataFrame, completions: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """One row per expected event, whatever is known of it: latest state, availability, observability and the reasons against it.

    expected: event_id, entity_id, period_end, eligibility_status. completions: event_id, doc_id,
    processing_state, observable, conflict, representative, reasons, accepted. acquisitions:
    event_id, state, doc_id, reason.
    """
    rank = F.coalesce(*[F.when(F.col("processing_state") == s, i) for i, s in enumerate(STATE_ORDER)])
    c = completions.groupBy("event_id").agg(
        F.min_by("processing_state", rank).alias("worst"), F.count_if("representative").alias("n_representatives"), F.bool_and("observable").alias("all_observable"), F.bool_or("conflict").alias("conflict"),
        F.sum(F.when(F.col("representative"), F.col("accepted"))).alias("accepted_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("c_reasons"),
    )
    a = acquisitions.groupBy("event_id").agg(
        F.bool_or(F.col("state") == "failed").alias("a_failed"), F.bool_or(F.col("state").isin("restricted", "unavailable")).alias("a_blocked"), F.bool_or(F.col("state") == "restricted").alias("a_restricted"),
        F.bool_or(F.col("doc_id").isNotNull()).alias("acquired"), F.bool_and(F.col("doc_id").isNotNull()).alias("all_parsed"), F.max("state").alias("a_state"), F.array_sort(F.collect_set("reason")).alias("a_reasons"),
    )
    none = F.array().cast("array<string>")
    rows = expected.join(c, "event_id", "left").join(a, "event_id", "left")
    state = F.when(F.col("a_failed"), "failed").otherwise(F.coalesce("worst", "a_state", F.lit("expected")))
    rows = rows.withColumns({"latest_state": state, "available": F.coalesce("acquired", F.lit(False)) | F.col("worst").isNotNull(), "parsed": F.coalesce("all_parsed", F.lit(False))})
    observable = F.col("parsed") & (F.col("n_representatives") > 0) & F.col("all_observable") & ~F.col("conflict") & F.col("latest_state").isin("completed", "completed-no-theme") & (F.col("eligibility_status") == "eligible") & ~F.coalesce("a_blocked", F.lit(False))
    availability = F.when(F.col("available"), "available").when(F.col("a_restricted"), "restricted").when(F.col("a_blocked"), "unavailable").otherwise("not_yet_checked")
    extra = F.array_compact(F.array(F.when(F.col("worst").isNull() & F.col("a_state").isNull(), "not_processed"), F.when(F.col("conflict"), "copy_processing_conflict"), F.when(F.col("eligibility_status") != "eligible", "not_eligible")))
    reasons = F.array_distinct(F.concat(F.coalesce("c_reasons", none), F.coalesce("a_reasons", none), extra))
    return rows.select(*expected.columns, "latest_state", "available", "parsed", F.coalesce(observable, F.lit(False)).alias("observable"), availability.alias("availability"), F.coalesce("accepted_count", F.lit(0)).alias("accepted_count"), reasons.alias("missing_reasons"))


def resolved_cells(cells: DataFrame, predicted: DataFrame) -> DataFrame:
    """Gold cells of each event with tie groups settled: a predicted member, else a present one, else any; the smallest stands, others are excused.

    cells: event_id, theme_id, tie_group (null: none), present. predicted: event_id, theme_id.
    """
    p = predicted.select("event_id", "theme_id", F.lit(True).alias("predicted")).distinct()
    rows = cells.join(p, ["event_id", "theme_id"], "left").withColumn("predicted", F.coalesce("predicted", F.lit(False)))
    tied = rows.where("tie_group is not null")
    untied = rows.where("tie_group is null and present").select("event_id", "theme_id", F.lit(True).alias("elsewhere")).distinct()
    order = F.struct(F.when(F.col("predicted"), 0).when(F.coalesce("elsewhere", F.lit(False)), 1).otherwise(2), "theme_id")
    chosen = tied.join(untied, ["event_id", "theme_id"], "left").groupBy("event_id", "tie_group").agg(F.min_by("theme_id", order).alias("chosen"))
    settled = tied.join(chosen, ["event_id", "tie_group"]).withColumn("role", F.when(F.col("theme_id") == F.col("chosen"), "gold").otherwise("excused"))
    plain = rows.where("tie_group is null and present").withColumn("role", F.lit("gold"))
    return settled.select("event_id", "theme_id", "tie_group", "predicted", "role").unionByName(plain.select("event_id", "theme_id", "tie_group", "predicted", "role"))

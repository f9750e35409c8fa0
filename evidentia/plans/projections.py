"""Queries on projections, refusals, inventories, attempts, snapshots, accounting and codebook trees.

Orders stand for documents, events or reports, their lines for quotes, facts and exhibits; customers
stand for issuers, nations and regions for the themes of a codebook.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.functions import dates as D, hashing as H, text as T
from evidentia.operators import extraction as X, governance as G, identity as N, intervals as I, layout as L, prevalence as P, release as R, selection as S, spans as Z, states as ST, support as U
from evidentia.session import table
from evidentia.sources import columns as C, stores as O


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"), start.alias("start"), (start + F.floor(F.col("o_totalprice") / 2000) + 1).alias("end"), F.col("o_orderstatus").alias("type"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def home_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first day of each pending order in the shortest span of the customer's others that holds it."""
    s = _spans(spark, sf_dir)
    homes = s.where("type <> 'P'").select("doc_id", "start", "end", F.col("id").alias("element_id"), F.when(F.col("type") == "F", 0).otherwise(1).alias("rank"))
    return Z.most_specific(s.where("type = 'P'").select("doc_id", "id", "start", (F.col("start") + 1).alias("end")), homes).select("id", "home_id")


def masked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir)
    masks = s.where("type = 'P'").select("doc_id", "start", "end", F.concat(F.lit("m"), "id").alias("mask_id"))
    return Z.masks_over(s.where("type = 'F'"), masks).select("id", F.concat_ws(",", "mask_ids").alias("mask_ids"))


def narrative_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir).withColumnRenamed("id", "element_id")
    return Z.narrative(s, ["P"]).select("element_id", "type")


def element_set_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order spans as elements of their customer's text of 2500 characters, some with a wrong id or parent."""
    s = _spans(spark, sf_dir)
    own = H.element_identity(F.col("type"), F.col("start"), F.col("end"))
    e = s.withColumn("element_id", F.when(F.col("id") % 7 == 0, "odd").otherwise(own)).withColumn("parent_id", F.when(F.col("id") % 11 == 0, "lost")).withColumnRenamed("id", "position")
    docs = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("doc_id"), F.repeat(F.lit("x"), F.lit(2500)).alias("canonical_text"))
    found = Z.element_problems(docs, e).where("problem <> 'crossing'")
    return found.groupBy("doc_id", "problem").agg(F.count("*").alias("n"))


def observation_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as assignments: a returned one's quote is masked, an odd order copies the even one before it."""
    li, o = _lines(spark, sf_dir), table(spark, sf_dir, "orders")
    pair = [F.col("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("quote_id")]
    masks = F.when(F.col("l_returnflag") == "R", F.array(F.lit("m"))).otherwise(F.array().cast("array<string>"))
    assignments = li.select(*pair, F.col("l_returnflag").alias("theme_id")).distinct()
    quotes = li.groupBy(*pair).agg(F.max_by(masks, "l_returnflag").alias("mask_ids"))
    metadata = o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("event_id"))
    events = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), F.col("c_nationkey").alias("entity_id"))
    copies = o.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") - F.col("o_orderkey") % 2).alias("representative_doc_id"), F.when(F.col("o_orderstatus") == "P", "conflict").otherwise("consistent").alias("status"))
    return G.observation_rows(assignments, quotes, metadata, events, copies).select("observation_id", "doc_id", "quote_id", "theme_id", "entity_id", "headline_eligible")


def audit_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rights = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("doc_id"), (F.col("c_mktsegment") == "BUILDING").alias("retain_text"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderpriority")
    return G.with_rights(rows, rights, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


def pointer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pointers into their order's span, ten characters before its beginning at the earliest."""
    elements = table(spark, sf_dir, "orders").where("o_orderkey % 13 <> 5").select(F.col("o_orderkey").alias("doc_id"), F.lit("e").alias("element_id"), F.col("o_custkey").alias("start"), (F.col("o_custkey") + 40).alias("end"))
    p = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.lit("e").alias("element_id"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("int") - 10).alias("start"), (F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("end"))
    return G.pointed(p, elements).groupBy(F.coalesce("reason", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"), F.sum("doc_start").alias("starts"), F.sum("doc_end").alias("ends"))


def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("l_orderkey", F.col("l_partkey").alias("chunk_start"), (F.col("l_partkey") + 40).alias("chunk_end"), (F.col("l_linenumber") - 2).alias("start"), (F.col("l_linenumber") - 2 + F.col("l_quantity").cast("int")).alias("end"))
    return Z.to_document_span(rows).groupBy("l_orderkey", "reason").agg(F.count("*").alias("n"), F.sum("doc_start").alias("starts"), F.sum("doc_end").alias("ends"))


def cutoff_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 > 0, F.to_date("o_orderdate")).alias("published_on"))
    applied, late = I.withheld(rows, "1995-06-30")
    return applied.select("o_orderkey", F.lit(False).alias("withheld")).unionByName(late.select("o_orderkey", F.lit(True).alias("withheld")))


def named_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(key % 11 > 0, F.col("o_orderdate")).alias("accepted_at"), F.col("o_custkey").alias("issuer_id"), (F.col("o_custkey") + F.when(key % 5 == 0, 1).otherwise(0)).alias("filing_issuer"),
        F.date_add(day, (key % 40 - 30).cast("int")).alias("period_end"), F.when(key % 3 > 0, F.date_add(day, (key % 40 - 20).cast("int"))).alias("next_period_end"),
    )
    return G.named_filing_refusal(rows, "1997-06-30").select("o_orderkey", "refusal")


def listing_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + (F.col("event_id") % 13 - 4) * 3600)
    which = F.when(F.col("event_id") % 3 == 0, "utc").when(F.col("event_id") % 3 == 1, "eastern")
    return table(spark, sf_dir, "events").select("event_id", G.visible(F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp"))), at, which).alias("visible"))


def page_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    pages = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cik"), F.year("o_orderdate").alias("page")).agg(F.min(day).alias("first_on"), F.date_add(F.max(day), F.lit(60)).alias("last_on"))
    return G.page_shifts(pages).select("cik", "page")


def set_join_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda year: table(spark, sf_dir, "orders").where(F.year("o_orderdate") == year).select("o_custkey").distinct()
    both, misses = G.joined_with_misses(of(1995), of(1996), ["o_custkey"])
    return misses.select("o_custkey", "side").unionByName(both.select("o_custkey", F.lit("matched").alias("side")))


def log_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a document's transitions, an error as its failure, and what is wrong with the history."""
    kind = F.col("event_type")
    state = F.when(kind == "signup", "expected").when(kind == "view", "acquired").when(kind == "click", "parsed").when(kind == "purchase", "completed").otherwise("failed")
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("document_id"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_id").alias("sequence"), F.col("ts").alias("recorded_at"), state.alias("to_state"),
        F.lit(None).cast("string").alias("missing_reason"), F.when(kind == "error", "broken").alias("failure_reason"), F.when(F.col("event_id") % 2 == 0, "o").alias("override_id"),
    )
    log = ST.ordered(log).withColumn("from_state", F.when(F.col("sequence") % 17 > 0, F.lag("to_state").over(ST.history()))).drop("run_started")
    return ST.checked(log).groupBy("to_state", "problem").agg(F.count("*").alias("n"))


def log_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user by runs of a day, and the last purchase known by then."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_id").alias("sequence"), F.col("ts").alias("recorded_at"), F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("purchase_id"))
    return ST.current(ST.carried(log, "purchase_id").drop("run_started")).select("document_id", "sequence", "purchase_id")


def exhibit_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("sequence")).agg(F.max(F.col("l_returnflag") == "R").alias("named"), F.max(F.col("l_linestatus") == "O").alias("described"), F.max(F.col("l_quantity") > 35).alias("confirmed"))
    tries = S.exhibit_order(rows).select(F.col("accession").alias("document_id"), "order", F.col("sequence").alias("exhibit"), "confirmed")
    return ST.attempts(tries).select(F.col("document_id").alias("accession"), F.col("chosen").cast("long").alias("chosen"), F.size("attempts").cast("long").alias("n_attempts"))


def resume_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _lines(spark, sf_dir).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ST.not_done(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(day.alias("as_of"), F.date_add(day, (F.col("o_custkey") % 90).cast("int")).alias("published_on"), F.col("o_orderkey").alias("evidence_id"))
    return I.latest_snapshots(rows, "1997-01-01").select(F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "evidence_id")


def quarters_uncorroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters in which a customer has orders but none published in time by another than the user."""
    o = table(spark, sf_dir, "orders")
    calendar = o.select(D.quarter(F.col("o_orderdate")).alias("quarter")).distinct()
    rows = o.select(F.to_date("o_orderdate").alias("as_of"), F.date_add("o_orderdate", 400).alias("published_on"), F.when(F.col("o_orderstatus") == "P", "index").otherwise("user").alias("source"))
    return I.uncorroborated_quarters(calendar, rows, "1997-01-01")


def identities_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("security_id"), F.col("event_type").alias("name"), F.concat(F.lit("T"), F.col("event_id") % 2).alias("ticker"), F.to_date("ts").alias("published_on"))
    shown = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["name"], x["ticker"]))).alias(c)
    return N.stated_identities(rows, "2024-01-10").select("security_id", shown("stated"), shown("timely"))


def assertion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    assertions = e.where("event_type in ('signup', 'error')").select(F.col("user_id").alias("security_id"), "event_id", (F.to_date("ts") > F.lit("2024-01-20").cast("date")).alias("withheld"))
    broken = e.where("user_id % 7 = 0").select(F.col("user_id").alias("security_id"))
    issuers = e.where("user_id % 5 <> 0").select(F.col("user_id").alias("security_id"), (F.col("user_id") % 40).alias("issuer_id")).distinct()
    return N.assertion_status(assertions, broken, issuers).select("event_id", "status")


def roster_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who viewed on a day against those who clicked (a check) or bought."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("user_id").alias("member"), "event_type")
    snapshots = e.where("event_type in ('click', 'purchase')").select(F.col("day").alias("as_of"), F.col("event_type").alias("source"), "member")
    out = N.snapshot_disagreements(e.where("event_type = 'view'").select("day", "member"), snapshots, ["click"])
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "source", F.concat_ws(",", F.col("roster_only").cast("array<string>")).alias("roster_only"), F.concat_ws(",", F.col("snapshot_only").cast("array<string>")).alias("snapshot_only"), "blocking")


def replayed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("request_hash"), F.col("c_mktsegment").alias("reply"))
    return U.replayed(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("request_hash")), replies).select("o_orderkey", "reply", "problem")


def coverage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as expected events, their orders as processed documents and their cheap orders as acquisitions."""
    o, none = table(spark, sf_dir, "orders"), F.array().cast("array<string>")
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), F.when(F.col("c_acctbal") > 0, "eligible").otherwise("ambiguous").alias("eligibility_status"))
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "completed-no-theme").otherwise("partial")
    done = o.where("o_custkey % 4 <> 1").select(
        F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("doc_id"), state.alias("processing_state"), (F.col("o_totalprice") > 3000).alias("observable"), (F.col("o_orderkey") % 97 == 0).alias("conflict"),
        (F.col("o_orderkey") % 3 == 0).alias("representative"), F.when(F.col("o_orderstatus") == "P", F.array(F.lit("open"))).otherwise(none).alias("reasons"), F.lit(1).alias("accepted"),
    )
    got = o.where("o_custkey % 6 <> 1 and o_totalprice < 100000").select(F.col("o_custkey").alias("event_id"), F.when(F.col("o_orderkey") % 50 == 0, "failed").when(F.col("o_orderkey") % 50 == 1, "restricted").otherwise("acquired").alias("state"), F.when(F.col("o_orderkey") % 50 > 1, F.col("o_orderkey")).alias("doc_id"), F.when(F.col("o_orderkey") % 50 < 2, "why").alias("reason"))
    return U.coverage_rows(expected, done, got).select("event_id", "latest_state", "available", "parsed", "observable", "availability", F.col("accepted_count").cast("long").alias("accepted_count"), F.concat_ws(",", "missing_reasons").alias("missing_reasons"))


def review_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.element_at(F.array(*[F.lit(x) for x in ("accepted", "edited", "rejected", "added")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    return G.review_shares(_lines(spark, sf_dir).select("l_returnflag", origin.alias("origin")), "l_returnflag")


def retention_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _lines(spark, sf_dir).groupBy("l_orderkey", "l_linestatus").agg(F.collect_list("l_linenumber").alias("offered"), F.collect_list(F.when(F.col("l_returnflag") != "R", F.col("l_linenumber"))).alias("kept"))
    return G.retention(per, "l_linestatus")


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as the targets of one run."""
    t = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "refused").otherwise("done").alias("status"), F.when(F.col("event_id") % 19 == 0, "malformed_reply").alias("failure"))
    odd = t.withColumn("failure", F.when(F.col("status") == "refused", "strange").otherwise(F.col("failure")))
    named = lambda df, name: G.run_state(df).withColumn("run", F.lit(name))
    return named(t, "counted").unionByName(named(odd, "strange")).unionByName(named(t.where("status = 'done' and failure is null"), "whole"))


def extraction_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _lines(spark, sf_dir).select(F.lit(1).alias("requests"), (F.col("l_returnflag") == "R").cast("int").alias("cache_hits"), F.when(F.col("l_linenumber") > 2, F.col("l_partkey")).alias("prompt_tokens"), F.col("l_suppkey").alias("completion_tokens"))
    return X.accounting(w)


def extraction_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents that state how many lines (windows) and parts (units) they have."""
    li, key = _lines(spark, sf_dir), F.col("l_orderkey").alias("doc_id")
    stated = li.groupBy(key).agg(F.count("*").alias("windows"), F.count_if(F.col("l_returnflag") == "R").alias("windows_failed"), F.count_distinct("l_partkey").alias("units")).where("doc_id % 23 <> 4")
    stated = stated.withColumns({"windows": F.col("windows") + (F.col("doc_id") % 10 == 0).cast("int"), "units": F.col("units") - (F.col("doc_id") % 15 == 0).cast("int")})
    return X.run_problems(stated, li.select(key, F.when(F.col("l_returnflag") == "R", "failed").otherwise("ok").alias("outcome")), li.select(key, F.col("l_partkey").alias("element_id")))


def support_run_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as targets, whose trials, signals and usage are spread over their lines."""
    li, key = _lines(spark, sf_dir), F.col("l_orderkey").alias("target_id")
    targets = li.groupBy(key).agg(F.collect_list(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber"))).alias("evidence_ids"))
    signals = li.select(key, F.when(F.col("l_linestatus") == "O", "quote").otherwise("joint").alias("scope"))
    trials = X.trial_panel(targets.where("target_id % 5 <> 2").select("target_id")).where("not (target_id % 7 = 3 and family = 'b')")
    usage = li.select(key, F.col("l_quantity").alias("reserved_tokens"), (F.col("l_tax") > 0.07).alias("unreported"), F.when(F.col("l_discount") > 0.05, 1).alias("actual_prompt_tokens"))
    return G.support_problems(targets, signals, trials, usage, 120)


def fact_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("accession"), F.year("l_shipdate").alias("fy"), F.when(F.col("l_tax") < 0.08, F.concat(F.lit("Q"), F.quarter("l_shipdate"))).alias("fp"))
    return C.fiscal_labels(facts)


def ticker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per nation whose running numbers are its customers."""
    entry = F.struct(F.col("c_custkey").alias("cik_str"), F.concat(F.lit("t"), "c_custkey").alias("ticker"), F.col("c_name").alias("title"))
    packed = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), entry)))).alias("payload"))
    return C.ticker_map(packed, "payload")


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as filing index pages and read again."""
    html = F.format_string(
        "<div id='f'><strong>Form %s</strong></div><div class='i'>Accepted</div><div class='t'> %s </div><div class='i'>Items</div>\n<div>Item %s</div><table><tr><th>Seq</th></tr><tr><td>1</td><td><a href='x'>Doc</a></td><td>d%s.htm</td><td>8-K</td></tr><tr><td>short</td></tr></table>",
        "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_custkey", "o_orderkey",
    )
    out = C.filing_index(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("accession"), html.alias("html")))
    return out.select("accession", "form", "accepted", "items", F.size("documents").cast("long").alias("n_documents"), F.array_join(F.col("documents")[0], "|").alias("document"))


def strict_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event payloads, some with a field more or of a wrong type, that pass a strict reader."""
    k = F.get_json_object("props", "$.k")
    payload = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"k": '), k, F.lit(', "more": 1}'))).when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"k": "x'), k, F.lit('"}'))).when(F.col("event_id") % 5 == 2, F.lit("{}")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", C.strict(payload, "struct<k:int>", ["k"])["k"].cast("long").alias("k"))


def listing_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("at"))
    wall = F.when(F.col("event_id") % 3 == 0, F.col("at")).when(F.col("event_id") % 3 == 1, F.from_utc_timestamp("at", "America/New_York")).when(F.col("event_id") % 9 == 2, F.col("at") + F.expr("interval 1 minute"))
    rows = e.select(F.col("event_id").alias("accession"), F.date_format(wall, "yyyy-MM-dd HH:mm:ss").alias("listed_at"))
    return R.convention_check(rows, e.select(F.col("event_id").alias("accession"), F.col("at").alias("accepted_at"))).select("accession", "convention")


def theme_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as claims with all regions as the probe set."""
    themes = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("theme_id"), F.col("r_name").alias("label"), F.lower("r_name").alias("definition"))
    out = X.probes(table(spark, sf_dir, "supplier").select("s_suppkey"), themes)
    return out.select("s_suppkey", F.size("themes").cast("long").alias("n_themes"), F.array_join(F.transform("themes", lambda t: F.concat_ws("=", t["label"], t["definition"])), ",").alias("themes"))


def citation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").where("o_orderkey % 8 <> 1").select(F.col("o_orderkey").alias("artifact_sha256"), F.col("o_orderstatus").alias("canonical_sha256"))
    citations = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("artifact_sha256"), F.col("l_linestatus").alias("canonical_sha256"))
    return O.cited(citations, stored).groupBy("artifact_sha256", "status").agg(F.count("*").alias("n"))


def newest_retrievals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderdate").alias("retrieved_at"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_sha256"))
    return O.newest(rows).select("url", "content_sha256")


def stored_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").where("o_orderkey % 6 <> 5").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").cast("binary").alias("content"))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.sha2(F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise(F.col("o_orderpriority")), 256).alias("content_sha256"))
    return O.verified(files, wanted).select("path", "status")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("theme_id"), F.concat(F.lit("R"), "n_regionkey").alias("parent_id"))
    return n.unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("theme_id"), F.lit("world").alias("parent_id"))).unionByName(spark.createDataFrame([("world", None)], "theme_id string, parent_id string"))


def theme_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.roots(_tree(spark, sf_dir))


def theme_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers choose their nation, and some its region or the whole, for claims of their segment."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    theme = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("R"), "n_regionkey")).when(F.col("c_custkey") % 50 == 1, "world").otherwise(F.concat(F.lit("N"), "n_nationkey"))
    return P.hierarchy_conflicts(c.select((F.col("c_custkey") % 60).alias("claim_id"), theme.alias("theme_id")), _tree(spark, sf_dir))


def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(T.paragraphs(F.concat(F.lit("# Head\n\n"), F.regexp_replace("text", r"\. ", ".\n \n")))).cast("long").alias("n_paragraphs"), T.scale_phrases(F.concat("text", F.lit(" Two million and 3 billions."))).cast("long").alias("n_scales"))


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    opening = F.concat(F.element_at(F.array(F.lit("Acme Reports fourth quarter"), F.lit("Acme announced a dividend. Its"), F.lit("Acme plans")), (F.col("o_orderkey") % 3 + 1).cast("int")), F.when(F.col("o_custkey") % 2 == 0, " results").otherwise(" meeting"))
    whole = F.concat(opening, F.lit(" for the quarter ended "), F.date_format("o_orderdate", "MMMM d, yyyy"))
    day = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 2).cast("int"))
    return o.select("o_orderkey", T.announces_results(opening).alias("announces"), R.confirmed(opening, whole, day, F.lit("Q4")).alias("confirmed"))


def quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" & "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", T.fragment_url(F.concat(F.lit("https://example.org/p?i="), "p_partkey", F.when(F.col("p_partkey") % 2 == 0, "#old").otherwise("")), name).alias("url"))


def row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free fingerprints of each order's parts, and a hash over parts of which one may be missing."""
    parts = _lines(spark, sf_dir).groupBy("l_orderkey").agg(H.fingerprint(F.collect_set(F.struct("l_partkey"))).alias("fingerprint"), F.min("l_shipdate").alias("first"))
    return parts.select("l_orderkey", "fingerprint", H.joined_hash(F.col("l_orderkey"), F.when(F.col("l_orderkey") % 3 > 0, F.date_format("first", "yyyy-MM-dd"))).alias("hash"))


def withheld_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("withheld"))
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("withheld"))
    return G.withheld_inventory(("orders", o), ("events", e))


def fixture_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.max(F.when(F.col("l_tax") > 0.06, "fixture")).alias("policy_scope"), F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))).alias("eligible_quotes"))
    return G.fixture_votes(rows).select("l_orderkey", "policy_vote", F.concat_ws(",", "policy_quotes").alias("policy_quotes"))


def span_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle third of each text of three characters or more."""
    n = F.length("text")
    return table(spark, sf_dir, "documents").where(n >= 3).select("doc_id", F.sha2(Z.sliced(F.col("text"), F.floor(n / 3).cast("int"), F.floor(n * 2 / 3).cast("int")), 256).alias("hash"))


def section_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as blocks: every fourth one a heading, some of a boilerplate section, every seventh a table."""
    t, n = table(spark, sf_dir, "conversations"), F.col("turn") + F.col("conv_id")
    kind = F.when(F.col("turn") % 4 == 0, "heading").when(n % 7 == 0, "table").when(n % 5 == 0, "page_artifact").otherwise("paragraph")
    text = F.when(n % 3 == 0, "Safe Harbor").when(n % 8 == 1, "Non-GAAP measures").when(n % 11 == 0, "All are trademarks of others").otherwise(F.col("text"))
    rows = t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), kind.alias("type"), text.alias("text"))
    return L.boilerplate_masks(rows).select("doc_id", "position", "type", "category")


QUERIES = {
    f.__name__: f
    for f in (
        home_element, masked_spans, narrative_elements, element_set_problems, observation_projection, audit_rights, pointer_spans, chunk_offsets, cutoff_withheld, named_filings, listing_visibility, page_shift,
        set_join_misses, log_problems, log_current, exhibit_attempts, resume_work, snapshot_latest, quarters_uncorroborated, identities_stated, assertion_states, roster_snapshots, replayed_requests, coverage_states,
        review_share, retention_pairs, run_states, extraction_accounts, extraction_problems, support_run_problems, fact_labels, ticker_rows, index_pages, strict_payloads, listing_conventions, theme_probes, citation_states,
        newest_retrievals, stored_states, theme_roots, theme_conflicts, paragraph_counts, announcements, quote_links, row_hashes, withheld_rows, fixture_policy, span_slices, section_masks,
    )
}

_S = "s AS (SELECT o_custkey AS doc_id, o_orderkey AS id, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS a, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + CAST(floor(o_totalprice / 2000) AS BIGINT) + 1 AS b, o_orderstatus AS type FROM orders)"
_LOG = "e AS (SELECT *, CAST(ts AS DATE) AS run, min(ts) OVER (PARTITION BY CAST(ts AS DATE)) AS began FROM events)"
_TREE = "tree AS (SELECT 'N' || n_nationkey AS t, 'R' || n_regionkey AS up FROM nation UNION ALL SELECT 'R' || r_regionkey, 'world' FROM region)"
_ABOVE = _TREE + ", above AS (SELECT t, up FROM tree UNION SELECT x.t, y.up FROM tree x JOIN tree y ON y.t = x.up)"

ORACLE_SQL = {
    "home_element": f"""WITH {_S}, p AS (SELECT x.id, y.id AS home, row_number() OVER (PARTITION BY x.id ORDER BY y.b - y.a, CASE y.type WHEN 'F' THEN 0 ELSE 1 END, y.id) AS r
  FROM s x JOIN s y ON y.doc_id = x.doc_id AND y.type <> 'P' AND y.a <= x.a AND x.a + 1 <= y.b WHERE x.type = 'P') SELECT s.id, p.home AS home_id FROM s LEFT JOIN p ON p.id = s.id AND p.r = 1 WHERE s.type = 'P'""",
    "masked_spans": f"WITH {_S} SELECT x.id, coalesce(string_agg('m' || y.id, ',' ORDER BY 'm' || y.id), '') AS mask_ids FROM s x LEFT JOIN s y ON y.doc_id = x.doc_id AND y.type = 'P' AND x.a < y.b AND y.a < x.b WHERE x.type = 'F' GROUP BY x.id",
    "narrative_elements": f"WITH {_S} SELECT id AS element_id, type FROM s x WHERE type <> 'P' AND NOT EXISTS (SELECT 1 FROM s y WHERE y.type = 'P' AND y.doc_id = x.doc_id AND x.a < y.b AND y.a < x.b)",
    "element_set_problems": f"""WITH {_S}, e AS (SELECT s.*, c.c_custkey AS known, CASE WHEN id % 7 = 0 THEN 'odd' ELSE type || '-' || a || '-' || b END AS name FROM s LEFT JOIN customer c ON c.c_custkey = s.doc_id AND c.c_custkey % 10 <> 3),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, name) AS same FROM e),
f AS (SELECT doc_id, 'wrong_document' AS problem FROM n WHERE known IS NULL UNION ALL SELECT doc_id, 'element_id' FROM n WHERE name = 'odd' UNION ALL SELECT doc_id, 'out_of_bounds' FROM n WHERE known IS NOT NULL AND b > 2500
  UNION ALL SELECT doc_id, 'duplicate' FROM n WHERE same > 1 UNION ALL SELECT doc_id, 'unknown_parent' FROM n WHERE id % 11 = 0) SELECT doc_id, problem, count(*) AS n FROM f GROUP BY ALL""",
    "observation_projection": """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS quote_id, l_returnflag AS theme_id FROM lineitem), q AS (SELECT doc_id, quote_id, max(theme_id) = 'R' AS masked FROM l GROUP BY ALL)
SELECT sha256(a.doc_id || '|' || a.quote_id || '|' || a.theme_id) AS observation_id, a.doc_id, a.quote_id, a.theme_id, c_nationkey AS entity_id, NOT q.masked AND o_orderkey % 2 = 0 AND o_orderstatus <> 'P' AS headline_eligible
FROM (SELECT DISTINCT * FROM l) a JOIN q USING (doc_id, quote_id) JOIN orders ON o_orderkey = a.doc_id JOIN customer ON c_custkey = o_custkey""",
    "audit_rights": "SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN o_orderpriority END AS o_orderpriority FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "pointer_spans": """WITH p AS (SELECT o_custkey AS a, o_custkey + 40 AS b, CASE WHEN l_linenumber > 1 THEN CAST(trunc(l_quantity) AS INTEGER) - 10 ELSE 0 END AS s, CAST(trunc(l_quantity) AS INTEGER) + l_linenumber AS e FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 13 <> 5),
r AS (SELECT *, CASE WHEN a IS NULL THEN 'unknown_element' WHEN s < 0 OR e > 40 OR e <= s THEN 'outside_element' ELSE 'ok' END AS outcome FROM p)
SELECT outcome, count(*) AS n, CAST(sum(CASE WHEN outcome = 'ok' THEN a + s END) AS BIGINT) AS starts, CAST(sum(CASE WHEN outcome = 'ok' THEN a + e END) AS BIGINT) AS ends FROM r GROUP BY 1""",
    "chunk_offsets": """WITH p AS (SELECT l_orderkey, l_partkey AS c, l_linenumber - 2 AS s, l_linenumber - 2 + CAST(trunc(l_quantity) AS INTEGER) AS e FROM lineitem)
SELECT l_orderkey, CASE WHEN s < 0 OR e > 40 OR e <= s THEN 'outside_chunk' END AS reason, count(*) AS n, CAST(sum(c + s) AS BIGINT) AS starts, CAST(sum(c + e) AS BIGINT) AS ends FROM p GROUP BY ALL""",
    "cutoff_withheld": "SELECT o_orderkey, o_orderkey % 9 > 0 AND CAST(o_orderdate AS DATE) > DATE '1995-06-30' AS withheld FROM orders",
    "named_filings": """WITH r AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 11 = 0 THEN 'unknown_filing' WHEN k % 5 = 0 THEN 'other_issuer' WHEN k % 40 >= 30 OR (k % 3 > 0 AND k % 40 < 20) THEN 'outside_period' WHEN d > DATE '1997-06-30' THEN 'after_cutoff' END AS refusal FROM r""",
    "listing_visibility": """WITH e AS (SELECT event_id, date_trunc('second', ts) AS f, date_trunc('second', ts) + INTERVAL 1 HOUR * (event_id % 13 - 4) AS seen FROM events),
v AS (SELECT event_id, f <= seen AS u, (f AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' <= seen AS n FROM e) SELECT event_id, CASE event_id % 3 WHEN 0 THEN u WHEN 1 THEN n ELSE CASE WHEN u = n THEN u END END AS visible FROM v""",
    "page_shift": """WITH p AS (SELECT o_custkey AS cik, year(o_orderdate) AS page, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) + 60 AS b FROM orders GROUP BY ALL)
SELECT cik, CAST(page AS INTEGER) AS page FROM (SELECT *, lead(a) OVER (PARTITION BY cik ORDER BY a, page) AS newer FROM p) WHERE b >= newer""",
    "set_join_misses": """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1995), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'left_only' WHEN a.o_custkey IS NULL THEN 'right_only' ELSE 'matched' END AS side FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""",
    "log_problems": f"""WITH {_LOG}, t AS (SELECT *, CASE event_type WHEN 'signup' THEN 'expected' WHEN 'view' THEN 'acquired' WHEN 'click' THEN 'parsed' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS st FROM e),
l AS (SELECT *, lag(st) OVER (PARTITION BY user_id ORDER BY began, run, event_id) AS last FROM t), f AS (SELECT *, CASE WHEN event_id % 17 > 0 THEN last END AS fr FROM l)
SELECT st AS to_state, CASE WHEN fr IS DISTINCT FROM last THEN 'broken_chain'
  WHEN NOT (coalesce(fr, '') || '>' || st IN ('>expected', 'expected>acquired', 'acquired>parsed', 'acquired>failed', 'parsed>completed', 'parsed>failed') OR (event_id % 2 = 0 AND coalesce(fr, '') || '>' || st = 'failed>acquired')) THEN 'illegal_transition'
  WHEN st = 'expected' THEN 'missing_reason' END AS problem, count(*) AS n FROM f GROUP BY ALL""",
    "log_current": f"""WITH {_LOG}, c AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS purchase_id, row_number() OVER (PARTITION BY user_id ORDER BY began DESC, run DESC, event_id DESC) AS r
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY began, run, event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id AS document_id, event_id AS sequence, purchase_id FROM c WHERE r = 1""",
    "exhibit_attempts": """WITH x AS (SELECT l_orderkey, l_linenumber, max(l_returnflag = 'R') AS named, max(l_linestatus = 'O') AS described, max(l_quantity > 35) AS ok FROM lineitem GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN named THEN 0 WHEN described THEN 1 ELSE 2 END, l_linenumber) AS n FROM x), f AS (SELECT l_orderkey, min(n) FILTER (ok) AS hit, count(*) AS every FROM o GROUP BY 1)
SELECT f.l_orderkey AS accession, CAST(o.l_linenumber AS BIGINT) AS chosen, coalesce(hit, every) AS n_attempts FROM f LEFT JOIN o ON o.l_orderkey = f.l_orderkey AND o.n = f.hit""",
    "resume_work": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "snapshot_latest": """WITH r AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_custkey % 90 AS INTEGER) AS p, o_orderkey AS k FROM orders)
SELECT strftime(d, '%Y-%m-%d') AS as_of, k AS evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY p DESC, k) AS n FROM r WHERE p <= DATE '1997-01-01') WHERE n = 1""",
    "quarters_uncorroborated": """WITH q AS (SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, CAST(o_orderdate AS DATE) + 400 <= DATE '1997-01-01' AND o_orderstatus = 'P' AS timely FROM orders)
SELECT quarter FROM q GROUP BY 1 HAVING NOT bool_or(timely)""",
    "identities_stated": """WITH i AS (SELECT user_id, event_type || ':T' || event_id % 2 AS x, CAST(ts AS DATE) <= DATE '2024-01-10' AS t FROM events)
SELECT user_id AS security_id, string_agg(DISTINCT x, ',' ORDER BY x) AS stated, coalesce(string_agg(DISTINCT x, ',' ORDER BY x) FILTER (t), '') AS timely FROM i GROUP BY 1""",
    "assertion_states": "SELECT event_id, CASE WHEN CAST(ts AS DATE) > DATE '2024-01-20' THEN 'withheld' WHEN user_id % 7 = 0 THEN 'broken' WHEN user_id % 5 = 0 THEN 'no_issuer' ELSE 'applied' END AS status FROM events WHERE event_type IN ('signup', 'error')",
    "roster_snapshots": """WITH e AS (SELECT DISTINCT CAST(ts AS DATE) AS d, user_id AS u, event_type AS k FROM events), r AS (SELECT d, u FROM e WHERE k = 'view'), s AS (SELECT d, k, u FROM e WHERE k IN ('click', 'purchase')),
b AS (SELECT coalesce(a.d, s.d) AS d, coalesce(a.k, s.k) AS k, coalesce(a.u, s.u) AS u, s.u IS NULL AS ro, a.u IS NULL AS so FROM (SELECT x.d, x.k, r.u FROM (SELECT DISTINCT d, k FROM s) x JOIN r USING (d)) a FULL JOIN s ON s.d = a.d AND s.k = a.k AND s.u = a.u)
SELECT strftime(d, '%Y-%m-%d') AS day, k AS source, coalesce(string_agg(u::VARCHAR, ',' ORDER BY u) FILTER (ro), '') AS roster_only, coalesce(string_agg(u::VARCHAR, ',' ORDER BY u) FILTER (so), '') AS snapshot_only, k <> 'click' AS blocking FROM b GROUP BY d, k HAVING bool_or(ro OR so)""",
    "replayed_requests": "SELECT o_orderkey, c_mktsegment AS reply, CASE WHEN c_custkey IS NULL THEN 'replay_miss' END AS problem FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0",
    "coverage_states": """WITH c AS (SELECT o_custkey AS k, min(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END) AS worst, count(*) FILTER (o_orderkey % 3 = 0) AS reps, bool_and(o_totalprice > 3000) AS obs, bool_or(o_orderkey % 97 = 0) AS conflict, bool_or(o_orderstatus = 'P') AS open
  FROM orders WHERE o_custkey % 4 <> 1 GROUP BY 1),
a AS (SELECT o_custkey AS k, bool_or(o_orderkey % 50 = 0) AS failed, bool_or(o_orderkey % 50 = 1) AS blocked, bool_or(o_orderkey % 50 > 1) AS acquired, bool_and(o_orderkey % 50 > 1) AS parsed, max(CASE o_orderkey % 50 WHEN 0 THEN 'failed' WHEN 1 THEN 'restricted' ELSE 'acquired' END) AS st
  FROM orders WHERE o_custkey % 6 <> 1 AND o_totalprice < 100000 GROUP BY 1),
r AS (SELECT c_custkey, c_acctbal > 0 AS el, c.*, a.*, CASE WHEN a.failed THEN 'failed' ELSE coalesce(['partial', 'completed', 'completed-no-theme'][c.worst], a.st, 'expected') END AS latest, coalesce(a.acquired, false) OR c.worst IS NOT NULL AS av FROM customer LEFT JOIN c ON c.k = c_custkey LEFT JOIN a ON a.k = c_custkey)
SELECT c_custkey AS event_id, latest AS latest_state, av AS available, coalesce(parsed, false) AS parsed, coalesce(parsed AND reps > 0 AND obs AND NOT conflict AND latest IN ('completed', 'completed-no-theme') AND el AND NOT coalesce(blocked, false), false) AS observable,
  CASE WHEN av THEN 'available' WHEN blocked THEN 'restricted' ELSE 'not_yet_checked' END AS availability, coalesce(reps, 0) AS accepted_count,
  array_to_string(list_filter([CASE WHEN open THEN 'open' END, CASE WHEN failed OR blocked THEN 'why' END, CASE WHEN worst IS NULL AND st IS NULL THEN 'not_processed' END, CASE WHEN conflict THEN 'copy_processing_conflict' END, CASE WHEN NOT el THEN 'not_eligible' END], lambda x: x IS NOT NULL), ',') AS missing_reasons FROM r""",
    "review_share": """WITH t AS (SELECT l_returnflag, count(*) FILTER (l_partkey % 4 = 0) AS accepted, count(*) FILTER (l_partkey % 4 = 1) AS edited, count(*) FILTER (l_partkey % 4 = 2) AS rejected, count(*) FILTER (l_partkey % 4 = 3) AS added FROM lineitem GROUP BY 1)
SELECT *, edited / nullif(accepted + edited + rejected, 0) AS edited_share, rejected / nullif(accepted + edited + rejected, 0) AS rejected_share, added / nullif(accepted + edited + added, 0) AS added_share FROM t""",
    "retention_pairs": "SELECT l_linestatus, count(*) FILTER (l_returnflag <> 'R') AS kept, count(*) AS offered FROM lineitem GROUP BY 1",
    "run_states": """WITH t AS (SELECT event_type = 'error' AS refused, event_id % 19 = 0 AS bad FROM events), c AS (SELECT count(*) FILTER (refused OR bad) AS n, count(*) FILTER (refused) AS odd FROM t)
SELECT 'counted' AS run, n = 0 AS complete, true AS processed, n AS n_open FROM c UNION ALL SELECT 'strange', n = 0, odd = 0, n FROM c UNION ALL SELECT 'whole', true, true, 0 FROM c""",
    "extraction_accounts": "SELECT count(*) AS requests, count(*) FILTER (l_returnflag = 'R') AS cache_hits, CAST(coalesce(sum(l_partkey) FILTER (l_linenumber > 2), 0) AS BIGINT) AS prompt_tokens, CAST(sum(l_suppkey) AS BIGINT) AS completion_tokens, count(*) FILTER (l_linenumber <= 2) AS unreported FROM lineitem",
    "extraction_problems": """WITH p AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_partkey) AS u FROM lineitem GROUP BY 1)
SELECT k AS doc_id, 'unknown_document' AS problem FROM p WHERE k % 23 = 4 UNION ALL SELECT k, 'window_count' FROM p WHERE k % 23 <> 4 AND k % 10 = 0 UNION ALL SELECT k, 'unit_count' FROM p WHERE k % 23 <> 4 AND k % 15 = 0 UNION ALL SELECT k, 'repeated_visit' FROM p WHERE n <> u""",
    "support_run_problems": """WITH p AS (SELECT l_orderkey AS k, count(*) FILTER (l_linestatus <> 'O') AS joint, sum(l_quantity) AS q, count(*) FILTER (l_tax > 0.07 AND l_discount > 0.05) AS odd FROM lineitem GROUP BY 1)
SELECT k AS target_id, 'signal_slots' AS problem FROM p WHERE joint <> 1 UNION ALL SELECT k, 'trial_panel' FROM p WHERE k % 5 = 2 OR k % 7 = 3 UNION ALL SELECT k, 'usage_accounting' FROM p WHERE odd > 0 UNION ALL SELECT k, 'over_ceiling' FROM p WHERE q > 120""",
    "fact_labels": """WITH f AS (SELECT l_orderkey AS k, CAST(year(l_shipdate) AS INTEGER) AS fy, CASE WHEN l_tax < 0.08 THEN 'Q' || quarter(l_shipdate) END AS fp FROM lineitem), g AS (SELECT k, count(DISTINCT fy) = 1 AND count(DISTINCT fp) = 1 AND count(*) FILTER (fp IS NULL) = 0 AS sure, max(fy) AS fy, max(fp) AS fp FROM f GROUP BY 1)
SELECT k AS accession, CASE WHEN sure THEN fy END AS fiscal_year, CASE WHEN sure THEN fp END AS fiscal_period FROM g""",
    "ticker_rows": "SELECT c_custkey AS cik, 'T' || c_custkey AS ticker, c_name AS name FROM customer",
    "index_pages": "SELECT o_orderkey AS accession, o_orderstatus AS form, strftime(o_orderdate, '%Y-%m-%d') AS accepted, 'Item ' || o_custkey AS items, 1 AS n_documents, '1|Doc|d' || o_orderkey || '.htm|8-K' AS document FROM orders",
    "strict_payloads": "SELECT event_id, CASE WHEN event_id % 5 > 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events",
    "listing_conventions": "SELECT event_id AS accession, CASE WHEN event_id % 3 = 0 THEN 'utc' WHEN event_id % 3 = 1 THEN 'eastern' WHEN event_id % 9 = 2 THEN 'neither' END AS convention FROM events",
    "theme_probes": "SELECT s_suppkey, (SELECT count(*) FROM region) AS n_themes, (SELECT string_agg(r_name || '=' || lower(r_name), ',' ORDER BY r_regionkey) FROM region) AS themes FROM supplier",
    "citation_states": "SELECT l_orderkey AS artifact_sha256, CASE WHEN o_orderkey IS NULL THEN 'missing_artifact' WHEN o_orderstatus <> l_linestatus THEN 'hash_mismatch' ELSE 'verified' END AS status, count(*) AS n FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 8 <> 1 GROUP BY ALL",
    "newest_retrievals": "SELECT o_custkey AS url, sha256(o_orderkey::VARCHAR) AS content_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, sha256(o_orderkey::VARCHAR)) AS n FROM orders) WHERE n = 1",
    "stored_states": "SELECT o_orderkey AS path, CASE WHEN o_orderkey % 6 = 5 THEN 'missing' WHEN o_orderkey % 4 = 0 THEN 'quarantined' ELSE 'ok' END AS status FROM orders",
    "theme_roots": f"WITH {_TREE} SELECT t AS theme_id, 'world' AS level_one FROM tree UNION ALL SELECT 'world', 'world'",
    "theme_conflicts": f"""WITH {_ABOVE}, ch AS (SELECT DISTINCT c_custkey % 60 AS claim_id, CASE WHEN c_custkey % 3 = 0 THEN 'R' || n_regionkey WHEN c_custkey % 50 = 1 THEN 'world' ELSE 'N' || n_nationkey END AS t FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT x.claim_id, above.up AS ancestor, x.t AS theme_id FROM ch x JOIN above ON above.t = x.t JOIN ch y ON y.claim_id = x.claim_id AND y.t = above.up""",
    "paragraph_counts": r"""WITH d AS (SELECT doc_id, text, '# Head' || chr(10) || chr(10) || regexp_replace(text, '\. ', '.' || chr(10) || ' ' || chr(10), 'g') AS m FROM documents)
SELECT doc_id, len(list_filter(regexp_split_to_array(m, '\n\s*\n'), lambda p: trim(p) <> '')) AS n_paragraphs, len(regexp_extract_all(lower(text || ' Two million and 3 billions.'), '\b(?:thousand|million|billion)s?\b')) AS n_scales FROM d""",
    "announcements": """SELECT o_orderkey, o_orderkey % 3 = 0 AND o_custkey % 2 = 0 AS announces, o_orderkey % 3 = 0 AND o_custkey % 2 = 0 AS confirmed FROM orders""",
    "quote_links": "SELECT p_partkey, 'https://example.org/p?i=' || p_partkey || '#:~:text=' || replace(replace(p_name || ' & ' || p_type, '&', '%26'), ' ', '%20') AS url FROM part",
    "row_hashes": """WITH p AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS k, strftime(min(l_shipdate), '%Y-%m-%d') AS d FROM lineitem GROUP BY 1)
SELECT l_orderkey, sha256('[' || array_to_string(list_transform(k, lambda x: '{"l_partkey":' || x || '}'), ',') || ']') AS fingerprint, sha256(l_orderkey || chr(31) || CASE WHEN l_orderkey % 3 > 0 THEN d ELSE chr(0) END) AS hash FROM p""",
    "withheld_rows": "SELECT 'orders' AS \"table\", o_orderkey::VARCHAR AS id FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'events', event_id::VARCHAR FROM events WHERE event_type = 'error'",
    "fixture_policy": """WITH p AS (SELECT l_orderkey, bool_or(l_tax > 0.06) AS f, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN f THEN 'accepted' ELSE 'refused' END AS policy_vote, CASE WHEN f THEN q ELSE '' END AS policy_quotes FROM p""",
    "span_slices": "SELECT doc_id, sha256(substr(text, length(text) // 3 + 1, length(text) * 2 // 3 - length(text) // 3)) AS hash FROM documents WHERE length(text) >= 3",
    "section_masks": """WITH b AS (SELECT conv_id, turn, turn + conv_id AS n, text FROM conversations),
k AS (SELECT *, CASE WHEN turn % 4 = 0 THEN 'heading' WHEN n % 7 = 0 THEN 'table' WHEN n % 5 = 0 THEN 'page_artifact' ELSE 'paragraph' END AS type, CASE WHEN n % 3 = 0 THEN 1 WHEN n % 8 = 1 THEN 2 WHEN n % 11 = 0 THEN 3 ELSE 0 END AS what FROM b),
o AS (SELECT *, CASE WHEN type = 'heading' AND what = 1 THEN 'safe_harbor' WHEN type = 'heading' AND what = 2 THEN 'non_gaap_disclaimer' WHEN type IN ('heading', 'table') THEN '' END AS opened FROM k),
h AS (SELECT *, nullif(last_value(opened IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '') AS held FROM o), c AS (SELECT *, coalesce(held, CASE WHEN what = 3 THEN 'repeated_legal' END) AS category FROM h)
SELECT conv_id AS doc_id, turn AS position, type, category FROM c WHERE type IN ('heading', 'paragraph') AND category IS NOT NULL""",
}

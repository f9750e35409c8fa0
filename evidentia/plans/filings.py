"""Queries on release candidates, names, locators and extraction replay.

Orders stand for reports of a customer, events for the filings of the customer with the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.functions import locators as K, text as T
from evidentia.operators import extraction as X, identity as N, release as R
from evidentia.session import ship, table


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int"))
    reports = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("issuer_id"), day.alias("period_end"), F.col("o_orderdate").alias("filed_at"), F.col("o_orderkey").alias("accession"), F.lit(False).alias("amended"))
    return R.slots(reports).withColumn("event_id", F.col("accession"))


def release_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).select("issuer_id", "event_id", F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), F.date_format("next_period_end", "yyyy-MM-dd").alias("next_period_end"))


def release_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    filings = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("issuer_id"), F.col("event_id").alias("accession"), F.col("ts").alias("accepted_at"))
    return R.candidates(_slots(spark, sf_dir), filings, "2024-01-25").select("event_id", "accession", F.date_format("accepted_on", "yyyy-MM-dd").alias("accepted_on"))


def release_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = release_candidates(spark, sf_dir).select("event_id", "accession", F.when(F.col("accession") % 3 == 0, "preliminary").alias("dropped"), (F.col("accession") % 2 == 0).alias("matched"))
    return R.identified(rows).select("event_id", "release_accession", "identification_method", "reason")


def doubly_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(F.col("l_partkey").alias("accession"), F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("issuer_id"))
    return R.doubly_claimed(lines)


def token_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short part types against full part names and types, by words through the rarest word."""
    part = table(spark, sf_dir, "part")
    left = part.select("p_partkey", T.name_tokens(F.concat_ws(" ", "p_name", "p_type"), fold=False).alias("tokens"))
    right = part.select(F.col("p_type").alias("type_id"), T.name_tokens(F.col("p_type"), fold=False).alias("tokens")).distinct()
    return N.token_candidates(left, right, "p_partkey", "type_id").groupBy("type_id").agg(F.count("*").alias("n"))


def registrant_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    securities = s.select(F.col("s_suppkey").alias("security_id"), F.concat(F.lit("T"), F.col("s_suppkey") % 90).alias("ticker"), F.col("s_name").alias("name"))
    tickers = s.where("s_suppkey % 90 <> 7").select(F.concat(F.lit("T"), "s_suppkey").alias("ticker"), F.col("s_suppkey").alias("cik"))
    registrants = s.select(F.col("s_suppkey").alias("cik"), F.array(F.concat(F.lit("T"), F.when(F.col("s_suppkey") % 10 == 3, F.lit("x")).otherwise(F.col("s_suppkey").cast("string")))).alias("tickers"), F.array("s_name").alias("names"))
    return N.confirmed_registrants(securities, tickers, registrants).select("security_id", "cik", "reason")


def locator_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How six characters at each document's beginning and middle resolve with one character of context on each side."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(F.lit(0), F.floor(F.length("text") / 2).cast("int"))).alias("place"))
    p, x, s = F.when(F.col("place") > 0, F.substring("text", F.col("place"), F.lit(1))).otherwise(""), F.substring("text", F.col("place") + 1, F.lit(6)), F.substring("text", F.col("place") + 7, F.lit(1))
    return d.select("doc_id", "place", K.resolution(F.col("text"), p, x, s).alias("reason"), K.resolved_start(F.col("text"), p, x, s).cast("long").alias("start"))


def minimal_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least context of five characters in each document's middle, and that it resolves; a text without any has its reason."""
    ship(spark)
    d = table(spark, sf_dir, "documents").withColumn("at", F.coalesce(F.floor(F.length("text") / 2).cast("int"), F.lit(0)))
    d = d.withColumn("l", K.locators("text", "at", F.least(F.col("at") + 5, F.coalesce(F.length("text"), F.lit(0)))))
    back = K.resolved_start(F.col("text"), F.col("l.prefix"), F.col("l.exact"), F.col("l.suffix"))
    return d.select("doc_id", "at", "l.prefix", "l.exact", "l.suffix", "l.reason", F.when(F.col("l.exact").isNotNull(), back).cast("long").alias("start"))


def extraction_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of turns: windows, requests, scripted replies, refusals and claims, as counts by outcome."""
    ship(spark)
    turns = table(spark, sf_dir, "conversations").where("text is not null and text <> ''")
    from evidentia.operators.layout import laid_out

    laid = laid_out(turns, "conv_id", "turn").select(F.col("conv_id").alias("doc_id"), "start", "end", F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("type"), "text", F.col("turn").alias("position"))
    documents = laid.groupBy("doc_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"])).alias("canonical_text"))
    unit_rows = X.units(laid.withColumn("element_id", F.concat_ws("-", "type", "start", "end")))
    requests = X.rendered(X.windows(unit_rows, 800), documents, "List the claims.")
    candidates, problems = X.parsed(requests, X.completed(requests, _scripted))
    judged = X.refusals(candidates)
    claims, quotes = X.claims_and_quotes(judged, unit_rows)
    counts = judged.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))
    more = problems.groupBy(F.col("problem").alias("outcome")).agg(F.count("*").alias("n"))
    return counts.unionByName(more).unionByName(claims.agg(F.lit("claims").alias("outcome"), F.count("*").alias("n"))).unionByName(quotes.agg(F.lit("quotes").alias("outcome"), F.count("*").alias("n")))


def _scripted(prompt: str) -> str | None:
    """A stand-in model: claims the first unit, cites an unknown one for long prompts and breaks on some."""
    import json

    if len(prompt) % 7 == 0:
        return "not json"
    if len(prompt) % 11 == 0:
        return None
    labels = ["U1", "U99"] if len(prompt) % 5 == 0 else ["U1"]
    return json.dumps({"claims": [{"claim": prompt.split("] ", 1)[1][:40], "labels": labels}]})


QUERIES = {f.__name__: f for f in (release_slots, release_candidates, release_outcomes, doubly_claimed, token_join, registrant_resolution, locator_resolution, minimal_locators, extraction_replay)}

_SLOTS = """r AS (SELECT o_custkey AS issuer_id, DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS period_end, o_orderdate AS filed_at, o_orderkey AS event_id FROM orders),
s AS (SELECT issuer_id, event_id, CAST(period_end AS DATE) AS period_end, CAST(lead(period_end) OVER (PARTITION BY issuer_id ORDER BY period_end) AS DATE) AS nxt FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id, period_end ORDER BY filed_at, event_id) AS n FROM r) WHERE n = 1)"""
_CANDIDATES = _SLOTS + """, f AS (SELECT user_id AS issuer_id, event_id AS accession, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase'),
c AS (SELECT s.event_id, f.accession, f.d FROM s JOIN f ON f.issuer_id = s.issuer_id AND f.d > s.period_end AND f.d <= coalesce(s.nxt, DATE '2024-01-25'))"""

ORACLE_SQL = {
    "release_slots": f"WITH {_SLOTS} SELECT issuer_id, event_id, strftime(period_end, '%Y-%m-%d') AS period_end, strftime(nxt, '%Y-%m-%d') AS next_period_end FROM s",
    "release_candidates": f"WITH {_CANDIDATES} SELECT event_id, accession, strftime(d, '%Y-%m-%d') AS accepted_on FROM c",
    "release_outcomes": f"""WITH {_CANDIDATES}, k AS (SELECT event_id, count(*) FILTER (accession % 3 <> 0) AS n, max(accession) FILTER (accession % 3 <> 0) AS a, bool_or(accession % 3 <> 0 AND accession % 2 = 0) AS m FROM c GROUP BY 1)
SELECT event_id, CASE WHEN n = 1 THEN a END AS release_accession, CASE WHEN n = 1 AND m THEN 'stated_period' WHEN n = 1 THEN 'sole_candidate' END AS identification_method, CASE WHEN n = 0 THEN 'no_release' WHEN n > 1 THEN 'several_releases' END AS reason FROM k""",
    "doubly_claimed": "SELECT l_partkey AS accession, count(DISTINCT l_orderkey) AS n_events, count(DISTINCT l_suppkey) AS n_issuers, CASE WHEN count(DISTINCT l_suppkey) > 1 THEN 'across_issuers' ELSE 'within_issuer' END AS kind FROM lineitem WHERE l_quantity >= 48 GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1",
    "token_join": """WITH l AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+') AS k FROM part), r AS (SELECT DISTINCT p_type, regexp_extract_all(lower(p_type), '[a-z0-9]+') AS k FROM part)
SELECT p_type AS type_id, count(*) AS n FROM l JOIN r ON list_has_all(l.k, r.k) AND len(r.k) > 0 GROUP BY 1""",
    "registrant_resolution": """SELECT s.s_suppkey AS security_id, CASE WHEN t.s_suppkey IS NOT NULL AND t.s_suppkey % 10 <> 3 AND t.s_suppkey = s.s_suppkey THEN t.s_suppkey END AS cik,
  CASE WHEN t.s_suppkey IS NULL THEN 'unknown_ticker' WHEN t.s_suppkey % 10 <> 3 AND t.s_suppkey = s.s_suppkey THEN NULL ELSE 'unconfirmed' END AS reason
FROM supplier s LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 90 <> 7) t ON t.s_suppkey = s.s_suppkey % 90""",
    "locator_resolution": """WITH q AS (SELECT doc_id, text, unnest([0, CAST(floor(length(text) / 2) AS INTEGER)]) AS place FROM documents),
x AS (SELECT *, CASE WHEN place > 0 THEN substr(text, place, 1) ELSE '' END || substr(text, place + 1, 7) AS w FROM q), n AS (SELECT *, len(list_filter(range(0, length(text) - length(w) + 1), lambda i: substr(text, i + 1, length(w)) = w)) AS k FROM x)
SELECT doc_id, place, CASE WHEN text IS NULL OR substr(text, place + 1, 6) = '' THEN 'malformed_record' WHEN k > 1 THEN 'ambiguous_occurrence' WHEN k = 0 THEN 'not_found' END AS reason,
  CASE WHEN substr(text, place + 1, 6) <> '' AND k = 1 THEN instr(text, w) - 1 + CASE WHEN place > 0 THEN 1 ELSE 0 END END AS start FROM n""",
}

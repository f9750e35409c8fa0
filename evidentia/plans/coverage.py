"""Queries on coverage, prevalence, contracts and reconciliation over the order tables.

Issuers are customers, periods are quarters of order dates, an order is observable unless it is
pending, and its priority is the theme.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.functions.dates import quarter_end
from evidentia.operators import contracts as C, prevalence as P
from evidentia.session import table


def none():
    """An empty array of strings."""
    return F.array().cast("array<string>")


def order_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as coverage rows."""
    observable = F.col("o_orderstatus") != "P"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("entity_id"), quarter_end(F.to_date("o_orderdate")).alias("period_end"),
        F.lit("order").alias("doc_type"), F.lit("all").alias("speaker_role"), F.lit("eligible").alias("eligibility_status"),
        (F.col("o_orderstatus") != "P").alias("available"), (F.col("o_orderstatus") != "P").alias("parsed"), observable.alias("observable"),
        F.when(observable, none()).otherwise(F.array(F.lit("pending"))).alias("missing_reasons"), "o_orderpriority",
    )


def observations(coverage: DataFrame, theme: str) -> DataFrame:
    return coverage.select("event_id", "doc_type", "speaker_role", F.col(theme).alias("theme_id"), F.lit(True).alias("headline_eligible"), none().alias("mask_ids"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        "view_kind", "view_id", "unit", F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), F.round("numerator", 6).alias("numerator"), "denominator", F.round("rate", 6).alias("rate"), "reason",
        "expected_count", "available_count", "parsed_count", "observable_count", "excluded_count", "missing_period_count", F.concat_ws(",", "restrictions").alias("restrictions"),
    )


def prevalence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    coverage = order_coverage(spark, sf_dir)
    themes = coverage.select(F.col("o_orderpriority").alias("theme_id")).distinct()
    views = themes.select(F.lit("direct").alias("view_kind"), F.col("theme_id").alias("view_id"), "theme_id")
    return _shown(P.prevalence(coverage, observations(coverage, "o_orderpriority"), views))


_UNITS = """
WITH cov AS (
  SELECT o_orderkey AS event_id, o_custkey AS e,
    CAST(last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS p, o_orderstatus <> 'P' AS ok, {theme} AS theme_id
  FROM orders {joins}
), views AS ({views}), kinds AS (SELECT DISTINCT view_kind, view_id FROM views),
obs AS (SELECT DISTINCT e, p FROM cov WHERE ok),
pos AS (SELECT DISTINCT view_kind, view_id, e, p FROM cov JOIN views USING (theme_id) WHERE ok),
units AS (SELECT e, p, bool_or(ok) AS ok FROM cov GROUP BY e, p),
aud AS (SELECT p, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM units GROUP BY GROUPING SETS ((p), ())),
restr AS (SELECT p, string_agg(DISTINCT CASE WHEN NOT ok THEN 'pending' END, ',') AS r FROM cov GROUP BY GROUPING SETS ((p), ())),
per AS (SELECT e, count(*) AS n FROM obs GROUP BY e),
hits AS (SELECT view_kind, view_id, e, count(*) AS h FROM pos GROUP BY ALL),
totals AS (
  SELECT view_kind, view_id, CAST(count(h.e) AS DOUBLE) AS issuer_window, CAST(coalesce(sum(h), 0) AS DOUBLE) AS firm_quarter, coalesce(sum(h / n), 0.0) AS equal_issuer_mean
  FROM kinds LEFT JOIN hits h USING (view_kind, view_id) LEFT JOIN per ON per.e = h.e GROUP BY ALL
), rows AS (
  SELECT view_kind, view_id, 'issuer_period' AS unit, p, (SELECT CAST(count(*) AS DOUBLE) FROM pos WHERE pos.view_kind = kinds.view_kind AND pos.view_id = kinds.view_id AND pos.p = q.p) AS numerator, (SELECT count(*) FROM obs WHERE obs.p = q.p) AS denominator
  FROM (SELECT DISTINCT p FROM cov) q, kinds
  UNION ALL SELECT view_kind, view_id, 'issuer_window', NULL, issuer_window, (SELECT count(*) FROM per) FROM totals
  UNION ALL SELECT view_kind, view_id, 'firm_quarter', NULL, firm_quarter, (SELECT count(*) FROM obs) FROM totals
  UNION ALL SELECT view_kind, view_id, 'equal_issuer_mean', NULL, equal_issuer_mean, (SELECT count(*) FROM per) FROM totals
)
SELECT view_kind, view_id, unit, strftime(rows.p, '%Y-%m-%d') AS period_end, round(numerator, 6) AS numerator, denominator,
  round(numerator / nullif(denominator, 0), 6) AS rate, CASE WHEN denominator = 0 THEN 'empty_denominator' END AS reason,
  n AS expected_count, n_ok AS available_count, n_ok AS parsed_count, n_ok AS observable_count, n - n_ok AS excluded_count, n - n_ok AS missing_period_count, coalesce(r, '') AS restrictions
FROM rows JOIN aud ON aud.p IS NOT DISTINCT FROM rows.p JOIN restr ON restr.p IS NOT DISTINCT FROM rows.p"""


def prevalence_parent_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    coverage = order_coverage(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("n"), "c_nationkey").alias("nation"))
    held = coverage.join(customers, "entity_id")
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("theme_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    tree = nations.unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("theme_id"), F.lit(None).cast("string").alias("parent_id")))
    views = P.views_of(tree).where("view_kind = 'parent'")
    return _shown(P.prevalence(held, observations(held, "nation"), views)).drop("restrictions")


def coverage_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer by every quarter of 1996, whatever was ordered, with what is missing."""
    slots = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id")).withColumn("period", F.explode(F.array(*[F.lit(f"1996Q{q}") for q in (1, 2, 3, 4)])))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("period"), "o_orderstatus")
    held = orders.groupBy("entity_id", "period").agg(F.count("*").alias("n_events"), F.count_if(F.col("o_orderstatus") != "P").alias("n_observable"), F.array_sort(F.collect_set("o_orderstatus")).alias("states"))
    out = slots.join(held, ["entity_id", "period"], "left")
    reason = F.when(F.col("n_events").isNull(), "not_processed").when(F.col("n_observable") == 0, "pending")
    return out.select("entity_id", "period", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("n_observable", F.lit(0)).alias("n_observable"), F.concat_ws(",", "states").alias("states"), reason.alias("missing_reason"))


def fk_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of cheap lines that are not among the large parts."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity < 3")
    parts = table(spark, sf_dir, "part").where("p_size > 25")
    return C.foreign_key_violations(lines, parts, ["l_partkey"], ["p_partkey"])


def grain_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.grain_violations(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


def single_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bindings(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


def reconcile_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    snapshot = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    return C.reconcile(roster, snapshot, ["k"]).groupBy("side").agg(F.count("*").alias("n"))


def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    planned = lines.where("l_linenumber <= 3").select("l_returnflag", "l_linestatus")
    done = lines.where("l_linenumber >= 3").select("l_returnflag", "l_linestatus")
    return C.multiset_difference(planned, done)


def draft_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.operators.support import drafts_compared

    part = table(spark, sf_dir, "part")
    draft = part.where("p_size <= 30").select("p_partkey", F.col("p_type").alias("content"))
    working = part.where("p_size >= 20").select("p_partkey", F.when(F.col("p_retailprice") > 1400, F.upper("p_type")).otherwise(F.col("p_type")).alias("content"))
    return drafts_compared(draft, working, "p_partkey", "content").groupBy("origin").agg(F.count("*").alias("n"))


def overrides_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    findings = s.select(F.col("s_suppkey").alias("finding_id"), F.sha2(F.col("s_nationkey").cast("string"), 256).alias("digest"))
    overrides = s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("finding_id"), F.sha2(F.when(F.col("s_suppkey") % 3 == 0, F.lit("0")).otherwise(F.col("s_nationkey").cast("string")), 256).alias("digest"), F.col("s_name").alias("override_id"))
    return C.overrides_applied(findings, overrides).select("finding_id", "status")


QUERIES = {f.__name__: f for f in (prevalence_units, prevalence_parent_view, coverage_spine, fk_anti, grain_dups, single_binding, reconcile_full_outer, multiset_diff, draft_compare, overrides_by_digest)}

ORACLE_SQL = {
    "prevalence_units": _UNITS.format(theme="o_orderpriority", joins="", views="SELECT DISTINCT 'direct' AS view_kind, o_orderpriority AS view_id, o_orderpriority AS theme_id FROM orders"),
    "prevalence_parent_view": _UNITS.format(
        theme="'n' || c_nationkey", joins="JOIN customer ON c_custkey = o_custkey",
        views="SELECT 'parent' AS view_kind, 'r' || n_regionkey AS view_id, 'n' || n_nationkey AS theme_id FROM nation",
    ).replace("n - n_ok AS missing_period_count, coalesce(r, '') AS restrictions", "n - n_ok AS missing_period_count"),
    "coverage_spine": """
SELECT c_custkey AS entity_id, period, coalesce(n_events, 0) AS n_events, coalesce(n_observable, 0) AS n_observable, coalesce(states, '') AS states,
  CASE WHEN n_events IS NULL THEN 'not_processed' WHEN n_observable = 0 THEN 'pending' END AS missing_reason
FROM customer CROSS JOIN (VALUES ('1996Q1'), ('1996Q2'), ('1996Q3'), ('1996Q4')) v(period)
LEFT JOIN (
  SELECT o_custkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period, count(*) AS n_events, count(*) FILTER (o_orderstatus <> 'P') AS n_observable,
    string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states FROM orders GROUP BY ALL
) o ON o.o_custkey = c_custkey AND o.period = v.period""".replace("SELECT c_custkey AS entity_id, period", "SELECT c_custkey AS entity_id, v.period"),
    "fk_anti": "SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity < 3 AND NOT EXISTS (SELECT 1 FROM part WHERE p_size > 25 AND p_partkey = l_partkey)",
    "grain_dups": "SELECT l_partkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "single_binding": "SELECT count(*) AS n_bindings, count(*) <= 1 AS single FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)",
    "reconcile_full_outer": """
SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'matched' END AS side, count(*) AS n
FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000) b ON a.k = b.k GROUP BY 1""",
    "multiset_diff": """
SELECT l_returnflag, l_linestatus, CASE WHEN a > b THEN 'left' ELSE 'right' END AS side, abs(a - b) AS surplus FROM (
  SELECT l_returnflag, l_linestatus, count(*) FILTER (l_linenumber <= 3) AS a, count(*) FILTER (l_linenumber >= 3) AS b FROM lineitem GROUP BY ALL) WHERE a <> b""",
    "draft_compare": """
WITH d AS (SELECT p_partkey, p_type AS c FROM part WHERE p_size <= 30), w AS (SELECT p_partkey, CASE WHEN p_retailprice > 1400 THEN upper(p_type) ELSE p_type END AS c FROM part WHERE p_size >= 20)
SELECT CASE WHEN d.p_partkey IS NULL THEN 'added' WHEN w.p_partkey IS NULL THEN 'rejected' WHEN d.c = w.c THEN 'accepted' ELSE 'edited' END AS origin, count(*) AS n
FROM d FULL JOIN w ON d.p_partkey = w.p_partkey GROUP BY 1""",
    "overrides_by_digest": """
SELECT s_suppkey AS finding_id, CASE WHEN s_acctbal <= 0 THEN 'open' WHEN s_suppkey % 3 <> 0 OR s_nationkey = 0 THEN 'acknowledged' ELSE 'stale' END AS status FROM supplier""",
}

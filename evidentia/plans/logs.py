"""Queries on membership intervals, as-of joins, state logs, periods and eligibility.

A user's `signup` adds, an `error` removes; the log of a user's events is its state history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evidentia.functions.dates import quarter, quarter_end
from evidentia.operators import intervals as I, selection as S, support as U
from evidentia.operators import spans as X
from evidentia.session import table


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type in ('signup', 'error')")
    return I.day_actions(e.select("user_id", F.to_date("ts").alias("day"), F.when(F.col("event_type") == "signup", "added").otherwise("removed").alias("action")), "user_id", "day")


def _spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.alternating(_days(spark, sf_dir), "user_id", "day")


def _day(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def interval_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spells(spark, sf_dir).select("user_id", _day("valid_from"), _day("valid_to"))


def interval_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.reconstruct(_days(spark, sf_dir), "user_id", "day")
    return out.select("user_id", _day("valid_from"), _day("valid_to"), "reason")


def roster_at_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.sql("select explode(array(date'2024-01-05', date'2024-01-15', date'2024-01-25')) as day")
    return I.members_at(_spells(spark, sf_dir), days, "user_id").select(_day("day"), "user_id")


def member_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.member_counts(_spells(spark, sf_dir)).select(_day("day"), "members")


def issuer_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _spells(spark, sf_dir).withColumn("issuer_id", F.col("user_id") % 40)
    return I.transitions(groups).select("issuer_id", "kind", _day("effective_on"))


def state_history_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the one before it; a repeat of the same type breaks the chain."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.lag("event_type").over(order).alias("from_state"))
    problem = F.when(F.col("from_state").isNull(), "first").when(F.col("from_state") == F.col("event_type"), "repeated")
    return rows.select("user_id", "event_id", "from_state", F.col("event_type").alias("to_state"), problem.alias("problem")).where("problem is not null")


def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last.alias("l"), F.count("*").alias("n_events")).select("user_id", F.col("l.event_id").alias("event_id"), F.col("l.event_type").alias("state"), "n_events")


def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.operators.states import state_counts as counts

    return counts(current_state(spark, sf_dir).withColumnRenamed("state", "to_state"), ["click", "error", "purchase", "signup", "view", "withdrawn"])


def carried_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the user's last purchase before it."""
    over = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(over)
    return table(spark, sf_dir, "events").withColumn("purchase_id", held).where("event_type = 'error'").select("event_id", "purchase_id")


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), quarter_end(F.to_date("o_orderdate")).alias("period_end")).distinct()


def period_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.period_gaps(_periods(spark, sf_dir)).select("entity_id", _day("period_end"), _day("next_period_end"), F.col("gap_days").cast("long").alias("gap_days"))


def edge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.edge_gaps(_periods(spark, sf_dir), "1992-01-01", "1998-12-31").select("entity_id", "kind", _day("first_period"), _day("last_period"))


def next_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = Window.partitionBy("entity_id").orderBy("period_end")
    return _periods(spark, sf_dir).withColumn("next_period_end", F.lead("period_end").over(over)).select("entity_id", _day("period_end"), _day("next_period_end"))


def eligibility_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders judged by window, releases, cutoff and the Eastern day's membership of the user with the customer's number."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderpriority", "o_orderstatus")
    shifted = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 613, F.lit(30 * 86400)))
    orders = orders.withColumn("at", shifted)
    spells = _spells(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.struct("valid_from", "valid_to")).alias("spells"))
    # exists() is three-valued: null where no interval holds and one of them is open about the time.
    member = F.exists("spells", lambda s: I.in_interval(F.col("at"), s["valid_from"], F.lit("before_open"), s["valid_to"], F.lit("before_open")))
    events = orders.join(spells, "user_id", "left").withColumn("member", F.when(F.col("spells").isNull(), F.lit(False)).otherwise(member))
    releases = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 2).otherwise(1)
    events = events.withColumns({"period_end": F.to_date("o_orderdate"), "n_releases": releases, "published_at": F.when(F.col("o_orderstatus") == "P", F.lit("2030-01-01").cast("timestamp")).otherwise(F.col("at"))})
    return I.eligibility(events, ("1993-01-01", "1997-12-31"), "2029-01-01").select("o_orderkey", "eligibility_status", "eligibility_reason")


def asof_member_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signup with the user's first purchase at or after it, if that is before the next error."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    signups = I.nearest(e.where("event_type = 'signup'").drop("event_type"), e.where("event_type = 'error'").drop("event_type"), "user_id", "ts", "ts", "event_id")
    signups = signups.select("user_id", "event_id", "ts", F.col("nearest_at").alias("until"))
    found = I.nearest(signups, e.where("event_type = 'purchase'").drop("event_type"), "user_id", "ts", "ts", "event_id", "until")
    return found.select("event_id", F.col("nearest_id").alias("purchase_id"))


def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the nearest error or signup of its user, an error first where both are as near."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    left = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), "ts")
    right = e.where("event_type in ('error', 'signup')").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("other_ts"), "event_type")
    return I.nearest_either(left, right, "user_id", "ts", "other_ts", "id", "event_type", "error").select("purchase_id", "nearest_id", "distance_us")


def issuer_time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("issuer_id"), F.to_date("o_orderdate").alias("period_end")).withColumn("quarter", quarter(F.col("period_end")))
    out = S.home_partition(events, [("train", "1992Q1", "1994Q4"), ("dev", "1995Q1", "1995Q4"), ("test", "1996Q1", "1997Q4")])
    return out.select("event_id", F.col("partition").alias("part"), "excluded_reason")


def quarter_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(quarter(F.col("o_orderdate")).alias("quarter")).agg(F.count("*").alias("n"))


def eastern_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_format(I.eastern(F.col("ts")), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def budget_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("cost", F.ceil(F.coalesce("value", F.lit(0.0))).cast("long")).withColumn("day", F.to_date("ts"))
    out = U.budget_audit(e, ["ts", "event_id"], {"per_day": (["user_id", "day"], 40), "per_user": (["user_id"], 600)}, "cost")
    return out.select("event_id", "per_day_used", "per_user_used", "over_ceiling")


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged length of each customer's spans of order days, a span lasting as long as its price is high."""
    return X.covered(_order_spans(spark, sf_dir), ["o_custkey"]).withColumn("covered", F.col("covered").cast("long"))


def _order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", start.alias("start"), (start + F.floor(F.col("o_totalprice") / 2000) + 1).alias("end"), "o_orderstatus")


def char_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _order_spans(spark, sf_dir)
    out = X.jaccard(s.where("o_orderstatus = 'F'"), s.where("o_orderstatus = 'O'"), ["o_custkey"])
    return out.select("o_custkey", F.col("common").cast("long").alias("common"), F.col("joint").cast("long").alias("joint"), F.round("jaccard", 6).alias("jaccard"))


def crossing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.crossings(_order_spans(spark, sf_dir), ["o_custkey"], name="o_orderkey").select("o_custkey", "a_id", "b_id")


def pairwise_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of the users of each pair of event types on a day."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "user_id").distinct()
    sets = e.groupBy("day", "event_type").agg(F.collect_set("user_id").alias("users"))
    pairs = sets.alias("a").join(sets.alias("b"), (F.col("a.day") == F.col("b.day")) & (F.col("a.event_type") < F.col("b.event_type")))
    j = F.try_divide(F.size(F.array_intersect("a.users", "b.users")).cast("double"), F.size(F.array_union("a.users", "b.users")).cast("double"))
    return pairs.groupBy(F.col("a.event_type").alias("type_a"), F.col("b.event_type").alias("type_b")).agg(F.count("*").alias("n_days"), F.round(F.avg(j), 6).alias("jaccard"))


def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "struct<k:int>")["k"])
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("least"), F.max("k").alias("most"))


def columnar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one payload of parallel arrays per user, and back to rows."""
    from evidentia.sources.columns import columnar

    rows = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    packed = table(spark, sf_dir, "events").groupBy("user_id").agg(rows.alias("r")).select("user_id", F.to_json(F.struct(F.transform("r", lambda x: x["event_id"]).alias("id"), F.transform("r", lambda x: x["event_type"]).alias("kind"))).alias("payload"))
    return columnar(packed, "payload", {"id": "bigint", "kind": "string"}).select("user_id", F.col("position").cast("long").alias("position"), "id", "kind")


QUERIES = {
    f.__name__: f
    for f in (
        interval_reconstruct, interval_breaks, roster_at_day, member_counts, issuer_transitions, state_history_check, current_state, state_counts, carried_forward, period_gaps, edge_gaps, next_period,
        eligibility_cascade, asof_member_side, asof_nearest, issuer_time_split, quarter_label, eastern_days, budget_audit, interval_merge, char_jaccard, crossing_pairs, pairwise_jaccard, json_columns, columnar_json,
    )
}

_DAYS = """days AS (
  SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN count(DISTINCT event_type) > 1 THEN 'ambiguous' WHEN min(event_type) = 'signup' THEN 'added' ELSE 'removed' END AS action
  FROM events WHERE event_type IN ('signup', 'error') GROUP BY ALL)"""
_SPELLS = _DAYS + """, clear AS (SELECT *, coalesce(lag(action) OVER w, 'removed') AS last FROM days WHERE action <> 'ambiguous' WINDOW w AS (PARTITION BY user_id ORDER BY day)),
turns AS (SELECT *, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS valid_to FROM clear WHERE action <> last),
spells AS (SELECT user_id, day AS valid_from, valid_to FROM turns WHERE action = 'added')"""
_ISO = "strftime({0}, '%Y-%m-%d') AS {0}"
_PERIODS = "periods AS (SELECT DISTINCT o_custkey AS entity_id, CAST(last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS period_end FROM orders)"
_ORDER_SPANS = "s AS (SELECT o_custkey, o_orderkey, o_orderstatus, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS a, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + CAST(floor(o_totalprice / 2000) AS BIGINT) + 1 AS b FROM orders)"


def _covered(name: str, where: str) -> str:
    return f"""{name} AS (SELECT o_custkey, CAST(sum(b - a) AS BIGINT) AS n FROM (SELECT o_custkey, i, min(a) AS a, max(b) AS b FROM (
  SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM (
    SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s WHERE {where})) GROUP BY ALL) GROUP BY o_custkey)"""


_F, _O, _EITHER = "o_orderstatus = 'F'", "o_orderstatus = 'O'", "o_orderstatus IN ('F', 'O')"

ORACLE_SQL = {
    "interval_reconstruct": f"WITH {_SPELLS} SELECT user_id, {_ISO.format('valid_from')}, {_ISO.format('valid_to')} FROM spells",
    "interval_breaks": f"""WITH {_DAYS}, m AS (SELECT *, lag(action) OVER w AS last, lead(day) OVER w AS nd, lead(action) OVER w AS na FROM days WINDOW w AS (PARTITION BY user_id ORDER BY day)),
f AS (SELECT *, CASE WHEN action = 'ambiguous' THEN 2 WHEN action = 'added' AND last = 'added' THEN 1 WHEN action = 'removed' AND coalesce(last, 'removed') = 'removed' THEN 1 END AS fault FROM m),
b AS (SELECT user_id, max(fault) AS worst FROM f GROUP BY 1)
SELECT user_id, strftime(day, '%Y-%m-%d') AS valid_from, strftime(CASE WHEN na = 'removed' THEN nd END, '%Y-%m-%d') AS valid_to, NULL AS reason FROM f JOIN b USING (user_id) WHERE worst IS NULL AND action = 'added'
UNION ALL SELECT user_id, NULL, NULL, CASE worst WHEN 2 THEN 'ambiguous' ELSE 'conflicting' END FROM b WHERE worst IS NOT NULL""",
    "roster_at_day": f"WITH {_SPELLS} SELECT DISTINCT strftime(d, '%Y-%m-%d') AS day, user_id FROM spells, (VALUES (DATE '2024-01-05'), (DATE '2024-01-15'), (DATE '2024-01-25')) v(d) WHERE valid_from <= d AND (valid_to IS NULL OR d < valid_to)",
    "member_counts": f"WITH {_SPELLS}, st AS (SELECT valid_from AS day, 1 AS step FROM spells UNION ALL SELECT valid_to, -1 FROM spells WHERE valid_to IS NOT NULL) SELECT strftime(day, '%Y-%m-%d') AS day, CAST(sum(sum(step)) OVER (ORDER BY st.day) AS BIGINT) AS members FROM st GROUP BY st.day",
    "issuer_transitions": f"""WITH {_SPELLS}, g AS (SELECT user_id % 40 AS issuer_id, valid_from AS a, coalesce(valid_to, DATE '9999-12-31') AS b FROM spells),
n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY issuer_id ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM g),
i AS (SELECT *, sum(new) OVER (PARTITION BY issuer_id ORDER BY a, b DESC ROWS UNBOUNDED PRECEDING) AS k FROM n), w AS (SELECT issuer_id, k, min(a) AS a, max(b) AS b FROM i GROUP BY ALL)
SELECT issuer_id, 'entry' AS kind, strftime(a, '%Y-%m-%d') AS effective_on FROM w UNION ALL SELECT issuer_id, 'exit', strftime(b, '%Y-%m-%d') FROM w WHERE b < DATE '9999-12-31'""",
    "state_history_check": "SELECT user_id, event_id, from_state, to_state, CASE WHEN from_state IS NULL THEN 'first' ELSE 'repeated' END AS problem FROM (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events) WHERE from_state IS NULL OR from_state = to_state",
    "current_state": "SELECT user_id, event_id, event_type AS state, n_events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n_events FROM events) WHERE r = 1",
    "state_counts": "SELECT s AS to_state, count(event_type) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('withdrawn')) v(s) LEFT JOIN (SELECT event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1) e ON e.event_type = v.s GROUP BY s",
    "carried_forward": "SELECT event_id, purchase_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS purchase_id FROM events) WHERE event_type = 'error'",
    "period_gaps": f"WITH {_PERIODS}, n AS (SELECT entity_id, period_end AS p, lead(period_end) OVER (PARTITION BY entity_id ORDER BY period_end) AS q FROM periods) SELECT entity_id, strftime(p, '%Y-%m-%d') AS period_end, strftime(q, '%Y-%m-%d') AS next_period_end, date_diff('day', p, q) AS gap_days FROM n WHERE date_diff('day', p, q) > 105",
    "edge_gaps": f"""WITH {_PERIODS}, e AS (SELECT entity_id, min(period_end) AS a, max(period_end) AS b FROM periods GROUP BY 1)
SELECT entity_id, 'first_edge' AS kind, strftime(a, '%Y-%m-%d') AS first_period, strftime(b, '%Y-%m-%d') AS last_period FROM e WHERE date_diff('day', DATE '1992-01-01', a) >= 92
UNION ALL SELECT entity_id, 'last_edge', strftime(a, '%Y-%m-%d'), strftime(b, '%Y-%m-%d') FROM e WHERE date_diff('day', b, DATE '1998-12-31') > 91""",
    "next_period": f"WITH {_PERIODS} SELECT entity_id, strftime(period_end, '%Y-%m-%d') AS period_end, strftime(lead(period_end) OVER (PARTITION BY entity_id ORDER BY periods.period_end), '%Y-%m-%d') AS next_period_end FROM periods",
    "eligibility_cascade": f"""WITH {_SPELLS},
o AS (SELECT o_orderkey, o_custkey AS user_id, o_orderdate, o_orderpriority, o_orderstatus, to_timestamp(1704067200 + (epoch(o_orderdate)::BIGINT + o_orderkey * 613) % 2592000) AT TIME ZONE 'UTC' AS tm FROM orders),
l AS (SELECT o.*, spells.valid_from AS a, spells.valid_to AS b, (tm AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS e FROM o LEFT JOIN spells USING (user_id)),
t AS (SELECT *, CASE WHEN CAST(e AS DATE) < a THEN false WHEN CAST(e AS DATE) > a OR hour(e) * 60 + minute(e) >= 570 THEN true END AS entered,
  CASE WHEN b IS NULL OR CAST(e AS DATE) < b THEN true WHEN CAST(e AS DATE) > b OR hour(e) * 60 + minute(e) >= 570 THEN false END AS staying FROM l),
m AS (SELECT o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, CASE WHEN bool_or(a IS NOT NULL AND entered AND staying) THEN true WHEN bool_or(a IS NOT NULL AND (entered AND staying) IS NULL) THEN NULL ELSE false END AS member FROM t GROUP BY ALL),
r AS (SELECT *, CASE WHEN CAST(o_orderdate AS DATE) NOT BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' THEN 'outside_window' WHEN o_orderpriority LIKE '1%' THEN 'no_release' WHEN o_orderpriority LIKE '2%' THEN 'several_releases'
  WHEN o_orderstatus = 'P' THEN 'after_cutoff' WHEN member IS NULL THEN 'membership_unordered' WHEN NOT member THEN 'not_a_member' END AS reason FROM m)
SELECT o_orderkey, CASE WHEN reason IS NULL THEN 'eligible' WHEN reason IN ('no_release', 'several_releases', 'membership_unordered') THEN 'ambiguous' ELSE 'ineligible' END AS eligibility_status, reason AS eligibility_reason FROM r""",
    "asof_member_side": """WITH s AS (SELECT user_id, event_id, ts, (SELECT min(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.ts >= e.ts) AS until FROM events e WHERE event_type = 'signup'),
p AS (SELECT s.event_id, q.event_id AS purchase_id, row_number() OVER (PARTITION BY s.event_id ORDER BY q.ts, q.event_id) AS r FROM s JOIN events q ON q.user_id = s.user_id AND q.event_type = 'purchase' AND q.ts >= s.ts AND (until IS NULL OR q.ts < until))
SELECT s.event_id, p.purchase_id FROM s LEFT JOIN p ON p.event_id = s.event_id AND p.r = 1""",
    "asof_nearest": """WITH r AS (SELECT a.event_id AS purchase_id, b.event_id AS nearest_id, abs(epoch_us(b.ts) - epoch_us(a.ts)) AS distance_us,
  row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)), CASE b.event_type WHEN 'error' THEN 0 ELSE 1 END, b.ts, b.event_id) AS k
  FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type IN ('error', 'signup') WHERE a.event_type = 'purchase') SELECT purchase_id, nearest_id, distance_us FROM r WHERE k = 1""",
    "issuer_time_split": """WITH e AS (SELECT o_orderkey AS event_id, o_custkey AS issuer_id, CAST(o_orderdate AS DATE) AS period_end, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS q FROM orders),
w AS (SELECT *, CASE WHEN q BETWEEN '1992Q1' AND '1994Q4' THEN 'train' WHEN q BETWEEN '1995Q1' AND '1995Q4' THEN 'dev' WHEN q BETWEEN '1996Q1' AND '1997Q4' THEN 'test' END AS win FROM e),
h AS (SELECT *, first_value(win) OVER (PARTITION BY issuer_id ORDER BY period_end, event_id) AS home FROM w)
SELECT event_id, CASE WHEN win = home THEN home END AS part, CASE WHEN win = home THEN NULL WHEN win IS NULL THEN 'outside_windows' ELSE 'issuer_in_earlier_partition' END AS excluded_reason FROM h""",
    "quarter_label": "SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, count(*) AS n FROM orders GROUP BY 1",
    "eastern_days": "SELECT strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1",
    "budget_audit": """WITH c AS (SELECT *, CAST(ceil(coalesce(value, 0)) AS BIGINT) AS cost, CAST(ts AS DATE) AS day FROM events),
u AS (SELECT event_id, CAST(sum(cost) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS per_day_used, CAST(sum(cost) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS per_user_used FROM c)
SELECT *, CASE WHEN per_day_used > 40 THEN 'per_day' WHEN per_user_used > 600 THEN 'per_user' END AS over_ceiling FROM u""",
    "interval_merge": f"WITH {_ORDER_SPANS}, {_covered('c', 'true')} SELECT o_custkey, n AS covered FROM c",
    "char_jaccard": f"WITH {_ORDER_SPANS}, {_covered('f', _F)}, {_covered('o', _O)}, {_covered('j', _EITHER)} SELECT o_custkey, coalesce(f.n, 0) + coalesce(o.n, 0) - j.n AS common, j.n AS joint, round((coalesce(f.n, 0) + coalesce(o.n, 0) - j.n) / j.n, 6) AS jaccard FROM j LEFT JOIN f USING (o_custkey) LEFT JOIN o USING (o_custkey)",
    "crossing_pairs": f"WITH {_ORDER_SPANS} SELECT x.o_custkey, x.o_orderkey AS a_id, y.o_orderkey AS b_id FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.a < y.a AND y.a < x.b AND x.b < y.b",
    "pairwise_jaccard": """WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, list(DISTINCT user_id) AS u FROM events GROUP BY ALL)
SELECT a.event_type AS type_a, b.event_type AS type_b, count(*) AS n_days, round(avg(len(list_intersect(a.u, b.u)) / len(list_distinct(list_concat(a.u, b.u)))), 6) AS jaccard FROM e a JOIN e b ON a.day = b.day AND a.event_type < b.event_type GROUP BY ALL""",
    "json_columns": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS least, max(k) AS most FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1",
    "columnar_json": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, event_id AS id, event_type AS kind FROM events",
}

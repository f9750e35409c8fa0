"""Queries on evaluation statistics over labels and documents.

A document is predicted good from 1200 characters on; its source is the theme and the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.functions import hashing as H, stats as S
from evidentia.operators import selection as L, support as U
from evidentia.session import table

CUT = 1200


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumns({"predicted": F.col("n_chars") >= CUT, "gold": F.col("quality") == 1})


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _judged(spark, sf_dir).select(F.col("source").alias("event_id"), F.col("lang").alias("theme_id"), F.col("doc_id").cast("string").alias("target_id"))
    return L.stratified_sample(pool, 7, 4, 60).select("event_id", "theme_id", "target_id", F.col("round").cast("long").alias("round"))


def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", H.seeded(11, F.col("doc_id")).alias("h")).orderBy("h", "doc_id").limit(50)


def f1_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = S.with_prf(S.tallies(_judged(spark, sf_dir), "source"))
    total = S.with_prf(per.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))
    macro = per.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count("f1").alias("n_themes"))
    return total.select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("micro_f1")).crossJoin(macro)


def f1_by_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = S.with_prf(S.tallies(_judged(spark, sf_dir), "source"))
    return per.select("source", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


def hard_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False acceptance among documents of no quality, by language and overall."""
    bad = _judged(spark, sf_dir).where("not gold")
    out = bad.rollup("lang").agg(F.count_if("predicted").alias("accepted"), F.count("*").alias("n"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("kind"), "accepted", "n", F.round(S.ratio(F.col("accepted"), F.col("n")), 6).alias("rate"))


def rare_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = _judged(spark, sf_dir).where("toxic = 1")
    rare = toxic.groupBy("source").agg(F.count("*").alias("n")).where("n <= 2")
    return toxic.join(rare, "source").groupBy("source").agg(F.count_if("predicted").alias("found"), F.count("*").alias("n"))


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir).select(F.col("n_chars").alias("score"), F.col("quality").alias("label"))
    return S.auc(j).withColumn("auc", F.round("auc", 6))


def auc_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir).select("lang", F.col("n_chars").alias("score"), F.col("quality").alias("label"))
    return S.auc(j, "lang").withColumn("auc", F.round("auc", 6))


def kappa_ac1(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir).select("lang", F.col("gold").alias("a"), F.col("predicted").alias("b"))
    return S.kappa_ac1(j, "lang").select("lang", "n", *[F.round(c, 6).alias(c) for c in ("observed", "kappa", "ac1")])


def fleiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir)
    ratings = j.select(F.col("doc_id").alias("item"), F.explode(F.array(F.col("quality"), 1 - F.col("toxic"), F.col("predicted").cast("int"))).alias("category"))
    return S.fleiss(ratings).select("n_items", "n_raters", F.round("fleiss_kappa", 6).alias("fleiss_kappa"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of micro F1 over sources drawn with replacement."""
    sums = S.tallies(_judged(spark, sf_dir), "source").withColumnRenamed("source", "cluster")
    names = [r["cluster"] for r in sums.select("cluster").distinct().collect()]  # a closed dimension of sources
    statistic = S.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    out = S.bootstrap(sums, S.draws(spark, names, 7, 1000), statistic)
    return out.select("n_defined", "n_undefined", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


CUTOFFS = [round(0.05 * i, 2) for i in range(1, 21)]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir)
    score = F.least(F.col("n_chars") / F.lit(8000.0), F.lit(1.0))
    long = j.select(F.lit("length").alias("candidate_id"), F.lit(1).alias("n_signals"), F.round(score, 6).alias("score"), F.lit(True).alias("eligible"), F.col("quality").alias("label"))
    both = j.select(F.lit("length_and_clean").alias("candidate_id"), F.lit(2).alias("n_signals"), F.round(score, 6).alias("score"), (F.col("toxic") == 0).alias("eligible"), F.col("quality").alias("label"))
    return long.unionByName(both)


def calibration_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.calibrate(_scored(spark, sf_dir), CUTOFFS, 0.4, ["candidate_id"])
    return out.select("candidate_id", "cutoff", "accepted", "hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.col("rank").cast("long").alias("rank"))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision by language against the even documents' precision as the bound."""
    def figure(rows: DataFrame, name: str) -> DataFrame:
        t = S.with_prf(S.tallies(rows, "lang"))
        return t.select("lang", F.round("precision", 6).alias(name))

    j = _judged(spark, sf_dir)
    dev = figure(j.where("doc_id % 2 = 0"), "dev_estimate").withColumn("dev_low", F.when(F.col("lang") == "en", F.lit(0.5)))
    out = S.gates(figure(j.where("doc_id % 2 = 1"), "estimate").join(dev, "lang", "full_outer"))
    return out.select("lang", "estimate", "bound", "reason", "passed")


def outcome_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as targets of four trials: family by presentation, read off quality, toxicity and length."""
    j = _judged(spark, sf_dir)
    panel = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(p).alias("presentation")) for f in ("a", "b") for p in ("x", "y")]))
    trials = j.select(F.col("doc_id").alias("target_id"), "quality", "toxic", "n_chars", panel.alias("p")).select("target_id", "quality", "toxic", "n_chars", "p.*")
    trials = trials.select(
        "target_id", "family", "presentation", (F.col("n_chars") > 100).alias("available"), F.when((F.col("family") == "a") | (F.col("quality") == 1), "supported").otherwise("unsupported").alias("claim_support"),
        F.when((F.col("presentation") == "x") | (F.col("toxic") == 0), "fits").otherwise("unclear").alias("theme_fit"), F.array().cast("array<string>").alias("reason_codes"), F.when(F.col("n_chars") <= 100, "input_too_short").alias("reason"),
    )
    signals = j.select(F.col("doc_id").alias("target_id"), F.explode(F.expr("array(named_struct('scope', 'joint', 'quote_id', null), named_struct('scope', 'quote', 'quote_id', 'q1'))")).alias("s")).select("target_id", "s.*", F.lit(True).alias("available"), F.lit(None).cast("string").alias("reason"))
    out = U.outcomes(j.select(F.col("doc_id").alias("target_id"), F.lit(1).alias("n_quotes")), trials, signals)
    return out.select("target_id", "status", F.concat_ws(",", "flags").alias("flags"), F.concat_ws(",", "missing").alias("missing"))


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two families, two presentations each; the second presentation of family b follows the toxicity label."""
    j = _judged(spark, sf_dir)
    rows = j.select(F.col("doc_id").alias("target_id"), F.explode(F.array(
        F.struct(F.lit("a").alias("family"), (F.col("quality") == 1).alias("yes")), F.struct(F.lit("a").alias("family"), (F.col("quality") == 1).alias("yes")),
        F.struct(F.lit("b").alias("family"), F.col("predicted").alias("yes")), F.struct(F.lit("b").alias("family"), (F.col("toxic") == 0).alias("yes")),
    )).alias("t")).select("target_id", "t.family", F.lit(True).alias("available"), F.when(F.col("t.yes"), "supported").otherwise("unsupported").alias("claim_support"), F.lit("fits").alias("theme_fit"))
    return U.consensus(rows).groupBy("family", "verdict").agg(F.count("*").alias("n"))


def decision_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir)
    none = F.array().cast("array<string>")
    rows = j.select(
        "doc_id", F.when(F.col("toxic") == 1, "flagged").when(F.col("n_chars") < 200, "incomplete").otherwise("assessed").alias("support_status"), F.when(F.col("lang") != "es", "p1").alias("policy_id"),
        F.least(F.col("n_chars") / F.lit(8000.0), F.lit(1.0)).alias("score"), F.when(F.col("quality") == 1, F.array(F.lit("q1"))).otherwise(none).alias("eligible_quotes"),
    )
    voted = U.scorer_vote(rows, 0.25).withColumn("policy_quotes", F.when(F.col("policy_vote") == "accepted", F.array(F.lit("q1"))).otherwise(none))
    return U.decided(voted).groupBy("status", "reason").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (seeded_sample, seeded_order, f1_micro_macro, f1_by_theme, hard_negative, rare_categories, auc, auc_by_language, kappa_ac1, fleiss, bootstrap_ci, calibration_grid, gates, outcome_flags, consensus, decision_votes)
}

_J = f"j AS (SELECT l.*, d.lang, d.source, d.n_chars, d.n_chars >= {CUT} AS predicted, l.quality = 1 AS gold FROM labels l JOIN documents d USING (doc_id))"
_PER = "per AS (SELECT source, count(*) FILTER (predicted AND gold) AS tp, count(*) FILTER (predicted AND NOT gold) AS fp, count(*) FILTER (NOT predicted AND gold) AS fn FROM j GROUP BY 1)"


def _auc(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    on = f"p.{keys} = n.{keys} AND " if keys else ""
    group = f" GROUP BY j.{keys}" if keys else ""
    pk = f"p.{keys}, " if keys else ""
    join = f"j.{keys} = w.{keys}" if keys else "true"
    return f"""WITH {_J}, w AS (SELECT {pk}sum(CASE WHEN p.n_chars > n.n_chars THEN 1.0 WHEN p.n_chars = n.n_chars THEN 0.5 ELSE 0 END) AS won FROM j p JOIN j n ON {on}p.quality = 1 AND n.quality = 0{f' GROUP BY p.{keys}' if keys else ''})
SELECT {'j.' + k if keys else ''}count(*) FILTER (quality = 1) AS n_positive, count(*) FILTER (quality = 0) AS n_negative, round(CAST(any_value(won) AS DOUBLE) / nullif(count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0), 0), 6) AS auc FROM j LEFT JOIN w ON {join}{group}"""


ORACLE_SQL = {
    "seeded_sample": f"""WITH {_J}, p AS (SELECT DISTINCT source AS event_id, lang AS theme_id, CAST(doc_id AS VARCHAR) AS target_id FROM j),
a AS (SELECT *, row_number() OVER (PARTITION BY event_id, theme_id ORDER BY sha256('7:' || target_id), target_id) AS t FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY t, sha256('7:' || event_id || '/' || theme_id), theme_id) AS round FROM a)
SELECT event_id, theme_id, target_id, round FROM b WHERE round <= 4 ORDER BY round, sha256('7:' || event_id), event_id LIMIT 60""",
    "seeded_order": "SELECT doc_id, sha256('11:' || doc_id) AS h FROM labels ORDER BY h, doc_id LIMIT 50",
    "f1_micro_macro": f"""WITH {_J}, {_PER} SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / nullif(sum(tp + fp), 0), 6) AS precision, round(sum(tp) / nullif(sum(tp + fn), 0), 6) AS recall,
  round(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 6) AS micro_f1, round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)), 6) AS macro_f1, count(2 * tp / nullif(2 * tp + fp + fn, 0)) AS n_themes FROM per""",
    "f1_by_theme": f"WITH {_J}, {_PER} SELECT source, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM per",
    "hard_negative": f"WITH {_J} SELECT coalesce(lang, 'all') AS kind, count(*) FILTER (predicted) AS accepted, count(*) AS n, round(count(*) FILTER (predicted) / count(*), 6) AS rate FROM j WHERE NOT gold GROUP BY ROLLUP (lang)",
    "rare_categories": f"WITH {_J} SELECT source, count(*) FILTER (predicted) AS found, count(*) AS n FROM j WHERE toxic = 1 GROUP BY 1 HAVING count(*) <= 2",
    "auc": _auc(""),
    "auc_by_language": _auc("lang"),
    "kappa_ac1": f"""WITH {_J}, m AS (SELECT lang, count(*) AS n, avg(CASE WHEN gold = predicted THEN 1.0 ELSE 0.0 END) AS po, avg(gold::INT) AS p1, avg(predicted::INT) AS p2 FROM j GROUP BY 1),
e AS (SELECT *, p1 * p2 + (1 - p1) * (1 - p2) AS pe, (p1 + p2) / 2 AS q FROM m)
SELECT lang, n, round(po, 6) AS observed, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa, round((po - 2 * q * (1 - q)) / nullif(1 - 2 * q * (1 - q), 0), 6) AS ac1 FROM e""",
    "fleiss": f"""WITH {_J}, r AS (SELECT doc_id, quality + (1 - toxic) + predicted::INT AS k FROM j), s AS (SELECT count(*) AS n, avg((k * k + (3 - k) * (3 - k) - 3) / 6.0) AS p, sum(k) / (3.0 * count(*)) AS q FROM r)
SELECT n AS n_items, CAST(3 AS BIGINT) AS n_raters, round((p - (q * q + (1 - q) * (1 - q))) / (1 - (q * q + (1 - q) * (1 - q))), 6) AS fleiss_kappa FROM s""",
    "calibration_grid": f"""WITH {_J}, c AS (SELECT 'length' AS candidate_id, 1 AS n_signals, round(least(n_chars / 8000.0, 1.0), 6) AS score, true AS eligible, quality FROM j UNION ALL SELECT 'length_and_clean', 2, round(least(n_chars / 8000.0, 1.0), 6), toxic = 0, quality FROM j),
g AS (SELECT candidate_id, n_signals, cutoff, count(*) FILTER (eligible AND score >= cutoff) AS accepted, count(*) FILTER (eligible AND score >= cutoff AND quality = 1) AS hits, count(*) FILTER (quality = 1) AS pos
  FROM c, (SELECT CAST(round(0.05 * i, 2) AS DOUBLE) AS cutoff FROM range(1, 21) t(i)) GROUP BY ALL),
p AS (SELECT *, hits / nullif(accepted, 0) AS pr, hits / nullif(pos, 0) AS re FROM g), f AS (SELECT *, pr IS NOT NULL AND coalesce(re >= 0.4, false) AS fit FROM p)
SELECT candidate_id, cutoff, accepted, hits, round(pr, 6) AS precision, round(re, 6) AS recall, CASE WHEN fit THEN row_number() OVER (PARTITION BY fit ORDER BY pr DESC, n_signals, cutoff, candidate_id) END AS rank FROM f""",
    "gates": f"""WITH {_J}, t AS (SELECT lang, doc_id % 2 AS h, round(count(*) FILTER (predicted AND gold) / nullif(count(*) FILTER (predicted), 0), 6) AS p FROM j GROUP BY ALL),
b AS (SELECT lang, CASE WHEN lang = 'en' THEN 0.5::DOUBLE ELSE p END AS bound FROM t WHERE h = 0), e AS (SELECT lang, p AS estimate FROM t WHERE h = 1)
SELECT lang, estimate, bound, CASE WHEN bound IS NULL THEN 'no_development_figure' END AS reason, CASE WHEN bound IS NOT NULL THEN coalesce(estimate >= bound, false) END AS passed FROM e FULL JOIN b USING (lang)""",
    "outcome_flags": f"""WITH {_J}, r AS (SELECT doc_id AS target_id, n_chars <= 100 AS short, quality = 0 AS u, toxic = 1 AS x FROM j)
SELECT target_id, CASE WHEN short THEN 'incomplete' WHEN u OR x THEN 'flagged' ELSE 'assessed' END AS status,
  concat_ws(',', CASE WHEN (u OR x) AND NOT short THEN 'category_disagreement' END, CASE WHEN x THEN 'unclear' END, CASE WHEN u THEN 'unsupported' END) AS flags, CASE WHEN short THEN 'input_too_short' ELSE '' END AS missing FROM r""",
    "consensus": f"""WITH {_J} SELECT family, verdict, count(*) AS n FROM (SELECT 'a' AS family, quality = 1 AS verdict FROM j UNION ALL SELECT 'b', CASE WHEN predicted = (toxic = 0) THEN predicted END FROM j) GROUP BY ALL""",
    "decision_votes": f"""WITH {_J}, s AS (SELECT CASE WHEN toxic = 1 THEN 'flagged' WHEN n_chars < 200 THEN 'incomplete' ELSE 'assessed' END AS s, lang, least(n_chars / 8000.0, 1.0) >= 0.25 AND quality = 1 AS v FROM j)
SELECT CASE WHEN s <> 'assessed' OR lang = 'es' THEN 'review' WHEN v THEN 'accepted' ELSE 'rejected' END AS status, CASE s WHEN 'incomplete' THEN 'assessment_incomplete' WHEN 'flagged' THEN 'assessment_flagged' ELSE CASE WHEN lang = 'es' THEN 'calibration_required' END END AS reason, count(*) AS n FROM s GROUP BY ALL""",
}

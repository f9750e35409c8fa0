"""Evaluation statistics; every undefined figure is null, never zero."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window, functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def with_prf(tally: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp and fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return tally.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def tallies(pairs: DataFrame, *keys: str) -> DataFrame:
    """tp, fp and fn of boolean columns `predicted` and `gold`."""
    p, g = F.col("predicted"), F.col("gold")
    return pairs.groupBy(*keys).agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"))


def auc(scored: DataFrame, *keys: str, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve by mid-ranks, ties half; null with one class alone.

    Rows are summed by distinct score before the window, so its partition holds scores, not rows.
    """
    known = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    per = known.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    below = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    wins = per.withColumn("won", F.col("p") * (F.coalesce(F.sum("n").over(below), F.lit(0)) + F.col("n") / 2.0))
    total = wins.groupBy(*keys).agg(F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"), F.sum("won").alias("won"))
    return total.select(*keys, "n_positive", "n_negative", ratio(F.col("won"), F.col("n_positive") * F.col("n_negative")).alias("auc"))


def kappa_ac1(rated: DataFrame, *keys: str, a: str = "a", b: str = "b") -> DataFrame:
    """Cohen's kappa and Gwet's AC1 of two boolean raters; kappa is null where chance agrees fully."""
    x, y = F.col(a).cast("int"), F.col(b).cast("int")
    m = rated.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("p1"), F.avg(y).alias("p2"))
    pe = F.col("p1") * F.col("p2") + (1 - F.col("p1")) * (1 - F.col("p2"))
    mean = (F.col("p1") + F.col("p2")) / 2
    ac = 2 * mean * (1 - mean)
    return m.select(*keys, "n", F.col("po").alias("observed"), ratio(F.col("po") - pe, F.when(1 - pe != 0, 1 - pe)).alias("kappa"), ratio(F.col("po") - ac, F.when(1 - ac != 0, 1 - ac)).alias("ac1"))


def fleiss(ratings: DataFrame, item: str = "item", category: str = "category") -> DataFrame:
    """Fleiss' kappa over (item, category) rows with a fixed number of raters; null where chance agrees fully or a count differs."""
    per = ratings.groupBy(item, category).agg(F.count("*").alias("n"))
    items = per.groupBy(item).agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n")).alias("s2"))
    shares = per.groupBy(category).agg(F.sum("n").alias("c"))
    agreed = items.agg(F.count("*").alias("n_items"), F.min("r").alias("r"), F.max("r").alias("most"), F.avg((F.col("s2") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("p"))
    chance = shares.agg(F.sum(F.col("c") * F.col("c")).alias("c2"), F.sum("c").alias("c"))
    both = agreed.crossJoin(chance).withColumn("pe", F.col("c2") / (F.col("c") * F.col("c")))
    sound = (F.col("r") == F.col("most")) & (F.col("r") > 1) & (F.col("pe") != 1)
    return both.select("n_items", F.col("r").alias("n_raters"), F.when(sound, (F.col("p") - F.col("pe")) / (1 - F.col("pe"))).alias("fleiss_kappa"))


def draws(spark, clusters: list[str], seed: int, resamples: int) -> DataFrame:
    """(resample, cluster, times): clusters drawn with replacement by Mersenne draws, which no SQL generator repeats.

    The clusters are the events of an evaluation, some hundreds; they are sorted first.
    """
    names, rng, rows = sorted(clusters), random.Random(seed), []
    for r in range(resamples):
        times: dict[str, int] = {}
        for _ in names:
            k = names[rng.randrange(len(names))]
            times[k] = times.get(k, 0) + 1
        rows += [(r, k, n) for k, n in times.items()]
    return spark.createDataFrame(rows, "resample int, cluster string, times int")


def bootstrap(sums: DataFrame, drawn: DataFrame, statistic: Column, level: float = 0.9, most_undefined: float = 1.0) -> DataFrame:
    """The statistic over all clusters (`point`) and its percentile interval, each cluster's sums taken as often as it was drawn.

    sums: cluster and numeric columns; the statistic is a column expression over those names.
    Undefined resamples are left out of the interval and counted; if their share is over
    `most_undefined`, or all are undefined, the bounds are null.
    """
    names = [c for c in sums.columns if c != "cluster"]
    summed = drawn.join(sums, "cluster").groupBy("resample").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in names]).select("resample", statistic.alias("value"))
    tail = (1 - level) / 2
    n, undefined = F.count("value"), F.count_if(F.col("value").isNull())
    bound = lambda share: F.when((n > 0) & (undefined <= most_undefined * (n + undefined)), F.percentile("value", share))
    point = sums.agg(*[F.sum(c).alias(c) for c in names]).select(statistic.alias("point"))
    return summed.agg(n.alias("n_defined"), undefined.alias("n_undefined"), bound(tail).alias("low"), bound(1 - tail).alias("high")).crossJoin(F.broadcast(point))


def judge_agreement(targets: DataFrame, seed: int, resamples: int, level: float = 0.9, most_undefined: float = 1.0) -> DataFrame:
    """Cohen's kappa and Gwet's AC1 of verdicts against labels, each with its interval by events; and the labels and uncertain verdicts behind them.

    targets: event_id, label (0, 1 or null), verdict (0 or 1), uncertain. Targets without a label
    are left out, and with them events that have none; only labelled targets' uncertain verdicts
    count. Events are those of an evaluation, some hundreds.
    """
    known = targets.where("label is not null")
    one = lambda c: F.sum(c.cast("long"))
    both, mine, its = F.col("verdict") == F.col("label"), F.col("verdict") == 1, F.col("label") == 1
    sums = known.groupBy(F.col("event_id").alias("cluster")).agg(F.count("*").alias("n"), one(both).alias("same"), one(mine).alias("first"), one(its).alias("second"))
    observed, first, second = (ratio(F.col(c), F.col("n")) for c in ("same", "first", "second"))
    chance, mean = first * second + (1 - first) * (1 - second), (first + second) / 2
    gwet = 2 * mean * (1 - mean)
    drawn = draws(targets.sparkSession, [r["cluster"] for r in sums.select("cluster").collect()], seed, resamples)
    counted = known.agg(F.count("*").alias("n_labels"), F.coalesce(F.sum(F.col("uncertain").cast("long")), F.lit(0)).alias("n_uncertain"))
    out = None
    for name, value in (("kappa", ratio(observed - chance, F.when(chance != 1, 1 - chance))), ("ac1", ratio(observed - gwet, 1 - gwet))):
        row = bootstrap(sums, drawn, value, level, most_undefined).withColumn("measure", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.crossJoin(F.broadcast(counted))


def calibrate(scored: DataFrame, cutoffs: list[float], least_recall: float, keys: list[str]) -> DataFrame:
    """Precision and recall of every candidate and cutoff, with `rank` 1 for the chosen one: the best precision among those of enough recall.

    scored: the candidate's keys, n_signals, score, eligible, label (null: not labelled). Ties go to
    fewer signals, the lower cutoff and the candidate's id. The cutoffs are a small grid.
    """
    grid = scored.sparkSession.createDataFrame([(c,) for c in cutoffs], "cutoff double")
    taken = F.col("eligible") & (F.col("score") >= F.col("cutoff"))
    positives = F.count_if(F.col("label") == 1)
    out = scored.crossJoin(F.broadcast(grid)).groupBy(*keys, "n_signals", "cutoff").agg(
        F.count_if(taken & F.col("label").isNotNull()).alias("accepted"), F.count_if(taken & (F.col("label") == 1)).alias("hits"), positives.alias("positives")
    )
    out = out.withColumns({"precision": ratio(F.col("hits"), F.col("accepted")), "recall": ratio(F.col("hits"), F.col("positives"))})
    fit = F.col("precision").isNotNull() & F.coalesce(F.col("recall") >= least_recall, F.lit(False))
    order = Window.partitionBy(fit).orderBy(F.desc("precision"), "n_signals", "cutoff", *keys)
    return out.withColumn("rank", F.when(fit, F.row_number().over(order)))


def gates(figures: DataFrame) -> DataFrame:
    """Whether each gate's estimate reaches its bound: the development's lower bound, else its estimate, else none with a reason; a null estimate fails."""
    bound = F.coalesce("dev_low", "dev_estimate")
    return figures.withColumns({"bound": bound, "reason": F.when(bound.isNull(), "no_development_figure"), "passed": F.when(bound.isNotNull(), F.coalesce(F.col("estimate") >= bound, F.lit(False)))})


def evidence_f1(hit_a: Column, a: Column, hit_b: Column, b: Column) -> Column:
    """Harmonic F1 of two-sided evidence: null with nothing on both sides, 0 where nothing hits."""
    under = hit_a * b + hit_b * a
    return F.when((a == 0) & (b == 0), None).when(under == 0, 0.0).otherwise(2.0 * hit_a * hit_b / under)

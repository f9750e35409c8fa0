"""Resolving names and securities to registrants."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidentia.functions.text import covers, name_tokens, significant


def token_candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """(left, right) pairs where the left name's words hold all of the right name's.

    The right side is indexed by its rarest word and probed by every left word, so only names
    that share that word are compared.
    """
    words = right.select(right_id, F.explode("tokens").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("n"))
    rarest = words.join(often, "word").groupBy(right_id).agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    index = right.select(right_id, F.col("tokens").alias("wanted")).join(rarest, right_id)
    probe = left.select(left_id, "tokens", F.explode("tokens").alias("word"))
    return probe.join(index, "word").where(covers(F.col("tokens"), F.col("wanted"))).select(left_id, right_id).distinct()


def matched_once(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """Keys with exactly one partner; none or several is unmatched."""
    per = pairs.groupBy(key).agg(F.count("*").alias("n"), F.max(other).alias(other))
    return per.select(key, F.when(F.col("n") == 1, F.col(other)).alias(other), F.when(F.col("n") > 1, "several").alias("reason"))


def confirmed_registrants(securities: DataFrame, tickers: DataFrame, registrants: DataFrame) -> DataFrame:
    """(security_id, cik, reason): ticker to registrant, confirmed where the registrant lists the ticker and a name of it covers the security's.

    securities: security_id, ticker, name. tickers: ticker, cik. registrants: cik, tickers (array), names (array).
    """
    hop = securities.join(tickers, "ticker", "left").join(registrants, "cik", "left")
    own = name_tokens(F.col("name"), fold=False)
    wanted = hop.withColumns({"own": own, "wanted": significant(own), "lists": F.array_contains("tickers", F.col("ticker"))})
    other = wanted.select("*", F.explode_outer("names").alias("registrant_name")).withColumn("other", name_tokens(F.col("registrant_name"), fold=False))
    named = other.withColumn("covering", covers(F.col("other"), F.col("wanted")) | covers(F.col("own"), significant(F.col("other"))))
    per = named.groupBy("security_id").agg(F.collect_set(F.when(F.col("lists") & F.col("covering"), F.col("cik"))).alias("ok"), F.count("cik").alias("n"))
    reason = F.when(F.size("ok") == 1, None).when(F.size("ok") > 1, "several_registrants").when(F.col("n") == 0, "unknown_ticker").otherwise("unconfirmed")
    return per.select("security_id", F.when(F.size("ok") == 1, F.col("ok")[0]).alias("cik"), reason.alias("reason"))


def stated_identities(rows: DataFrame, cutoff: str) -> DataFrame:
    """Of each security its stated (name, ticker) pairs, and those published by the cutoff."""
    pair = F.struct("name", "ticker")
    timely = F.when(F.col("published_on") <= F.lit(cutoff).cast("date"), pair)
    return rows.groupBy("security_id").agg(F.array_sort(F.collect_set(pair)).alias("stated"), F.array_sort(F.collect_set(timely)).alias("timely"))


def assertion_status(assertions: DataFrame, broken: DataFrame, issuers: DataFrame) -> DataFrame:
    """Assertions with their issuer and whether they were applied, withheld, broken or left without an issuer."""
    b = broken.select("security_id", F.lit(True).alias("__broken")).distinct()
    status = F.when(F.col("withheld"), "withheld").when(F.col("__broken"), "broken").when(F.col("issuer_id").isNull(), "no_issuer").otherwise("applied")
    return assertions.join(b, "security_id", "left").join(issuers, "security_id", "left").withColumn("status", status).drop("__broken")


def snapshot_disagreements(roster: DataFrame, snapshots: DataFrame, check_sources: list[str]) -> DataFrame:
    """Per snapshot the members that only one side has; a disagreement blocks unless the source is only a check."""
    r = roster.select("day", "member").distinct().withColumn("__r", F.lit(True))
    s = snapshots.select(F.col("as_of").alias("day"), "source", "member").distinct().withColumn("__s", F.lit(True))
    asked = s.select("day", "source").distinct().join(r, "day")
    both = asked.join(s, ["day", "source", "member"], "full_outer")
    per = both.groupBy("day", "source").agg(F.array_sort(F.collect_set(F.when(F.col("__s").isNull(), F.col("member")))).alias("roster_only"), F.array_sort(F.collect_set(F.when(F.col("__r").isNull(), F.col("member")))).alias("snapshot_only"))
    return per.where((F.size("roster_only") > 0) | (F.size("snapshot_only") > 0)).withColumn("blocking", ~F.col("source").isin(check_sources))

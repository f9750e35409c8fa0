"""Units, windows, prompts, replies and the pluggable model calls of extraction.

A model is anything that answers request rows; in tests and re-runs it is the table of stored
replies. What a model returns is untrusted: it is parsed into typed rows or a reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from evidentia.operators.layout import last_of, packed_windows
from evidentia.operators.spans import contains, overlapping
from evidentia.session import ship

#: From most to least specific. (Fixed values.)
NARRATIVE_RANK = ["sentence", "list_item", "footnote", "heading", "paragraph", "speaker_turn", "section"]
MOST_CHARS = 600


def units(elements: DataFrame) -> DataFrame:
    """Narrative elements that hold no better-ranked one, in order: (doc_id, element_id, start, end, type, position)."""
    rank = F.coalesce(*[F.when(F.col("type") == t, i) for i, t in enumerate(NARRATIVE_RANK)])
    rows = elements.withColumn("rank", rank).where("rank is not null").select("doc_id", "element_id", "type", "start", "end", "rank")
    held = overlapping(rows, rows).where(contains(F.col("start"), F.col("end"), F.col("other_start"), F.col("other_end")) & (F.col("other_rank") < F.col("rank")))
    out = rows.join(held.select("doc_id", "element_id").distinct(), ["doc_id", "element_id"], "left_anti")
    return out.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "rank"))).drop("rank")


def windows(unit_rows: DataFrame, budget: int | None) -> DataFrame:
    """Units dealt into windows of a character budget, labelled U1..Un, with the nearest heading before the window as its context."""
    sized = unit_rows.withColumn("n", F.col("end") - F.col("start"))
    packed = packed_windows(sized, "doc_id", "position", "n", budget)
    rows = sized.join(packed, ["doc_id", "position"])
    rows = last_of(rows, "doc_id", "position", F.col("type") == "heading", F.col("element_id"), "heading")
    order = Window.partitionBy("doc_id", "window").orderBy("position")
    first = F.first(F.struct("type", "heading")).over(order)
    return rows.withColumns({"label": F.concat(F.lit("U"), F.row_number().over(order)), "context_id": F.when(first["type"] != "heading", first["heading"])})


def rendered(window_rows: DataFrame, documents: DataFrame, header: str) -> DataFrame:
    """One request per window: the header, then each unit's label and text; the hash is the request's key."""
    texts = window_rows.join(documents.select("doc_id", "canonical_text"), "doc_id").withColumn("line", F.concat(F.lit("["), "label", F.lit("] "), F.substring(F.col("canonical_text"), F.col("start") + 1, F.col("end") - F.col("start"))))
    rows = F.array_sort(F.collect_list(F.struct("position", "line", "label", "element_id")))
    out = texts.groupBy("doc_id", "window").agg(rows.alias("r"), F.first("context_id").alias("context_id"))
    prompt = F.concat(F.lit(header + "\n"), F.concat_ws("\n", F.transform("r", lambda x: x["line"])))
    return out.select("doc_id", "window", "context_id", prompt.alias("prompt"), F.transform("r", lambda x: F.struct(x["label"].alias("label"), x["element_id"].alias("element_id"))).alias("labels")).withColumn("request_hash", F.sha2("prompt", 256))


def completed(requests: DataFrame, complete: Callable[[str], str | None]) -> DataFrame:
    """Requests with a model's replies; a call that fails is a row with its problem.

    The function runs in the executors and gets a prompt; it stands for a local or scripted model.
    """
    ship(requests.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies, problems = [], []
            for prompt in frame["prompt"]:
                try:
                    reply = complete(prompt)
                    replies.append(reply)
                    problems.append(None if reply is not None else "no_reply")
                except Exception as error:  # a model's failure is data here
                    replies.append(None)
                    problems.append(type(error).__name__)
            yield pd.DataFrame({"request_hash": frame["request_hash"], "reply": replies, "problem": problems})

    return requests.select("request_hash", "prompt").dropDuplicates(["request_hash"]).mapInPandas(run, "request_hash string, reply string, problem string")


REPLY = "struct<claims:array<struct<claim:string,labels:array<string>>>>"


def parsed(requests: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, problems) from replies: strict JSON with claims and unit labels, nothing guessed."""
    rows = requests.join(replies.select("request_hash", "reply", F.col("problem").alias("call_problem")), "request_hash", "left")
    rows = rows.withColumn("p", F.from_json("reply", REPLY))
    keys = F.json_object_keys("reply")
    problem = F.when(F.col("reply").isNull(), F.coalesce("call_problem", F.lit("replay_miss"))).when(F.col("p.claims").isNull() | ~F.coalesce(F.size(keys) == 1, F.lit(False)), "malformed_reply")
    rows = rows.withColumn("problem", problem)
    good = rows.where("problem is null").select("doc_id", "window", "labels", F.posexplode("p.claims").alias("candidate_index", "c"))
    out = good.select("doc_id", "window", "candidate_index", F.col("c.claim").alias("claim"), F.col("c.labels").alias("cited"), F.map_from_arrays(F.transform("labels", lambda x: x["label"]), F.transform("labels", lambda x: x["element_id"])).alias("known"))
    return out, rows.where("problem is not null").select("doc_id", "window", "problem")


def refusals(candidates: DataFrame) -> DataFrame:
    """Candidates with their element ids and the first rule that refuses them, or null."""
    cited = F.coalesce("cited", F.array().cast("array<string>"))
    reason = (
        F.when(F.trim(F.coalesce("claim", F.lit(""))) == "", "blank_claim").when(F.length("claim") > MOST_CHARS, "claim_too_long").when(F.size(cited) == 0, "no_label")
        .when(F.size(F.array_except(cited, F.map_keys("known"))) > 0, "unknown_label").when(F.size(F.array_distinct(cited)) != F.size(cited), "duplicate_label")
    )
    return candidates.withColumn("reason", reason).withColumn("element_ids", F.when(F.col("reason").isNull(), F.transform("cited", lambda x: F.try_element_at("known", x)))).drop("known")


def claims_and_quotes(accepted: DataFrame, unit_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, quotes): each accepted claim with its quotes' ids, each cited unit as a quote once."""
    spread = accepted.where("reason is null").select("doc_id", "window", "claim", F.explode("element_ids").alias("element_id"))
    quotes = spread.select("doc_id", "element_id").distinct().join(unit_rows.select("doc_id", "element_id", "start", "end"), ["doc_id", "element_id"]).withColumn("quote_id", F.concat_ws(":", "doc_id", "start", "end"))
    held = spread.join(quotes, ["doc_id", "element_id"])
    claims = held.groupBy("doc_id", "window", "claim").agg(F.array_sort(F.collect_set("quote_id")).alias("quote_ids")).withColumn("claim_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "claim", F.concat_ws(",", "quote_ids")), 256))
    return claims, quotes


def scored(pairs: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """Pairs (premise, hypothesis) with a scorer's number; the scorer gets whole Arrow batches."""
    ship(pairs.sparkSession)
    from pyspark.sql.types import DoubleType

    call = F.pandas_udf(score, DoubleType())
    return pairs.withColumn("score", call("premise", "hypothesis"))


def trial_panel(targets: DataFrame, families: tuple[str, str] = ("a", "b"), presentations: tuple[str, str] = ("forward", "reversed")) -> DataFrame:
    """Four trials for every target: two families by two presentations."""
    panel = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(p).alias("presentation")) for f in families for p in presentations])
    return targets.select("*", F.explode(panel).alias("t")).select(*targets.columns, "t.*")


def probes(claims: DataFrame, themes: DataFrame) -> DataFrame:
    """Every claim with the whole frozen set of themes, as one array; the codebook is a small closed table."""
    held = themes.agg(F.array_sort(F.collect_list(F.struct("theme_id", "label", "definition"))).alias("themes"))
    return claims.crossJoin(F.broadcast(held))


def accounting(windows_rows: DataFrame) -> DataFrame:
    """Totals of requests, cache hits and tokens; what was not reported is counted, not taken as zero."""
    return windows_rows.agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), F.coalesce(F.sum("cache_hits"), F.lit(0)).alias("cache_hits"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), F.count_if(F.col("prompt_tokens").isNull()).alias("unreported"),
    )


def run_problems(documents: DataFrame, window_rows: DataFrame, visits: DataFrame) -> DataFrame:
    """(doc_id, problem): documents whose stated counts of windows or units differ from their rows, and rows without a document."""
    w = window_rows.groupBy("doc_id").agg(F.count("*").alias("n_w"), F.count_if(F.col("outcome") == "failed").alias("n_f"))
    v = visits.groupBy("doc_id").agg(F.count("*").alias("n_v"), F.count_distinct("element_id").alias("n_e"))
    rows = documents.join(w, "doc_id", "full_outer").join(v, "doc_id", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    found = F.array_compact(F.array(F.when(F.col("windows").isNull(), "unknown_document"), F.when(F.col("windows") != zero("n_w"), "window_count"), F.when(F.col("windows_failed") != zero("n_f"), "failed_count"), F.when(F.col("units") != zero("n_e"), "unit_count"), F.when(zero("n_v") != zero("n_e"), "repeated_visit")))
    return rows.select("doc_id", F.explode(found).alias("problem"))

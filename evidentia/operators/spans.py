"""Half-open spans over text: predicates, validation, joins, merging and crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidentia.functions.text import literal

#: Width of the strips that spans of one document are dealt into before they are compared.
STRIP = 4096


def contains(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    return (outer_start <= start) & (end <= outer_end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def sliced(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points; a span that is empty or leaves the text is an error."""
    bad = (start < 0) | (end <= start) | (end > F.length(text))
    return F.when(bad, F.raise_error(F.lit("the span leaves the text")).cast("string")).otherwise(F.substring(text, start + 1, end - start))


def strips(rows: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Rows once for every strip that their span touches, so that overlap becomes an equi-join on (document, strip)."""
    return rows.withColumn("strip", F.explode(F.sequence(F.floor(F.col(start) / STRIP), F.floor((F.col(end) - 1) / STRIP))))


def overlapping(left: DataFrame, right: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pairs of overlapping spans of one document; right columns get the prefix `other_`.

    A pair is taken in the strip where the later of the two begins, so it comes once.
    """
    other = strips(right).select(doc, "strip", *[F.col(c).alias(f"other_{c}") for c in right.columns if c != doc])
    both = strips(left).join(other, [doc, "strip"]).where(overlaps(F.col("start"), F.col("end"), F.col("other_start"), F.col("other_end")))
    return both.where(F.col("strip") == F.floor(F.greatest("start", "other_start") / STRIP)).drop("strip")


def most_specific(spans: DataFrame, homes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each span with the shortest home that contains it, ties by the home's rank and id."""
    pairs = overlapping(spans, homes, doc).where(contains(F.col("other_start"), F.col("other_end"), F.col("start"), F.col("end")))
    order = F.struct((F.col("other_end") - F.col("other_start")).alias("n"), F.col("other_rank"), F.col("other_element_id"))
    best = pairs.groupBy(doc, "start", "end").agg(F.min_by("other_element_id", order).alias("home_id"))
    return spans.join(best, [doc, "start", "end"], "left")


def masks_over(spans: DataFrame, masks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each span with the sorted ids of the masks over it, an empty array where there are none."""
    found = overlapping(spans.select(doc, "start", "end").distinct(), masks.select(doc, "start", "end", "mask_id"), doc)
    ids = found.groupBy(doc, "start", "end").agg(F.array_sort(F.collect_set("other_mask_id")).alias("mask_ids"))
    return spans.join(ids, [doc, "start", "end"], "left").withColumn("mask_ids", F.coalesce("mask_ids", F.array().cast("array<string>")))


def merge(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The union of each key's spans as disjoint spans; touching ones are one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def covered(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Merged length of each key's spans."""
    return merge(spans, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))


def jaccard(a: DataFrame, b: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Of each key: common and joint length of two span sets and their share, null where both are empty."""
    both = a.select(*keys, start, end).unionByName(b.select(*keys, start, end))
    alone = covered(a, keys, start, end).withColumnRenamed("covered", "a").join(covered(b, keys, start, end).withColumnRenamed("covered", "b"), keys, "full_outer")
    joint = covered(both, keys, start, end).withColumnRenamed("covered", "joint")
    out = joint.join(alone, keys).withColumn("common", F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)) - F.col("joint"))
    return out.select(*keys, "common", "joint", F.try_divide(F.col("common").cast("double"), F.col("joint").cast("double")).alias("jaccard"))


def crossings(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", name: str = "element_id") -> DataFrame:
    """Pairs that overlap without one holding the other: a begins first and ends inside b."""
    b = strips(spans, start, end).select(*keys, "strip", F.col(start).alias("b_start"), F.col(end).alias("b_end"), F.col(name).alias("b_id"))
    pairs = strips(spans, start, end).join(b, [*keys, "strip"]).where((F.col(start) < F.col("b_start")) & (F.col("b_start") < F.col(end)) & (F.col(end) < F.col("b_end")))
    return pairs.where(F.col("strip") == F.floor(F.col("b_start") / STRIP)).select(*keys, F.col(name).alias("a_id"), "b_id")


def span_problem(candidates: DataFrame, documents: DataFrame, elements: DataFrame, turns: DataFrame, ocr: DataFrame) -> DataFrame:
    """Candidates with `reason`, the first check that fails, or null where the quote is verified.

    candidates: candidate_id, doc_id, start, end, quote_text, canonical_hash, element_id, prefix, suffix.
    documents: doc_id, canonical_text, canonical_hash. elements: doc_id, element_id, start, end.
    turns and ocr: doc_id, start, end.
    """
    d = documents.select("doc_id", "canonical_text", F.col("canonical_hash").alias("doc_hash"))
    e = elements.select("doc_id", "element_id", F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    rows = candidates.join(d, "doc_id", "left").join(e, ["doc_id", "element_id"], "left")

    def touching(other: DataFrame, crossing: bool, name: str) -> DataFrame:
        pairs = overlapping(candidates.where("start is not null and end is not null and start < end").select("doc_id", "candidate_id", "start", "end"), other.select("doc_id", "start", "end"))
        if crossing:
            pairs = pairs.where(~contains(F.col("other_start"), F.col("other_end"), F.col("start"), F.col("end")))
        return pairs.select("candidate_id", F.lit(True).alias(name)).distinct()

    rows = rows.join(touching(turns, True, "crosses"), "candidate_id", "left").join(touching(ocr, False, "in_ocr"), "candidate_id", "left")
    text, start, end, quote = F.col("canonical_text"), F.col("start"), F.col("end"), F.col("quote_text")
    found = F.when((end > start) & (start >= 0), F.substring(text, start + 1, end - start))
    prefix, suffix = F.coalesce("prefix", F.lit("")), F.coalesce("suffix", F.lit(""))
    before = F.substring(text, F.greatest(start - F.length(prefix), F.lit(0)) + 1, F.least(start, F.length(prefix)))
    after = F.substring(text, end + 1, F.length(suffix))
    times = F.regexp_count(text, F.concat(F.lit("(?="), literal(F.concat(prefix, quote, suffix)), F.lit(")")))
    reason = (
        F.when(start.isNull() | end.isNull() | quote.isNull(), "malformed_record")
        .when(text.isNull(), "wrong_document")
        .when(F.sha2(text, 256) != F.col("doc_hash"), "document_integrity")
        .when(F.col("canonical_hash") != F.col("doc_hash"), "hash_mismatch")
        .when((start < 0) | (end <= start) | (end > F.length(text)), "out_of_bounds")
        .when(found != quote, "text_mismatch")
        .when(F.col("e_start").isNull(), "unknown_element")
        .when(~contains(F.col("e_start"), F.col("e_end"), start, end), "outside_element")
        .when(F.col("crosses"), "crosses_speaker_turn")
        .when(F.col("in_ocr"), "overlaps_ocr_text")
        .when((before != prefix) | (after != suffix), "context_mismatch")
        .when(times > 1, "ambiguous_occurrence")
    )
    return rows.select(*candidates.columns, reason.alias("reason"))


def element_problems(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, element_id, problem) rows: ids, bounds, duplicates, parents and crossings of element sets.

    elements: doc_id, element_id, type, start, end, parent_id, position.
    """
    d = documents.select("doc_id", F.length("canonical_text").alias("n"))
    p = elements.select("doc_id", F.col("element_id").alias("parent_id"), F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("position").alias("p_position")).dropDuplicates(["doc_id", "parent_id"])
    rows = elements.join(d, "doc_id", "left").join(p, ["doc_id", "parent_id"], "left").withColumn("n_same", F.count("*").over(Window.partitionBy("doc_id", "element_id")))
    derived = F.concat_ws("-", "type", "start", "end")
    found = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "wrong_document"),
        F.when(F.col("element_id") != derived, "element_id"),
        F.when((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col("n")), "out_of_bounds"),
        F.when(F.col("n_same") > 1, "duplicate"),
        F.when(F.col("parent_id").isNotNull() & F.col("p_start").isNull(), "unknown_parent"),
        F.when(F.col("p_position") >= F.col("position"), "parent_order"),
        F.when(~contains(F.col("p_start"), F.col("p_end"), F.col("start"), F.col("end")), "outside_parent"),
    ))
    own = rows.select("doc_id", "element_id", F.explode(found).alias("problem"))
    crossing = crossings(elements.where("start < end"), ["doc_id"]).select("doc_id", F.col("a_id").alias("element_id"), F.lit("crossing").alias("problem"))
    return own.unionByName(crossing)


def to_document_span(rows: DataFrame) -> DataFrame:
    """Chunk-local offsets as document offsets, with a reason where they leave the chunk (chunk_start, chunk_end)."""
    outside = (F.col("start") < 0) | (F.col("chunk_start") + F.col("end") > F.col("chunk_end")) | (F.col("end") <= F.col("start"))
    return rows.withColumns({"doc_start": F.col("chunk_start") + F.col("start"), "doc_end": F.col("chunk_start") + F.col("end"), "reason": F.when(outside, "outside_chunk")})


def narrative(elements: DataFrame, excluded_types: list[str]) -> DataFrame:
    """Elements that overlap no excluded element of their document."""
    out = elements.where(F.col("type").isin(excluded_types)).select("doc_id", "start", "end")
    rest = elements.where(~F.col("type").isin(excluded_types))
    bad = overlapping(rest.select("doc_id", "element_id", "start", "end"), out).select("doc_id", "element_id").distinct()
    return rest.join(bad, ["doc_id", "element_id"], "left_anti")

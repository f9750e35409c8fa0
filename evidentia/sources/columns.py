"""JSON and XML payloads as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def columnar(rows: DataFrame, payload: str, fields: dict[str, str]) -> DataFrame:
    """One row per position of a payload that holds an array per field; arrays of unequal length are an error.

    fields: name -> type of its elements.
    """
    schema = "struct<" + ",".join(f"`{n}`:array<{t}>" for n, t in fields.items()) + ">"
    p = F.from_json(F.col(payload), schema)
    sizes = F.array_distinct(F.array(*[F.size(p[n]) for n in fields]))
    checked = F.when(F.size(sizes) > 1, F.raise_error(F.lit("the arrays differ in length")).cast(f"array<struct<{','.join(f'`{n}`:{t}' for n, t in fields.items())}>>")).otherwise(F.arrays_zip(*[p[n].alias(n) for n in fields]))
    rest = [c for c in rows.columns if c != payload]
    return rows.select(*rest, F.posexplode(checked).alias("position", "row")).select(*rest, "position", "row.*")


def stated_count(rows: DataFrame, payload: str, field: str, stated: str) -> DataFrame:
    """Rows with a reason where an array's size is not the stated count."""
    n = F.size(F.from_json(F.get_json_object(F.col(payload), f"$.{field}"), "array<string>"))
    return rows.withColumn("reason", F.when(n.isNull(), "unreadable").when(n != F.col(stated), "row_count"))


def pointer(payload: Column, path: str) -> Column:
    """The value at a JSON pointer as text, null where there is none."""
    steps = [s.replace("~1", "/").replace("~0", "~") for s in path.split("/")[1:]]
    return F.get_json_object(payload, "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps))


def strict(payload: Column, schema: str, fields: list[str]) -> Column:
    """The struct of a payload, null unless it has exactly the fields and every one parses."""
    parsed = F.from_json(payload, schema, {"mode": "PERMISSIVE"})
    same = F.array_sort(F.json_object_keys(payload)) == F.array_sort(F.array(*[F.lit(f) for f in fields]))
    whole = F.lit(True)
    for f in fields:
        whole = whole & (parsed[f].isNotNull() | (F.get_json_object(payload, f"$.{f}").isNull()))
    return F.when(same & whole, parsed)


def ticker_map(rows: DataFrame, payload: str) -> DataFrame:
    """Registrants of a ticker map, whose keys are running numbers."""
    entries = F.from_json(F.col(payload), "map<string,struct<cik_str:long,ticker:string,title:string>>")
    return rows.select(F.explode(F.map_values(entries)).alias("e")).select(F.col("e.cik_str").alias("cik"), F.upper("e.ticker").alias("ticker"), F.col("e.title").alias("name"))


def fiscal_labels(facts: DataFrame) -> DataFrame:
    """(accession, fiscal_year, fiscal_period): null halves where facts of one filing disagree or a half is missing."""
    per = facts.groupBy("accession").agg(F.count_distinct("fy").alias("ny"), F.count_distinct("fp").alias("np"), F.max("fy").alias("fy"), F.max("fp").alias("fp"), F.count_if(F.col("fy").isNull() | F.col("fp").isNull()).alias("holes"))
    sure = (F.col("ny") == 1) & (F.col("np") == 1) & (F.col("holes") == 0)
    return per.select("accession", F.when(sure, F.col("fy")).alias("fiscal_year"), F.when(sure, F.col("fp")).alias("fiscal_period"))


def holdings(rows: DataFrame, payload: str) -> DataFrame:
    """Securities of an XML holdings report."""
    schema = "struct<invstOrSecs:struct<invstOrSec:array<struct<name:string,cusip:string,balance:double,valUSD:double>>>>"
    parsed = F.from_xml(F.col(payload), schema)
    return rows.select(*[c for c in rows.columns if c != payload], F.explode(parsed["invstOrSecs"]["invstOrSec"]).alias("h")).select("*", "h.*").drop("h")


def registrants(rows: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """(names, older pages) of registrant files: current and former names with their spans, and the pages that hold older filings."""
    schema = "struct<cik:string,name:string,tickers:array<string>,formerNames:array<struct<name:string,from:string,to:string>>,filings:struct<files:array<struct<name:string,filingCount:long,filingFrom:string,filingTo:string>>>>"
    p = rows.select(F.from_json(F.col(payload), schema).alias("p")).select("p.*").withColumn("cik", F.col("cik").cast("long"))
    now = F.array(F.struct(F.col("name"), F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("to")))
    names = p.select("cik", F.explode(F.concat(now, F.coalesce("formerNames", F.array().cast("array<struct<name:string,from:string,to:string>>")))).alias("n")).select("cik", F.col("n.name").alias("name"), F.to_date("n.from").alias("valid_from"), F.to_date("n.to").alias("valid_to"))
    pages = p.select("cik", F.explode("filings.files").alias("f")).select("cik", F.col("f.name").alias("page"), F.col("f.filingCount").alias("stated_count"), F.to_date("f.filingFrom").alias("first_on"), F.to_date("f.filingTo").alias("last_on"))
    return names, pages


def filing_index(pages: DataFrame, html: str = "html") -> DataFrame:
    """Form, acceptance time, items and document rows of filing index pages, read off labels and table rows."""
    h = F.col(html)
    label = lambda name: F.trim(F.regexp_extract(h, rf"(?is){name}\s*</div>\s*<div[^>]*>\s*([^<]+?)\s*</div>", 1))
    cells = F.regexp_extract_all(h, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    documents = F.transform(cells, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1), lambda c: F.trim(F.regexp_replace(c, r"<[^>]+>", ""))))
    return pages.select("accession", F.regexp_extract(h, r"(?is)<strong>\s*Form\s+([^<\s]+)", 1).alias("form"), label("Accepted").alias("accepted"), label("Items").alias("items"), F.filter(documents, lambda d: F.size(d) >= 4).alias("documents"))


def bundle(spark, path: str, schema: str = "doc_id string, source_document_id string, canonicalization_version string, canonical_text string, canonical_hash string, elements array<struct<element_id:string,type:string,start:int,end:int,parent_id:string>>"):
    """Canonical bundles from JSON files, one document each, with a reason where the hash does not fit the text."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.withColumn("reason", F.when(F.col("canonical_text").isNull(), "unreadable").when(F.sha2("canonical_text", 256) != F.col("canonical_hash"), "hash_mismatch"))

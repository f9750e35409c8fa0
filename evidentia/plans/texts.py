"""Queries on documents, pages, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.functions import hashing as H, text as T
from evidentia.functions.sentences import sentences as sentence_spans
from evidentia.operators import layout as L, spans as X
from evidentia.session import ship, table
from evidentia.sources.html import page_elements as elements


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents")


def normalize_n1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _docs(spark, sf_dir).select("doc_id", T.normalized(F.col("text")).alias("n"))
    return n.select("doc_id", F.length("n").cast("long").alias("n_chars"), F.sha2("n", 256).alias("hash"))


def doc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = H.doc_identity(F.col("source"), F.lit("v1"), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", name.alias("identity"), (F.length("text") == F.col("n_chars")).alias("intact"))


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.exact_groups(_docs(spark, sf_dir).select("doc_id", "text"), [F.col("text")])


def copy_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies joined by equal texts and by the assertion that each document of a source follows the one a thousand before it."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", "source")
    groups = L.exact_groups(docs, [F.col("text")]).select(F.col("doc_id").alias("a"), F.col("representative").alias("b"))
    asserted = docs.where("doc_id % 97 = 0").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 97).alias("b")).join(docs.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")
    return L.connected(groups.unionByName(asserted), docs)


def wording_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("label_id"), "text")
    texts = _docs(spark, sf_dir).select(F.col("doc_id").alias("text_id"), "text")
    return L.shingle_hits(labels, texts)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line"))


def boilerplate_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("category", T.boilerplate(F.col("line"))).where("category is not null").select("doc_id", F.col("position").cast("long").alias("position"), "category")


def line_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.repeats(_lines(spark, sf_dir), "doc_id", "line")


def line_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy(T.line_class(F.col("line")).alias("pattern")).agg(F.count("*").alias("n"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = T.occurrences(F.col("text"), "tha")
    return _docs(spark, sf_dir).where(F.col("text").contains("tha")).select("doc_id", hits.alias("h")).select("doc_id", F.size("h").cast("long").alias("n"), F.col("h")[0].cast("long").alias("first"), F.element_at("h", -1).cast("long").alias("last"))


def stated_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days written into a sentence and read back."""
    written = F.concat(F.lit("Results for the quarter ended "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" and the year ending December 31, 1999."))
    found = table(spark, sf_dir, "orders").select("o_orderkey", T.stated_dates(written).alias("d"))
    return found.select("o_orderkey", F.concat_ws(",", F.transform("d", lambda d: F.date_format(d, "yyyy-MM-dd"))).alias("stated"))


def stated_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    written = F.concat(F.lit("We report "), F.element_at(F.array(F.lit("first quarter"), F.lit("Q2"), F.lit("third-quarter"), F.lit("fourth quarter and full year")), F.quarter("o_orderdate")), F.lit(" figures"))
    stated = T.stated_periods(written)
    return o.select("o_orderkey", F.concat_ws(",", stated).alias("stated"), T.period_matches(stated, F.concat(F.lit("Q"), F.quarter(F.add_months("o_orderdate", F.when(F.col("o_orderkey") % 2 == 0, 3).otherwise(0))))).alias("matches"))


def name_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that another part's name covers with all its words."""
    ship(spark)
    named = table(spark, sf_dir, "part").select("p_partkey", T.name_tokens(F.col("p_name"), fold=False).alias("tokens"))
    types = table(spark, sf_dir, "part").select(T.significant(T.name_tokens(F.element_at(F.split("p_name", " "), 1), fold=False)).alias("wanted")).distinct()
    hits = named.join(types, T.covers(F.col("tokens"), F.col("wanted")))
    return hits.groupBy("p_partkey").agg(F.count("*").alias("n_covered"), F.array_join(F.array_sort(F.collect_set(F.array_join("wanted", " "))), ",").alias("covered"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _docs(spark, sf_dir).select("doc_id", F.explode(sentence_spans(T.normalized(F.col("text")))).alias("s"))
    return spans.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(table(spark, sf_dir, "pages"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("n_items"), F.parse_url("url", F.lit("HOST")).alias("host"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.laid_out(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def turn_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def turn_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 200 characters of a conversation that overlap a turn without lying in it."""
    turns = _turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), "turn", "start", "end").where("start < end")
    whole = turns.groupBy("doc_id").agg(F.max("end").alias("n"))
    spans = whole.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 200, F.lit(0)), F.lit(150))).alias("start")).withColumn("end", F.col("start") + 200)
    pairs = X.overlapping(spans, turns).where(~X.contains(F.col("other_start"), F.col("other_end"), F.col("start"), F.col("end")))
    return pairs.groupBy("doc_id", "start").agg(F.count("*").alias("n_turns")).select(F.col("doc_id").alias("conv_id"), F.col("start").cast("long").alias("start"), "n_turns")


def heading_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.last_of(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") != "assistant", F.col("turn"), "context")
    return rows.where("role = 'assistant'").select("conv_id", "turn", "context")


def window_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return L.packed_windows(turns, "conv_id", "turn", "n", 600)


def turn_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.operators.selection import first_opening

    out = first_opening(table(spark, sf_dir, "conversations").where("text is not null"), "conv_id", "turn", 2)
    return out.select("conv_id", F.sha2("opening", 256).alias("hash"), F.length("opening").cast("long").alias("n"))


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses against rules by path; the longest match decides."""
    from evidentia.sources.stores import robots_decision

    pages = table(spark, sf_dir, "pages").select("url").distinct()
    hosts = pages.select(F.parse_url("url", F.lit("HOST")).alias("host")).distinct()
    rules = hosts.select("host", F.explode(F.expr("array(named_struct('prefix', '/', 'allow', false), named_struct('prefix', '/en/', 'allow', true), named_struct('prefix', '/en/1', 'allow', false), named_struct('prefix', '/fr/', 'allow', true))")).alias("r")).select("host", "r.*")
    return robots_decision(pages, rules)


QUERIES = {
    f.__name__: f
    for f in (
        normalize_n1, doc_identity, exact_copies, copy_components, wording_guard, boilerplate_mask, line_repeats, line_patterns, occurrences, stated_dates, stated_periods, name_cover, sentences,
        page_elements, page_titles, turn_layout, turn_crossing, heading_context, window_pack, turn_openings, robots,
    )
}

_LINES = "lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position, unnest(string_split(text, chr(10))) AS line FROM documents)"
_TURNS = "t AS (SELECT conv_id, turn, role, text, coalesce(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM conversations), l AS (SELECT conv_id, turn, CAST(a AS BIGINT) AS s, CAST(a + length(coalesce(text, '')) AS BIGINT) AS e FROM t)"
_ANY = " OR ".join


def _has(*phrases: str) -> str:
    return "(" + _ANY(f"contains(lower(line), '{p}')" for p in phrases) + ")"


_MASKED = r"regexp_replace(text, '\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+[0-9]{1,2},\s+[0-9]{4}\b', chr(0), 'g')"
_SPACES = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_GONE = r"[\x{AD}\x{200B}\x{2060}\x{FEFF}\x00-\x08\x0E-\x1B\x7F-\x{84}\x{86}-\x{9F}]"

ORACLE_SQL = {
    "normalize_n1": f"SELECT doc_id, length(n) AS n_chars, sha256(n) AS hash FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '{_GONE}', '', 'g'), '{_SPACES}', ' ', 'g')) AS n FROM documents)",
    "doc_identity": "SELECT doc_id, source || '@v1#' || substr(sha256(text), 1, 16) AS identity, length(text) = n_chars AS intact FROM documents",
    "exact_copies": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS representative, count(*) OVER (PARTITION BY text) AS n_copies FROM documents",
    "copy_components": """WITH RECURSIVE p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id
  UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 97 AND a.doc_id % 97 = 0 UNION SELECT b.doc_id, a.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 97 AND a.doc_id % 97 = 0),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b) SELECT a AS doc_id, min(b) AS component FROM r GROUP BY 1""",
    "wording_guard": f"""WITH a AS (SELECT DISTINCT item_id, substr(m, i, 40) AS w FROM (SELECT item_id, {_MASKED} AS m FROM benchmark), unnest(range(1, length(m) - 38)) u(i)),
b AS (SELECT DISTINCT doc_id, substr(m, i, 40) AS w FROM (SELECT doc_id, {_MASKED} AS m FROM documents), unnest(range(1, length(m) - 38)) u(i))
SELECT DISTINCT item_id AS label_id, doc_id AS text_id FROM a JOIN b USING (w)""",
    "boilerplate_mask": f"""WITH {_LINES}, c AS (SELECT doc_id, position, CASE
  WHEN {_has(*T.LITIGATION)} OR ({_has(T.FORWARD)} AND {_has(*T.FORWARD_WITH)}) THEN 'safe_harbor'
  WHEN {_has(T.NON_GAAP)} AND {_has(*T.NON_GAAP_WITH)} THEN 'non_gaap_disclaimer'
  WHEN {_has(*T.TRADEMARK)} OR ({_has(T.FILED)} AND {_has(T.FILED_WITH)}) OR {_has(*T.SOLICITATION)} THEN 'repeated_legal' END AS category FROM lines)
SELECT doc_id, position, category FROM c WHERE category IS NOT NULL""",
    "line_repeats": f"WITH {_LINES} SELECT doc_id, trim(line) AS line, count(*) AS n FROM lines WHERE trim(line) <> '' AND len(regexp_split_to_array(trim(line), '\\s+')) <= 12 GROUP BY 1, 2 HAVING count(*) >= 3",
    "line_patterns": f"""WITH {_LINES}, c AS (SELECT trim(line) AS t FROM lines) SELECT CASE WHEN regexp_matches(t, '^[-_=*—]{{3,}}$') THEN 'rule' WHEN regexp_matches(t, '\\.{{4,}}\\s*\\S*$') THEN 'dot_leader'
  WHEN regexp_matches(t, '^(?:19|20)[0-9]{{2}}$') THEN NULL WHEN regexp_matches(t, '^-?\\s*[0-9]{{1,4}}\\s*-?$') THEN 'page_number' WHEN regexp_matches(t, '(?i)^(?:page\\s+)?[0-9]+\\s+of\\s+[0-9]+$') THEN 'page_of'
  WHEN regexp_matches(t, '^[$(]*[0-9][0-9,.]*[)%]*$') THEN 'numeric' END AS pattern, count(*) AS n FROM c GROUP BY 1""",
    "occurrences": "SELECT doc_id, len(h) AS n, h[1] AS first, h[len(h)] AS last FROM (SELECT doc_id, list_filter(range(0, length(text) - 2), lambda i: substr(text, i + 1, 3) = 'tha') AS h FROM documents WHERE contains(text, 'tha'))",
    "stated_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ',1999-12-31' AS stated FROM orders",
    "stated_periods": """SELECT o_orderkey, CASE quarter(o_orderdate) WHEN 1 THEN 'Q1' WHEN 2 THEN 'Q2' WHEN 3 THEN 'Q3' ELSE 'FY,Q4' END AS stated,
  quarter(o_orderdate) = quarter(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 3 MONTH ELSE o_orderdate END) AS matches FROM orders""",
    "name_cover": f"""WITH t AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS k, string_split(p_name, ' ')[1] AS f FROM part),
w AS (SELECT DISTINCT list_sort(list_distinct(list_filter(regexp_extract_all(lower(f), '[a-z0-9]+'), lambda x: x NOT IN ({', '.join(f"'{x}'" for x in T.LEGAL_FORMS)})))) AS k FROM t)
SELECT p_partkey, count(*) AS n_covered, string_agg(DISTINCT array_to_string(w.k, ' '), ',' ORDER BY array_to_string(w.k, ' ')) AS covered FROM t JOIN w ON len(w.k) > 0 AND list_has_all(t.k, w.k) GROUP BY 1""",
    "page_titles": "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<li>')) AS n_items, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages",
    "turn_layout": f"WITH {_TURNS} SELECT conv_id, turn, s AS start, e AS \"end\" FROM l",
    "turn_crossing": f"""WITH {_TURNS}, w AS (SELECT conv_id, max(e) AS n FROM l WHERE s < e GROUP BY 1), p AS (SELECT conv_id, unnest(range(0, greatest(n - 200, 0) + 1, 150)) AS a FROM w)
SELECT p.conv_id, p.a AS start, count(*) AS n_turns FROM p JOIN l ON l.conv_id = p.conv_id AND l.s < l.e AND l.s < p.a + 200 AND p.a < l.e WHERE NOT (l.s <= p.a AND p.a + 200 <= l.e) GROUP BY ALL""",
    "heading_context": "SELECT conv_id, turn, context FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role <> 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS context FROM conversations) WHERE role = 'assistant'",
    "window_pack": """WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (SELECT conv_id, turn, k, n AS used, CAST(0 AS BIGINT) AS w FROM o WHERE k = 1
  UNION ALL SELECT o.conv_id, o.turn, o.k, CASE WHEN r.used + o.n <= 600 THEN r.used + o.n ELSE o.n END, CASE WHEN r.used + o.n <= 600 THEN r.w ELSE r.w + 1 END FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1)
SELECT conv_id, turn, w AS "window" FROM r""",
    "turn_openings": "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS hash, length(string_agg(text, chr(10) ORDER BY turn)) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE text IS NOT NULL) WHERE r <= 2 GROUP BY 1",
    "robots": """WITH u AS (SELECT DISTINCT url, CASE WHEN regexp_extract(url, '://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]+([^?#]*)', 1) END AS p FROM pages)
SELECT url, CASE WHEN starts_with(p, '/en/1') THEN false WHEN starts_with(p, '/en/') OR starts_with(p, '/fr/') THEN true ELSE false END AS allowed FROM u""",
}

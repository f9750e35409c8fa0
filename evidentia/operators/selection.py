"""Splits, samples and selections with seeded hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from evidentia.functions.hashing import seeded


def home_partition(events: DataFrame, windows: list[tuple[str, str, str]], entity: str = "issuer_id") -> DataFrame:
    """Events with the partition of their issuer's earliest event; later windows' events are excluded with a reason.

    windows: (name, first quarter, last quarter) of the labels in column `quarter`.
    """
    name = F.coalesce(*[F.when(F.col("quarter").between(a, b), n) for n, a, b in windows])
    order = Window.partitionBy(entity).orderBy("period_end", "event_id")
    rows = events.withColumn("window", name).withColumn("home", F.first("window").over(order))
    fits = F.col("window").eqNullSafe(F.col("home")) & F.col("window").isNotNull()
    return rows.withColumns({"partition": F.when(fits, F.col("home")), "excluded_reason": F.when(~fits, F.when(F.col("window").isNull(), "outside_windows").otherwise("issuer_in_earlier_partition"))})


def stratified_sample(pool: DataFrame, seed: int, cap: int, size: int, stratum: str = "event_id", theme: str = "theme_id", item: str = "target_id") -> DataFrame:
    """Items by rounds: in each stratum themes take turns up to the cap, then strata take turns up to the size.

    With a fixed cap a larger size only adds items.
    """
    rows = pool.select(stratum, theme, item).distinct().withColumns({"hi": seeded(seed, F.col(item)), "ht": seeded(seed, F.concat(F.col(stratum), F.lit("/"), F.col(theme))), "hs": seeded(seed, F.col(stratum))})
    in_theme = Window.partitionBy(stratum, theme).orderBy("hi", item)
    in_stratum = Window.partitionBy(stratum).orderBy("turn", "ht", theme)
    turns = rows.withColumn("turn", F.row_number().over(in_theme)).withColumn("round", F.row_number().over(in_stratum)).where(F.col("round") <= cap)
    return turns.orderBy("round", "hs", stratum).limit(size).select(stratum, theme, item, "round")


def first_opening(blocks: DataFrame, doc: str = "doc_id", position: str = "position", n: int = 12) -> DataFrame:
    """The text of each document's first blocks, joined by line feeds."""
    ranked = blocks.withColumn("__n", F.row_number().over(Window.partitionBy(doc).orderBy(position))).where(F.col("__n") <= n)
    rows = F.array_sort(F.collect_list(F.struct("__n", "text")))
    return ranked.groupBy(doc).agg(F.concat_ws("\n", F.transform(rows, lambda r: r["text"])).alias("opening"))


def exhibit_order(exhibits: DataFrame) -> DataFrame:
    """Exhibits in the order in which they are tried: named in the filing, described as a release, lowest sequence."""
    rank = F.when(F.col("named"), 0).when(F.col("described"), 1).otherwise(2)
    return exhibits.withColumn("order", F.row_number().over(Window.partitionBy("accession").orderBy(rank, "sequence")))


def pilot(events: list[dict], seed: int, target: int, quarters: list[str], member_side: list[str] = ()) -> list[dict]:
    """A bounded greedy choice of events on the driver: every issuer, transitions, empty quarters, then the farthest from what an issuer has.

    Each step depends on the picks before it, and an evaluation pilot has some hundred candidates;
    more than 100,000 are refused. Events: event_id, issuer_id, quarter, day (ordinal).
    """
    import hashlib

    if len(events) > 100_000:
        raise ValueError("a pilot is chosen among at most 100,000 events")
    issuers = {e["issuer_id"] for e in events}
    if len(issuers) > 40 or len(events) < 20:
        raise ValueError("a pilot needs at most 40 issuers and at least 20 events")

    def h(x: str) -> str:
        return hashlib.sha256(f"{seed}:{x}".encode()).hexdigest()

    picked: list[dict] = []

    def take(e: dict, reason: str) -> None:
        if all(p["event_id"] != e["event_id"] for p in picked):
            picked.append(e | {"selection_reason": reason, "selection_order": len(picked) + 1})

    def n_quarter(q: str) -> int:
        return sum(p["quarter"] == q for p in picked)

    def n_issuer(i: str) -> int:
        return sum(p["issuer_id"] == i for p in picked)

    for issuer in sorted(issuers, key=h):
        take(min((e for e in events if e["issuer_id"] == issuer), key=lambda e: (n_quarter(e["quarter"]), h(e["event_id"]))), "issuer_coverage")
    for name in member_side:
        take(next(e for e in events if e["event_id"] == name), "transition")
    for q in quarters:
        held = [e for e in events if e["quarter"] == q]
        if held and not n_quarter(q):
            take(min(held, key=lambda e: (n_issuer(e["issuer_id"]), h(e["event_id"]))), "quarter_coverage")
    if len(picked) > target:
        raise ValueError("the mandatory events are more than the target")
    while len(picked) < min(target, len(events)):
        names = {p["event_id"] for p in picked}
        rest = [e for e in events if e["event_id"] not in names]
        fewest = min(n_issuer(e["issuer_id"]) for e in rest)
        near = [e for e in rest if n_issuer(e["issuer_id"]) == fewest]
        far = {e["event_id"]: min((abs(e["day"] - p["day"]) for p in picked if p["issuer_id"] == e["issuer_id"]), default=0) for e in near}
        take(min(near, key=lambda e: (-far[e["event_id"]], h(e["event_id"]))), "fill")
    return picked

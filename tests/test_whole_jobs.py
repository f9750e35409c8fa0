"""Queries on small tables with keys beyond those of the smallest test data."""

from __future__ import annotations

import datetime as dt

from evidentia.plans import registry


def saved(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def answer(spark, folder, name):
    return sorted((tuple(r) for r in registry.QUERIES[name](spark, folder).collect()), key=repr)


def test_release_of_all_customers(spark, tmp_path):
    day, at = dt.date(1995, 1, 1), dt.datetime(2024, 1, 5, 12)
    folder = saved(
        spark, tmp_path,
        orders=([(31, 150, day), (62, 151, day), (93, 9000, day)], "o_orderkey long, o_custkey long, o_orderdate date"),
        events=([(4, 150, "purchase", at), (5, 151, "purchase", at), (7, 9000, "purchase", at), (8, 9000, "view", at)], "event_id long, user_id long, event_type string, ts timestamp"),
    )
    assert answer(spark, folder, "release_slots") == [(150, 31, "2024-01-02", None), (151, 62, "2024-01-03", None), (9000, 93, "2024-01-04", None)]
    assert answer(spark, folder, "release_candidates") == [(31, 4, "2024-01-05"), (62, 5, "2024-01-05"), (93, 7, "2024-01-05")]
    assert answer(spark, folder, "release_outcomes") == [(31, 4, "stated_period", None), (62, 5, "sole_candidate", None), (93, 7, "sole_candidate", None)]


def test_crossing_pairs_of_all_customers(spark, tmp_path):
    def order(key, customer, start, length):
        return key, customer, dt.date(1992, 1, 1) + dt.timedelta(days=start), 2000.0 * (length - 1), "F"

    rows = [order(10 * c + i, c, start, length) for c in range(1, 12) for i, (start, length) in enumerate([(0, 10), (5, 10), (6, 3), (9, 20), (40, 2)])]
    folder = saved(spark, tmp_path, orders=(rows, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderstatus string"))
    assert answer(spark, folder, "crossing_pairs") == sorted(((c, 10 * c + a, 10 * c + b) for c in range(1, 12) for a, b in [(0, 1), (0, 3), (1, 3)]), key=repr)


def test_eligibility_by_all_intervals_of_the_own_user(spark, tmp_path):
    placed, first, month = dt.datetime(1995, 1, 1), 1704067200, 30 * 86400

    def order(customer, at):
        """An order whose shifted time is `at`; its number is its key, since the time follows from both."""
        away = int((at - dt.datetime(1970, 1, 1)).total_seconds()) - first - int((placed - dt.datetime(1970, 1, 1)).total_seconds())
        return away * pow(613, -1, month) % month, customer, placed.date(), "3-MEDIUM", "O"

    wanted = [
        (200, dt.datetime(2024, 1, 2, 12), "not_a_member"), (200, dt.datetime(2024, 1, 5, 12), None), (200, dt.datetime(2024, 1, 10, 10), "membership_unordered"),
        (200, dt.datetime(2024, 1, 10, 20), "not_a_member"), (200, dt.datetime(2024, 1, 15, 12), "not_a_member"), (200, dt.datetime(2024, 1, 25, 12), None),
        (300, dt.datetime(2024, 1, 5, 13), "not_a_member"), (300, dt.datetime(2024, 1, 25, 13), None), (350, dt.datetime(2024, 1, 25, 14), "not_a_member"),
    ]
    log = [(200, "signup", 3), (200, "error", 10), (200, "signup", 20), (300, "error", 3), (300, "signup", 12), (50, "signup", 1)]
    folder = saved(
        spark, tmp_path,
        orders=([order(c, at) for c, at, _ in wanted], "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string, o_orderstatus string"),
        events=([(i, u, kind, dt.datetime(2024, 1, day, 15)) for i, (u, kind, day) in enumerate(log)], "event_id long, user_id long, event_type string, ts timestamp"),
    )
    status = {None: "eligible", "not_a_member": "ineligible", "membership_unordered": "ambiguous"}
    assert answer(spark, folder, "eligibility_cascade") == sorted(((order(c, at)[0], status[why], why) for c, at, why in wanted), key=repr)

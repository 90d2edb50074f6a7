"""Time outside of outages where a day has very many of them: by a sweep, against plain Python, and no list of a day's outages in any row."""

import random

import pytest

from zonelake.operators import intervals as iv
from zonelake.plans import queries, service_queries  # noqa: F401

SPAN = "k string, id long, a_us long, b_us long"


def test_sweep_equals_plain(spark):
    """Overlapping rows, empty ones, holes that cover bins, begin or end with a row; keys without holes, null keys, holes of no row."""
    rng = random.Random(2)
    for bin_us in (7, 50, 1000):
        holes, t = [], 0
        while t < 900:
            t += rng.choice((1, 2, 5, 40))
            holes.append(("a", t, t := t + rng.choice((1, 1, 3, 60))))
        holes.append(("none", 3, 9))
        rows = [(rng.choice(("a", "a", "a", "b", None)), i, a, a + rng.choice((0, 0, 1, 2, 10, 300))) for i, a in enumerate(rng.randrange(900) for _ in range(300))]
        df, dark = spark.createDataFrame(rows, SPAN), spark.createDataFrame([*holes, (None, 0, 500)], "k string, a_us long, b_us long")
        free = lambda k, a, b: [t for t in range(a, b) if not any(h[0] == k and h[1] <= t < h[2] for h in holes)]
        want = {i: free(k, a, b) for k, i, a, b in rows}
        seen = iv.observed(df, dark, ["k"], bin_us).groupBy("id").agg({"seen_us": "sum"}).collect()
        assert {r[0]: r[1] for r in seen} == {i: len(x) for i, x in want.items()}
        assert iv.observed(df, dark, ["k"], bin_us).where("once").count() == len(rows)
        parts = {i: [] for i in want}
        for r in iv.subtract(df, dark, ["k"], bin_us).select("id", "a_us", "b_us").collect():
            parts[r.id] += range(r.a_us, r.b_us)
        assert {i: sorted(x) for i, x in parts.items()} == want


@pytest.mark.parametrize("name", ["duration_where", "report_totals", "time_weighted", "series_charts", "time_weighted_unlimited_hold", "occupancy_report"])
def test_no_row_carries_the_outages_of_its_day(spark, name):
    """A day's outages in a list beside each of its readings are as much work as outages times readings."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "__holes" not in plan

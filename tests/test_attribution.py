"""Attribution, outcomes and coverage on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from tallywright.operators import attribution as A


@pytest.mark.parametrize(("primary", "all_", "want"), [
    (["D"], ["D", "R", "R", "R"], "D"), (["D", "R"], ["D"], "bipartisan"), ([], ["D", "D"], "D"), (["unknown"], ["R", "R"], "R"), (["other"], [], "unknown"), ([], ["D", "R"], "bipartisan"),
])
def test_attribute(spark, primary, all_, want):
    rows = [(1, p, True) for p in primary] + [(1, p, False) for p in all_] + [(2, None, None)]
    got = {r.item: r.sponsor_group for r in A.attribute(spark.createDataFrame(rows, "item int, grp string, is_primary boolean"), "item").collect()}
    assert got == {1: want, 2: "unknown"}


def test_as_of_ladder(spark):
    i = spark.createDataFrame([("p", "2018-01-01", "2022-12-31", "D", 1), ("p", "2023-01-01", None, "R", 2), ("f", "2030-01-01", None, "R", 3), ("b", "2010-01-01", "2011-01-01", "D", 4)], "person string, s string, e string, v string, o int")
    probes = spark.createDataFrame([(1, "p", "2020-05-01"), (2, "p", "2025-05-01"), (3, "x", "2020-01-01"), (4, "f", "2020-01-01"), (5, "b", "2020-01-01"), (6, "p", None)], "id int, person string, at string")
    got = {r.id: r.found for r in A.as_of(probes, i, "person", "at", "s", "e", "v", "o", "id").collect()}
    assert got == {1: "D", 2: "R", 3: "unknown", 4: "R", 5: "D", 6: "R"}


def test_latest_membership_tie_goes_to_the_later_row(spark):
    m = spark.createDataFrame([("a", "2020", "D", 1), ("a", "2020", "R", 2), ("b", None, "D", 3), ("b", "2001", "R", 4)], "person string, s string, v string, o int")
    assert {r.person: r.v for r in A.latest_membership(m, "person", "s", "v", "o").collect()} == {"a": "R", "b": "R"}


def test_nearest_ancestor_with_cycle_and_depth(spark):
    rows = [("s", "Upper", None), ("c", "committee", "s"), ("x", "committee", "y"), ("y", "committee", "x")] + [(f"d{i}", "sub", f"d{i - 1}" if i else "c") for i in range(20)]
    got = {r.id: r.chamber for r in A.nearest_ancestor(spark.createDataFrame(rows, "id string, class string, parent string"), ["upper", "lower"]).collect()}
    assert got["c"] == got["s"] == got["d19"] == "upper" and got["x"] == got["y"] == "unknown"


@pytest.mark.parametrize(("classes", "chambers", "want"), [
    (["introduction"], [], "introduced_or_pending"), (["passage"], ["upper"], "passed_one_chamber"), (["passage"], ["upper", "lower"], "passed_legislature"), (["executive-veto"], ["upper"], "vetoed"),
    (["became-law", "executive-veto"], [], "became_law"), (["executive-receipt"], [], "sent_to_executive"), (["withdrawal"], [], "recorded_failure_or_withdrawal"), ([], [], "no_action_data"), (["passage"], ["unknown"], "passed_one_chamber"),
])
def test_recorded_outcome(spark, classes, chambers, want):
    row = spark.createDataFrame([(classes, chambers)], "c array<string>, p array<string>")
    assert row.select(A.recorded_outcome(F.col("c"), F.col("p")).alias("o")).first().o == want


def test_law_eligible(spark):
    t = spark.createDataFrame([("bill",), ("resolution",), ("bill|joint resolution",), (None,), ("Bill|appropriation",)], "c string")
    assert [r.e for r in t.select(A.is_law_eligible(F.col("c")).alias("e")).collect()] == [True, False, False, False, True]


def test_outcome_rates(spark):
    rows = [(u, g, 3, "became_law" if i < k else "introduced_or_pending", i < k, 0) for u in ("TX", "OH") for g, k in (("D", 100), ("R", 50)) for i in range(500)]
    t = A.outcome_rates(spark.createDataFrame(rows, "unit string, grp string, n_actions int, recorded_outcome string, recorded_enacted boolean, n_votes int"), 500, 0.8)
    m = {r.grp: r for r in A.matched_rates(t, ["D", "R"]).collect()}
    assert (m["D"].mean_enactment_rate, m["R"].mean_enactment_rate, m["D"].n_units) == (0.2, 0.1, 2) and t.filter("reliable").count() == 4


def test_rollcall(spark):
    v = spark.createDataFrame([("v", "TX", "D", "D", "yes", 20), ("v", "TX", "D", "R", "yes", 5), ("v", "TX", "D", "R", "no", 15), ("w", "TX", "D", "D", "yes", 3)], "vote_id string, unit string, sponsor_grp string, voter_grp string, opt string, n long")
    got = {(r.sponsor_grp, r.voter_grp): r.mean_yes_share for r in A.rollcall_support(v, v.select("vote_id").distinct(), ("D", "R"), 10).collect()}
    assert got == {("D", "D"): 1.0, ("D", "R"): 0.25}


def test_reconcile(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, h string")
    old = spark.createDataFrame([("b", "2"), ("c", "4"), ("d", "5")], "name string, h string")
    assert {r.name: r.state for r in A.reconcile(new, old, "name", "h").collect()} == {"a": "added", "b": "shared", "c": "revised", "d": "deleted"}

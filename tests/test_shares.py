"""Share, peer, vector and trend operators on small tables with known results."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywright.operators import peers, shares, trends


def counts(spark, rows, cols="unit string, grp string, category int, n long"):
    return spark.createDataFrame(rows, cols)


def test_shares_leave_out_null_categories(spark):
    t = shares.shares(counts(spark, [("TX", "D", 1, 5), ("TX", "D", 5, 5), ("TX", "D", None, 90)]), ["unit", "grp"]).collect()
    assert sorted(r.share for r in t) == [0.5, 0.5]


def test_equal_unit_against_pooled(spark):
    c = counts(spark, [("TX", "D", 5, 100), ("TX", "R", 1, 100), ("VT", "D", 1, 1), ("VT", "R", 1, 1), ("OH", "D", 5, 40)])
    equal = {r.category: r for r in shares.emphasis(c, ["D", "R"]).collect()}
    assert equal[5].D == 0.5 and equal[5].n_units == 2 and equal[5].gap == 0.5
    pooled = {r.category: r for r in shares.emphasis(c.filter("unit <> 'OH'"), ["D", "R"], equal_unit=False).collect()}
    assert pooled[5].D == pytest.approx(100 / 101)


def test_other_groups_are_no_part(spark):
    c = counts(spark, [("TX", "D", 5, 60), ("TX", "D", 1, 40), ("TX", "R", 5, 10), ("TX", "R", 1, 90), ("TX", "other", 5, 100)])
    r = next(r for r in shares.emphasis(c, ["D", "R"]).collect() if r.category == 5)
    assert (r.D, r.R, r.n_D, r.n_R) == (0.6, 0.1, 60, 10) and r.gap == pytest.approx(0.5)


def test_vectors_sum_over_splits_and_have_a_floor(spark):
    c = counts(spark, [("TN", "D", 1, 30), ("TN", "D", 5, 10), ("TN", "D", 1, 5), ("TN", "D", 5, 55), ("RI", "D", 1, 2)])
    v = {(r.unit, r.category): r.share for r in shares.vectors(c, 30).collect()}
    assert v == {("TN", 1): 0.35, ("TN", 5): 0.65}


def test_divergence_fills_missing_sides(spark):
    stated = spark.createDataFrame([(12, 0.07, 0.05), (19, 0.01, 0.02)], "category int, D double, R double")
    revealed = spark.createDataFrame([(12, "D", 0.14, 10)], "category int, grp string, share double, n long")
    got = {(r.category, r.grp): r.stated_minus_revealed for r in shares.divergence(stated, revealed, ["D", "R"]).collect()}
    assert got[12, "D"] == pytest.approx(-0.07) and got[19, "R"] == pytest.approx(0.02)


VEC = [("TX", "D", 1, 0.8), ("TX", "D", 3, 0.2), ("OH", "D", 1, 0.2), ("OH", "D", 3, 0.8), ("VT", "D", 1, 0.2), ("VT", "D", 3, 0.8)]


def vec(spark, rows=VEC):
    return spark.createDataFrame(rows, "unit string, grp string, category int, share double")


def test_focus_and_centroid(spark):
    f = {r.unit: r for r in peers.focus(vec(spark)).collect()}
    assert (f["TX"].focus, f["TX"].focus_share, f["TX"].peer_share) == (1, 0.8, pytest.approx(0.2)) and f["TX"].overemphasis == pytest.approx(0.6)
    c = {r.unit: r for r in peers.to_centroid(vec(spark)).collect()}
    assert c["TX"].distinctive == 1 and c["TX"].distance > c["OH"].distance


def test_single_unit_has_no_peers(spark):
    r = peers.focus(vec(spark, [("TX", "D", 1, 1.0)])).first()
    assert r.distance is None and r.focus is None
    assert peers.outliers(vec(spark, [("TX", "D", 1, 1.0)])).count() == 0


def test_outlier_ties_go_to_what_the_unit_holds_more_of(spark):
    assert {r.unit: r.distinctive for r in peers.outliers(vec(spark)).collect()}["TX"] == 1


def test_dispersion_pairs_and_coherence(spark):
    rows = [(u, g, c, s) for g, base in (("D", (0.8, 0.2)), ("R", (0.2, 0.8))) for u, e in (("TX", 0), ("OH", 0.02), ("VT", 0.04)) for c, s in ((1, base[0] - e), (3, base[1] + e))]
    d = {r.grp: r for r in peers.dispersion(vec(spark, rows)).collect()}
    assert d["D"].n_pairs == 3 and d["D"].n_units == 3
    assert peers.coherence(vec(spark, rows)).first().within_over_between < 0.1


def test_zero_vectors_have_no_distance(spark):
    r = peers.dispersion(vec(spark, [("A", "D", 1, 0.0), ("B", "D", 1, 1.0), ("C", "D", 1, 1.0)])).first()
    assert r.n_pairs == 1 and r.mean_distance == pytest.approx(0)


def test_q_values(spark):
    t = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.20])], "i int, p_value double")
    q = [r.q_value for r in trends.with_q_values(t).orderBy("i").collect()]
    assert q == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.20])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=0, max_size=8))
def test_sign_flip_is_a_probability(values):
    p = trends.sign_flip(np.array(values), 7, 200)
    assert 0 < p <= 1 and (len(values) > 1 or p == 1)


def test_trends(spark):
    rows = [(f"S{u}", g, y, c, n) for u in range(6) for g in "DR" for y in range(2018, 2026) for c, n in ((1, 20 if y < 2022 else 40), (2, 80 if y < 2022 else 60))]
    c = spark.createDataFrame(rows, "unit string, grp string, yr int, category int, n long")
    r = trends.group_trends(c, [2018, 2019], [2024, 2025], 100, 1, 500).filter("category = 1 AND grp = 'D'").first()
    assert r.early_share == pytest.approx(0.2) and r.late_share == pytest.approx(0.4) and r.change == pytest.approx(0.2) and r.slope_per_year > 0 and r.q_value < 0.1
    u = trends.unit_trends(c, list(range(2018, 2026)), 50, 5)
    assert u.count() == 24 and u.first().n_years == 8
    assert trends.unit_trends(c, list(range(2018, 2026)), 1000, 5).count() == 0


def test_unit_trends_keep_zero_years(spark):
    rows = [("TX", "D", y, 2, 60) for y in range(2018, 2024)] + [("TX", "D", 2023, 1, 60)]
    c = spark.createDataFrame(rows, "unit string, grp string, yr int, category int, n long")
    assert trends.unit_trends(c, list(range(2018, 2026)), 50, 5).filter("category = 1").first().first_share == 0


def test_null_model_keeps_only_clear_outliers(spark):
    rows = [(u, "D", c, s) for u in ("A", "B", "C", "D") for c, s in ((1, 0.5), (2, 0.5))] + [("TX", "D", 1, 0.95), ("TX", "D", 2, 0.05)]
    sizes = spark.createDataFrame([(u, "D", 1000) for u in ("A", "B", "C", "D", "TX")], "unit string, grp string, n long")
    got = trends.null_distances(vec(spark, rows), sizes, 5, 300).collect()
    tx = next(r for r in got if r.unit == "TX")
    assert tx.distance > tx.null_p95 and tx.n_observations == 1000


def test_empty_tables(spark):
    e = counts(spark, [])
    assert shares.emphasis(e, ["D", "R"]).count() == 0 and shares.vectors(e).count() == 0
    v = vec(spark, [])
    for f in (peers.focus, peers.outliers, peers.to_centroid, peers.dispersion, peers.divisive, peers.coherence):
        assert f(v).count() == 0
    assert trends.dispersion_gap(v, 1, 10).count() == 0


def test_shares_sum_to_one(spark):
    rng = np.random.default_rng(3)
    c = counts(spark, [(f"u{a}", g, int(k), int(rng.integers(0, 9))) for a in range(5) for g in "DR" for k in range(4)])
    s = shares.vectors(c, 1).groupBy("unit", "grp").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in s)

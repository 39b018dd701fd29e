"""Share, peer, vector and trend queries: units are nations, groups order states, categories order priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import peers, shares, trends
from .common import query, rounded, table

GROUPS = ["F", "O"]
EARLY, LATE = [1995, 1996], [1999, 2000]


def counts(spark: SparkSession, d: str) -> DataFrame:
    """unit, grp, category, yr, n: what every query here starts from, aggregated once before anything else."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("yr"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "o_orderstatus", "o_orderpriority", "yr").agg(F.count("*").alias("n"))
    return rows.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("unit"), F.col("o_orderstatus").alias("grp"), F.col("o_orderpriority").alias("category"), "yr", "n")


COUNTS = """counts AS (SELECT n_name AS unit, o_orderstatus AS grp, o_orderpriority AS category, CAST(year(o_orderdate) AS INT) AS yr, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
MAJOR = COUNTS + """, major AS (SELECT * FROM counts WHERE grp IN ('F', 'O') AND unit IN
  (SELECT unit FROM counts WHERE grp IN ('F', 'O') GROUP BY unit HAVING count(DISTINCT grp) = 2))"""
DENSE = MAJOR + """, by_unit AS (SELECT unit, grp, category, sum(n)::BIGINT AS n FROM major GROUP BY ALL),
  tot AS (SELECT unit, grp, sum(n)::BIGINT AS t FROM by_unit GROUP BY ALL),
  vec AS (SELECT t.unit, t.grp, c.category, coalesce(b.n / t.t, 0.0) AS share FROM tot t CROSS JOIN (SELECT DISTINCT category FROM by_unit) c
    LEFT JOIN by_unit b ON b.unit = t.unit AND b.grp = t.grp AND b.category = c.category)"""


def vec(spark: SparkSession, d: str) -> DataFrame:
    return shares.vectors(shares.in_matched_units(counts(spark, d), GROUPS))


@query(f"""WITH {DENSE}
SELECT category, round(avg(share) FILTER (grp = 'F'), 6) AS f, round(avg(share) FILTER (grp = 'O'), 6) AS o,
  round(avg(share) FILTER (grp = 'F') - avg(share) FILTER (grp = 'O'), 6) AS gap,
  (SELECT sum(n)::BIGINT FROM major m WHERE m.category = vec.category AND grp = 'F') AS n_f, (SELECT sum(n)::BIGINT FROM major m WHERE m.category = vec.category AND grp = 'O') AS n_o,
  (SELECT count(DISTINCT unit) FROM major) AS n_units FROM vec GROUP BY category""")
def equal_unit_emphasis(spark, d):
    """AG5, PF1, PF2, PF12, RS1, RS4, AG13: mean share by group over matched units."""
    out = shares.emphasis(counts(spark, d), GROUPS).withColumnsRenamed({"F": "f", "O": "o", "n_F": "n_f", "n_O": "n_o"})
    return rounded(out, "f", "o", "gap")


@query(f"""WITH {COUNTS}, m AS (SELECT * FROM counts WHERE grp IN ('F', 'O')),
g AS (SELECT grp, category, sum(n)::BIGINT AS n FROM m GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY grp) AS share FROM g)
SELECT category, round(max(share) FILTER (grp = 'F'), 6) AS f, round(max(share) FILTER (grp = 'O'), 6) AS o, round(max(share) FILTER (grp = 'F') - max(share) FILTER (grp = 'O'), 6) AS gap,
  max(n) FILTER (grp = 'F') AS n_f, max(n) FILTER (grp = 'O') AS n_o, (SELECT count(DISTINCT unit) FROM m) AS n_units FROM s GROUP BY category""")
def pooled_emphasis(spark, d):
    """AG6: share of summed counts."""
    out = shares.emphasis(counts(spark, d), GROUPS, equal_unit=False).withColumnsRenamed({"F": "f", "O": "o", "n_F": "n_f", "n_O": "n_o"})
    return rounded(out, "f", "o", "gap")


@query(f"""WITH {COUNTS}, g AS (SELECT unit, grp, category, sum(n)::BIGINT AS n FROM counts GROUP BY ALL)
SELECT unit, grp, category, n, round(n / sum(n) OVER (PARTITION BY unit, grp), 6) AS share FROM g""")
def emphasis_by_unit(spark, d):
    """AG1-AG4, WN1, J6: share of each category in each unit and group."""
    return rounded(shares.shares(counts(spark, d), ["unit", "grp"]), "share")


@query(f"""WITH {DENSE}, s AS (SELECT grp, category, avg(share) AS share FROM vec GROUP BY ALL), k AS (SELECT grp, category, sum(n)::BIGINT AS n FROM major GROUP BY ALL),
u AS (SELECT grp, count(DISTINCT unit) AS n_units FROM major GROUP BY ALL)
SELECT s.grp, s.category, round(s.share, 6) AS share, coalesce(k.n, 0) AS n, n_units FROM s LEFT JOIN k USING (grp, category) JOIN u USING (grp)""")
def group_emphasis(spark, d):
    """AG7, J8, ST8: long form over matched units."""
    c = counts(spark, d).filter(F.col("grp").isin(GROUPS))
    return rounded(shares.group_emphasis(c, shares.matched_units(c, GROUPS)), "share")


@query(f"""WITH {DENSE}, st AS (SELECT category, grp, avg(share) AS x FROM vec GROUP BY ALL),
rv AS (SELECT grp, category, sum(n)::BIGINT AS n FROM counts WHERE yr >= 1999 AND category <> '5-LOW' GROUP BY ALL),
rs AS (SELECT *, n / sum(n) OVER (PARTITION BY grp) AS y FROM rv)
SELECT coalesce(st.category, rs.category) AS category, coalesce(st.grp, rs.grp) AS grp, round(coalesce(x, 0), 6) AS stated_share, round(coalesce(y, 0), 6) AS revealed_share,
  coalesce(n, 0) AS n, round(coalesce(x, 0) - coalesce(y, 0), 6) AS stated_minus_revealed FROM st FULL JOIN rs ON st.category = rs.category AND st.grp = rs.grp""")
def divergence(spark, d):
    """ST9, RS3, J4: all years' mean shares against the pooled shares of recent ones."""
    c = counts(spark, d)
    revealed = shares.group_emphasis(c.filter("yr >= 1999 AND category <> '5-LOW'"), equal_unit=False)
    return rounded(shares.divergence(shares.emphasis(c, GROUPS), revealed, GROUPS), "stated_share", "revealed_share", "stated_minus_revealed")


@query(f"""WITH {DENSE}, x AS (SELECT * FROM vec WHERE category = '1-URGENT')
SELECT unit, grp, round(share, 6) AS share, round((sum(share) OVER w - share) / nullif(count(*) OVER w - 1, 0), 6) AS peer_share,
  round(share - (sum(share) OVER w - share) / nullif(count(*) OVER w - 1, 0), 6) AS overemphasis FROM x WINDOW w AS (PARTITION BY grp)""")
def leave_one_out_share(spark, d):
    """WN2: each unit's share of one category against the mean of the others."""
    v = vec(spark, d).filter("category = '1-URGENT'").withColumn("peer_share", peers.leave_one_out("share", ["grp"]))
    return rounded(v.select("unit", "grp", "share", "peer_share", (F.col("share") - F.col("peer_share")).alias("overemphasis")), "share", "peer_share", "overemphasis")


PEER = DENSE + """, p AS (SELECT *, (sum(share) OVER w - share) / nullif(count(*) OVER w - 1, 0) AS peer FROM vec WINDOW w AS (PARTITION BY grp, category))"""


@query(f"""WITH {PEER}, r AS (SELECT *, row_number() OVER (PARTITION BY unit, grp ORDER BY share - peer DESC, category) AS k,
  row_number() OVER (PARTITION BY unit, grp ORDER BY share DESC, category) AS h FROM p)
SELECT unit, grp, round(1 - sum(share * peer) / sqrt(sum(share * share) * sum(peer * peer)), 6) AS distance, max(category) FILTER (k = 1) AS focus,
  round(max(share) FILTER (k = 1), 6) AS focus_share, round(max(peer) FILTER (k = 1), 6) AS peer_share, round(max(share - peer) FILTER (k = 1), 6) AS overemphasis,
  string_agg(category || ' (' || CAST(round_even(share * 100, 0)::INT AS VARCHAR) || '%)', '; ' ORDER BY h) FILTER (h <= 3 AND share > 0) AS top
FROM r GROUP BY unit, grp""")
def peer_focus(spark, d):
    """WN3, WN5, WN11, SF34, SF37: vectors against leave-one-out means."""
    return rounded(peers.focus(vec(spark, d)), "distance", "focus_share", "peer_share", "overemphasis")


@query(f"""WITH {PEER}, r AS (SELECT *, row_number() OVER (PARTITION BY unit, grp ORDER BY round(abs(share - peer), 12) DESC, share <= peer, category) AS k FROM p)
SELECT unit, grp, round(1 - sum(share * peer) / sqrt(sum(share * share) * sum(peer * peer)), 6) AS distance, max(category) FILTER (k = 1) AS distinctive,
  round(max(share) FILTER (k = 1), 6) AS share, round(max(peer) FILTER (k = 1), 6) AS peer_share, round(max(share - peer) FILTER (k = 1), 6) AS difference FROM r GROUP BY unit, grp""")
def unit_outliers(spark, d):
    """WN4, WN6: distance from peers and the category that departs most."""
    return rounded(peers.outliers(vec(spark, d)), "distance", "share", "peer_share", "difference")


@query(f"""WITH {DENSE}, p AS (SELECT *, avg(share) OVER (PARTITION BY grp, category) AS mean FROM vec),
r AS (SELECT *, row_number() OVER (PARTITION BY unit, grp ORDER BY round(abs(share - mean), 12) DESC, category) AS k FROM p)
SELECT unit, grp, round(1 - sum(share * mean) / sqrt(sum(share * share) * sum(mean * mean)), 6) AS distance, max(category) FILTER (k = 1) AS distinctive,
  round(max(share) FILTER (k = 1), 6) AS share, round(max(mean) FILTER (k = 1), 6) AS mean_share FROM r GROUP BY unit, grp""")
def centroid_distance(spark, d):
    """WN7: distance from the group's mean vector."""
    return rounded(peers.to_centroid(vec(spark, d)), "distance", "share", "mean_share")


PAIRS = DENSE + """, pr AS (SELECT a.unit AS ua, a.grp AS ga, b.unit AS ub, b.grp AS gb, 1 - sum(a.share * b.share) / sqrt(sum(a.share * a.share) * sum(b.share * b.share)) AS dist
  FROM vec a JOIN vec b ON a.category = b.category AND ((a.grp < b.grp AND a.unit <> b.unit) OR (a.grp = b.grp AND a.unit < b.unit)) GROUP BY ALL)"""


@query(f"""WITH {PAIRS} SELECT ga AS grp, (SELECT count(DISTINCT unit) FROM vec WHERE grp = ga) AS n_units, count(*) AS n_pairs, round(avg(dist), 6) AS mean_distance,
  round(median(dist), 6) AS median_distance, round(quantile_cont(dist, 0.9), 6) AS p90_distance FROM pr WHERE ga = gb GROUP BY ga""")
def dispersion(spark, d):
    """ST6, J13, AG21: pairwise distances within groups."""
    return rounded(peers.dispersion(vec(spark, d)), "mean_distance", "median_distance", "p90_distance")


@query(f"""WITH {PAIRS}, w AS (SELECT ga, avg(dist) AS x FROM pr WHERE ga = gb GROUP BY ga), b AS (SELECT avg(dist) AS y FROM pr WHERE ga <> gb)
SELECT round((SELECT avg(x) FROM w), 6) AS mean_within, round((SELECT x FROM w WHERE ga = 'F'), 6) AS within_first, round((SELECT x FROM w WHERE ga = 'O'), 6) AS within_second,
  round(y, 6) AS "between", round((SELECT avg(x) FROM w) / y, 6) AS within_over_between FROM b""")
def coherence(spark, d):
    """ST7, J14: within-group against between-group distance."""
    return rounded(peers.coherence(vec(spark, d)), "mean_within", "within_first", "within_second", "between", "within_over_between")


@query(f"""WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY grp, category ORDER BY share DESC, unit) AS k FROM vec)
SELECT grp, category, count(*) AS n_units, round(avg(share), 6) AS mean_share, round(stddev_samp(share), 6) AS sd_share, max(unit) FILTER (k = 1) AS max_unit,
  round(max(share), 6) AS max_share, round(min(share), 6) AS min_share FROM r GROUP BY ALL""")
def divisive_categories(spark, d):
    """AG22, SO1: spread of each category over units."""
    return rounded(peers.divisive(vec(spark, d)), "mean_share", "sd_share", "max_share", "min_share")


PAIRED = COUNTS + """, pd AS (SELECT *, CASE WHEN yr IN (1995, 1996) THEN 'e' WHEN yr IN (1999, 2000) THEN 'l' END AS p FROM counts WHERE yr IN (1995, 1996, 1999, 2000)),
  tt AS (SELECT unit, grp, sum(n) FILTER (p = 'e') AS te, sum(n) FILTER (p = 'l') AS tl FROM pd GROUP BY ALL HAVING te >= 5 AND tl >= 5),
  ct AS (SELECT unit, grp, category, coalesce(sum(n) FILTER (p = 'e'), 0) AS ne, coalesce(sum(n) FILTER (p = 'l'), 0) AS nl FROM pd GROUP BY ALL),
  ps AS (SELECT tt.unit, tt.grp, g.category, coalesce(ne, 0)::BIGINT / te::BIGINT AS early, coalesce(nl, 0)::BIGINT / tl::BIGINT AS late FROM tt JOIN (SELECT DISTINCT grp, category FROM pd) g USING (grp)
    LEFT JOIN ct ON ct.unit = tt.unit AND ct.grp = tt.grp AND ct.category = g.category)"""


@query(f"WITH {PAIRED} SELECT unit, grp, category, round(early, 6) AS early, round(late, 6) AS late, round(late - early, 6) AS change FROM ps")
def paired_shares(spark, d):
    """ST2, RS2: early and late shares of units with enough in both periods."""
    return rounded(trends.paired_shares(counts(spark, d), EARLY, LATE, 5), "early", "late", "change")


@query(f"""WITH {PAIRED}, a AS (SELECT grp, category, count(*) AS n_units, avg(early) AS early_share, avg(late) AS late_share, avg(late - early) AS change, stddev_samp(late - early) / sqrt(count(*)) AS se FROM ps GROUP BY ALL),
b AS (SELECT *, least(1.0, 1.0 / (1 + abs(change / nullif(se, 0)))) AS p FROM a), c AS (SELECT *, row_number() OVER (ORDER BY p, grp, category) AS k, count(*) OVER () AS m FROM b)
SELECT grp, category, n_units, round(early_share, 6) AS early_share, round(late_share, 6) AS late_share, round(change, 6) AS change, round(se, 6) AS se, round(p, 6) AS p_value,
  round(least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM c""")
def change_with_q_values(spark, d):
    """WN12, AG27: mean change with paired error and step-up q-values of a given p."""
    a = trends.paired_shares(counts(spark, d), EARLY, LATE, 5).groupBy("grp", "category").agg(
        F.count("*").alias("n_units"), F.avg("early").alias("early_share"), F.avg("late").alias("late_share"), F.avg("change").alias("change"), (F.stddev_samp("change") / F.sqrt(F.count("*"))).alias("se"))
    a = a.withColumn("p_value", F.least(F.lit(1.0), 1 / (1 + F.abs(F.col("change") / F.nullif(F.col("se"), F.lit(0.0))))))
    return rounded(trends.with_q_values(a), "early_share", "late_share", "change", "se", "p_value", "q_value")


@query(f"""WITH {COUNTS}, y AS (SELECT grp, yr, category, sum(n)::BIGINT AS n FROM counts WHERE yr BETWEEN 1995 AND 2000 GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY grp, yr) AS share FROM y)
SELECT grp, category, count(*) AS n_years, round(regr_slope(share, yr), 8) AS slope_per_year FROM s GROUP BY ALL HAVING count(*) > 1""")
def group_slopes(spark, d):
    """AG25: slope over the years observed."""
    return rounded(trends.group_slopes(counts(spark, d).filter("yr BETWEEN 1995 AND 2000")), "slope_per_year", digits=8)


@query(f"""WITH {COUNTS}, r AS (SELECT * FROM counts WHERE yr BETWEEN 1995 AND 2000), t AS (SELECT unit, grp, yr, sum(n)::BIGINT AS t FROM r GROUP BY ALL HAVING sum(n) >= 5),
u AS (SELECT *, count(*) OVER (PARTITION BY unit, grp) AS ny FROM t), g AS (SELECT u.unit, u.grp, u.yr, c.category, coalesce(k.n, 0) / u.t AS share FROM u CROSS JOIN (SELECT DISTINCT category FROM r) c
 LEFT JOIN (SELECT unit, grp, yr, category, sum(n)::BIGINT AS n FROM r GROUP BY ALL) k ON k.unit = u.unit AND k.grp = u.grp AND k.yr = u.yr AND k.category = c.category WHERE ny >= 4)
SELECT unit, grp, category, count(*) AS n_years, min(yr) AS first_year, max(yr) AS last_year, round(regr_slope(share, yr), 8) AS slope_per_year, round(arg_min(share, yr), 6) AS first_share, round(arg_max(share, yr), 6) AS last_share FROM g GROUP BY ALL""")
def unit_trends(spark, d):
    """AG26: slopes of units over usable years, absent categories zero."""
    out = trends.unit_trends(counts(spark, d), list(range(1995, 2001)), 5, 4)
    return rounded(rounded(out, "first_share", "last_share"), "slope_per_year", digits=8)


@query()
def group_trends(spark, d):
    """ST1, ST3, WN12: the whole trend table with sign-flip p-values."""
    return trends.group_trends(counts(spark, d), EARLY, LATE, 5, 20_260_731, 10_000)


@query()
def outliers_beyond_sampling(spark, d):
    """ST4: units beyond the 95th percentile of multinomial draws."""
    c = shares.in_matched_units(counts(spark, d), GROUPS)
    return trends.null_distances(shares.vectors(c), c.groupBy("unit", "grp").agg(F.sum("n").alias("n")), 20_260_731)


@query()
def dispersion_gap(spark, d):
    """ST5: label-permutation test of the dispersion gap."""
    return trends.dispersion_gap(vec(spark, d), 20_260_729, 5_000)

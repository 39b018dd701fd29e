"""Composite reports and the data behind figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import attribution as A
from ..operators import peers, shares, trends
from .common import query, rounded, table
from .composition import COUNTS, DENSE, GROUPS, PEER, counts, vec
from .text import BILL_ROWS

SUBJECTS = {"elections": 20, "voting": 20, "education": 6, "transport": 10, "ethics": 20}
CASES = " ".join(f"WHEN subject = '{k}' THEN {v}" for k, v in SUBJECTS.items())


def tagged(spark):
    b = spark.sql(f"SELECT * FROM VALUES {BILL_ROWS} AS t(unit, grp, title, subject, cls)").filter(F.col("grp").isin("D", "R"))
    return b.withColumn("category", T.unanimous(F.col("subject"), SUBJECTS)).groupBy("unit", "grp", "category").agg(F.count("*").alias("n"))


@query(f"""WITH b(unit, grp, title, subject, cls) AS (VALUES {BILL_ROWS}), t AS (SELECT unit, grp, CASE {CASES} END AS category FROM b WHERE grp IN ('D', 'R')), c AS (SELECT grp, category, count(*) AS n FROM t WHERE category IS NOT NULL GROUP BY ALL)
SELECT grp, category, n, round(n / sum(n) OVER (PARTITION BY grp), 6) AS share FROM c""")
def tag_replication(spark, d):
    """ST12: shares from tags alone, pooled."""
    return rounded(shares.shares(tagged(spark), ["grp"]), "share")


@query(f"""WITH b(unit, grp, title, subject, cls) AS (VALUES {BILL_ROWS}), t AS (SELECT unit, grp, CASE {CASES} END AS category FROM b WHERE grp IN ('D', 'R')), c AS (SELECT unit, grp, category, count(*) AS n FROM t WHERE category IS NOT NULL GROUP BY ALL)
SELECT unit, grp, category, n, round(n / sum(n) OVER (PARTITION BY unit, grp), 6) AS share FROM c""")
def tag_replication_by_unit(spark, d):
    """ST12: shares from tags alone, by unit."""
    return rounded(shares.shares(tagged(spark), ["unit", "grp"]), "share")


@query(f"""WITH {COUNTS}, a AS (SELECT grp, category, sum(n)::BIGINT AS n FROM counts WHERE yr < 1998 GROUP BY ALL), b AS (SELECT grp, category, sum(n)::BIGINT AS n FROM counts WHERE yr >= 1998 GROUP BY ALL), c AS (SELECT grp, category, sum(n)::BIGINT AS n FROM counts WHERE unit < 'NATION_2' GROUP BY ALL),
s AS (SELECT grp, category, n / sum(n) OVER (PARTITION BY grp) AS x FROM a), m AS (SELECT grp, category, n / sum(n) OVER (PARTITION BY grp) AS y FROM b), t AS (SELECT grp, category, n / sum(n) OVER (PARTITION BY grp) AS z FROM c)
SELECT grp, category, round(y - x, 6) AS model_gap, round(z - x, 6) AS tag_gap, (y - x) * (z - x) > 0 AS same_direction FROM s JOIN m USING (grp, category) JOIN t USING (grp, category)""")
def direction_replication(spark, d):
    """ST10, J5: whether two sources move the same way from a third."""
    c = counts(spark, d)
    of = lambda where, name: shares.shares(c.filter(where), ["grp"]).select("grp", "category", F.col("share").alias(name))
    j = of("yr < 1998", "x").join(of("yr >= 1998", "y"), ["grp", "category"]).join(of("unit < 'NATION_2'", "z"), ["grp", "category"])
    return j.select("grp", "category", F.round(F.col("y") - F.col("x"), 6).alias("model_gap"), F.round(F.col("z") - F.col("x"), 6).alias("tag_gap"), ((F.col("y") - F.col("x")) * (F.col("z") - F.col("x")) > 0).alias("same_direction"))


TOP = "string_agg(category || ' (' || CAST(round_even(share * 100, 0)::INT AS VARCHAR) || '%)', '; ' ORDER BY share DESC, category)"


@query(f"""WITH {COUNTS}, a AS (SELECT unit, grp, category, sum(n)::BIGINT AS n FROM counts WHERE yr < 1997 GROUP BY ALL), b AS (SELECT unit, grp, category, sum(n)::BIGINT AS n FROM counts WHERE yr >= 1997 GROUP BY ALL),
x AS (SELECT unit, grp, category, n / sum(n) OVER (PARTITION BY unit, grp) AS share FROM a), y AS (SELECT unit, grp, category, n / sum(n) OVER (PARTITION BY unit, grp) AS share FROM b),
tx AS (SELECT unit, grp, {TOP} AS top_stated FROM x GROUP BY ALL), ty AS (SELECT unit, grp, {TOP} AS top_filed FROM y GROUP BY ALL)
SELECT coalesce(tx.unit, ty.unit) AS unit, coalesce(tx.grp, ty.grp) AS grp, coalesce(top_stated, '') AS top_stated, coalesce(top_filed, '') AS top_filed FROM tx FULL JOIN ty ON tx.unit = ty.unit AND tx.grp = ty.grp""")
def profiles(spark, d):
    """ST17, SE6, WN11: what each organisation says and files, in one line each."""
    c = counts(spark, d)
    top = lambda where, name: shares.shares(c.filter(where), ["unit", "grp"]).groupBy("unit", "grp").agg(peers.top_text("category", "share", 5).alias(name))
    return top("yr < 1997", "top_stated").join(top("yr >= 1997", "top_filed"), ["unit", "grp"], "full").na.fill("", ["top_stated", "top_filed"])


@query(f"""WITH {PEER}, f AS (SELECT unit, grp, category, share, peer, row_number() OVER (PARTITION BY unit, grp ORDER BY share - peer DESC, category) AS k FROM p),
t AS (SELECT unit, grp, sum(n)::BIGINT AS n FROM major GROUP BY ALL), g AS (SELECT n_name AS unit, s AS grp FROM nation CROSS JOIN (VALUES ('F'), ('O'), ('X')) z(s))
SELECT g.unit, g.grp, coalesce(t.n, 0) AS n_items, f.category AS focus, round(f.share - f.peer, 6) AS overemphasis, coalesce(t.n >= 200, false) AS reliable, CASE WHEN t.n IS NULL THEN 'none' ELSE 'orders' END AS origin
FROM g LEFT JOIN t ON t.unit = g.unit AND t.grp = g.grp LEFT JOIN f ON f.unit = g.unit AND f.grp = g.grp AND f.k = 1""")
def atlas(spark, d):
    """ST19, J16, PF10, PF17: a row for every unit and group; missing evidence stays missing."""
    c = shares.in_matched_units(counts(spark, d), GROUPS)
    f = peers.focus(shares.vectors(c)).select("unit", "grp", "focus", "overemphasis")
    t = c.groupBy("unit", "grp").agg(F.sum("n").alias("n"))
    g = A.grid(table(spark, d, "nation").select(F.col("n_name").alias("unit")), spark.sql("SELECT * FROM VALUES 'F', 'O', 'X' AS t(grp)"), t, f)
    out = g.select("unit", "grp", F.coalesce("n", F.lit(0)).alias("n_items"), "focus", "overemphasis", F.coalesce(F.col("n") >= 200, F.lit(False)).alias("reliable"), F.when(F.col("n").isNull(), "none").otherwise("orders").alias("origin"))
    return rounded(out, "overemphasis")


@query(f"""WITH {DENSE}, f AS (SELECT unit, category, share FROM vec WHERE grp = 'F'), m AS (SELECT category, CAST(row_number() OVER (ORDER BY round(avg(share), 9) DESC, category) AS INT) AS position FROM f GROUP BY category)
SELECT n_name AS unit, category, position, round(share, 6) AS share FROM nation CROSS JOIN m LEFT JOIN f USING (category) WHERE f.unit = n_name
UNION ALL SELECT n_name, category, position, NULL FROM nation CROSS JOIN m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.unit = n_name AND f.category = m.category)""")
def unit_matrix(spark, d):
    """FP1, FP8: every unit by every category, categories in order of their mean share; null where a unit has no vector."""
    from pyspark.sql import Window

    f = vec(spark, d).filter("grp = 'F'").select("unit", "category", "share")
    m = f.groupBy("category").agg(F.avg("share").alias("s")).withColumn("position", F.row_number().over(Window.orderBy(F.desc(F.round("s", 9)), "category"))).drop("s")
    grid = table(spark, d, "nation").select(F.col("n_name").alias("unit")).crossJoin(F.broadcast(m))  # units by categories, the matrix itself
    return rounded(grid.join(f, ["unit", "category"], "left"), "share")


@query(f"""WITH {DENSE}, m AS (SELECT grp, category, avg(share) AS s FROM vec GROUP BY ALL), n AS (SELECT grp, category, sum(n)::BIGINT AS n FROM major GROUP BY ALL)
SELECT m.grp, m.category, round(s, 6) AS share, n < 1000 AS unreliable, CAST(rank() OVER (PARTITION BY m.grp ORDER BY round(s, 9) DESC, m.category) AS INT) AS position FROM m JOIN n ON n.grp = m.grp AND n.category = m.category""")
def figure_rows(spark, d):
    """FP3, FP8: rows in display order with flags."""
    from pyspark.sql import Window

    c = shares.in_matched_units(counts(spark, d), GROUPS)
    g = shares.group_emphasis(c)
    w = Window.partitionBy("grp").orderBy(F.desc(F.round("share", 9)), "category")
    return rounded(g.select("grp", "category", "share", (F.col("n") < 1000).alias("unreliable"), F.rank().over(w).alias("position")), "share")


@query(f"""WITH {COUNTS} SELECT unit, grp, category, max(yr) FILTER (n >= 2) AS latest, 2001 - coalesce(max(yr) FILTER (n >= 2), 1900) AS age FROM counts GROUP BY ALL""")
def recency(spark, d):
    """FP6: latest year with two or more; what has none is the oldest."""
    c = counts(spark, d).groupBy("unit", "grp", "category").agg(F.max(F.when(F.col("n") >= 2, F.col("yr"))).alias("latest"))
    return c.withColumn("age", F.lit(2001) - F.coalesce("latest", F.lit(1900)))


@query()
def significant_trends(spark, d):
    """FP4: categories whose change is significant."""
    return trends.group_trends(counts(spark, d), [1995, 1996], [1999, 2000], 5, 20_260_731, 10_000).filter("q_value < 0.5").select("grp", "category", "change", "q_value")


NAMES = {"Virginia": "VA", "West Virginia": "WV", "Texas": "TX", "New York": "NY", "Hawaii": "HI"}
ORGS = [("West Virginia Democratic Party", "", "WV"), ("Republican Party of Texas", "", "TX"), ("Erie County Republican Committee", "", None), ("Young Republicans of Texas", "", None), ("Some Party", "New York", "NY"), ("Texas Party", "Hawaii", "HI"), ("Republican State Committee of New York", "Albany", "NY"), ("", "", None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {'NULL' if c is None else repr(c)})" for a, b, c in ORGS) + ") t(label, place, code)")
def organisation_units(spark, d):
    """SF29: unit of an organisation from its place or its label."""
    t = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', '{b}')" for a, b, _ in ORGS) + " AS t(label, place)")
    return t.withColumn("code", L.match_unit(F.col("label"), F.col("place"), NAMES))


SITES = [
    ("Welcome to the Texas Democratic Party. Texas Democrats win; democrats.", "", "Texas", True), ("Account Suspended texas democrats", "", "Texas", False), ("contact webmaster@texasdemocrats.org about texas", "", "Texas", False),
    ("Republicans republicans of New York against the democrats, democrats say republican", "New York Republican State Committee", "New York", False), ("The democrats and the gop of New York", "New York Democrats", "New York", True), ("Democrats of Ohio", "", "Texas", False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {str(ok).lower()})" for a, b, c, ok in SITES) + ") t(body, title, name, confirms)")
def site_checks(spark, d):
    """SF30: whether a page is the site of a unit's organisation."""
    t = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c, _ in SITES) + " AS t(body, title, name)")
    return t.withColumn("confirms", L.page_confirms(F.col("body"), F.col("title"), F.col("name"), "D"))


PAGE = "24RS SB 2 Title An act on schools Bill Documents Summary of Original Version Fund schools. Index Headings x 24RS SB 1 Title Water Bill Documents 24RS SB 2 Title Again Bill Documents 24RS SB 40 Title No Bill Documents"


@query("SELECT * FROM (VALUES (1, 'Water', NULL), (2, 'An act on schools', 'Fund schools.')) t(number, title, summary)")
def page_sections(spark, d):
    """SF42: numbered sections of a combined page, with what stands between their anchors."""
    s = spark.sql(f"SELECT '{PAGE}' AS text").select(F.inline(L.numbered_sections(F.col("text"), r"24RS SB\s+(\d+)\b", 10)))
    return s.select("number", L.between(F.col("section"), r"\bTitle", r"\bBill Documents\b").alias("title"), L.between(F.col("section"), r"Summary of (?:Original|Enacted) Version", "Index Headings|Legislative History|Amendments|$").alias("summary"))

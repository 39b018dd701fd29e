"""Attribution, outcome and coverage queries: orders are bills, line items sponsors, actions and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators import shares
from .common import query, rounded, table
from .composition import COUNTS, GROUPS, MAJOR, counts


def sponsors(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    grp = F.when(F.col("s_nationkey") % 3 == 0, "D").when(F.col("s_nationkey") % 3 == 1, "R").otherwise("other")
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", (F.col("l_linenumber") == 1).alias("is_primary"), grp.alias("grp"))


SPONSORS = """sp AS (SELECT l_orderkey, l_linenumber = 1 AS pr, CASE s_nationkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'R' ELSE 'other' END AS grp FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
fl AS (SELECT l_orderkey, count(*) AS n_sponsors, bool_or(pr AND grp = 'D') AS pd, bool_or(pr AND grp = 'R') AS prr, bool_or(grp = 'D') AS ad, bool_or(grp = 'R') AS ar FROM sp GROUP BY ALL),
ag AS (SELECT l_orderkey, n_sponsors, CASE WHEN pd OR prr THEN pd ELSE ad END AS d, CASE WHEN pd OR prr THEN prr ELSE ar END AS r FROM fl),
att AS (SELECT l_orderkey, CASE WHEN d AND r THEN 'bipartisan' WHEN d THEN 'D' WHEN r THEN 'R' ELSE 'unknown' END AS sponsor_group, n_sponsors FROM ag)"""


@query(f"WITH {SPONSORS} SELECT * FROM att")
def sponsor_attribution(spark, d):
    """AG20: group of each item from its sponsors."""
    return A.attribute(sponsors(spark, d), "l_orderkey")


@query(f"WITH {SPONSORS} SELECT sponsor_group, count(*) AS n, max(n_sponsors) AS most FROM att GROUP BY ALL")
def attribution_counts(spark, d):
    """AG24: how many items each attribution has."""
    return A.attribute(sponsors(spark, d), "l_orderkey").groupBy("sponsor_group").agg(F.count("*").alias("n"), F.max("n_sponsors").alias("most"))


@query("SELECT user_id, arg_max(event_type, struct_pack(a := date_trunc('day', ts), b := event_id)) AS event_type FROM events GROUP BY ALL")
def latest_membership(spark, d):
    """J10: the latest row by day, of equal days the later row."""
    e = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    return A.latest_membership(e, "user_id", "day", "event_type", "event_id")


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """Each user's signups open an interval that lasts ten days; its value is the interval's own id."""
    e = table(spark, d, "events").filter("event_type = 'signup'")
    return e.select("user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("e"), F.col("event_id").cast("string").alias("v"), F.col("event_id").alias("o"))


@query("""WITH i AS (SELECT user_id, ts AS s, ts + INTERVAL 10 DAYS AS e, event_id AS v FROM events WHERE event_type = 'signup'),
j AS (SELECT p.event_id, i.v, row_number() OVER (PARTITION BY p.event_id ORDER BY (i.s <= p.ts AND i.e >= p.ts) DESC, (i.s <= p.ts) DESC, i.s DESC, i.v) AS k
  FROM events p LEFT JOIN i ON i.user_id = p.user_id WHERE p.event_type = 'purchase')
SELECT event_id, coalesce(CAST(v AS VARCHAR), 'unknown') AS found FROM j WHERE k = 1""")
def as_of_membership(spark, d):
    """J9, SF41: the interval at a time, with the ladder of fallbacks."""
    p = table(spark, d, "events").filter("event_type = 'purchase'").select("event_id", F.col("user_id"), "ts")
    return A.as_of(p, intervals(spark, d), "user_id", "ts", "s", "e", "v", "o", "event_id").select("event_id", "found")


TREE = "(1, 'upper', NULL), (2, 'committee', 1), (3, 'sub', 2), (4, 'lower', NULL), (5, NULL, 4), (6, 'committee', 7), (7, 'committee', 6), (8, 'x', 99), (9, 'Legislature', NULL), (10, 'a', 9), (11, 'b', 10), (12, 'c', 11), (13, 'd', 12)"


@query(f"""WITH RECURSIVE t(id, class, parent) AS (VALUES {TREE}), w AS (SELECT id, lower(class) AS c, parent, 0 AS k FROM t
  UNION ALL SELECT w.id, lower(t.class), t.parent, k + 1 FROM w JOIN t ON t.id = w.parent WHERE k < 40 AND (w.c IS NULL OR w.c NOT IN ('upper', 'lower', 'legislature')))
SELECT id, coalesce(max(c) FILTER (c IN ('upper', 'lower', 'legislature')), 'unknown') AS chamber FROM w GROUP BY id""")
def nearest_chamber(spark, d):
    """J11: nearest ancestor of a wanted class; cycles and ends are unknown."""
    nodes = spark.sql(f"SELECT * FROM VALUES {TREE} AS t(id, class, parent)")
    return A.nearest_ancestor(nodes, ["upper", "lower", "legislature"])


def actions(spark: SparkSession, d: str) -> DataFrame:
    """Line items as actions: return flag, line status and number give classes, the supplier's side the chamber."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")
    c = F.array_compact(F.array(
        F.when(F.col("l_returnflag") == "A", "introduction"), F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "passage"), F.when((F.col("l_linenumber") == 6) & (F.col("l_linestatus") == "O"), "executive-signature"),
        F.when(F.col("l_linenumber") == 7, "became-law"), F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 5), "committee-failure"),
    ))
    return li.select("l_orderkey", c.alias("classes"), F.when(F.col("l_suppkey") % 2 == 0, "upper").otherwise("lower").alias("chamber"))


ACTIONS = """ac AS (SELECT l_orderkey, list_filter([CASE WHEN l_returnflag = 'A' THEN 'introduction' END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'passage' END,
    CASE WHEN l_linenumber = 6 AND l_linestatus = 'O' THEN 'executive-signature' END, CASE WHEN l_linenumber = 7 THEN 'became-law' END, CASE WHEN l_returnflag = 'N' AND l_linenumber = 5 THEN 'committee-failure' END], lambda x: x IS NOT NULL) AS c,
    CASE WHEN l_suppkey % 2 = 0 THEN 'upper' ELSE 'lower' END AS ch FROM lineitem),
ev AS (SELECT l_orderkey, count(*) AS n_actions, list_distinct(flatten(list(c))) AS cs, list_distinct(list(ch) FILTER (list_contains(c, 'passage'))) AS ps FROM ac GROUP BY ALL),
oc AS (SELECT l_orderkey, n_actions, CASE WHEN list_contains(cs, 'became-law') THEN 'became_law' WHEN list_contains(cs, 'executive-signature') THEN 'signed'
    WHEN len(coalesce(ps, [])) = 2 THEN 'passed_legislature' WHEN len(coalesce(ps, [])) = 1 THEN 'passed_one_chamber' WHEN list_contains(cs, 'committee-failure') THEN 'recorded_failure_or_withdrawal'
    WHEN len(cs) > 0 THEN 'introduced_or_pending' ELSE 'no_action_data' END AS recorded_outcome,
    list_contains(cs, 'became-law') OR list_contains(cs, 'executive-signature') AS recorded_enacted FROM ev)"""


@query(f"WITH {ACTIONS} SELECT * FROM oc")
def recorded_outcomes(spark, d):
    """SF12, SF13, AG17: the highest stage of each item."""
    return A.collect_actions(actions(spark, d), "l_orderkey").select("l_orderkey", "n_actions", "recorded_outcome", "recorded_enacted")


def bills(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    done = A.collect_actions(actions(spark, d), "l_orderkey").drop("classes", "chambers")
    votes = table(spark, d, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n_votes"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(votes, F.col("o_orderkey") == F.col("k"), "left")
    return j.select(F.col("o_orderkey").alias("item"), F.col("c_nationkey").alias("unit"), F.col("o_orderstatus").alias("grp"), F.col("c_mktsegment").alias("chamber"), "n_actions", "recorded_outcome", "recorded_enacted", "n_votes")


BILLS = ACTIONS + """, vt AS (SELECT l_orderkey, count(*) AS n_votes FROM lineitem WHERE l_quantity > 45 GROUP BY ALL),
bl AS (SELECT o_orderkey AS item, c_nationkey AS unit, o_orderstatus AS grp, c_mktsegment AS chamber, coalesce(n_actions, 0) > 0 AS ha, coalesce(recorded_outcome IN ('passed_one_chamber', 'passed_legislature', 'sent_to_executive', 'signed', 'vetoed', 'became_law'), false) AS adv,
  coalesce(recorded_enacted, false) AS en, coalesce(n_votes, 0) > 0 AS hv FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN oc ON oc.l_orderkey = o_orderkey LEFT JOIN vt ON vt.l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O')),
rt AS (SELECT unit, grp, count(*) AS n_bills, count_if(ha)::BIGINT AS n_with_actions, count_if(adv)::BIGINT AS n_advanced, count_if(en)::BIGINT AS n_enacted, count_if(hv)::BIGINT AS n_with_votes FROM bl GROUP BY ALL),
rr AS (SELECT *, n_with_actions / n_bills AS action_coverage, n_advanced / n_bills AS advancement_rate, n_enacted / n_bills AS enactment_rate, n_with_votes / n_bills AS vote_coverage,
  n_bills >= 30 AND n_with_actions / n_bills >= 0.8 AS reliable FROM rt)"""


def rates(spark, d):
    return A.outcome_rates(bills(spark, d).filter(F.col("grp").isin(GROUPS)), 30, 0.8)


RATES = ("action_coverage", "advancement_rate", "enactment_rate", "vote_coverage")


@query(f"WITH {BILLS} SELECT unit, grp, n_bills, n_with_actions, n_advanced, n_enacted, n_with_votes, reliable, {', '.join(f'round({c}, 6) AS {c}' for c in RATES)} FROM rr")
def outcome_rates(spark, d):
    """AG8, PF10, PF11: counts and rates by unit and group."""
    return rounded(rates(spark, d), *RATES)


@query(f"""WITH {BILLS}, m AS (SELECT * FROM rr WHERE reliable AND unit IN (SELECT unit FROM rr WHERE reliable GROUP BY unit HAVING count(DISTINCT grp) = 2))
SELECT grp, count(DISTINCT unit) AS n_units, {', '.join(f'round(avg({c}), 6) AS mean_{c}' for c in RATES)} FROM m GROUP BY grp""")
def matched_outcome_rates(spark, d):
    """AG9, PF12: mean rates over units reliable for both groups."""
    return rounded(A.matched_rates(rates(spark, d), GROUPS), *[f"mean_{c}" for c in RATES])


@query(f"""WITH {BILLS}, p AS (SELECT unit, max(enactment_rate) FILTER (grp = 'F') AS f, max(enactment_rate) FILTER (grp = 'O') AS o FROM rr WHERE reliable GROUP BY unit)
SELECT count(*) AS n_paired_units, round(avg(f - o), 6) AS mean_difference FROM p WHERE f IS NOT NULL AND o IS NOT NULL""")
def outcome_comparison(spark, d):
    """ST15, RS1: paired difference of rates over units."""
    p = rates(spark, d).filter("reliable").groupBy("unit").pivot("grp", GROUPS).agg(F.max("enactment_rate")).dropna()
    return rounded(p.agg(F.count("*").alias("n_paired_units"), F.avg(F.col("F") - F.col("O")).alias("mean_difference")), "mean_difference")


@query(f"WITH {BILLS} SELECT chamber, grp, count(*) AS n_bills, round(avg(ha::INT), 6) AS action_coverage, round(avg(adv::INT), 6) AS advancement_rate, round(avg(en::INT), 6) AS enactment_rate FROM bl GROUP BY ALL")
def chamber_rates(spark, d):
    """AG10: means of booleans by chamber and group."""
    b = bills(spark, d).filter(F.col("grp").isin(GROUPS))
    mean = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    out = b.groupBy("chamber", "grp").agg(F.count("*").alias("n_bills"), mean(F.col("n_actions") > 0).alias("action_coverage"), mean(F.col("recorded_outcome").isin(*A.ADVANCED)).alias("advancement_rate"), mean(F.col("recorded_enacted")).alias("enactment_rate"))
    return rounded(out, "action_coverage", "advancement_rate", "enactment_rate")


@query("""WITH v AS (SELECT l_orderkey AS vote_id, c_nationkey AS unit, o_orderstatus AS sg, CASE WHEN l_suppkey % 2 = 0 THEN 'F' ELSE 'O' END AS vg, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' ELSE 'other' END AS opt, sum(l_quantity)::BIGINT AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
w AS (SELECT vote_id, unit, sg, vg, sum(n)::BIGINT AS n, sum(n) FILTER (opt = 'yes') AS y FROM v WHERE sg IN ('F', 'O') AND opt IN ('yes', 'no') AND vote_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW') GROUP BY ALL HAVING sum(n) >= 10),
u AS (SELECT * FROM w WHERE (SELECT count(DISTINCT (sg, vg)) FROM w) < 4 OR unit IN (SELECT unit FROM w GROUP BY unit HAVING count(DISTINCT (sg, vg)) = 4))
SELECT sg AS sponsor_grp, vg AS voter_grp, count(DISTINCT vote_id) AS n_votes, count(DISTINCT unit) AS n_units, sum(n)::BIGINT AS n_person_votes, round(avg(coalesce(y, 0)::BIGINT / n), 6) AS mean_yes_share FROM u GROUP BY ALL""")
def rollcall_support(spark, d):
    """J1, AG11, AG12, AG19: yes shares by sponsor and voter group."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    opt = F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "R", "no").otherwise("other")
    v = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    v = v.groupBy(F.col("l_orderkey").alias("vote_id"), F.col("c_nationkey").alias("unit"), F.col("o_orderstatus").alias("sponsor_grp"), F.when(F.col("l_suppkey") % 2 == 0, "F").otherwise("O").alias("voter_grp"), opt.alias("opt")).agg(F.sum("l_quantity").cast("long").alias("n"))
    passages = o.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("vote_id"))
    return rounded(A.rollcall_support(v, passages, ("F", "O"), 10), "mean_yes_share")


@query("SELECT o_orderstatus AS grp, count_if(o_orderpriority = '1-URGENT')::BIGINT AS urgent, count_if(o_orderpriority = '5-LOW')::BIGINT AS low, count_if(o_totalprice > 100000)::BIGINT AS large, count(DISTINCT o_custkey) AS customers, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY ALL")
def conditional_counts(spark, d):
    """AG13, AG16, AG18: conditional and distinct counts, extremes."""
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("grp")).agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"), F.count_if(F.col("o_totalprice") > 100000).alias("large"),
        F.count_distinct("o_custkey").alias("customers"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("""SELECT c_mktsegment AS segment, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names, count(DISTINCT n_name) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def name_lists(spark, d):
    """AG14: sorted distinct names in one string."""
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"), F.count_distinct("n_name").alias("n"))


@query("SELECT conv_id, string_agg(text, '\n\n' ORDER BY turn) FILTER (text <> '') AS body, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def ordered_text(spark, d):
    """AG15, SRC19, UD11: texts of a group joined in order, empty ones left out."""
    rows = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("turn", "text"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.nullif(F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n"), F.lit("")).alias("body"), F.count("*").alias("n_turns"))


@query("""WITH g AS (SELECT n_name AS unit, s AS grp FROM nation CROSS JOIN (VALUES ('F'), ('O'), ('X')) t(s)), k AS (SELECT n_name AS unit, o_orderstatus AS grp, count(*) AS n, count_if(o_totalprice > 400000)::BIGINT AS strong, max(CAST(year(o_orderdate) AS INT)) AS latest FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT unit, grp, coalesce(n, 0) AS n_candidates, coalesce(strong, 0) AS n_strong, latest, CASE WHEN coalesce(strong, 0) > 20 THEN 'found' WHEN coalesce(strong, 0) > 10 THEN 'candidates_rejected' WHEN coalesce(strong, 0) > 0 THEN 'candidates_unfetched' WHEN coalesce(n, 0) > 0 THEN 'no_strong_candidates' ELSE 'no_candidates' END AS status FROM g LEFT JOIN k USING (unit, grp)""")
def gap_report(spark, d):
    """ST20, J16, RS4: a row for every unit and group, with how far a search got."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = o.groupBy(F.col("n_name").alias("unit"), F.col("o_orderstatus").alias("grp")).agg(F.count("*").alias("n_candidates"), F.count_if(F.col("o_totalprice") > 400000).alias("n_strong"), F.max(F.year("o_orderdate")).alias("latest"))
    units = table(spark, d, "nation").select(F.col("n_name").alias("unit"))
    out = A.grid(units, spark.sql("SELECT * FROM VALUES 'F', 'O', 'X' AS t(grp)"), k).na.fill(0, ["n_candidates", "n_strong"])
    s = F.col("n_strong")
    return out.withColumn("status", A.status_of((s > 20).cast("int"), F.col("n_candidates"), s, (s > 10).cast("int")))


@query(f"""WITH {COUNTS} SELECT unit, coalesce(sum(n) FILTER (grp = 'F'), 0)::BIGINT AS n_f, coalesce(sum(n) FILTER (grp = 'O'), 0)::BIGINT AS n_o, max(yr) FILTER (grp = 'F') AS latest_f, max(yr) FILTER (grp = 'O') AS latest_o,
  coalesce(sum(n) FILTER (grp IN ('F', 'O')), 0)::BIGINT AS total, greatest(max(yr) FILTER (grp = 'F'), max(yr) FILTER (grp = 'O')) AS latest FROM counts GROUP BY unit""")
def coverage_matrix(spark, d):
    """ST21: counts and latest year of each group side by side."""
    w = counts(spark, d).groupBy("unit").pivot("grp", GROUPS).agg(F.sum("n").alias("n"), F.max("yr").alias("y"))
    return w.select("unit", F.coalesce("F_n", F.lit(0)).alias("n_f"), F.coalesce("O_n", F.lit(0)).alias("n_o"), F.col("F_y").alias("latest_f"), F.col("O_y").alias("latest_o"), (F.coalesce("F_n", F.lit(0)) + F.coalesce("O_n", F.lit(0))).alias("total"), F.greatest("F_y", "O_y").alias("latest"))


@query(f"""WITH {COUNTS}, a AS (SELECT * FROM counts WHERE yr < 1998 AND category <> '5-LOW'), b AS (SELECT * FROM counts WHERE yr >= 1998)
SELECT unit, grp, category, sum(n)::BIGINT AS n, 'first' AS origin FROM a GROUP BY ALL UNION ALL SELECT unit, grp, category, sum(n)::BIGINT, 'second' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.unit = b.unit AND a.grp = b.grp AND a.category = b.category) GROUP BY ALL""")
def combined_emphasis(spark, d):
    """ST18, J7, SE1: a second source only where the first has nothing."""
    c = counts(spark, d)
    keys = ["unit", "grp", "category"]
    sum_ = lambda t, o: t.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("origin", F.lit(o))
    a, b = c.filter("yr < 1998 AND category <> '5-LOW'"), c.filter("yr >= 1998")
    return sum_(a, "first").unionByName(sum_(b.join(a, keys, "left_anti"), "second"))


@query("""WITH a AS (SELECT p_name AS name, md5(p_type) AS h FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_name AS name, md5(CASE WHEN p_size > 45 THEN p_brand ELSE p_type END) AS h FROM part WHERE p_partkey % 5 <> 0),
a1 AS (SELECT name, min(h) AS h FROM a GROUP BY name), b1 AS (SELECT name, min(h) AS h FROM b GROUP BY name)
SELECT coalesce(a1.name, b1.name) AS name, CASE WHEN b1.h IS NULL THEN 'added' WHEN a1.h IS NULL THEN 'deleted' WHEN a1.h <> b1.h THEN 'revised' ELSE 'shared' END AS state FROM a1 FULL JOIN b1 ON a1.name = b1.name""")
def reconciled_snapshots(spark, d):
    """SE5, SF33: two snapshots of digests against each other."""
    p = table(spark, d, "part")
    a = p.filter("p_partkey % 7 <> 0").groupBy(F.col("p_name").alias("name")).agg(F.min(F.md5("p_type")).alias("h"))
    b = p.filter("p_partkey % 5 <> 0").groupBy(F.col("p_name").alias("name")).agg(F.min(F.md5(F.when(F.col("p_size") > 45, F.col("p_brand")).otherwise(F.col("p_type")))).alias("h"))
    return A.reconcile(a, b, "name", "h")


@query(f"WITH {MAJOR} SELECT 'units' AS what, count(DISTINCT unit)::BIGINT AS n FROM counts UNION ALL SELECT 'matched', count(DISTINCT unit) FROM major UNION ALL SELECT 'rows', sum(n)::BIGINT FROM counts UNION ALL SELECT 'years', count(DISTINCT yr) FROM counts")
def capability_report(spark, d):
    """ST22, AG28, FP2, FP10: what the data can answer, as numbers."""
    c = counts(spark, d)
    one = lambda what, t: t.select(F.lit(what).alias("what"), F.col("n").cast("long"))
    out = one("units", c.agg(F.count_distinct("unit").alias("n")))
    out = out.unionByName(one("matched", shares.matched_units(c, GROUPS).agg(F.count("*").alias("n"))))
    return out.unionByName(one("rows", c.agg(F.sum("n").alias("n")))).unionByName(one("years", c.agg(F.count_distinct("yr").alias("n"))))

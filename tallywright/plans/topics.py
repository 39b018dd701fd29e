"""Queries that classify titles and statements and count what was classified."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segments as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import attribution as A
from ..operators import classify as C
from ..operators import shares, terms
from .common import query, rounded, table
from .composition import COUNTS, counts
from .text import CENTROID, NORMAL, TOPICS, UNITS, nearest, titles

SHELL = r"(unit = 'IL' AND upper(trim(title)) LIKE '%-TECH' OR unit = 'NM' AND regexp_full_match(trim(title), '(?i)PUBLIC,?\s+PEACE,\s+HEALTH,\s+SAFETY\s+&\s+WELFARE'))"
ITEMS = """it AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'IL' WHEN 1 THEN 'NM' WHEN 2 THEN 'TX' ELSE 'VT' END AS unit, CASE WHEN c_nationkey < 12 THEN 'D' ELSE 'R' END AS grp, CAST(2018 + c_custkey % 5 AS INT) AS year,
CASE c_custkey % 6 WHEN 0 THEN c_mktsegment || '-Tech ' WHEN 1 THEN 'Public, peace,  health, safety & welfare' WHEN 2 THEN c_mktsegment ELSE c_name || ' on ' || c_mktsegment END AS title FROM customer)"""
LABELLED = f"{ITEMS}, {CENTROID}, cl AS (SELECT it.*, {SHELL} AS procedural_shell, length(title) >= 20 AND NOT {SHELL} AS usable, topic AS t, similarity AS s FROM it LEFT JOIN nc ON nc.vec_id = it.id), la AS (SELECT id, unit, grp, year, CASE WHEN usable THEN t END AS topic, CASE WHEN usable THEN round(coalesce(s, 0), 4) ELSE 0 END AS similarity, procedural_shell FROM cl)"


def items(spark: SparkSession, d: str) -> DataFrame:
    k, of = F.col("c_custkey"), lambda n, *v: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in v]), (F.col("c_custkey") % n + 1).cast("int"))
    own = F.concat_ws(" on ", "c_name", "c_mktsegment")
    title = of(6, F.concat("c_mktsegment", F.lit("-Tech ")), "Public, peace,  health, safety & welfare", F.col("c_mktsegment"), own, own, own)
    return table(spark, d, "customer").select(k.alias("id"), of(4, "IL", "NM", "TX", "VT").alias("unit"), F.when(F.col("c_nationkey") < 12, "D").otherwise("R").alias("grp"), (F.lit(2018) + k % 5).cast("int").alias("year"), title.alias("title"))


def classified(spark: SparkSession, d: str) -> DataFrame:
    return C.classify_titles(items(spark, d), nearest(spark, d).select(F.col("vec_id").alias("id"), "topic", "similarity"))


@query(f"WITH {LABELLED} SELECT id, topic, similarity, procedural_shell FROM la")
def title_topics(spark, d):
    """UD6, PF8, PF9: topics of titles that are long enough and no procedural shells."""
    return classified(spark, d).select("id", "topic", "similarity", "procedural_shell")


@query(f"WITH {LABELLED} SELECT unit, grp, year, topic, count(*) AS n FROM la WHERE topic IS NOT NULL GROUP BY ALL")
def topic_counts(spark, d):
    """UD7, AG1: items by unit, group, year and topic."""
    return C.topic_counts(classified(spark, d))


@query(f"""WITH {LABELLED} SELECT unit, grp, count(*) AS n_attributed, count_if(procedural_shell)::BIGINT AS n_procedural, count_if(NOT procedural_shell)::BIGINT AS n_substantive, count_if(NOT procedural_shell AND topic IS NOT NULL)::BIGINT AS n_classified,
round(coalesce(count_if(NOT procedural_shell AND topic IS NOT NULL) / nullif(count_if(NOT procedural_shell), 0), 0), 6) AS rate FROM la GROUP BY ALL""")
def topic_coverage(spark, d):
    """AG29: how much of each unit and group could be classified."""
    return rounded(C.coverage(classified(spark, d)), "rate")


HITS = {c: " + ".join(rf"regexp_matches(unit, '(?:^|[^\pL\pN_]){s}(?:$|[^\pL\pN_])', 'i')::INT" for s in seeds) for c, seeds in TOPICS.items()}
STATED = f"""{UNITS}, un AS (SELECT doc_id, source, unnest(u) AS unit FROM c JOIN documents USING (doc_id)), sc AS (SELECT source, {", ".join(f"({h}) / sqrt({len(TOPICS[c])}) AS s{c}" for c, h in HITS.items())} FROM un),
tp AS (SELECT source, CASE WHEN greatest(s1, s2, s3, s4) = 0 THEN NULL WHEN s1 = greatest(s1, s2, s3, s4) THEN 1 WHEN s2 = greatest(s1, s2, s3, s4) THEN 2 WHEN s3 = greatest(s1, s2, s3, s4) THEN 3 ELSE 4 END AS topic FROM sc)"""


@query(f"WITH {STATED}, n AS (SELECT source, topic, count(*) AS n FROM tp WHERE topic IS NOT NULL GROUP BY ALL) SELECT source AS unit, topic AS category, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM n")
def stated_topics(spark, d):
    """UD5, UD8, UD9, AG3: the statements of each source's documents, classified, and the share of each topic."""
    found = S.with_statements(table(spark, d, "documents").select("source", "text"), "text")
    each = found.select(F.col("source").alias("unit"), F.explode("statements").alias("statement"))
    k = each.select("unit", C.keyword_topic(F.col("statement"), TOPICS)["topic"].alias("category")).filter("category IS NOT NULL")
    return rounded(shares.shares(k.groupBy("unit", "category").agg(F.count("*").alias("n")), ["unit"]), "share")


TAGS = "CASE o_orderkey % 5 WHEN 0 THEN 'bill' WHEN 1 THEN ' Bill |appropriation' WHEN 2 THEN 'bill|joint resolution' WHEN 3 THEN 'bill|constitutional amendment' ELSE 'resolution' END"


@query(f"WITH t AS (SELECT o_orderpriority, {TAGS} AS tags FROM orders) SELECT o_orderpriority AS category, count(*) AS n, count_if(list_contains(list_transform(string_split(tags, '|'), lambda x: lower(trim(x))), 'bill') AND NOT regexp_matches(lower(tags), 'resolution|constitutional'))::BIGINT AS n_eligible FROM t GROUP BY ALL")
def law_eligible(spark, d):
    """PF6: ordinary bills by their tags."""
    o = table(spark, d, "orders").select("o_orderpriority", F.expr(TAGS).alias("tags"))
    return o.groupBy(F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n"), F.count_if(A.is_law_eligible(F.col("tags"))).alias("n_eligible"))


@query(f"""WITH {COUNTS}, g AS (SELECT unit, grp, category, sum(n) AS n FROM counts GROUP BY ALL), t AS (SELECT unit, grp, sum(n) AS total FROM g GROUP BY ALL HAVING sum(n) >= 200), k AS (SELECT DISTINCT category FROM g JOIN t USING (unit, grp))
SELECT t.unit, t.grp, k.category, round(coalesce(g.n, 0) / total, 6) AS share FROM t CROSS JOIN k LEFT JOIN g ON g.unit = t.unit AND g.grp = t.grp AND g.category = k.category""")
def topic_vectors(spark, d):
    """RS5: dense share vectors of units and groups with 200 observations or more."""
    return rounded(shares.vectors(counts(spark, d), 200).select("unit", "grp", "category", "share"), "share")


DECLARED = r"""regexp_extract(url_decode(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '([^/]*)$', 1)"""
ADDRESS = "url || CASE page_id % 6 WHEN 0 THEN '/2022%2DBylaws.pdf' WHEN 1 THEN '/press/x?minutes' WHEN 2 THEN '/a%20call-to-the-convention.html' WHEN 3 THEN '#agenda' ELSE '' END"


@query(f"""WITH p AS (SELECT page_id, {ADDRESS} AS url FROM pages), n AS (SELECT page_id, url, lower(regexp_extract({DECLARED}, '(?i)({T.OTHER_NAMES})', 1)) AS name FROM p)
SELECT page_id, CASE WHEN name <> '' THEN name WHEN regexp_matches(url_decode(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '(?i)(?:{T.OTHER_PATHS})') THEN 'press release or index page' END AS class FROM n""")
def declared_classes(spark, d):
    """SF22: what a file name or a path says a document is."""
    p = table(spark, d, "pages").select("page_id", F.expr(ADDRESS).alias("url"))
    return p.select("page_id", T.other_class(F.col("url")).alias("class"))


SCORE = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(rf"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://(?:www\.)?([^/?#:]*)', 1) AS host FROM pages), q AS (SELECT page_id, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain FROM p) SELECT domain, count(*) AS n, min(page_id) AS first FROM q GROUP BY ALL""")
def page_domains(spark, d):
    """SF28: pages by registrable domain."""
    p = table(spark, d, "pages").select("page_id", U.registrable_domain(F.col("url")).alias("domain"))
    return p.groupBy("domain").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@query("""WITH o AS (SELECT o_orderstatus AS sponsor, c_mktsegment AS voter, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') AND c_mktsegment IN ('BUILDING', 'MACHINERY')), s AS (SELECT sponsor, voter, avg((o_totalprice > 150000)::INT) AS yes FROM o GROUP BY ALL)
SELECT sponsor, round(100 * max(yes) FILTER (voter = 'BUILDING'), 4) AS building, round(100 * max(yes) FILTER (voter = 'MACHINERY'), 4) AS machinery FROM s GROUP BY sponsor""")
def yes_matrix(spark, d):
    """FP5: sponsors by voters, per cent in favour."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).filter(F.col("o_orderstatus").isin("F", "O"))
    m = o.groupBy(F.col("o_orderstatus").alias("sponsor")).pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(100 * F.avg((F.col("o_totalprice") > 150_000).cast("int")))
    return rounded(m.select("sponsor", F.col("BUILDING").alias("building"), F.col("MACHINERY").alias("machinery")), "building", "machinery", digits=4)


@query(f"""WITH {NORMAL} SELECT unit, count(*) AS n, count_if(length(title) >= 20)::BIGINT AS n_long FROM tt GROUP BY ALL""")
def title_gates(spark, d):
    """PF9: titles long enough to be classified."""
    t = titles(spark, d)
    return t.groupBy("unit").agg(F.count("*").alias("n"), F.count_if(F.length("title") >= 20).alias("n_long"))


@query()
def barred_terms(spark, d):
    """SF15: distinctive terms without the words that name a unit."""
    docs = table(spark, d, "conversations").select((F.col("conv_id") % 20).cast("string").alias("unit"), F.col("role").alias("grp"), (F.col("turn") * 0).cast("string").alias("evidence"), "text")
    whole = docs.groupBy("unit", "grp", "evidence").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    return terms.distinctive(whole, ["der", "die", "the"], 5, barred=["und", "que"]).select("unit", "grp", "term", "n", "tfidf_rank", "concentration_rank")

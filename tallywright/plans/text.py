"""Text, cluster, classification and table-maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import segments as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import attribution as A
from ..operators import classify as C
from ..operators import cluster, terms
from ..sources import writers
from ..streaming import shares as windows
from .common import query, rounded, table


def titles(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    grp = F.when(F.col("lang") == "en", "D").when(F.col("lang") == "fr", "R").otherwise("other")
    return x.select(F.col("doc_id").alias("id"), F.col("source").alias("unit"), (F.col("doc_id") % 8 + 2018).cast("int").alias("year"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), grp.alias("grp"))


NORMAL = rf"""tt AS (SELECT doc_id AS id, source AS unit, CAST(doc_id % 8 + 2018 AS INT) AS year, split_part(text, chr(10), 1) AS title, CASE lang WHEN 'en' THEN 'D' WHEN 'fr' THEN 'R' ELSE 'other' END AS grp FROM documents),
nt AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '{T.BILL_NUMBER}', ' ', 'g'), '{T.YEAR}', ' ', 'g'), '{T.ORDINAL}', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS normalized FROM tt)"""
STOP = ", ".join(f"'{w}'" for w in T.TITLE_STOP_WORDS)


@query(f"""WITH {NORMAL} SELECT id, normalized, regexp_matches(normalized, '{T.GENERIC}', 'i') AS generic, regexp_matches(title, '{T.CEREMONIAL}', 'i') AS ceremonial,
CAST(len(list_distinct(list_filter(string_split(normalized, ' '), lambda w: length(w) > 2 AND w NOT IN ({STOP}) AND NOT regexp_matches(w, '^[0-9]+$')))) AS INT) AS n_tokens FROM nt""")
def normalized_titles(spark, d):
    """SF1-SF3, SF5: normalised titles and what they say of themselves."""
    n = titles(spark, d).withColumn("normalized", T.normalize_title(F.col("title")))
    return n.select("id", "normalized", T.found(F.col("normalized"), T.GENERIC).alias("generic"), T.found(F.col("title"), T.CEREMONIAL).alias("ceremonial"), F.size(T.significant_tokens(F.col("normalized"))).alias("n_tokens"))


@query(f"""WITH {NORMAL}, g AS (SELECT normalized, count(DISTINCT unit) AS n_units, count(*) AS n_items, string_agg(DISTINCT unit, ',' ORDER BY unit) AS units, min(year) AS first_year, max(year) AS last_year, arg_min(title, id) AS example,
count_if(grp = 'D')::BIGINT AS n_a, count_if(grp = 'R')::BIGINT AS n_b FROM nt WHERE length(normalized) >= 45 AND NOT regexp_matches(normalized, '{T.GENERIC}', 'i') GROUP BY ALL)
SELECT *, round((n_a - n_b) / greatest(n_a + n_b, 1), 3) AS skew FROM g WHERE n_units >= 2""")
def reuse_clusters(spark, d):
    """CL1, AG13, AG14, AG16: titles that several units share."""
    return cluster.reuse_clusters(titles(spark, d), 2)


@query(f"""WITH RECURSIVE d0 AS (SELECT doc_id AS id, source AS unit, CAST(doc_id % 8 + 2018 AS INT) AS year, split_part(text, chr(10), 1) AS title, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}'))) AS tk FROM documents),
d AS (SELECT * FROM d0 WHERE len(tk) >= 5), e AS (SELECT id, unnest(tk) AS token FROM d), f AS (SELECT token, count(*) AS df FROM e GROUP BY ALL),
r AS (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY df, token) AS k FROM e JOIN f USING (token)), b AS (SELECT token, id FROM r WHERE k <= 3), z AS (SELECT token FROM b GROUP BY token HAVING count(*) BETWEEN 2 AND 3500),
p AS (SELECT DISTINCT x.id AS u, y.id AS v FROM b x JOIN b y ON x.token = y.token AND x.id < y.id WHERE x.token IN (SELECT token FROM z)),
l AS (SELECT u, v FROM p JOIN d a ON a.id = u JOIN d c ON c.id = v WHERE len(list_intersect(a.tk, c.tk)) / len(list_distinct(list_concat(a.tk, c.tk))) >= 0.8),
ed AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l), re AS (SELECT id AS a, id AS b FROM d UNION SELECT re.a, ed.v FROM re JOIN ed ON ed.u = re.b), c AS (SELECT a AS id, min(b) AS cluster FROM re GROUP BY a),
m AS (SELECT d.*, cluster FROM d JOIN c USING (id)), o AS (SELECT cluster, count(DISTINCT unit) AS n_units, count(*) AS n_items, string_agg(DISTINCT unit, ',' ORDER BY unit) AS units, min(year) AS first_year, max(year) AS last_year, arg_min(title, id) AS example FROM m GROUP BY ALL HAVING count(DISTINCT unit) >= 2),
h AS (SELECT x.cluster, round(min(len(list_intersect(x.tk, y.tk)) / len(list_distinct(list_concat(x.tk, y.tk)))), 3) AS cohesion FROM m x JOIN m y ON x.cluster = y.cluster AND x.id < y.id AND x.tk <> y.tk GROUP BY ALL)
SELECT o.*, coalesce(cohesion, 1.0) AS cohesion FROM o LEFT JOIN h USING (cluster)""")
def near_duplicate_clusters(spark, d):
    """CL2-CL4, J15, AG30, SF4, SF35: rarest-token blocks, Jaccard, components, cohesion."""
    x = titles(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.content_tokens(F.col("text")).alias("tokens")), "id")
    return cluster.near_duplicate_clusters(x, least_units=2)


@query("""WITH RECURSIVE d AS (SELECT doc_id AS id, source, lang, CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id % 5 + 2010 AS INT) END AS year, doc_id % 3 <> 0 AS col, length(text) AS ch, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS tk FROM documents),
l AS (SELECT a.id AS u, b.id AS v FROM d a JOIN d b ON a.source = b.source AND a.lang = b.lang AND a.id < b.id AND (a.col OR b.col) AND (abs(a.year - b.year) <= 1 OR a.year IS NULL OR b.year IS NULL)
  WHERE len(list_concat(a.tk, b.tk)) > 0 AND (len(list_intersect(a.tk, b.tk)) / len(list_distinct(list_concat(a.tk, b.tk))) >= 0.85 OR coalesce(len(list_intersect(a.tk, b.tk)) / nullif(least(len(a.tk), len(b.tk)), 0) >= 0.9, false))),
ed AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l), re AS (SELECT id AS a, id AS b FROM d UNION SELECT re.a, ed.v FROM re JOIN ed ON ed.u = re.b), c AS (SELECT a AS id, min(b) AS component FROM re GROUP BY a)
SELECT id, component, row_number() OVER (PARTITION BY component ORDER BY col DESC, ch DESC, coalesce(year, -1) DESC, id) = 1 AS kept FROM d JOIN c USING (id)""")
def redundant_documents(spark, d):
    """CL5, J12, SF35: copies within a unit and group, the best one kept."""
    x = table(spark, d, "documents")
    year = F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 5 + 2010).cast("int"))
    return cluster.redundant(x.select(F.col("doc_id").alias("id"), F.col("source").alias("unit"), F.col("lang").alias("grp"), year.alias("year"), (F.col("doc_id") % 3 != 0).alias("collected"), "text"))


@query(r"""WITH f AS (SELECT doc_id, source, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h FROM documents) SELECT doc_id, source, first_value(doc_id) OVER w AS first_id, row_number() OVER w = 1 AS kept FROM f WINDOW w AS (PARTITION BY source, h ORDER BY doc_id)""")
def fingerprint_copies(spark, d):
    """CL6, SF33: equal texts within a group; the first stays."""
    f = table(spark, d, "documents").select("doc_id", "source", T.fingerprint(F.col("text")).alias("h"))
    first = f.groupBy("source", "h").agg(F.min("doc_id").alias("first_id"))
    return f.join(first, ["source", "h"]).select("doc_id", "source", "first_id", (F.col("doc_id") == F.col("first_id")).alias("kept"))


@query(r"""WITH n AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^(?:www\.|archive\.)', '') || lower(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/index\.html?$', '/', 'i'), '/+$', '')) AS key FROM pages)
SELECT key, min(page_id) AS page_id, arg_min(url, page_id) AS url, count(*) AS n FROM n GROUP BY key""")
def url_keys(spark, d):
    """CL8, SF24: pages by canonical URL, the first of each."""
    p = table(spark, d, "pages").withColumn("key", U.normalize_url(F.col("url")))
    return p.groupBy("key").agg(F.min("page_id").alias("page_id"), F.min_by("url", "page_id").alias("url"), F.count("*").alias("n"))


@query()
def url_scores(spark, d):
    """SF25-SF28, SO5: rule scores of URLs with their reasons."""
    p = table(spark, d, "pages").select("page_id", "url")
    s = p.withColumn("s", U.score(F.col("url")))
    return s.select("page_id", "s.score", "s.reasons", U.is_excluded(F.col("url")).alias("excluded"), U.year_hint(F.col("url"), F.lit("20230101")).alias("year"), U.registrable_domain(F.col("url")).alias("domain"), F.size(U.variants(F.col("url"))).alias("n_variants"))


URLS = [
    ("https://www.x.org/platform/", 5, False), ("https://x.org/2024-idaho-democratic-party-platform", 7, False), ("https://x.org/files/2022-platform.pdf", 10, False), ("https://x.org/2019/05/why-our-principles-still-matter-to-us/", -5, False),
    ("https://x.org/legislative-priorities", 4, False), ("https://x.org/about", -5, False), ("https://x.org/cdn-cgi/challenge-platform/h", 0, True), ("https://x.org/platform/10K/black/10K", 5, True), ("https://x.org", 0, False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{u}', {s}, {str(e).lower()})" for u, s, e in URLS) + ") t(url, score, excluded)")
def url_rules(spark, d):
    """SF25, SF26: rule scores of known URLs."""
    t = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}')" for u, _, _ in URLS) + " AS t(url)")
    return t.select("url", U.score(F.col("url"))["score"].alias("score"), U.is_excluded(F.col("url")).alias("excluded"))


BILLS = [
    ("TX", "D", "Voter registration act", "elections", "bill"), ("TX", "D", "Relating to redistricting plans", "", "bill"), ("TX", "D", "Electrical codes", "", "bill"), ("VT", "D", "School lunches", "education", "bill"), ("VT", "D", "Ballot harvesting penalties", "voting", "bill"),
    ("VT", "D", "Campaign finance reports", "ethics", "proposed bill"), ("OH", "D", "Elected officials pay", "", "bill"), ("OH", "D", "Roads", "transport", "bill"), ("TX", "R", "Candidate filing fees", "elections", "bill"), ("TX", "R", "Honoring voters", "elections", "resolution"),
    ("VT", "R", "Mail-in voting repeal", "absentee voting", "constitutional amendment"), ("VT", "R", "Water", "", "bill"), ("OH", "other", "Elections", "elections", "bill"), ("OH", "R", "Taxes", "", "bill"),
]
BILL_ROWS = ", ".join(f"('{s}', '{p}', '{t}', '{g}', '{c}')" for s, p, t, g, c in BILLS)
SUBTYPE = f"CASE WHEN regexp_matches(title, '{T.ELECTION}', 'i') THEN CASE " + " ".join(f"WHEN regexp_matches(title, '{p}', 'i') THEN '{n}'" for n, p in T.ELECTION_SUBTYPES) + " ELSE 'other_election' END END"
ELECTIONS = f"b0(unit, grp, title, subject, cls) AS (VALUES {BILL_ROWS}), b AS (SELECT *, {SUBTYPE} AS sub FROM b0 WHERE grp IN ('D', 'R') AND (starts_with(cls, 'bill') OR cls IN ('proposed bill', 'constitutional amendment')))"


def bills(spark: SparkSession) -> DataFrame:
    b = spark.sql(f"SELECT * FROM VALUES {BILL_ROWS} AS t(unit, grp, title, subject, cls)")
    return b.filter(F.col("grp").isin("D", "R") & (F.col("cls").startswith("bill") | F.col("cls").isin("proposed bill", "constitutional amendment"))).withColumn("sub", T.election_subtype(F.col("title")))


@query(f"""WITH {ELECTIONS}, t AS (SELECT unit, grp, count(*) AS n, count(sub) AS k, count(sub) / count(*) AS share FROM b GROUP BY ALL),
s AS (SELECT unit, grp, sub, row_number() OVER (PARTITION BY unit, grp ORDER BY count(*) DESC, sub) AS r FROM b WHERE sub IS NOT NULL GROUP BY unit, grp, sub)
SELECT t.unit, t.grp, n, k, round(share, 6) AS share, round((sum(share) OVER w - share) / nullif(count(*) OVER w - 1, 0), 6) AS peer_share, sub AS top_subtype FROM t LEFT JOIN s ON s.unit = t.unit AND s.grp = t.grp AND r = 1 WINDOW w AS (PARTITION BY t.grp)""")
def subject_focus(spark, d):
    """ST16, SF6, PF7, WN2, WN9: shares of a subject and its top kind by unit and group."""
    from ..operators.peers import leave_one_out

    b = bills(spark)
    t = b.groupBy("unit", "grp").agg(F.count("*").alias("n"), F.count("sub").alias("k")).withColumn("share", F.col("k") / F.col("n"))
    s = A.first_per(b.filter("sub IS NOT NULL").groupBy("unit", "grp", "sub").count(), ["unit", "grp"], F.desc("count"), F.asc("sub")).select("unit", "grp", F.col("sub").alias("top_subtype"))
    return rounded(t.withColumn("peer_share", leave_one_out("share", ["grp"])).join(s, ["unit", "grp"], "left"), "share", "peer_share")


@query(f"WITH {ELECTIONS}, q AS (SELECT subject <> '' AS u, sub IS NOT NULL AS r, regexp_matches(subject, '{T.ELECTION_SUBJECT}', 'i') AS t FROM b) SELECT count_if(u)::BIGINT AS n, count_if(u AND r)::BIGINT AS n_rule, count_if(u AND t)::BIGINT AS n_truth, round(count_if(u AND r AND t) / count_if(u AND r), 6) AS precision, round(count_if(u AND r AND t) / count_if(u AND t), 6) AS recall FROM q")
def subject_rule_quality(spark, d):
    """ST13: precision and recall of the title rule against tags."""
    s = F.col("subject")
    return rounded(C.rule_quality(bills(spark), F.col("sub").isNotNull(), T.found(s, T.ELECTION_SUBJECT), s != ""), "precision", "recall")


TAGS = [("Education (I0705)", 6), ("education|EDUCATION  (A12)", 6), ("Education|Taxation", None), ("Taxation|Unknown tag", 1), ("Unknown", None), ("", None), ("  taxation ", 1)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {'NULL' if c is None else c})" for t, c in TAGS) + ") t(tags, topic)")
def unanimous_tags(spark, d):
    """SF7, SF8: what the tags of an item agree on."""
    t = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}')" for t, _ in TAGS) + " AS t(tags)")
    return t.select("tags", T.unanimous(F.col("tags"), {"education": 6, "taxation": 1}).alias("topic"))


PARTIES = [("Democratic", "D"), ("Democratic-NPL", "D"), ("Republican", "R"), ("Democratic/Working Families", "D"), ("Republican/Conservative/Independence", "R"), ("Democratic/Republican", "other"), ("Working Families/Conservative", "other"), ("Independent", "other"), ("", "other")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PARTIES) + ") t(label, party)")
def party_labels(spark, d):
    """SF9, SF10: party of a ballot label."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}')" for a, _ in PARTIES) + " AS t(label)").select("label", T.normalize_party(F.col("label")).alias("party"))


@query(rf"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\t\n\v\f\r ]+') AS ws FROM documents) SELECT doc_id, CAST(len(ws) AS INT) AS n_words, coalesce(len(ws) >= 12 AND length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) <= 0.08 AND NOT regexp_matches(text, '{T.SPACED_CAPITALS}')
AND len(list_filter(ws, lambda x: regexp_matches(x, '^\p{{Ll}}'))) / len(ws) >= 0.4, false) AS prose FROM w""")
def prose_test(spark, d):
    """UD2, SF38: whether a text reads as prose."""
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"), T.looks_like_prose(F.col("text")).alias("prose"))


TOPICS = {1: ["of the", "that", "was"], 2: ["is", "ing"], 3: ["de la", "que", "pour"], 4: ["der", "die", "und", "nicht"]}
HIT = {c: " + ".join(rf"regexp_matches(text, '(?:^|[^\pL\pN_]){s}(?:$|[^\pL\pN_])', 'i')::INT" for s in seeds) for c, seeds in TOPICS.items()}


@query("WITH s AS (SELECT doc_id, " + ", ".join(f"({h}) / sqrt({len(TOPICS[c])}) AS s{c}" for c, h in HIT.items()) + " FROM documents), m AS (SELECT *, greatest(s1, s2, s3, s4) AS b FROM s) SELECT doc_id, CASE WHEN b = 0 THEN NULL WHEN s1 = b THEN 1 WHEN s2 = b THEN 2 WHEN s3 = b THEN 3 ELSE 4 END AS topic, round(b, 6) AS score FROM m")
def keyword_topics(spark, d):
    """UD3: topic of the most seeds found."""
    k = C.keyword_topic(F.col("text"), TOPICS)
    return rounded(table(spark, d, "documents").select("doc_id", k.alias("k")).select("doc_id", "k.topic", "k.score"), "score")


CENTROID = """un AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings),
me AS (SELECT label, i, avg(v[i]) AS x FROM un, generate_series(1, 64) g(i) GROUP BY ALL), ce AS (SELECT label, list(x ORDER BY i) AS c FROM me GROUP BY label),
sm AS (SELECT vec_id, un.label AS gold, ce.label, list_cosine_similarity(v, c) AS s FROM un, ce), rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM sm),
nc AS (SELECT vec_id, max(gold) AS gold, CASE WHEN max(s) FILTER (k = 1) >= 0.2 THEN max(label) FILTER (k = 1) END AS topic, max(label) FILTER (k = 2) AS second, max(label) FILTER (k = 1) AS best, max(s) FILTER (k = 1) AS similarity, max(s) FILTER (k = 1) - max(s) FILTER (k = 2) AS margin FROM rk GROUP BY vec_id)"""


def nearest(spark, d):
    e = table(spark, d, "embeddings")
    return C.nearest_centroid(e, "vec_id", "embedding", C.centroids(e, "label", "embedding"), "label").join(e.select("vec_id", F.col("label").alias("gold")), "vec_id")


@query(f"WITH {CENTROID} SELECT vec_id, topic, round(similarity, 6) AS similarity, round(margin, 6) AS margin FROM nc")
def nearest_centroid(spark, d):
    """UD4, UD6, WN13: nearest class of each vector, or none, and the margin."""
    return rounded(nearest(spark, d).select("vec_id", "topic", "similarity", "margin"), "similarity", "margin")


@query(f"""WITH {CENTROID}, m AS (SELECT gold AS r, topic AS p, count(*) AS n FROM nc WHERE topic IS NOT NULL GROUP BY ALL),
a AS (SELECT r, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (r = p), 0)::BIGINT AS agreed FROM m GROUP BY r), b AS (SELECT p, sum(n)::BIGINT AS np FROM m GROUP BY p),
x AS (SELECT r, p || ' (' || n || ')' AS t, row_number() OVER (PARTITION BY r ORDER BY n DESC, p) AS k FROM m WHERE r <> p), y AS (SELECT p, r || ' (' || n || ')' AS t, row_number() OVER (PARTITION BY p ORDER BY n DESC, r) AS k FROM m WHERE r <> p)
SELECT a.r AS reference, a.n, agreed, round(agreed / a.n, 6) AS recall, coalesce(np, 0) AS n_predicted, round(agreed / np, 6) AS precision, coalesce(x.t, '') AS top_confusion, coalesce(y.t, '') AS top_contaminant
FROM a LEFT JOIN b ON b.p = a.r LEFT JOIN x ON x.r = a.r AND x.k = 1 LEFT JOIN y ON y.p = a.r AND y.k = 1""")
def agreement_report(spark, d):
    """ST11, AG23: recall, precision and the main confusions of each label."""
    return rounded(C.agreement(nearest(spark, d).select(F.col("gold").alias("reference"), F.col("topic").alias("predicted"))), "recall", "precision")


@query(f"WITH {CENTROID} SELECT count(*) AS n, count_if(gold = topic)::BIGINT AS correct, count_if(gold IN (best, second))::BIGINT AS top2_correct, count_if(topic IS NULL)::BIGINT AS unclassified, round(count_if(gold = topic) / count(*), 6) AS accuracy, round(count_if(gold IN (best, second)) / count(*), 6) AS top2_accuracy FROM nc")
def classifier_accuracy(spark, d):
    """ST14: top-1 and top-2 accuracy."""
    return rounded(C.accuracy(nearest(spark, d)), "accuracy", "top2_accuracy")


STOPS = ["the", "and", "that", "for", "with", "are", "was"]


def chats(spark, d):
    c = table(spark, d, "conversations").groupBy((F.col("conv_id") % 20).cast("string").alias("unit"), F.col("role").alias("grp"))
    rows = F.array_sort(F.collect_list(F.struct("conv_id", "turn", "text")))
    return c.agg(F.array_join(F.transform(rows, lambda r: r["text"]), ". ").alias("text")).withColumn("evidence", F.lit("chat"))


TERMS = rf"""dc AS (SELECT CAST(conv_id % 20 AS VARCHAR) AS unit, role AS grp, string_agg(text, '. ' ORDER BY conv_id, turn, text) AS text FROM conversations GROUP BY ALL),
wd AS (SELECT unit, grp, list_filter(regexp_extract_all(regexp_replace(trim(lower(regexp_replace(text, '\s+', ' ', 'g'))), '[\pL\pN_]*[^\x00-\x7F][\pL\pN_]*', '|', 'g'), '\b([a-z][a-z''-]{{2,}})\b'), lambda w: w NOT IN ({', '.join(f"'{w}'" for w in STOPS)})) AS w FROM dc),
ng AS (SELECT unit, grp, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM wd), nn AS (SELECT unit, grp, term, count(*) AS n FROM ng GROUP BY ALL),
vo AS (SELECT term, count(*) AS df, sum(n) AS total FROM nn GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM dc)), vt AS (SELECT * FROM vo ORDER BY total DESC, term LIMIT 30000),
w1 AS (SELECT unit, grp, term, n, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM dc)) / (1 + df)) + 1) AS w FROM nn JOIN vt USING (term)),
w2 AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY unit, grp)) AS tfidf, (sum(n) OVER (PARTITION BY unit, grp))::BIGINT AS ft, (sum(n) OVER (PARTITION BY grp, term))::BIGINT - n AS pn, (sum(n) OVER (PARTITION BY grp))::BIGINT AS gt FROM w1),
w3 AS (SELECT *, gt - ft AS pt, pn = 0 AS pa, CASE WHEN pn > 0 THEN log2((n / ft) / (pn / nullif(gt - ft, 0))) END AS lc FROM w2 WHERE gt - ft > 0), w4 AS (SELECT * FROM w3 WHERE n >= 3 AND (pa OR lc > 0)),
w5 AS (SELECT *, row_number() OVER (PARTITION BY unit, grp ORDER BY round(tfidf, 9) DESC, term) AS tr, CASE WHEN NOT pa THEN row_number() OVER (PARTITION BY unit, grp, pa ORDER BY round(lc, 9) DESC, term) END AS cr FROM w4),
tm AS (SELECT * FROM w5 WHERE tr <= 12 OR coalesce(cr <= 12, false))"""


@query(f"WITH {TERMS} SELECT unit, grp, term, n, pn AS peer_n, ft AS feature_total, pt AS peer_feature_total, round(tfidf, 6) AS tfidf, round(lc, 6) AS log2_concentration, pa AS peer_absent, CAST(tr AS INT) AS tfidf_rank, CAST(cr AS INT) AS concentration_rank FROM tm")
def distinctive_terms(spark, d):
    """UD10, UD11, WN10, SF14, SF36: TF-IDF and concentration of terms against peers."""
    return rounded(terms.distinctive(chats(spark, d), STOPS, 3).drop("evidence"), "tfidf", "log2_concentration")


@query()
def term_highlights(spark, d):
    """UD12, WN8: one line of terms for each document."""
    return terms.highlights(terms.distinctive(chats(spark, d), STOPS, 3))


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY md5('7-' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, d):
    """SO4: a seeded sample."""
    return C.sample(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 50, 7)


@query("SELECT * FROM (SELECT c_nationkey AS unit, c_custkey, round(c_acctbal, 2) AS balance, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC, c_custkey) AS INT) AS rank FROM customer) WHERE rank <= 3")
def top_per_unit(spark, d):
    """SO1-SO3, WN8, FP9: the largest absolute values of each unit."""
    t = C.top_per(table(spark, d, "customer"), ["c_nationkey"], 3, F.desc(F.abs("c_acctbal")), F.asc("c_custkey"))
    return t.select(F.col("c_nationkey").alias("unit"), "c_custkey", F.round("c_acctbal", 2).alias("balance"), "rank")


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9900), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT k, 'both' AS state FROM c INTERSECT SELECT k, 'both' FROM s UNION ALL (SELECT k, 'first only' FROM c WHERE k NOT IN (SELECT k FROM s)) UNION ALL (SELECT n_nationkey, 'neither' FROM nation WHERE n_nationkey NOT IN (SELECT k FROM c) AND n_nationkey NOT IN (SELECT k FROM s))""")
def set_checks(spark, d):
    """SE2-SE4, SE6, FP7: members of both, of one, and of neither set."""
    c = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")).distinct()
    s = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    as_ = lambda t, x: t.withColumn("state", F.lit(x))
    return as_(c.intersect(s), "both").unionByName(as_(c.join(s, "k", "left_anti"), "first only")).unionByName(as_(n.join(c.union(s).distinct(), "k", "left_anti"), "neither"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, to_json([event_type, CAST(user_id AS VARCHAR)]) AS pair FROM events")
def json_fields(spark, d):
    """SF40, SRC8: fields out of and into JSON."""
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(F.array("event_type", F.col("user_id").cast("string"))).alias("pair"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_log_entry(spark, d):
    """SNK7: the last record of each key."""
    return writers.latest_per(table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("""WITH u AS (SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey, 'new' AS note FROM nation WHERE n_regionkey = 2) SELECT n_nationkey, n_name, n_regionkey, NULL::VARCHAR AS note FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT * FROM u""")
def partial_overwrite(spark, d):
    """SNK5: rows of the updated keys are replaced, the others stay."""
    n = table(spark, d, "nation")
    update = n.filter("n_regionkey = 2").withColumns({"n_name": F.upper("n_name"), "note": F.lit("new")})
    return writers.replaced(n, update, "n_regionkey").select("n_nationkey", "n_name", "n_regionkey", "note")


@query("""WITH u AS (SELECT c_custkey + 5 AS c_custkey, c_name, c_acctbal, 1 AS rev FROM customer WHERE c_custkey <= 20) SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, NULL::INT AS rev FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM u) AND c_name NOT IN (SELECT c_name FROM u) UNION ALL SELECT c_custkey, c_name, round(c_acctbal, 2), rev FROM u""")
def upsert(spark, d):
    """SNK6: an update replaces what shares its id or its name."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    u = c.filter("c_custkey <= 20").withColumns({"c_custkey": F.col("c_custkey") + 5, "rev": F.lit(1)})
    return rounded(writers.upserted(c, u, ["c_custkey", "c_name"]).select("c_custkey", "c_name", "c_acctbal", "rev"), "c_acctbal", digits=2)


@query("""WITH y(session, first) AS (VALUES (2021, 202), (2019, 1959), (2023, 2003), (2018, 2016), (2020, NULL), (NULL, 2022), (NULL, NULL))
SELECT session, first, CASE WHEN first IS NULL THEN session WHEN session IS NULL THEN first WHEN first < session - 2 THEN session ELSE first END AS year, coalesce(greatest(session, first) >= 2019, false) AS admitted FROM y""")
def filing_years(spark, d):
    """PF14, PF15: the credible year, and whether the window admits the row."""
    y = spark.sql("SELECT * FROM VALUES (2021, 202), (2019, 1959), (2023, 2003), (2018, 2016), (2020, NULL), (NULL, 2022), (NULL, NULL) AS t(session, first)")
    return y.select("session", "first", A.filing_year(F.col("session"), F.col("first")).alias("year"), F.coalesce(F.greatest("session", "first") >= 2019, F.lit(False)).alias("admitted"))


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 1998 OR o_orderkey % 13 = 0 THEN '1998-present' WHEN o_orderstatus IN ('F', 'O') THEN '1995-1997' END AS era, TRY_CAST(CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS INT) AS yr FROM orders""")
def eras(spark, d):
    """PF1, PF3-PF5, PF16: era of each row; an unreadable year counts as current."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "n/a").otherwise(F.year("o_orderdate").cast("string")).alias("raw"))
    o = o.withColumn("yr", T.try_int(F.col("raw")))
    return o.select("o_orderkey", F.when(F.col("yr").isNull() | (F.col("yr") >= 1998), "1998-present").when(F.col("o_orderstatus").isin("F", "O"), "1995-1997").alias("era"), "yr")


IDS = [("ocd-jurisdiction/country:us/state:tx/government", "TX"), ("ocd-jurisdiction/country:us/state:ak/government", "AK"), ("ocd-jurisdiction/country:us/government", None), ("ocd-jurisdiction/country:us/state:zz/government", None), ("", None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {'NULL' if b is None else repr(b)})" for a, b in IDS) + ") t(id, code)")
def jurisdiction_codes(spark, d):
    """PF13: unit code of an id."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}')" for a, _ in IDS) + " AS t(id)").select("id", T.state_code(F.col("id"), ["TX", "AK", "OH"]).alias("code"))


ARRAYS = [("{bill,resolution}", "bill|resolution"), ('{"Pardons and Paroles, Board of",PUBLIC}', "Pardons and Paroles, Board of|PUBLIC"), ("{}", ""), ("", ""), ('{"say ""x",a}', "say x|a"), ("{a,,b}", "a|b")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ARRAYS) + ") t(literal, joined)")
def array_literals(spark, d):
    """SF11: elements of database array literals."""
    t = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}')" for a, _ in ARRAYS) + " AS t(literal)")
    return t.select("literal", F.array_join(K.pg_array_col("literal"), "|").alias("joined"))


PROSE = rf"""len(regexp_extract_all(u, '[^\t\n\v\f\r ]+')) >= 12 AND length(regexp_replace(u, '[^0-9]', '', 'g')) / length(u) <= 0.08 AND NOT regexp_matches(u, '{T.SPACED_CAPITALS}')
AND len(list_filter(regexp_extract_all(u, '[^\t\n\v\f\r ]+'), lambda x: regexp_matches(x, '^\p{{Ll}}'))) / len(regexp_extract_all(u, '[^\t\n\v\f\r ]+')) >= 0.4"""


def packed_sentences(block: str) -> str:
    """SQL for a block's runs of sentences: a fold that keeps the finished runs in front of the open one."""
    cut = rf"string_split(regexp_replace({block}, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))"
    return f"string_split(list_reduce({cut}, lambda acc, x: acc || CASE WHEN length(split_part(acc, chr(30), -1)) + length(x) + 1 > {S.MOST} THEN chr(30) ELSE ' ' END || x), chr(30))"


def statements_sql(blocks: str) -> str:
    plain = rf"list_transform({blocks}, lambda b: trim(regexp_replace(b, '\s+', ' ', 'g')))"
    opened = rf"list_transform({plain}, lambda b: regexp_replace(b, '{S.BOILERPLATE}[ :.—-]*', ''))"
    cut = f"list_transform(list_filter({opened}, lambda b: length(b) >= {S.LEAST}), lambda b: CASE WHEN length(b) <= {S.MOST} THEN [b] ELSE {packed_sentences('b')} END)"
    return f"list_filter(flatten({cut}), lambda u: length(u) >= {S.LEAST} AND {PROSE})"


PARAGRAPHS = r"string_split_regex(text, '\n\s*\n')"
JOINED = rf"""string_split(list_reduce(list_prepend('', list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(9) || chr(10) || chr(13) || ' '))), lambda acc, x: acc || CASE
WHEN x = '' THEN CASE WHEN length(split_part(acc, chr(30), -1)) >= {S.LEAST} THEN chr(30) ELSE '' END
WHEN length(split_part(acc, chr(30), -1)) + length(x) + (split_part(acc, chr(30), -1) <> '')::INT >= CASE WHEN regexp_matches(x, '[.!?:;]$') THEN {S.WRAPPED} ELSE {3 * S.WRAPPED} END
THEN CASE WHEN split_part(acc, chr(30), -1) = '' THEN '' ELSE ' ' END || x || chr(30) ELSE CASE WHEN split_part(acc, chr(30), -1) = '' THEN '' ELSE ' ' END || x END), chr(30))"""


UNITS = rf"""t AS (SELECT doc_id, text, len(regexp_extract_all(text, '[^\t\n\v\f\r ]+')) AS words, {statements_sql(PARAGRAPHS)} AS own FROM documents WHERE text <> ''),
a AS (SELECT doc_id, own, CASE WHEN words > 500 AND len(own) * 500 < words THEN {statements_sql(JOINED)} END AS again FROM t),
c AS (SELECT doc_id, CASE WHEN len(again) > len(own) THEN again ELSE own END AS u FROM a)"""


@query(f"WITH {UNITS} SELECT doc_id, (generate_subscripts(u, 1) - 1)::INT AS unit_index, unnest(u) AS unit FROM c")
def document_units(spark, d):
    """UD1, UD8: statements that each document is made of."""
    found = S.with_statements(table(spark, d, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", F.posexplode("statements").alias("unit_index", "unit"))


@query()
def page_text(spark, d):
    """SF16-SF18: visible text of pages."""
    p = table(spark, d, "pages").select("page_id", T.html_text(K.strip_blocks_col("html")).alias("text"))
    return p.withColumn("n_words", T.word_count(F.col("text")))


@query()
def confirmed_documents(spark, d):
    """SF20-SF23: whether a document is what it is taken for, and of which type."""
    x = table(spark, d, "documents").select("doc_id", "source", "text")
    c = T.confirm_document(F.col("text"), F.col("source"), ["src1", "src2"])
    return x.select("doc_id", c.alias("c"), T.document_type(F.lit(""), F.col("text")).alias("doc_type")).select("doc_id", "c.confirmed", "c.reason", "c.hits", "doc_type")


@query("""WITH c AS (SELECT date_trunc('day', ts) AS start, event_type AS category, count(*) AS n FROM events GROUP BY ALL) SELECT start::TIMESTAMP AS start, category, n, round(n / sum(n) OVER (PARTITION BY start), 6) AS share FROM c""")
def window_shares(spark, d):
    """2.16: shares by day of event time."""
    e = table(spark, d, "events").select("ts", F.col("event_type").alias("category"))
    return rounded(windows.window_shares(windows.window_counts(e)), "share")


@query("""SELECT 'shares sum to one' AS name, true AS ok, 0::BIGINT AS failures UNION ALL SELECT 'keys are unique', count(*) = count(DISTINCT o_orderkey), count(*) - count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'no orphans', count(*) = 0, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def audit(spark, d):
    """ST23: invariants as rows of name, ok and the number of failures."""
    from ..operators import shares
    from .composition import counts

    s = shares.shares(counts(spark, d), ["unit", "grp"]).groupBy("unit", "grp").agg(F.sum("share").alias("s"))
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    rows = [
        s.agg(F.count_if(F.abs(F.col("s") - 1) > 1e-9).alias("failures")).withColumn("name", F.lit("shares sum to one")),
        o.agg((F.count("*") - F.count_distinct("o_orderkey")).alias("failures")).withColumn("name", F.lit("keys are unique")),
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("failures")).withColumn("name", F.lit("no orphans")),
    ]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.select("name", (F.col("failures") == 0).alias("ok"), "failures")

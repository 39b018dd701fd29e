"""Text rules, kernels, clusters, sources and sinks on small inputs with known results."""

import random
import re
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tallywright.functions import kernels as K
from tallywright.functions.segments import joined_lines, with_statements
from tallywright.functions import text as T
from tallywright.functions import urls as U
from tallywright.operators import classify, cluster, terms
from tallywright.sources import readers, writers


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first().x


def test_titles_of_one_template_agree(spark):
    a = one(spark, T.normalize_title, "An Act HB 1234 relating to voting, 2024 (3rd reading)")
    assert a == one(spark, T.normalize_title, "An Act SB 99 relating to voting 2019 2nd reading")
    assert one(spark, T.normalize_title, None) == ""


@pytest.mark.parametrize(("title", "want"), [("Voter fraud penalties", None), ("Election fraud penalties", "election_security"), ("Redistricting commission", "redistricting"), ("Electrical codes", None), ("Elected officials", None), ("Campaign finance limits", "campaign_finance"), ("Write-in candidates", "candidates_and_parties")])
def test_election_subtypes(spark, title, want):
    got = one(spark, T.election_subtype, title)
    assert got == (want if title != "Voter fraud penalties" else "election_security")


@pytest.mark.parametrize(("title", "want"), [("Recognizing nurses week", True), ("Designating May as Bike Month", True), ("Tax reform", False), ("Honor roll act", True)])
def test_ceremonial(spark, title, want):
    assert one(spark, lambda c: T.found(c, T.CEREMONIAL), title) is want


def test_keyword_ties_go_to_the_first_topic(spark):
    topics = {5: ["labor", "wage", "union", "job"], 6: ["school"], 7: ["water"]}
    k = lambda t: one(spark, lambda c: classify.keyword_topic(c, topics), t)
    assert k("nothing here").topic is None and k("labor unions and a wage").topic == 5 and k("School and water").topic == 6


def test_strip_blocks_equals_the_pattern_and_is_linear():
    for s in ("a<nav>b</nav>c", "a<SCRIPT x=1>b</script >c", "<style>x</style><p>y</p>", "a<nav>b", "x<nav>a<script>b</nav>c</script>d", ""):
        import re

        want = re.sub(r"(?is)<(script|style|nav|header|footer)\b[^>]*>.*?</\1[^>]*>", " ", s)
        assert " ".join(K.strip_blocks(s).replace("<nav>", " ").split()) == " ".join(want.replace("<nav>", " ").split())
    began = time.time()
    K.strip_blocks("<nav>" * 200_000)
    assert time.time() - began < 5


def test_segments(spark):
    p = "We believe that every child in the state should have a good school and that teachers deserve fair pay for the hard work they do. "
    short_lines = "\n\n".join((p * 40).replace(" teachers", "\n\nteachers").split(" should "))
    long_sentence = "we hold " + "that all of this is so and " * 80 + "no more."
    texts = [
        p + "\n\n" + p, "Contents 1 2 3\n\nPREAMBLE", None, "", p * 40, "PAID FOR BY " + p, "\n".join((p * 30).split(". ")), short_lines, long_sentence,
        "A ND D EMOCRACY " + p, "Page 12 . 13 . 14 " * 20, "PREAMBLE too short", p.strip() + "\n \t\n" + p + "\nmore",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.statements for r in with_statements(d, "text").collect()}
    assert got[0] == [p.strip()] * 2 and got[1] == got[2] == got[3] == []
    assert len(got[4]) == -(-40 // (1500 // len(p))) and " ".join(got[4]) == (p * 40).strip() and all(len(u) <= 1500 for u in got[4])
    assert got[5][0].startswith("We believe") and len(got[6]) >= 3 and len(got[7]) >= 3 and got[8] == [long_sentence]
    assert got[9] == got[10] == got[11] == [] and got[12] == [p.strip(), p + "more"]


def test_joined_lines(spark):
    line = "x" * 49
    texts = ["\n".join([line] * 30), "\n".join([line, line + "."] * 20), "\n\n".join([line] * 5), f"  a b \n\n\n  c  \n d", ""]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: [len(b) for b in r.b] for r in d.select("id", joined_lines(F.col("text")).alias("b")).collect()}
    assert got[0] == [24 * 50 - 1 + 50 * (24 * 50 - 1 < 1200), 5 * 50 - 1] and got[1] == [8 * 50 + 4 - 1] * 5
    assert got[2] == [149, 99] and got[3] == [7] and got[4] == []


@pytest.mark.parametrize(("literal", "want"), [("{bill,resolution}", ["bill", "resolution"]), ('{"a, b",c}', ["a, b", "c"]), (r'{"say \"x\"",y}', ['say "x"', "y"]), ("", []), (None, []), ("{}", [])])
def test_pg_array(literal, want):
    assert K.pg_array(literal) == want


def test_rtf_and_decoding():
    assert K.strip_rtf(r"{\rtf1{\fonttbl\f0 Helvetica;}\f0 Hello\par W\'e9 \{ok\}}") == "Hello\nWé {ok}"
    assert K.strip_rtf("plain {x}") == "plain {x}"
    assert [K.decode(b) for b in ("é".encode(), "é".encode("cp1252"), b"\x81", b"\xef\xbb\xbfa", None)] == ["é", "é", "\x81", "a", None]


@pytest.mark.parametrize("spelled", ["Hawaii", "Hawai'i", "Hawaiʻi", "Hawai‘i"])
def test_names_fold(spelled):
    assert K.fold_name(spelled) == "Hawaii" and K.fold_name("Ohio’s Ohio") == "Ohio's Ohio"


def test_ligatures(spark):
    assert one(spark, T.repair_ligatures, "ConsƟtuƟons ﬁrst") == "Constitutions first"


def test_confirm(spark):
    body = "We believe in Ohio. We support Ohio. We oppose waste. " + "Ohio people work here every day. " * 100
    f = lambda t, rivals=(): spark.createDataFrame([(t, "Ohio")], "t string, n string").select(T.confirm_document(F.col("t"), F.col("n"), list(rivals)).alias("c")).first().c
    assert f(body).confirmed and f(body).hits >= 3
    assert f("").reason == "no text" and f("short").reason == "too short" and f("words " * 900).reason == "lacks platform language"
    assert f(body.replace("Ohio", "Iowa"), ["Iowa"]).reason == "never names its state"
    assert f(body + "Iowa " * 300, ["Iowa"]).reason == "names another state more"
    assert f(body + "annual report upcoming events").reason == "another class of document"


def test_urls(spark):
    for u in ("https://www.texasgop.org/2022platform/", "http://archive.texasgop.org/2022platform/index.html", "https://texasgop.org/2022platform?utm_x=1"):
        assert one(spark, U.normalize_url, u) == "texasgop.org/2022platform"
    assert one(spark, U.registrable_domain, "https://www.mtgop.org/path") == "mtgop.org"
    assert one(spark, U.variants, "http://www.x.org/")[0] == "http://www.x.org/"
    assert one(spark, lambda c: U.year_hint(c, F.lit("20230101")), "https://x.org/2022platform/") == 2022


def test_reuse_needs_several_units(spark):
    t = "Establishing the interstate compact for the practice of nursing in the several states"
    rows = [(i, u, 2019 + i, f"HB {i} {t}", g) for i, (u, g) in enumerate([("TX", "D"), ("OH", "R"), ("GA", "R"), ("TX", "D")])] + [(9, u, 2020, "Making appropriations for the support of government and other purposes", "D") for u in ("TX", "OH", "GA")]
    d = spark.createDataFrame(rows, "id long, unit string, year int, title string, grp string")
    r = cluster.reuse_clusters(d).collect()
    assert len(r) == 1 and (r[0].n_units, r[0].n_items, r[0].units, r[0].n_a, r[0].n_b, r[0].skew) == (3, 4, "GA,OH,TX", 2, 2, 0.0)


def test_near_duplicates_chain_and_report_cohesion(spark):
    a = ["w1", "w2", "w3", "w4", "w5", "w6"]
    rows = [(1, "TX", 2019, "a", a), (2, "OH", 2021, "b", [*a[1:], "x1"]), (3, "GA", 2023, "c", [*a[2:], "x1", "x2"]), (4, "VT", 2020, "d", ["q1", "q2", "q3", "q4", "q5"]), (5, "TX", 2020, "e", a)]
    d = spark.createDataFrame(rows, "id long, unit string, year int, title string, tokens array<string>")
    r = cluster.near_duplicate_clusters(d, threshold=0.6, least_units=3).collect()
    assert len(r) == 1 and r[0].units == "GA,OH,TX" and r[0].cohesion < 0.6 and (r[0].first_year, r[0].last_year, r[0].n_items) == (2019, 2023, 4)


def test_redundant_documents(spark):
    words = " ".join(f"word{chr(97 + i)}" for i in range(20))
    rows = [(1, "CO", "D", 2020, True, words), (2, "CO", "D", 2021, False, words + " extra"), (3, "CO", "D", 2024, True, words), (4, "CO", "D", None, False, words), (5, "TX", "D", 2020, True, words)]
    got = {r.id: (r.component, r.kept) for r in cluster.redundant(spark.createDataFrame(rows, "id long, unit string, grp string, year int, collected boolean, text string")).collect()}
    assert got[5] == (5, True) and {got[k][0] for k in (1, 2, 3, 4)} == {1} and [k for k, (_, kept) in got.items() if kept and k < 5] == [3]


def test_redundant_documents_against_all_pairs(spark, monkeypatch):
    """Few links whatever the number of copies, and the components of all pairs."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    bases = [r.sample(vocabulary, r.choice([1, 3, 9, 12, 20, 30])) for _ in range(40)]
    rows = [(i, "CO", "D", 2020, True, "some words that repeat") for i in range(150)] + [(150 + i, "CO", "D", 2022, False, "other words here again") for i in range(50)]
    for i in range(200, 420):
        t = list(r.choice(bases))
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = r.choice(vocabulary)
        t += r.sample(vocabulary, r.choice([0, 0, 0, 10]))
        rows.append((i, r.choice(["CO", "TX", None]), r.choice("DR"), r.choice([None, *range(2015, 2022)]), r.random() < 0.4, r.choice([" ".join(t)] * 9 + [None])))
    links, plain = [], cluster.components
    monkeypatch.setattr(cluster, "components", lambda edges, scratch: links.append(edges.count()) or plain(edges, scratch))
    got = {x.id: (x.component, x.kept) for x in cluster.redundant(spark.createDataFrame(rows, "id long, unit string, grp string, year int, collected boolean, text string")).collect()}
    label, words = {x[0]: x[0] for x in rows}, {x[0]: set(re.findall("[a-z]{4,}", x[5] or "")) for x in rows}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for j, a in enumerate(rows):
        for b in rows[:j]:
            if a[1] is not None and a[1:3] == b[1:3] and (a[4] or b[4]) and (a[3] is None or b[3] is None or abs(a[3] - b[3]) <= 1):
                x, y = words[a[0]], words[b[0]]
                if x and y and (len(x & y) / len(x | y) >= 0.85 or len(x & y) / min(len(x), len(y)) >= 0.9):
                    u, v = sorted((find(a[0]), find(b[0])))
                    label[v] = u
    best = {}
    for x in sorted(rows, key=lambda x: (not x[4], -len(x[5] or "") if x[5] is not None else 1, -(-1 if x[3] is None else x[3]), x[0])):
        best.setdefault(find(x[0]), x[0])
    assert got == {x[0]: (find(x[0]), best[find(x[0])] == x[0]) for x in rows}
    assert sum(got[i][0] != i for i in range(200, 420)) > 30 and links[0] < 3000


def test_terms_absent_in_peers(spark):
    rows = [("TX", "D", "x", "solar solar solar energy jobs"), ("OH", "D", "x", "energy jobs energy"), ("VT", "D", "x", "jobs energy jobs"), ("TX", "R", "x", "solar panels"), ("GA", "D", "x", "schools")]
    t = terms.distinctive(spark.createDataFrame(rows, "unit string, grp string, evidence string, text string"), [], 1)
    solar = t.filter("unit = 'TX' AND grp = 'D' AND term = 'solar'").first()
    assert solar.peer_absent and solar.log2_concentration is None and solar.n == 3
    assert "solar (absent in peers)" in terms.highlights(t).filter("unit = 'TX' AND grp = 'D'").first().distinctive_terms


def test_agreement_and_rules(spark):
    s = spark.createDataFrame([(6, 6), (6, 6), (1, 6), (1, 1), (None, 1)], "reference int, predicted int")
    r = {x.reference: x for x in classify.agreement(s).collect()}
    assert (r[6].recall, r[6].n_predicted, r[6].top_contaminant, r[1].recall) == (1.0, 3, "1 (1)", 0.5) and r[6].precision == pytest.approx(2 / 3)
    q = classify.rule_quality(s.limit(0), F.lit(True), F.lit(True), F.lit(True)).first()
    assert (q.n, q.precision, q.recall) == (0, 0.0, 0.0)


def test_copy_sections(spark, tmp_path):
    lines = ["COPY public.a (id, name) FROM stdin;", "1\t\\N", "2\tx\\ty\\\\nz", "bad", "\\.", "COPY public.b (k) FROM stdin;", "7", "\\."]
    (tmp_path / "dump.sql").write_text("\n".join(lines))
    t = readers.copy_tables(spark, str(tmp_path / "dump.sql"))
    assert [tuple(r) for r in t["public.a"].orderBy("id").collect()] == [("1", None), ("2", "x\ty\\nz")] and t["public.b"].first().k == "7"


def test_zip_members_and_filenames(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/TX-2020-D.txt", "hello")
        z.writestr("__MACOSX/d/._TX-2020-D.txt", "junk")
    m = readers.zip_members(spark, str(tmp_path / "*.zip")).collect()
    assert [r.member for r in m] == ["d/TX-2020-D.txt"]
    p = one(spark, readers.parse_filename, "US-1916-Socialist-B-EA.rtf")
    assert (p.state, p.year, p.party, p.flags) == ("US", 1916, "Socialist", ["B", "EA"])
    with pytest.raises(Exception, match="unparseable"):
        one(spark, readers.parse_filename, "nonsense.txt")


def test_json_rows_and_settings(spark, tmp_path):
    assert [r.url for r in one(spark, lambda c: readers.json_rows(c, ["url", "ts"]), '[["url","ts"],["u1","1"],["u2","2"]]')] == ["u1", "u2"]
    (tmp_path / "t.yml").write_text("topics:\n - {code: 1, name: a}\n - {code: 1, name: b}\n")
    assert readers.settings(spark, str(tmp_path / "t.yml"), "topics", "code int, name string").count() == 2
    with pytest.raises(ValueError, match="repeated"):
        readers.settings(spark, str(tmp_path / "t.yml"), "topics", "code int, name string", unique="code")


def test_upsert_and_logs(spark, tmp_path):
    old = spark.createDataFrame([("1", "u1", "a"), (None, "u2", "b"), ("3", "u3", "c")], "id string, url string, text string")
    new = spark.createDataFrame([("1", "u9", "A", 1), ("5", "u2", "B", 1)], "id string, url string, text string, rev int")
    assert sorted(r.text for r in writers.upserted(old, new, ["id", "url"]).collect()) == ["A", "B", "c"]
    log = str(tmp_path / "log")
    writers.append_log(spark.createDataFrame([("u", 503, 1)], "url string, status int, seq int"), log)
    writers.append_log(spark.createDataFrame([("u", 200, 2)], "url string, status int, seq int"), log)
    assert writers.latest_per(writers.read_log(spark, log, "url string, status int, seq int"), "url", "seq").first().status == 200
    settled, retry = writers.to_retry(spark.createDataFrame([("a", "ok"), ("b", "fetch failed: 503")], "url string, reason string"), spark.createDataFrame([("a",), ("b",), ("c",)], "url string"), "url")
    assert settled.count() == 1 and sorted(r.url for r in retry.collect()) == ["b", "c"]
    writers.overwrite(old.limit(0), str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).columns == old.columns


def test_sample_depends_on_seed_only(spark):
    d = spark.range(100).withColumnRenamed("id", "k")
    a = [r.k for r in classify.sample(d, "k", 10, 1).collect()]
    assert a == [r.k for r in classify.sample(d.repartition(7), "k", 10, 1).collect()] != [r.k for r in classify.sample(d, "k", 10, 2).collect()]


def test_stream_counts_windows(spark, tmp_path):
    from tallywright.streaming import shares as S

    src = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 01:00' AS ts, 'a' AS category UNION ALL SELECT timestamp'2024-01-01 02:00', 'b' UNION ALL SELECT timestamp'2024-02-01 02:00', 'b'").write.parquet(src)
    q = S.run(spark.readStream.schema("ts timestamp, category string").parquet(src), "windows", str(tmp_path / "cp"))
    q.processAllAvailable()
    spark.sql("SELECT timestamp'2024-02-09 01:00' AS ts, 'a' AS category").write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    got = S.window_shares(spark.table("windows")).collect()
    assert sorted((r.category, r.n, r.share) for r in got if r.start.month == 1) == [("a", 1, 0.5), ("b", 1, 0.5)]

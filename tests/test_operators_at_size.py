"""Operators whose plans split rows, blocks or files: results don't depend on how."""

import random

import pytest
from pyspark.sql import functions as F

from tallywright.functions import text as T
from tallywright.operators import classify as C
from tallywright.operators import cluster
from tallywright.sources import readers


@pytest.mark.parametrize("split", ["128m", "300b"])
def test_dump_in_splits(spark, tmp_path, split):
    rows = [f"{i}\tname {i}\t\\N" for i in range(60)]
    lines = ["-- a dump", "COPY public.a (id, name, note) FROM stdin;", *rows, "COPY public.x (id) FROM stdin;", "\\.", "", "COPY public.b (id) FROM stdin;", "1", "2", "\\.", "COPY public.a (id, name, note) FROM stdin;", "99\tlast\tx\\ty", "\\.", "1\tstray\t2"]
    (tmp_path / "d.sql").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        t = readers.copy_tables(spark, str(tmp_path))
        assert sorted(t) == ["public.a", "public.b"]
        got = sorted((int(r.id), r.name, r.note) for r in t["public.a"].collect())
        assert got == [(i, f"name {i}", None) for i in range(60)] + [(99, "last", "x\ty")] and sorted(r.id for r in t["public.b"].collect()) == ["1", "2"]
        assert t["public.a"].rdd.getNumPartitions() >= (1 if split == "128m" else 4)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_nearest_centroid_keeps_repeated_keys(spark):
    classes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "label int, centroid array<double>")
    rows = spark.createDataFrame([(7, [3.0, 0.0]), (7, [0.0, 2.0]), (8, [0.0, 0.0]), (9, None)], "k int, v array<double>")
    got = sorted((r.k, r.topic, r.top2) for r in C.nearest_centroid(rows, "k", "v", classes, "label").collect() if r.k == 7)
    assert got == [(7, 1, [1, 2]), (7, 2, [2, 1])]
    assert {r.k: r.topic for r in C.nearest_centroid(rows, "k", "v", classes, "label").collect() if r.k > 7} == {8: None, 9: None}
    one = C.nearest_centroid(rows.filter("k = 7"), "k", "v", classes.limit(1), "label")
    assert all(r.margin is None for r in one.collect())


def test_redundant_against_all_pairs(spark):
    r = random.Random(5)
    words = [a + b + "word" for a in "abcdefgh" for b in "ijklmnop"]
    rows = []
    for i in range(120):
        base = [r.choice(words) for _ in range(r.randint(0, 24))] if not rows or r.random() < 0.4 else r.choice(rows)[5].split()
        text = [w for w in base if r.random() > 0.06] + [r.choice(words) for _ in range(r.randint(0, 2))]
        rows.append((i, "u" + str(i % 2), "g", r.choice([None, 2000, 2001, 2003]), r.random() < 0.5, " ".join(text)))
    d = spark.createDataFrame(rows, "id long, unit string, grp string, year int, collected boolean, text string")
    label = list(range(120))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    sets = [set(x[5].split()) for x in rows]
    for i in range(120):
        for j in range(i):
            a, b = rows[i], rows[j]
            both, x, y = sets[i] & sets[j], sets[i], sets[j]
            if a[1] == b[1] and (a[4] or b[4]) and (a[3] is None or b[3] is None or abs(a[3] - b[3]) <= 1) and x and y and (len(both) / len(x | y) >= 0.85 or len(both) / min(len(x), len(y)) >= 0.9):
                lo, hi = sorted((find(i), find(j)))
                label[hi] = lo
    got = {x.id: x.component for x in cluster.redundant(d).collect()}
    assert [got[i] for i in range(120)] == [find(i) for i in range(120)]


def test_blocks_without_a_bound(spark):
    rows = [(i, f"u{i}", 2000, "t", ["common", "a", "b", "c", "d", f"own{i}"]) for i in range(12)]
    d = spark.createDataFrame(rows, "id long, unit string, year int, title string, tokens array<string>")
    assert cluster.near_duplicate_clusters(d, threshold=0.7, keys=6, most_block=5).count() == 0
    assert cluster.near_duplicate_clusters(d, threshold=0.7, keys=6, most_block=None).first().n_items == 12


def test_what_responses_and_names_declare(spark):
    cases = [
        (b"%PDF-1.4", "", "x", "pdf"), (b"abc", "application/pdf", "x", "pdf"), (b"abc", None, "https://x.org/A.PDF?x=1", "pdf"), (b"PK\x03\x04abc", None, "x", "binary"),
        (b"abc", "Image/PNG; a=b", "x", "binary"), (b"a\x00" * 100, "", "x", "binary"), (b"<p>x</p>", "text/html", "x", "text"), (b"", "", "x", "text"), (None, "", "x", "text"),
    ]
    d = spark.createDataFrame([(i, bytearray(b) if b is not None else None, c, u) for i, (b, c, u, _) in enumerate(cases)], "i int, body binary, kind string, url string")
    got = {r.i: r.k for r in d.select("i", T.response_kind(F.col("body"), F.col("kind"), F.col("url")).alias("k")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]
    names = [("https://x.org/PADEMS-NEWSLETTER.pdf", "newsletter"), ("https://x.org/a/annual%20report.pdf", "annual report"), ("https://x.org/press/z", "press release or index page"), ("https://x.org/minutes/platform.pdf", None), ("https://x.org/platform?minutes", None), ("x", None), (None, None)]
    d = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(names)], "i int, u string")
    got = {r.i: r.c for r in d.select("i", T.other_class(F.col("u")).alias("c")).collect()}
    assert [got[i] for i in range(len(names))] == [c for _, c in names]


def test_names_in_text_without_spaces(spark):
    body = ("WebelieveNewYorkshouldthriveandWesupportNewYorkschools;WeopposefraudinNewYork." * 60)
    d = spark.createDataFrame([(body, "New York"), (body, "Ohio")], "t string, n string")
    got = [r.c for r in d.select(T.confirm_document(F.col("t"), F.col("n")).alias("c")).collect()]
    assert got[0].confirmed and not got[1].confirmed and got[1].reason == "never names its state"

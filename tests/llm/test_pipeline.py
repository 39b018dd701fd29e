"""The stages against brute force over a small corpus."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tallywright.llm import mixing, queries, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    import sys

    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_texts import toxic_texts

    at = tmp_path_factory.mktemp("corpus")
    texts = list(toxic_texts(160, 9))
    r = random.Random(77)
    item = " ".join("".join(r.choice(["an", "te", "lo", "ri", "mu"]) for _ in range(r.randint(1, 4))) for _ in range(25))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, (t, _) in enumerate(texts)]
    rows += [(500, texts[0][0] + " more", "en", "s0", 1), (501, f"an {item} lo", "en", "s1", 1), (502, None, "en", None, None), (503, "", None, "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), {i: y for i, (_, y) in enumerate(texts)}


def test_stages(spark, corpus, monkeypatch):
    d, toxic = corpus
    small = toxicity.Settings(steps=60, batch=48, bits=11)
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: fit(docs, labels, small))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = pipeline.toxicity(spark, docs, d).cache()
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and {501, 502, 503} <= ids and sum((i in ids) == (not y) for i, y in toxic.items()) >= 0.93 * len(toxic)
    unique = pipeline.near_duplicates(spark, kept, d).cache()
    left = {r.doc_id for r in unique.collect()}
    assert left <= ids and {501, 502, 503} <= left and not (0 in ids and 500 in left)
    clean = pipeline.decontamination(spark, unique, d).cache()
    assert {r.doc_id for r in clean.collect()} == left - {501}
    mixed = pipeline.mixing(spark, clean, d).cache()
    assert mixed.columns == docs.columns and mixed.count() == mixing.fair_mix(clean).agg({"copies": "sum"}).first()[0]
    sharded = pipeline.sharding(spark, mixed, d)
    assert sharded.count() == mixed.count() and sharded.agg({"shard": "max"}).first()[0] < pipeline.SHARDS
    assert sharded.columns == [*docs.columns, "size", "shard", "slot"]
    key = lambda r: tuple(str(r[c]) for c in docs.columns)
    assert sorted(map(key, sharded.collect())) == sorted(map(key, mixed.collect()))


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, held_out string, id string, mix int, size string, shard int, slot int, `a.b` string, key string, `__id` int, `__n` int"


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_every_stage_takes_any_columns_repeats_and_nothing(spark, corpus, monkeypatch, name):
    d, _ = corpus
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: None)
    stage = dict(pipeline.STAGES)[name]
    more = (0.5, 1, "h", "i", 3, "s", 1, 2, "ab", "k", 4, 5)
    texts = [("one two three four five six seven", "s0"), ("another text of words that is not the same", "s1"), (None, None), ("", "s1"), ("word " * 200_000, "s0")]
    rows = [(i, t, "en", s, 1, *more) for i, (t, s) in enumerate(texts)] + [(0, texts[0][0], "en", "s0", 1, *more), (None, "null id has a text of its own here", None, None, None, *more)]
    docs = spark.createDataFrame(rows, CLASHES)
    out = stage(spark, docs, d)
    added = ["size_", "shard_", "slot_"] if name == "sharding" else []
    assert out.columns == [*docs.columns, *added]
    got = out.collect()
    ids = {r.doc_id for r in got}
    assert ids >= {1, 4} and all(tuple(r)[5:17] == more for r in got)
    if name == "near_duplicates":
        assert len(got) == 6
    elif name != "mixing":
        assert len(got) == 7
    assert stage(spark, docs.limit(0), d).count() == 0


def test_run_is_its_stages(spark, corpus, monkeypatch):
    d, _ = corpus
    small, fit = toxicity.Settings(steps=40, batch=48, bits=11), toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: fit(docs, labels, small))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, d).cache()
    want = sorted((str(r.doc_id), str(r.text), r.size) for r in docs.collect())
    assert sorted((str(r.doc_id), str(r.text), r.size) for r in pipeline.run(spark, d).collect()) == want


def test_queries_are_registered():
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in queries.QUERIES)] == []

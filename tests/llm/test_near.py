import random

import numpy as np
import pytest

from tallywright.llm import embedding_links, shingle_join
from tallywright.llm.shingles import shingles, word_hashes
from tallywright.operators.graph import components
from tallywright.operators.scratch import Scratch


def reach(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(x) for x in range(n)]


def test_components_of_chain_star_and_cycle(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (200, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[100 + k] for k in range(40)} == {100} and {got[200], got[201], got[202]} == {200}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def shingle_set(text):
    words = [w.lower() for w in (text or "").split()]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("hot", [1 << 16, 3])
def test_shingle_join_against_all_pairs(spark, hot):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "  ", "one two", "ONE two", "one two three"]
    passage = [r.choice(vocabulary) for _ in range(30)]
    for _ in range(40):
        base = [r.choice(vocabulary) for _ in range(r.randint(6, 90))]
        if r.random() < 0.4:
            base[3:3] = passage
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    for _ in range(60):  # near the threshold on either side
        copy = list(passage)
        for _ in range(r.randint(0, 2)):
            copy[r.randrange(30)] = r.choice(vocabulary)
        texts.append(" ".join(copy[: r.randint(25, 30)]))
    hub = [r.choice(vocabulary) for _ in range(100)]
    for k in range(30):
        copy = list(hub)
        copy[(k * 7) % 100] = f"z{k}"
        texts.append(" ".join(copy))
    texts += ["same text of some words here"] * 30
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = reach(len(texts), links)
    d = spark.createDataFrame([(i, t, 5, "g") for i, t in enumerate(texts)], "doc_id long, text string, n int, digest string").repartition(5)
    got = {x.doc_id: x for x in shingle_join.near_duplicates(d, hot=hot).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want
    kept = shingle_join.distinct_rows(d)
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect()) == sorted(i for i, c in enumerate(want) if i == c)


def test_members_of_a_group_that_its_first_one_does_not_link(spark):
    """Nine shingles, of which the two of the prefix are equal: 2 and 3 link, as do 4 and 5, none of them with 1 or across."""
    r = random.Random(5)
    new = lambda n: " ".join(f"x{r.randrange(1 << 30)}" for _ in range(n))
    of = lambda text: shingles(word_hashes([text.encode()])[0])
    while True:
        start = new(6)
        low = of(start)
        if low.max() < 1 << 61:  # likely the least two of nine
            break

    def grown(text, n):
        while True:
            found = f"{text} {new(n)}"
            if (of(found)[:2] == low).all():
                return found

    texts = [grown(start, 7)]
    for _ in range(2):
        base = grown(start, 6)
        texts += [grown(base, 1), grown(base, 1)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in shingle_join.near_duplicates(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")).collect()}
    assert got == {1: (9, 1), 2: (9, 2), 3: (9, 2), 4: (9, 4), 5: (9, 4)}


def test_shingle_join_edges(spark):
    assert shingle_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "x" * 300_000)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in shingle_join.near_duplicates(d).collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("3", 3), ("None", None)]
    assert sorted(str(r.doc_id) for r in shingle_join.distinct_rows(d).collect()) == ["1", "3", "None"]


@pytest.mark.parametrize("hot", [2000, 8])
def test_embedding_links_against_all_pairs(spark, hot):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 16)).tolist()
    for k in range(60):
        x.append([a + 0.05 * e for a, e in zip(x[k % 9], rng.standard_normal(16).tolist(), strict=True)])
    x += [list(x[0]), [2 * a for a in x[0]], [0.0] * 16, None, [float("nan")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0], [1e300] * 16, []]
    d = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, copies int")
    good = {i: np.array(v, float) / np.abs(np.array(v, float)).max() for i, v in enumerate(x) if v and all(a is not None and np.isfinite(a) for a in v) and any(v)}
    links = [(i, j) for i in good for j in good if i != j and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.95]
    want = reach(len(x), links)
    got = {r.vec_id: r for r in embedding_links.link_vectors(d, hot=hot).collect()}
    assert [got[i].n_links for i in range(len(x))] == [sum(a == i for a, _ in links) for i in range(len(x))]
    assert [got[i].component_id for i in range(len(x))] == want and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_plan_is_calibrated():
    plan = embedding_links.Plan(100_000, 0.95, 0.998, 1)
    assert 1 - (1 - embedding_links.cell_share(plan.radius) ** plan.per_table) ** plan.tables >= 0.998
    rng = np.random.default_rng(0)
    u = rng.standard_normal((400, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal((400, 64))
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.95 * u + np.sqrt(1 - 0.95**2) * w
    fine = plan.directions(64)[2]
    assert embedding_links.colliding(u @ fine, v @ fine, plan).mean() >= 0.99
    assert (plan.keys(u) == plan.keys(v)).any(1).mean() >= 0.99


def near_copies(rng, n, cosine, dim=64):
    center = rng.standard_normal(dim)
    x = np.sqrt(cosine) * center / np.linalg.norm(center) + np.sqrt((1 - cosine) / dim) * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_pairs_of_large_groups_are_found_as_surely_as_of_small_ones(spark):
    rng = np.random.default_rng(6)
    groups = [near_copies(rng, 300, c) for c in (0.95, 0.96, 0.97)]
    plan = embedding_links.Plan(900, 0.95, 0.998, 11)
    fine = plan.directions(64)[2]
    for x in groups:
        got = set(zip(*(k.tolist() for k in embedding_links.linked(x, None, plan)), strict=True))
        i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
        p = (x @ fine).astype(np.float32)
        near = embedding_links.colliding(p[i], p[j], plan)
        assert got == set(zip(i[near].tolist(), j[near].tolist(), strict=True))
        between = {(a, b + 100) for a, b in zip(*(k.tolist() for k in embedding_links.linked(x[:100], x[100:], plan)), strict=True)}
        assert between == {(a, b) for a, b in got if a < 100 <= b}
    d = spark.createDataFrame([(i, v) for i, v in enumerate(np.concatenate(groups).tolist())], "vec_id long, embedding array<double>")
    n = {r.vec_id: r.n_links for r in embedding_links.link_vectors(d).collect()}
    for k, x in enumerate(groups):
        true = (x @ x.T >= 0.95).sum(1) - 1
        found = np.array([n[300 * k + i] for i in range(300)])
        assert (found <= true).all() and found.sum() >= 0.998 * true.sum()


def test_keys_do_not_depend_on_the_block():
    rng = np.random.default_rng(8)
    plan = embedding_links.Plan(50_000, 0.95, 0.998, 1)
    x = rng.standard_normal((700, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    whole = plan.keys(x)
    for n in (1, 2, 3, 7, 64):
        assert (np.concatenate([plan.keys(x[i : i + n]) for i in range(0, 140, n)])[:140] == whole[:140]).all()


def test_recall_on_many_vectors_and_a_large_bucket(spark):
    """20,000 vectors of unrelated ones, pairs at the threshold, and a group of 2,400 near copies that share buckets."""
    rng = np.random.default_rng(16)
    x = rng.standard_normal((13_600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.standard_normal((4_000, 64))
    w -= (w * x[:4_000]).sum(1, keepdims=True) * x[:4_000]
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    cosine = rng.uniform(0.9502, 0.99, (4_000, 1))
    x = np.concatenate([x, cosine * x[:4_000] + np.sqrt(1 - cosine**2) * w, near_copies(rng, 2_400, 0.955)])
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    got = {r.vec_id: r.n_links for r in embedding_links.link_vectors(d).collect()}
    found = np.array([got[i] for i in range(len(x))])
    true = np.concatenate([(x[a : a + 2_000] @ x.T >= 0.95).sum(1) for a in range(0, len(x), 2_000)]) - 1
    near = np.arange(len(x)) >= 17_600
    assert (found <= true).all()
    shares = found[near].sum() / true[near].sum(), found[~near].sum() / true[~near].sum()
    print("recall in the large group and of pairs:", shares)
    assert min(shares) >= 0.99


def test_no_vectors(spark):
    assert embedding_links.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0

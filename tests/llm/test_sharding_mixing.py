import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from tallywright.llm import mixing, sharding

DOCS = "doc_id long, text string, source string, shard string, size string, target int"


def docs(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "x", None, 3) for i, t, s in rows], DOCS)


def least_capacity(texts, shards):
    g = defaultdict(int)
    for t in texts:
        g["null" if t is None else hashlib.sha256(t.encode()).hexdigest()] += (len(t.encode()) if t else 0) + 8
    sizes = [g[k] for k in sorted(g)]

    def fits(c):
        n, held = 1, 0
        for s in sizes:
            if s > c:
                return False
            n, held = (n + 1, s) if held + s > c else (n, held + s)
        return n <= shards

    low, high = -(-sum(sizes) // shards), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("case", ["mixed", "hot", "few", "empty"])
def test_sharding_is_minimax(spark, case):
    texts = {
        "mixed": [None, "", "é" * 300, *(f"text {i} " * (i % 17) for i in range(200))], "hot": ["copy " * 40] * 150 + [f"t{i}" * i for i in range(100)] + [None, None], "few": ["a", "b", "b"], "empty": [],
    }[case]
    out = sharding.shard_by_bytes(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), 5, points=16).collect()
    assert len(out) == len(texts)
    load, slots, where = Counter(), defaultdict(list), {}
    for r in out:
        t = texts[r.doc_id]
        assert r.size == (len(t.encode()) if t else 0) + 8 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert where.setdefault(t, r.shard) == r.shard and 0 <= r.shard < 5
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if texts:
        assert max(load.values()) == least_capacity(texts, 5)


def mix(rows, weights, budget, most):
    """Words taken of each row, by the plain algorithm."""
    size = [len((t or "").split()) for _, t, _ in rows]
    total = Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = budget * sum(size), set(order), {}
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        full = {s for s in open_ if w[s] * level > most * total[s]}
        if not full:
            break
        for s in full:
            target[s] = float(most * total[s])
            left -= most * total[s]
        open_ -= full
    target |= {s: w[s] * level for s in open_}
    queue = []
    for s in order:
        mine = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, n, k) for k, ((i, _, x), n) in enumerate(zip(rows, size, strict=True)) if x == s)
        for c in range(most):
            upto = c * total[s]
            for key, i, n, k in mine:
                upto += n
                queue.append((upto / target[s] if target[s] else 0.0, order.index(s), key, i, c, n, k))
    taken, spent = [0] * len(rows), 0
    for *_, n, k in sorted(queue):
        spent += n
        if spent > budget * sum(size):
            break
        taken[k] += n
    return taken, target


def test_mix_against_the_plain_algorithm(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 40)), ["hot", "hot", "b", None, "c"][i % 5]) for i in range(300)] + [(1000, None, "b"), (1001, "", "empty")]
    want, target = mix(rows, (3, 1, 2), 1.5, 2)
    got = {r.doc_id: r for r in mixing.fair_mix(docs(spark, rows)).collect()}
    assert [got[i].taken for i, _, _ in rows] == want
    by = Counter()
    for r in got.values():
        by[r.source] += r.taken
        assert r.taken <= 2 * r.size and r.target == pytest.approx(target[r.source])
    assert all(abs(by[s] - t) <= 80 for s, t in target.items())


def test_mix_of_nothing(spark):
    assert mixing.fair_mix(docs(spark, [])).count() == 0
    assert mixing.fair_mix(docs(spark, [(1, None, None), (2, " \t", None)])).agg({"taken": "sum"}).first()[0] == 0


def test_mixed_rows_are_taken_as_often_as_the_mix_says(spark):
    d = docs(spark, [(i, " ".join(["w"] * (1 + i % 9)), "abc"[i % 3]) for i in range(200)])
    want = {r.doc_id: r.copies for r in mixing.fair_mix(d).collect() if r.copies}
    got = mixing.mixed_rows(d)
    assert got.columns == d.columns and Counter(r.doc_id for r in got.collect()) == want

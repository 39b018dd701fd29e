"""Near-duplicate vectors by collision-counting projections.

A link is a pair with cosine at or above a threshold, so of unit vectors no further apart than r. The
difference of their projections on a Gaussian direction is normal with deviation at most r, however many
dimensions there are; that calibrates every step by recall at the threshold.

Coarse step: projections are cut into cells, and tables of several projections bring together what falls
into the same cells. Inside such a bucket every pair's query-centred windows are counted over many more
projections: a pair that collides in enough windows is verified by its cosine in double precision. That
depends on nothing but the pair, not on the bucket's size, so a pair is judged in the first table that it shares.

Equal vectors are one class. The number of projections to a table grows with the logarithm of the number
of classes, so buckets of unrelated vectors stay small; a bucket that is large all the same, one group of
near copies, is split into blocks whose pairs are separate groups. Only link counts and a spanning forest
leave a bucket, never all of its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.scratch import Scratch

#: Cell width in deviations of a unit vector's projection, and the share of random pairs within one cell of it.
CELL, RANDOM_IN_CELL = 2.0, 0.486
#: Steps to one in the directions of tables; a vector's are a sixteenth of them.
GRID = 1 << 14
#: Projections whose windows are counted, and a window's half width in distances r.
COUNTED, WINDOW = 32, 2.0
#: Groups of up to so many rows are judged together, offset by offset.
SMALL = 48


def cell_share(distance: float) -> float:
    """Chance that vectors this far apart fall into the same randomly shifted cell of one projection."""
    if distance <= 0:
        return 1.0
    x = CELL / distance
    tail = 0.5 * math.erfc(x / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def least_count(recall: float) -> int:
    """Window collisions that a pair at the threshold reaches with this chance."""
    p = math.erf(WINDOW / math.sqrt(2))
    below, k = 0.0, 0
    while below + (mass := math.comb(COUNTED, k) * p**k * (1 - p) ** (COUNTED - k)) <= 1 - recall:
        below += mass
        k += 1
    return k


class Plan:
    """Tables and projections for so many vectors of one dimension."""

    def __init__(self, n: int, threshold: float, recall: float, seed: int):
        self.threshold, self.seed = threshold, seed
        self.radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
        self.per_table = max(2, math.ceil(math.log(max(n, 2)) / -math.log(RANDOM_IN_CELL)))
        hit = cell_share(self.radius) ** self.per_table
        self.tables = max(1, math.ceil(math.log((1 - recall) / 2) / math.log(1 - hit))) if hit < 1 else 1
        self.least = least_count(1 - (1 - recall) / 2)

    def directions(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng([self.seed, dim])
        coarse = np.rint(rng.standard_normal((dim, self.tables * self.per_table)) * GRID) / GRID
        return coarse, rng.uniform(0, CELL, coarse.shape[1]), rng.standard_normal((dim, COUNTED))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A 64-bit key of every table for each row.

        Vectors and directions are on a grid so coarse that their products add up without rounding, so a row has the
        same keys in whatever block it is multiplied.
        """
        coarse, shift, _ = self.directions(unit.shape[1])
        unit = np.rint(unit * (GRID * 16)) / (GRID * 16)
        cells = np.floor((unit @ coarse + shift) / CELL).astype(np.int64).reshape(len(unit), self.tables, self.per_table)
        key = np.full(cells.shape[:2], unit.shape[1], np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.per_table):
                key = (key ^ cells[:, :, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
        return key.view(np.int64)


def pack(vectors: Column, kind: str) -> Column:
    """The vector's bytes: four a number where the column holds floats, else eight."""
    typed = np.float32 if kind == "array<float>" else np.float64

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, np.float64).astype(typed).tobytes())

    return packed(vectors)


def colliding(a: np.ndarray, b: np.ndarray, plan: Plan) -> np.ndarray:
    """Which pairs of projections share enough query-centred windows."""
    return (np.abs(a - b) <= np.float32(WINDOW * plan.radius)).sum(1) >= plan.least


def unit_rows(raw: list[bytes], typed=np.float64) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), typed).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # else squares overflow or vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def linked(a: np.ndarray, b: np.ndarray | None, plan: Plan, block: int = 512):
    """Index pairs of linked rows, within a or between a and b."""
    _, _, fine = plan.directions(a.shape[1])
    width = np.float32(WINDOW * plan.radius)
    same = b is None
    b = a if same else b
    pa, pb = (np.ascontiguousarray((x @ fine).astype(np.float32).T) for x in (a, b))
    out = []
    for s in range(0, len(a), block):
        for t in range(s if same else 0, len(b), 4 * block):
            rows, cols = pa[:, s : s + block], pb[:, t : t + 4 * block]
            count = np.zeros((rows.shape[1], cols.shape[1]), np.uint8)
            for p, q in zip(rows, cols, strict=True):
                count += np.abs(p[:, None] - q) <= width
            i, j = np.nonzero(count >= plan.least)
            i, j = i + s, j + t
            if same:
                i, j = i[i < j], j[i < j]
            for c in range(0, len(i), 1 << 16):
                u, v = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                good = np.einsum("ij,ij->i", a[u], b[v]) >= plan.threshold
                out.append((u[good], v[good]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def forest(u: np.ndarray, v: np.ndarray) -> list[int]:
    """Positions of pairs that join two trees."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    out = []
    for k, (x, y) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            parent[x] = y
            out.append(k)
    return out


def link_vectors(vectors: DataFrame, *, threshold: float = 0.95, recall: float = 0.998, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11, hot: int = 2000) -> DataFrame:
    """``id_col``, n_links, component_id and kept for every row.

    n_links counts the other rows at or above the cosine ``threshold``; component_id is the smallest id that
    links reach; kept marks that row. ``recall`` is the chance to find a pair at the threshold itself; nearer
    pairs are found more surely, and no pair below it is linked. Null, zero or non-finite vectors link with
    nothing; vectors of different lengths never link. Rows that repeat an id with an equal vector are separate
    rows of its class. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "links")
    raw = F.col(f"`{vector_col}`").cast("array<double>")
    usable = F.coalesce((F.size(raw) > 0) & ~F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(raw, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(usable, F.transform(raw, lambda x: x + F.lit(0.0))).alias("v"))
    rows = rows.withColumn("digest", F.when(F.col("v").isNotNull(), F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256)))
    rows = scratch.write(rows.withColumn("body", pack(F.col("v"), dict(vectors.dtypes)[vector_col])).drop("v"), "rows")
    # one row for equal vectors; the vector itself is taken from any of them
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("body").alias("body"))
    classes = scratch.write(classes, "classes")
    plan = Plan(classes.count(), threshold, recall, seed)

    typed = np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64

    def explode(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, bodies = part.column("rep").to_numpy(), part.column("body").to_pylist()
                lengths = np.array([len(x) for x in bodies])
                for size in np.unique(lengths):
                    mine = np.nonzero(lengths == size)[0]
                    keys = plan.keys(unit_rows([bodies[k] for k in mine], typed))
                    for t in range(plan.tables):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), t, np.int32)), pa.array(np.ascontiguousarray(keys[:, t])), pa.array(ids[mine])], names=["t", "key", "id"])

    keyed = scratch.write(classes.select("rep", "body").mapInArrow(explode, "t int, key bigint, id bigint"), "keyed")
    parts = F.ceil(F.col("count") / F.lit(hot)).cast("int")
    shared = keyed.groupBy("t", "key").count().filter("count > 1").withColumn("parts", parts).drop("count")
    # a large bucket is dealt in blocks: each pair of blocks is a group of its own
    mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows_of = keyed.join(shared, ["t", "key"]).withColumn("part", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows_of = rows_of.select("t", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id")
    rows_of = rows_of.join(classes.select(F.col("rep").alias("id"), "copies", "body"), "id")

    def judge(batches):
        """Rows come sorted by group; a group may cross batches."""
        import pyarrow as pa

        group = ["t", "key", "low", "high"]
        held: list = []

        def settle(table):
            """Link counts and forest edges of whole groups."""
            cols = {c: table.column(c).to_numpy() for c in (*group, "part", "id", "copies")}
            bodies = table.column("body").to_pylist()
            sizes = np.array([len(x) for x in bodies])
            new = np.ones(len(sizes), bool)
            new[1:] = sizes[1:] != sizes[:-1]
            for c in group:
                new[1:] |= cols[c][1:] != cols[c][:-1]
            starts = np.append(np.nonzero(new)[0], len(new))
            us, vs = [], []
            for size in np.unique(sizes):
                at = np.nonzero(sizes == size)[0]
                x = unit_rows([bodies[k] for k in at], typed)
                place = np.cumsum(sizes == size) - 1
                whole = np.diff(starts)
                for g in np.nonzero((whole > SMALL) & (sizes[starts[:-1]] == size))[0]:
                    own = np.arange(starts[g], starts[g + 1])
                    if cols["low"][own[0]] == cols["high"][own[0]]:
                        i, j = linked(x[place[own]], None, plan)
                        u, v = own[i], own[j]
                    else:
                        left, right = (own[cols["part"][own] == cols[c][own]] for c in ("low", "high"))
                        i, j = linked(x[place[left]], x[place[right]], plan)
                        u, v = left[i], right[j]
                    us.append(u)
                    vs.append(v)
                gid = np.repeat(np.arange(len(whole)), whole)
                few = (whole <= SMALL)[gid] & (sizes == size)
                p = (x @ plan.directions(x.shape[1])[2]).astype(np.float32)
                for d in range(1, SMALL):
                    u = np.nonzero(few[:-d] & (gid[:-d] == gid[d:]))[0] if d < len(gid) else np.zeros(0, int)
                    if not len(u):
                        break
                    crossing = (cols["low"][u] == cols["high"][u]) | (cols["part"][u] != cols["part"][u + d])
                    u = u[crossing]
                    for c in range(0, len(u), 1 << 16):
                        a = u[c : c + (1 << 16)]
                        a = a[colliding(p[place[a]], p[place[a + d]], plan)]
                        a = a[np.einsum("ij,ij->i", x[place[a]], x[place[a + d]]) >= plan.threshold]
                        us.append(a)
                        vs.append(a + d)
            u, v = (np.concatenate(z) if z else np.zeros(0, int) for z in (us, vs))
            if not len(u):
                return None
            # a pair counts in the first table that holds both
            seen, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
            keys = np.empty((len(seen), plan.tables), np.int64)
            for size in np.unique(sizes[seen]):
                own = np.nonzero(sizes[seen] == size)[0]
                for c in range(0, len(own), 2048):
                    keys[own[c : c + 2048]] = plan.keys(unit_rows([bodies[k] for k in seen[own[c : c + 2048]]], typed))
            ku, kv = inverse[: len(u)], inverse[len(u) :]
            fresh = np.concatenate([
                ~((keys[ku[c : c + 65536]] == keys[kv[c : c + 65536]]) & (np.arange(plan.tables) < cols["t"][u[c : c + 65536]][:, None])).any(1) for c in range(0, len(u), 65536)
            ])
            u, v = u[fresh], v[fresh]
            a, b = cols["id"][u], cols["id"][v]
            who, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            n = np.bincount(at, np.concatenate([cols["copies"][v], cols["copies"][u]]), len(who)).astype(np.int64)
            tree = forest(a, b)
            no, yes = [None] * len(tree), [None] * len(who)
            return pa.RecordBatch.from_arrays(
                [pa.array(who.tolist() + no, pa.int64()), pa.array(n.tolist() + no, pa.int64()), pa.array(yes + a[tree].tolist(), pa.int64()), pa.array(yes + b[tree].tolist(), pa.int64())],
                names=["id", "n", "u", "v"],
            )

        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) < 8192:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = [table.column(c)[-1].as_py() for c in group]
            same = np.ones(table.num_rows, bool)
            for c, value in zip(group, last, strict=True):
                same &= table.column(c).to_numpy() == value
            cut = int(np.argmax(same))  # the last group may go on in the next batch
            if cut:
                out = settle(table.slice(0, cut))
                if out is not None:
                    yield out
            held = table.slice(cut).to_batches()
        if held and (out := settle(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out

    group = ["t", "key", "low", "high"]
    found = rows_of.repartition(*group).sortWithinPartitions(*group).mapInArrow(judge, "id bigint, n bigint, u bigint, v bigint")
    found = scratch.write(found, "found")
    n_links = found.filter("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.filter("u IS NOT NULL").select("u", "v"), scratch)
    known = classes.select("digest", F.col("rep").alias("id"), "copies").join(n_links, "id", "left").join(joined, "id", "left")
    known = known.select("digest", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("id", "digest").join(known, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op1_embedding_links(spark, sf_dir: str) -> DataFrame:
    """Links of all embeddings at cosine 0.95."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs, which SQL can afford on a small table.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(cnt.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e JOIN comp c ON c.a = e.vec_id LEFT JOIN cnt ON cnt.a = e.vec_id
"""

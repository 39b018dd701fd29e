"""Near-duplicate documents by a grouped prefix join on word shingles.

Two sets of Jaccard similarity t or more share a token among the first |x| - ceil(t|x|) + 1 of each in any
common order of tokens. The order puts tokens that occur often last (their counts are summed over all
documents from what each task sees twice or more; a token outside that bounded table counts as rare, which
only adds candidates), then goes by hash.

Documents with equal prefix and size are one group, and only groups are joined. A component needs a spanning
set of links, not all of them. A first pass verifies a number of pairs linear in the entries: within every
shared token each group with its neighbour by size and with the token's hub, the group that has it earliest in
its prefix (of near copies the one with the fewest changes), and the members of a group with its first one and
with the first that has the same token after the prefix. What that links is one component. Then every remaining
pair of groups in different components that shares a token, and passes the size and position filters, is expanded
to its members and verified. Members of one group in different components share its prefix, whatever else they
hold: they meet by the next |x| - o + 1 tokens, o the overlap that two sets of this size need. Pairs within a component
need no further look, so a group of copies costs its size and not its square, and no link between two
components is missed.

A token that very many documents share is dealt in parts for the first pass, whose hubs are paired in turn; the
second pass is a plain join, which Spark splits where it is skewed.

Sets are compared by 64-bit hashes of their shingles, equal sets found by 128-bit digests: a wrong answer needs
two different shingles of one pair with the same hash, about one chance in 2^64 for each two of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.scratch import Scratch
from .shingles import encoded, shingles, word_hashes
from .tables import free, map_rows

#: Entries of the table of frequent tokens, which every task holds: 16 bytes each.
FREQUENT = 200_000
#: Documents of a token in one part of the first pass, and bits of a sieve of ids.
HOT, SIEVE = 1 << 16, 1 << 26


def frequent_tokens(docs: DataFrame, size: int, least: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that tasks see in several different documents, sorted, with their counts; the FREQUENT most frequent."""

    def count(cols):
        texts = list(dict.fromkeys(encoded(cols["text"])))
        for s in range(0, len(texts), 4096):
            found = [shingles(w, size) for w in word_hashes(texts[s : s + 4096])]
            token, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield {"token": token[n > 1].view(np.int64), "n": n[n > 1]}

    seen = map_rows(docs.select("text"), count, "token bigint, n bigint", 4096)
    top = seen.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    tokens, counts = np.array([r.token for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def prefix_size(n: int, num: int, den: int) -> int:
    return n + num * n // -den + 1


def ordered(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens, rare ones first, and their counts where those are known, else 0."""
    known, counts = frequent
    weight = np.zeros(len(tokens), np.int64)
    if len(known) and len(tokens):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        weight = np.where(known[at] == tokens, counts[at], 0)
        if weight.any():
            order = np.lexsort((tokens, weight))
            tokens, weight = tokens[order], weight[order]
    return tokens, weight


def verify(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough, judged on whole sets. texts: id, body (packed)."""
    a, b = (texts.select(F.col("id").alias(c), F.col("body").alias(f"body_{c}")) for c in "ab")

    def judge(cols):
        unpack = zstandard.ZstdDecompressor().decompress
        n = len(cols["a"])
        unique = {}
        for side in "ab":
            for k, t in zip(cols[side], cols[f"body_{side}"], strict=True):
                unique.setdefault(k, t)
        sets = {}
        keys = list(unique)
        for s in range(0, len(keys), 512):
            for k, w in zip(keys[s : s + 512], word_hashes([unpack(unique[x]) for x in keys[s : s + 512]]), strict=True):
                sets[k] = shingles(w, size)
        good = []
        for i in range(n):
            x, y = sets[cols["a"][i]], sets[cols["b"][i]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(den * both >= num * (len(x) + len(y) - both))
        yield {"a": [x for x, g in zip(cols["a"], good, strict=True) if g], "b": [x for x, g in zip(cols["b"], good, strict=True) if g]}

    return map_rows(pairs.join(a, "a").join(b, "b").select("a", "b", "body_a", "body_b"), judge, "a bigint, b bigint")


def packed(texts: DataFrame) -> DataFrame:
    """id and body: the text's bytes, compressed, for a shuffle of whole texts."""

    def pack(cols):
        c = zstandard.ZstdCompressor(level=1)
        for s in range(0, len(cols["id"]), 1024):
            yield {"id": cols["id"][s : s + 1024], "body": [c.compress(t) for t in encoded(cols["text"][s : s + 1024])]}

    return map_rows(texts, pack, "id bigint, body binary")


def sieved(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows without most of those whose id isn't among the ids, so that few are shuffled to meet them.

    A bitmap of hashed ids, 16 bits for each and at most SIEVE in all, goes to every task: 8 MB.
    """
    bits = min(SIEVE, 1 << max(15, (16 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    maps = ids.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    return rows.withColumn("map", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "map").filter(held).select(*rows.columns)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100, hot: int = HOT) -> DataFrame:
    """``id_col``, n_shingles and component_id for every row.

    A row's set is the distinct shingles of ``size`` words, or its whole word sequence where it has fewer; rows
    link where den * intersection >= num * union. component_id is the smallest id that links reach. A null or
    empty text, or one without words, has no shingles and links with nothing. Rows that repeat an id are taken
    to repeat its text. A text of any length is one set. An empty table gives an empty result; other columns are
    ignored, whatever their names. Ids are long; a null id links with nothing. ``hot`` bounds the documents of a
    token that the first pass deals to one task; it changes no result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sent = spark.sparkContext.broadcast(frequent_tokens(slim, size))

    def sets(cols):
        frequent = sent.value
        for s in range(0, len(cols["id"]), 1024):
            out = {"id": cols["id"][s : s + 1024], "n": [], "digest": [], "head": [], "next": [], "prefix": [], "parts": []}
            for w in word_hashes(encoded(cols["text"][s : s + 1024])):
                x = shingles(w, size)
                keep = prefix_size(len(x), num, den)
                tokens, weight = ordered(x, frequent)
                p, weight = tokens[:keep], weight[:keep]
                out["n"].append(len(x))
                out["digest"].append(hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest())
                out["head"].append(hashlib.blake2b(p.tobytes() + len(x).to_bytes(8, "little"), digest_size=16).hexdigest())
                out["next"].append(int(tokens[keep].view(np.int64)) if keep < len(x) else None)
                out["prefix"].append(p.view(np.int64))
                out["parts"].append(weight // hot + 1 if weight.max(initial=0) >= hot else None)
            yield out

    rows = map_rows(slim, sets, "id bigint, n bigint, digest string, head string, next bigint, prefix array<bigint>, parts array<bigint>")
    rows = scratch.write(rows, "rows")
    some = rows.filter("n > 0 AND id IS NOT NULL")
    classes = some.groupBy("digest", "head").agg(F.min("id").alias("rep"), F.any_value("next").alias("next"))
    classes = classes.join(some.groupBy("head").agg(F.min("id").alias("gid")), "head").select("digest", "rep", "gid", "next")
    classes = scratch.write(classes, "classes")
    groups = some.groupBy("head").agg(F.min("id").alias("gid"), F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"), F.any_value("parts").alias("parts"))
    tokens = groups.select("gid", "n", "head", "parts", F.posexplode("prefix").alias("pos", "token"))
    # n and pos in one number, and a part (0 where a token isn't dealt in parts), keep the widest shuffle narrow
    of_token = F.get("parts", F.col("pos"))
    part = F.when(of_token > 1, F.pmod(F.xxhash64("head"), of_token) + 1).otherwise(F.lit(0))
    tokens = tokens.select("gid", "token", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("size_place"), part.alias("part")).repartition("token", "part")
    tokens = tokens.select("gid", "token", "part", F.shiftright("size_place", 32).alias("n"), F.pmod("size_place", F.lit(1 << 32)).alias("pos"))

    def fits(small, large):
        return F.coalesce(F.lit(den) * small >= F.lit(num) * large, F.lit(False))

    def near(x, y):
        """Sizes fit, and if this token is the first that the sets share, enough tokens can follow."""
        (n, pos), (m, at) = x, y
        reach = F.lit(1) + F.least(n - pos - 1, m - at - 1)
        return fits(F.least(n, m), F.greatest(n, m)) & F.coalesce(reach * (num + den) >= F.lit(num) * (n + m), F.lit(False))

    def size_and_place(of):
        return tuple(F.col(f"{of}{c}") for c in ("n", "pos"))

    deal = Window.partitionBy("token", "part")
    by_size = deal.orderBy("n", "gid")
    tokens = tokens.select("*", F.lag(F.struct("gid", "n", "pos")).over(by_size).alias("low"), F.lead("n").over(by_size).alias("high"), F.min(F.struct("pos", "gid", "n")).over(deal).alias("hub"))
    tokens = tokens.filter((F.col("part") > 0) | fits(F.col("low.n"), F.col("n")) | fits(F.col("n"), F.col("high")))
    is_hub = F.col("hub.gid") == F.col("gid")
    others = [F.when(near(size_and_place(""), size_and_place(f"{k}.")) & (F.col(f"{k}.gid") != F.col("gid")), F.col(f"{k}.gid")) for k in ("low", "hub")]
    shared = tokens.select("token", "gid", "n", "pos", F.filter(F.array(*others), lambda x: x.isNotNull()).alias("others"), ((F.col("part") > 0) & is_hub).alias("lead"))
    shared = scratch.write(shared, "shared")
    leads = shared.filter("lead").withColumn("hub", F.min(F.struct("pos", "gid", "n")).over(Window.partitionBy("token")))  # one row a part
    leads = leads.filter((F.col("hub.gid") != F.col("gid")) & near(size_and_place(""), size_and_place("hub."))).select("gid", F.col("hub.gid").alias("other"))
    inner = classes.filter("rep <> gid")
    in_group = inner.select("gid", F.col("rep").alias("other"))
    alike = inner.join(inner.groupBy("gid", "next").agg(F.min("rep").alias("low")), ["gid", "next"]).filter("rep <> low").select("low", F.col("rep").alias("other"))
    first = shared.select("gid", F.explode("others").alias("other")).union(leads).union(in_group).union(alike)
    first = scratch.write(first.select(F.least("other", "gid").alias("a"), F.greatest("other", "gid").alias("b")).distinct(), "pairs")

    def ends(pairs):
        return scratch.write(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ends")

    twice = scratch.write(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "twice")

    def texts_of(ids):
        """One text for each id; only those of ids that repeat are shuffled for that."""
        found = scratch.write(packed(sieved(slim, ids)).join(ids, "id", "left_semi"), "texts")
        return found, found.join(twice, "id", "left_anti").unionByName(found.join(twice, "id", "left_semi").dropDuplicates(["id"]))

    of_first = ends(first)
    held, texts = texts_of(of_first)
    linked = scratch.write(verify(first, texts, size, num, den), "linked")
    found = components(linked.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)

    # groups of different components that share a token
    placed = classes.select("rep", "gid").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "gid", F.coalesce("component", "rep").alias("comp"))
    placed = scratch.write(placed, "placed")
    entries = scratch.write(shared.select("token", "gid", "n", "pos").join(placed.select("gid", "comp").distinct(), "gid"), "entries")
    x, y = (entries.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("gid", "comp", "n", "pos")]) for k in "xy")
    close = near(*((F.col(f"n_{k}"), F.col(f"pos_{k}")) for k in "xy"))
    across = x.join(y, "token").filter((F.col("comp_x") < F.col("comp_y")) & (F.col("gid_x") != F.col("gid_y")) & close).select("gid_x", "comp_x", "gid_y", "comp_y").distinct()
    mx, my = (placed.select(F.col("rep").alias(c), F.col("gid").alias(f"gid_{k}"), F.col("comp").alias(f"comp_{k}")) for c, k in (("p", "x"), ("q", "y")))
    second = across.join(mx, ["gid_x", "comp_x"]).join(my, ["gid_y", "comp_y"]).select("p", "q")

    # members of one group in different components: all have its prefix, so the tokens after it tell
    def tails(cols):
        frequent, unpack = sent.value, zstandard.ZstdDecompressor().decompress
        for s in range(0, len(cols["rep"]), 512):
            out = {c: cols[c][s : s + 512] for c in ("rep", "gid", "comp")} | {"token": []}
            for w in word_hashes([unpack(t) for t in cols["body"][s : s + 512]]):
                tokens = ordered(shingles(w, size), frequent)[0]
                n, keep = len(tokens), prefix_size(len(tokens), num, den)
                overlap = -(-2 * num * n // (num + den))
                out["token"].append(tokens[keep : keep + n - overlap + 1].view(np.int64))
            yield out

    split = placed.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("gid")
    split = scratch.write(placed.join(split, "gid"), "split")
    bodies = sieved(texts, split.select(F.col("rep").alias("id"))).withColumnRenamed("id", "rep")
    tail = map_rows(split.join(bodies, "rep").select("rep", "gid", "comp", "body"), tails, "rep bigint, gid bigint, comp bigint, token array<bigint>")
    tail = scratch.write(tail.withColumn("token", F.explode("token")), "tails")
    x, y = (tail.select("gid", "token", F.col("comp").alias(f"comp_{k}"), F.col("rep").alias(k)) for k in "pq")
    inside = x.join(y, ["gid", "token"]).filter("comp_p < comp_q").select("p", "q")
    second = second.union(inside).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    second = scratch.write(second.join(first, ["a", "b"], "left_anti"), "pairs")
    of_second = ends(second)
    late, more_texts = texts_of(scratch.write(of_second.join(of_first, "id", "left_anti"), "ends"))
    more = verify(second, sieved(texts, of_second).unionByName(more_texts).join(of_second, "id", "left_semi"), size, num, den)
    cx, cy = (placed.select(F.col("rep").alias(k), F.col("comp").alias(c)) for k, c in (("a", "u"), ("b", "v")))
    joined = components(more.join(cx, "a").join(cy, "b").select("u", "v"), scratch)
    label = placed.join(joined.select(F.col("id").alias("comp"), "component"), "comp", "left").select("rep", F.coalesce("component", "comp").alias("comp"))
    label = classes.join(label, "rep").select("digest", "comp")
    out = rows.select("id", "n", "digest").join(label, "digest", "left")
    kept = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("comp")).otherwise(F.col("id"))
    scratch.drop(shared, first, held, late, entries)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), kept.alias("component_id"))


def distinct_rows(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """One row, that of the smallest id, of each component; with all its columns.

    Of rows that repeat an id one stays; rows without words, and those with a null id, all stay.
    """
    found = near_duplicates(docs, id_col=id_col, **how).filter("n_shingles > 0")
    mark = free("id", docs)
    own = F.col(f"`{id_col}`").cast("long") == F.col(f"`{mark}`")
    found = found.select(F.col(f"`{id_col}`").alias(mark), F.col("component_id").alias(f"{mark}_of"))
    gone = found.filter(F.col(mark) != F.col(f"{mark}_of")).select(mark).distinct()
    twice = found.filter(F.col(mark).isNotNull()).groupBy(mark).agg(F.count("*").alias(f"{mark}_n")).filter(F.col(f"{mark}_n") > 1).select(mark)
    left = docs.join(gone, own, "left_anti")
    once = left.join(twice, own, "left_semi").dropDuplicates([id_col])
    return left.join(twice, own, "left_anti").unionByName(once)


def op10_shingle_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at Jaccard 0.8 of five-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle, which SQL can afford on a small table.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS sh FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""

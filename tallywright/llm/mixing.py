"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled by the MD5 of their id. In that order a document's virtual finish time is its
source's cumulative words divided by the source's target; a second copy continues where the first pass
over the source ended. The mix is the globally sorted queue, truncated at the total budget.

No source is ordered in one task: prefix sums are taken in blocks of the shuffled order, and the global cut is found
from the sums of blocks of virtual time, then of blocks of the one that the budget ends in, until few rows are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from .tables import free

WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of the shuffled order within each source, by the first hex digits of the key.
BLOCK_DIGITS = 3
#: Blocks of a histogram of virtual times, and the rows among which the last one of the mix is looked for by sorting.
TIME_BLOCKS, CUT_ROWS = 4096, 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], budget: float, most: int) -> DataFrame:
    """source, source_size, rank, target: ``budget`` of all words shared by weight, capped at ``most`` times
    the source's words, the excess reshared among the others until none is above its cap.

    Sources fill in the order of cap by weight, so the level at which the rest share is a running sum.
    Sources are ordered by code point, null last; their weights repeat.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size")).withColumns({
        "capped": F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "sharing": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)),
        "budget": F.lit(float(budget)) * F.sum("source_size").over(all_),
    })
    ranked = ranked.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("sharing"))
    # the level is that of the first source that doesn't fill up; without one, every source is full
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("cap_by_weight", "rank", "level"))).over(all_)
    ranked = ranked.withColumn("cap_by_weight", F.col("cap") / F.col("weight")).withColumn("level", level["level"])
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def fair_mix(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Every row with its size, its source's size and target, and the words that the mix takes of it.

    ``taken`` is a whole number of copies, 0 to ``most``, of the row's words. A null or empty text has no
    words and adds nothing; a very long one counts whole; a null source is a source of its own, last in order;
    repeated rows are separate rows. An empty table gives an empty result. Other columns are ignored, whatever
    their names. Equal finish times are ordered by
    source, key, id and copy, so reruns agree.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = scratch.write(
        docs.select(
            F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
            words(F.col(f"`{text_col}`")).alias("size"), F.coalesce(F.md5(F.col(f"`{id_col}`").cast("string")), F.lit("")).alias("key"),
        ).withColumn("block", F.substring("key", 1, BLOCK_DIGITS)),
        "rows",
    )
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("bytes"))
    sources = scratch.write(targets(blocks.groupBy("source").agg(F.sum("bytes").alias("source_size")), weights, budget, most), "sources")
    total, = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(float(budget))).first()
    running = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = blocks.withColumn("before", F.coalesce(F.sum("bytes").over(running), F.lit(0))).drop("bytes")
    known = known.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    known = known.select(F.col("source").alias("s"), F.col("block").alias("b"), "before", "source_size", "rank", "target")
    within = Window.partitionBy("source", "block").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queue = rows.withColumns({"upto": F.sum("size").over(within), "at": F.row_number().over(Window.partitionBy("source", "block").orderBy("key", "id", "size"))})
    queue = queue.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("upto", F.col("upto") + F.col("before"))
    finish = [F.when(F.col("target") > 0, (F.lit(c) * F.col("source_size") + F.col("upto")) / F.col("target")).otherwise(F.lit(0.0)) for c in range(most)]
    queue = scratch.write(queue.select("id", "source", "size", "source_size", "target", "rank", "key", "at", F.array(*finish).alias("finish")), "queue")
    copies = queue.select("rank", "key", "id", "at", "size", F.posexplode("finish").alias("copy", "finish"))
    # where the budget ends: a histogram of times, and then of the block in which it ends, until few rows are left
    copies = copies.filter("size > 0")  # rows without words decide nothing
    before, inside = 0, copies
    low, high, n = inside.agg(F.min("finish"), F.max("finish"), F.count("*")).first()
    while n > CUT_ROWS and high > low:
        spot = F.least(F.floor((F.col("finish") - F.lit(low)) * F.lit(TIME_BLOCKS / (high - low))), F.lit(TIME_BLOCKS - 1)).cast("long")
        blocks = inside.groupBy(spot.alias("spot")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high")).orderBy("spot").collect()
        chosen = None
        for t in blocks:  # at most TIME_BLOCKS
            if before + t.words > total:
                chosen = t
                break
            before += t.words
        if chosen is None or chosen.n == n:
            break
        inside, low, high, n = inside.filter(spot == chosen.spot), chosen.low, chosen.high, chosen.n
    order = ["finish", "rank", "key", "id", "at", "copy"]
    upto = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(before)
    found = inside.withColumn("upto", upto).filter(F.col("upto") > F.lit(total)).orderBy(*order).limit(1).collect()
    if found:
        first = found[0]

        def kept(c: int) -> Column:
            out = F.lit(False)
            mine = {"copy": F.lit(c), "finish": F.col("finish")[c]}
            for k in reversed(order):
                x, y = mine.get(k, F.col(k)), F.lit(first[k])
                out = (x < y) | ((x == y) & out)
            return F.coalesce(out, F.lit(False))
    else:

        def kept(c: int) -> Column:
            return F.lit(True)

    n = sum((kept(c).cast("long") for c in range(most)), F.lit(0))
    scratch.drop(rows)
    return queue.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"), "key")


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """The rows of the mix with all their columns, each as often as it is taken.

    The mix takes a run of each source's shuffled order in every copy, so its last row tells for any row
    whether it is in: rows meet a table of one row a source, and texts aren't shuffled. Rows that repeat the
    id at which a source ends are taken alike.
    """
    taken = fair_mix(docs, id_col=id_col, source_col=source_col, **how)
    most = how.get("most", 2)
    mark = free("mix", docs)
    order = F.struct("key", F.col(f"`{id_col}`").alias("id"))
    ends = taken.groupBy(F.col(f"`{source_col}`").alias(mark)).agg(*[F.max(F.when(F.col("copies") > c, order)).alias(f"{mark}_{c}") for c in range(most)])
    ends = Scratch(docs.sparkSession, "mixing").write(ends, "ends")
    key = F.coalesce(F.md5(F.col(f"`{id_col}`").cast("string")), F.lit(""))
    here = F.struct(key.alias("key"), F.col(f"`{id_col}`").alias("id"))
    n = sum((F.coalesce(here <= F.col(f"{mark}_{c}"), F.lit(False)).cast("int") for c in range(most)), F.lit(0))
    joined = docs.join(ends, F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(mark)))
    each = F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))
    return joined.select(*[f"`{c}`" for c in docs.columns], each.alias(f"{mark}_copy")).drop(f"{mark}_copy")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 3, 1, 2 with a budget of 150% of all words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fair_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM src),
weighed AS (SELECT *, [3, 1, 2][(rnk - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM ranked),
lev AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM src)
    - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM weighed),
chosen AS (SELECT level FROM lev WHERE level * weight <= cap ORDER BY cap::DOUBLE / weight, rnk LIMIT 1),
tgt AS (SELECT source, source_size, rnk,
  CASE WHEN (SELECT level FROM chosen) IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, weight * (SELECT level FROM chosen)) END AS target FROM weighed),
q AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, t.rnk, r.k,
         CAST(sum(r.size) OVER (PARTITION BY t.rnk ORDER BY r.k, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM rows r JOIN tgt t ON r.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT q.*, c.c, CASE WHEN target > 0 THEN (c.c * source_size + upto)::DOUBLE / target ELSE 0.0 END AS finish
  FROM q, (VALUES (0), (1)) AS c(c)),
cut AS (
  SELECT doc_id, size, source_size, target,
         sum(size) OVER (ORDER BY finish, rnk, k, doc_id, c ROWS UNBOUNDED PRECEDING) AS total
  FROM copies)
SELECT doc_id, size, source_size, target,
       CAST(sum(CASE WHEN total <= 1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM src) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM cut GROUP BY doc_id, size, source_size, target
"""

"""Classifiers and their reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import procedural_shell

#: Classes that go to every task.
MOST_CLASSES = 10_000


def keyword_topic(text: Column, topics: dict[int, list[str]]) -> Column:
    """struct(topic, score): most seeds found by the root of their number; ties to the first topic, none is null.
    The topics are part of the expression: no join and no Python."""
    scored = F.array(*[
        F.struct((sum((F.coalesce(text.rlike(rf"(?i)\b{re.escape(s)}\b"), F.lit(False)).cast("int") for s in seeds), F.lit(0)) / F.lit(float(max(len(seeds), 1)) ** 0.5)).alias("score"), F.lit(-i).alias("order"), F.lit(code).alias("topic"))
        for i, (code, seeds) in enumerate(topics.items())
    ])
    best = F.array_max(scored)
    return F.struct(F.when(best["score"] > 0, best["topic"]).alias("topic"), best["score"].alias("score"))


def unit_vector(v: Column) -> Column:
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.nullif(norm, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """label and mean unit vector, normalised; one row a label."""
    each = rows.select(label, F.posexplode(unit_vector(F.col(vector))).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    v = each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return v.select(label, unit_vector(F.col("v")).alias("centroid"))


def nearest_centroid(rows: DataFrame, key: str, vector: str, classes: DataFrame, label: str, least: float = 0.20) -> DataFrame:
    """key, topic, similarity, margin to the runner-up, top2: the nearest class, null below ``least``; ties to the lower
    label. classes (label, centroid) are at most MOST_CLASSES, more are an error: they go to every task as one array, and
    each row is scored where it is. Rows that repeat a key stay apart."""
    few = classes.limit(MOST_CLASSES + 1).agg(F.collect_list(F.struct(F.col(label).alias("o"), F.col("centroid").alias("v"))).alias("__classes"))
    few = few.select(F.when(F.size("__classes") <= MOST_CLASSES, F.col("__classes")).otherwise(F.raise_error(F.lit(f"more than {MOST_CLASSES} classes"))).alias("__classes"))
    r = rows.select(key, unit_vector(F.col(vector)).alias("__v")).crossJoin(F.broadcast(few))
    scored = F.transform("__classes", lambda c: F.struct(dot(F.col("__v"), c["v"]).alias("s"), (-c["o"]).alias("o")))
    top = r.select(key, F.slice(F.sort_array(scored, asc=False), 1, 2).alias("t"))
    first, second = (F.try_element_at("t", F.lit(i)) for i in (1, 2))
    return top.select(key, F.when(first["s"] >= least, -first["o"]).alias("topic"), first["s"].alias("similarity"), (first["s"] - second["s"]).alias("margin"), F.transform("t", lambda x: -x["o"]).alias("top2"))


def classify_titles(items: DataFrame, scored: DataFrame, least_chars: int = 20) -> DataFrame:
    """The items with topic, similarity and procedural_shell. items: id, unit, title and more; scored: id, topic,
    similarity of a classifier. Titles below ``least_chars`` characters, untrimmed, and procedural shells stay without a
    topic and get similarity 0."""
    shell = procedural_shell(F.col("title"), F.col("unit"))
    usable = (F.length(F.coalesce("title", F.lit(""))) >= least_chars) & ~shell
    out = items.join(scored.select("id", F.col("topic").alias("__t"), F.col("similarity").alias("__s")), "id", "left")
    out = out.withColumns({"topic": F.when(usable, F.col("__t")), "similarity": F.round(F.when(usable, F.coalesce("__s", F.lit(0.0))).otherwise(F.lit(0.0)), 4), "procedural_shell": shell})
    return out.drop("__t", "__s")


def topic_counts(classified: DataFrame) -> DataFrame:
    """unit, grp, year, topic and n of classified items."""
    return classified.filter("topic IS NOT NULL").groupBy("unit", "grp", "year", "topic").agg(F.count("*").alias("n"))


def coverage(classified: DataFrame) -> DataFrame:
    """Per unit and group: items, procedural shells, the rest, those with a topic, and their share (0 of none)."""
    shell = F.col("procedural_shell")
    c = classified.groupBy("unit", "grp").agg(F.count("*").alias("n_attributed"), F.count_if(shell).alias("n_procedural"), F.count_if(~shell).alias("n_substantive"), F.count_if(~shell & F.col("topic").isNotNull()).alias("n_classified"))
    return c.withColumn("rate", F.coalesce(F.col("n_classified") / F.nullif(F.col("n_substantive"), F.lit(0)), F.lit(0.0)))


def agreement(scored: DataFrame) -> DataFrame:
    """Per reference label: recall, precision, and what it is most taken for and most confused with, with counts.
    scored: reference, predicted; both non-null rows count. Everything comes from the confusion matrix."""
    m = scored.filter("reference IS NOT NULL AND predicted IS NOT NULL").groupBy("reference", "predicted").agg(F.count("*").alias("n"))
    hit = F.col("reference") == F.col("predicted")
    worst = lambda c: F.min(F.when(~hit, F.struct((-F.col("n")).alias("o"), F.col(c).alias("c"))))
    shown = lambda c: F.coalesce(F.concat(F.col(f"{c}.c").cast("string"), F.lit(" ("), (-F.col(f"{c}.o")).cast("string"), F.lit(")")), F.lit(""))
    r = m.groupBy("reference").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("agreed"), worst("predicted").alias("x"))
    p = m.groupBy(F.col("predicted").alias("reference")).agg(F.sum("n").alias("n_predicted"), worst("reference").alias("y"))
    out = r.join(p, "reference", "left").na.fill(0, ["n_predicted"])
    return out.select("reference", "n", "agreed", (F.col("agreed") / F.col("n")).alias("recall"), "n_predicted", (F.col("agreed") / F.nullif(F.col("n_predicted"), F.lit(0))).alias("precision"), shown("x").alias("top_confusion"), shown("y").alias("top_contaminant"))


def rule_quality(rows: DataFrame, rule: Column, truth: Column, usable: Column) -> DataFrame:
    """Precision and recall of a yes-no rule over the usable rows; 0 where there is nothing to judge."""
    u = rows.select(F.coalesce(usable, F.lit(False)).alias("u"), F.coalesce(rule, F.lit(False)).alias("r"), F.coalesce(truth, F.lit(False)).alias("t"))
    a = u.agg(F.count_if("u").alias("n"), F.count_if(F.col("u") & F.col("r")).alias("n_rule"), F.count_if(F.col("u") & F.col("t")).alias("n_truth"), F.count_if(F.col("u") & F.col("r") & F.col("t")).alias("both"))
    return a.select("n", "n_rule", "n_truth", F.coalesce(F.col("both") / F.nullif(F.col("n_rule"), F.lit(0)), F.lit(0.0)).alias("precision"), F.coalesce(F.col("both") / F.nullif(F.col("n_truth"), F.lit(0)), F.lit(0.0)).alias("recall"))


def accuracy(scored: DataFrame) -> DataFrame:
    """Top-1 and top-2 accuracy and the number left open. scored: gold, topic, top2 (array)."""
    return scored.agg(
        F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("topic")).alias("correct"), F.count_if(F.array_contains("top2", F.col("gold"))).alias("top2_correct"), F.count_if(F.col("topic").isNull()).alias("unclassified"),
    ).withColumns({"accuracy": F.coalesce(F.col("correct") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)), "top2_accuracy": F.coalesce(F.col("top2_correct") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))})


def sample(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """A seeded sample without replacement that depends on keys only, not on partitions or order."""
    return rows.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(size)


def top_per(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)

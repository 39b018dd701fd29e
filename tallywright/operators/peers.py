"""Units against their peers: leave-one-out means, distances, the most distinctive category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .roles import Roles

R = Roles()


def leave_one_out(value: str, by: list[str]) -> Column:
    """The mean of the other rows of the partition; null for a single row."""
    w = Window.partitionBy(*by)
    return (F.sum(value).over(w) - F.col(value)) / F.nullif(F.count(value).over(w) - 1, F.lit(0))


def cosine_distance(dot: Column, left: Column, right: Column, zero: float | None = None) -> Column:
    """From the dot product and the sums of squares; null, or ``zero``, where either vector is zero."""
    norm = F.sqrt(left * right)
    return F.when(norm > 0, 1 - dot / norm).otherwise(F.lit(zero).cast("double"))


def top_text(name: str, share: str, k: int = 3) -> Column:
    """'Name (12%); ...' of the k largest positive shares; an aggregate."""
    rows = F.array_sort(F.collect_list(F.when(F.col(share) > 0, F.struct((-F.col(share)).alias("o"), F.col(name).alias("name")))))
    return F.array_join(F.transform(F.slice(rows, 1, k), lambda x: F.concat(x["name"], F.lit(" ("), F.format_number(-x["o"] * 100, 0), F.lit("%)"))), "; ")


def focus(vectors: DataFrame, r: Roles = R) -> DataFrame:
    """Each (unit, group) vector against the mean of its group's others.

    distance: cosine, null without peers. focus_*: the category furthest above the peers, ties to the first.
    """
    v = vectors.withColumn("peer", leave_one_out("share", [r.group, r.category])).withColumn("over", F.col("share") - F.col("peer"))
    first = F.min(F.struct((-F.col("over")).alias("o"), F.col(r.category).alias("category"), "share", "peer", "over"))
    out = v.groupBy(r.unit, r.group).agg(
        F.sum(F.col("share") * F.col("peer")).alias("dot"), F.sum(F.col("share") * F.col("share")).alias("a"), F.sum(F.col("peer") * F.col("peer")).alias("b"),
        F.when(F.count("peer") > 0, first).alias("first"), top_text(r.category, "share").alias("top"),
    )
    return out.select(
        r.unit, r.group, cosine_distance(F.col("dot"), F.col("a"), F.col("b")).alias("distance"), F.col("first.category").alias("focus"),
        F.col("first.share").alias("focus_share"), F.col("first.peer").alias("peer_share"), F.col("first.over").alias("overemphasis"), "top",
    )


def outliers(vectors: DataFrame, r: Roles = R) -> DataFrame:
    """Cosine distance from the leave-one-out mean (1 for a zero vector) and the category that departs most,
    ties within 1e-12 going to one that the unit holds more of; groups of one unit are left out."""
    v = vectors.withColumn("peer", leave_one_out("share", [r.group, r.category])).filter("peer IS NOT NULL").withColumn("over", F.col("share") - F.col("peer"))
    w = Window.partitionBy(r.unit, r.group)
    v = v.withColumn("near", F.abs("over") >= F.max(F.abs("over")).over(w) - F.lit(1e-12))
    # of the nearest ones: the largest if any is positive, else the smallest; both are the largest there
    pick = F.min(F.when(F.col("near"), F.struct((F.col("over") <= 0).alias("neg"), F.round(-F.abs("over"), 12).alias("o"), F.col(r.category).alias("category"), "share", "peer", "over")))
    out = v.groupBy(r.unit, r.group).agg(
        F.sum(F.col("share") * F.col("peer")).alias("dot"), F.sum(F.col("share") * F.col("share")).alias("a"), F.sum(F.col("peer") * F.col("peer")).alias("b"), pick.alias("p")
    )
    return out.select(
        r.unit, r.group, cosine_distance(F.col("dot"), F.col("a"), F.col("b"), 1.0).alias("distance"), F.col("p.category").alias("distinctive"),
        F.col("p.share").alias("share"), F.col("p.peer").alias("peer_share"), F.col("p.over").alias("difference"),
    )


def to_centroid(vectors: DataFrame, r: Roles = R) -> DataFrame:
    """Cosine distance to the group's mean vector, the unit included, and the category that departs most."""
    w = Window.partitionBy(r.group, r.category)
    v = vectors.withColumns({"mean": F.avg("share").over(w), "units": F.count("*").over(w)}).filter("units > 1")
    v = v.withColumn("over", F.col("share") - F.col("mean"))
    pick = F.min(F.struct(F.round(-F.abs("over"), 12).alias("o"), F.col(r.category).alias("category"), "share", "mean"))
    out = v.groupBy(r.unit, r.group).agg(
        F.sum(F.col("share") * F.col("mean")).alias("dot"), F.sum(F.col("share") * F.col("share")).alias("a"), F.sum(F.col("mean") * F.col("mean")).alias("b"), pick.alias("p")
    )
    return out.select(r.unit, r.group, cosine_distance(F.col("dot"), F.col("a"), F.col("b")).alias("distance"), F.col("p.category").alias("distinctive"), F.col("p.share").alias("share"), F.col("p.mean").alias("mean_share"))


def pair_distances(vectors: DataFrame, r: Roles = R) -> DataFrame:
    """Distances of all pairs of different units (a, b) with their groups; vectors of units, not rows, are paired."""
    v = vectors.groupBy(r.unit, r.group).agg(F.transform(F.array_sort(F.collect_list(F.struct(r.category, "share"))), lambda x: x["share"]).alias("v"))
    a, b = (v.select(F.col(r.unit).alias(f"unit_{k}"), F.col(r.group).alias(f"grp_{k}"), F.col("v").alias(f"v_{k}")) for k in "ab")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    pairs = a.join(b, (F.col("grp_a") < F.col("grp_b")) & (F.col("unit_a") != F.col("unit_b")) | (F.col("grp_a") == F.col("grp_b")) & (F.col("unit_a") < F.col("unit_b")))
    return pairs.select("unit_a", "grp_a", "unit_b", "grp_b", cosine_distance(dot(F.col("v_a"), F.col("v_b")), dot(F.col("v_a"), F.col("v_a")), dot(F.col("v_b"), F.col("v_b"))).alias("d"))


def dispersion(vectors: DataFrame, r: Roles = R) -> DataFrame:
    """By group: units, pairs, and mean, median and 90th percentile of the distances within it."""
    d = pair_distances(vectors, r).filter("grp_a = grp_b AND d IS NOT NULL").groupBy(F.col("grp_a").alias(r.group))
    d = d.agg(F.count("*").alias("n_pairs"), F.avg("d").alias("mean_distance"), F.median("d").alias("median_distance"), F.percentile("d", F.lit(0.9)).alias("p90_distance"))
    return vectors.groupBy(r.group).agg(F.count_distinct(r.unit).alias("n_units")).join(d, r.group)


def coherence(vectors: DataFrame, r: Roles = R) -> DataFrame:
    """Mean distance within each of two groups and between them (never within a unit), and their ratio."""
    d = pair_distances(vectors, r).filter("d IS NOT NULL")
    within = d.filter("grp_a = grp_b").groupBy("grp_a").agg(F.avg("d").alias("within")).agg(F.avg("within").alias("mean_within"), F.min_by("within", "grp_a").alias("within_first"), F.max_by("within", "grp_a").alias("within_second"), F.count("*").alias("groups"))
    between = d.filter("grp_a <> grp_b").agg(F.avg("d").alias("between"))
    out = within.crossJoin(between).filter("groups = 2").drop("groups")
    return out.withColumn("within_over_between", F.col("mean_within") / F.nullif(F.col("between"), F.lit(0.0)))


def divisive(vectors: DataFrame, r: Roles = R) -> DataFrame:
    """By group and category: mean and sample deviation over units, the extremes and the unit of the largest share."""
    out = vectors.groupBy(r.group, r.category).agg(
        F.count("*").alias("n_units"), F.avg("share").alias("mean_share"), F.stddev_samp("share").alias("sd_share"),
        F.min(F.struct((-F.col("share")).alias("o"), F.col(r.unit).alias("u"))).alias("m"), F.min("share").alias("min_share"),
    )
    return out.filter("n_units > 1").select(r.group, r.category, "n_units", "mean_share", "sd_share", F.col("m.u").alias("max_unit"), (-F.col("m.o")).alias("max_share"), "min_share")

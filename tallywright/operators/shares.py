"""Share tables: counts, shares of a group's total, equal-unit and pooled means over matched units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .roles import Roles

R = Roles()


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys, null keys included."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def shares(counts: DataFrame, by: list[str], r: Roles = R) -> DataFrame:
    """Counts summed by ``by`` and category, with their share of the total of ``by``; null categories don't count."""
    table = counts.filter(F.col(r.category).isNotNull()).groupBy(*by, r.category).agg(F.sum(r.count).alias(r.count))
    return table.withColumn("share", F.col(r.count) / F.sum(r.count).over(Window.partitionBy(*by)))


def matched_units(table: DataFrame, groups: list[str], r: Roles = R) -> DataFrame:
    """The units that hold rows of every one of the groups."""
    held = table.filter(F.col(r.group).isin(groups)).groupBy(r.unit).agg(F.count_distinct(r.group).alias("held"))
    return held.filter(F.col("held") == len(groups)).select(r.unit)


def in_matched_units(table: DataFrame, groups: list[str], r: Roles = R) -> DataFrame:
    return table.filter(F.col(r.group).isin(groups)).join(matched_units(table, groups, r), r.unit, "left_semi")


def dense(table: DataFrame, r: Roles = R) -> DataFrame:
    """Shares of every present (unit, group) over every present category, absent ones 0."""
    grid = table.select(r.unit, r.group).distinct().crossJoin(F.broadcast(table.select(r.category).distinct()))
    return grid.join(table.select(r.unit, r.group, r.category, "share"), [r.unit, r.group, r.category], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))


def vectors(counts: DataFrame, least: int = 1, r: Roles = R) -> DataFrame:
    """Dense share vectors, in long form, of the (unit, group) that have at least ``least`` observations.

    Shares come from counts summed over whatever else the table is split by.
    """
    table = shares(counts, [r.unit, r.group], r)
    total = F.sum(r.count).over(Window.partitionBy(r.unit, r.group))
    return dense(table.withColumn("total", total).filter(F.col("total") >= least).drop("total"), r)


def _wide(long: DataFrame, groups: list[str], value: Column, r: Roles) -> DataFrame:
    return long.groupBy(r.category).pivot(r.group, groups).agg(value).na.fill(0.0)


def emphasis(counts: DataFrame, groups: list[str], equal_unit: bool = True, r: Roles = R) -> DataFrame:
    """One row per category: each group's share, first minus second (gap), counts, and the number of units.

    Equal-unit: the mean over matched units of each unit's share. Pooled: the share of the summed counts.
    """
    major = counts.filter(F.col(r.group).isin(groups) & F.col(r.category).isNotNull())
    if equal_unit:
        major = major.join(matched_units(major, groups, r), r.unit, "left_semi")
        mean = dense(shares(major, [r.unit, r.group], r), r)
        wide = _wide(mean, groups, F.avg("share"), r)
    else:
        wide = _wide(shares(major, [r.group], r), groups, F.first("share"), r)
    n = major.groupBy(r.category).pivot(r.group, groups).agg(F.sum(r.count)).na.fill(0)
    n = n.select(r.category, *[F.col(f"`{g}`").cast("long").alias(f"n_{g}") for g in groups])
    units = major.agg(F.count_distinct(r.unit).alias("n_units"))
    return wide.withColumn("gap", F.col(f"`{groups[0]}`") - F.col(f"`{groups[1]}`")).join(n, r.category, "left").crossJoin(units)


def group_emphasis(counts: DataFrame, units: DataFrame | None = None, equal_unit: bool = True, r: Roles = R) -> DataFrame:
    """Long form: group, category, share, n, n_units; over ``units`` only if given."""
    if units is not None:
        counts = counts.join(units, r.unit, "left_semi")
    n = counts.groupBy(r.group, r.category).agg(F.sum(r.count).alias(r.count))
    held = counts.groupBy(r.group).agg(F.count_distinct(r.unit).alias("n_units"))
    if equal_unit:
        mean = dense(shares(counts, [r.unit, r.group], r), r).groupBy(r.group, r.category).agg(F.avg("share").alias("share"))
    else:
        mean = shares(counts, [r.group], r).drop(r.count)
    return mean.join(n, [r.group, r.category], "left").join(held, r.group).na.fill(0, [r.count])


def divergence(stated: DataFrame, revealed: DataFrame, groups: list[str], r: Roles = R) -> DataFrame:
    """Wide stated shares against long revealed ones: category, group, both shares (absent 0) and their difference."""
    long = stated.select(r.category, *groups).unpivot([r.category], groups, r.group, "stated_share")
    other = revealed.select(r.category, r.group, F.col("share").alias("revealed_share"), r.count)
    out = long.join(other, [r.category, r.group], "full").na.fill(0.0, ["stated_share", "revealed_share"]).na.fill(0, [r.count])
    return out.withColumn("stated_minus_revealed", F.col("stated_share") - F.col("revealed_share"))

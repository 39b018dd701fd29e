"""Change over periods: paired and pooled shares, slopes, and inference with false-discovery control."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .peers import leave_one_out
from .roles import Roles

R = Roles()


def with_q_values(table: DataFrame, p: str = "p_value") -> DataFrame:
    """One row per test: tests are few, whatever they were computed from."""
    n = table.withColumn("__rank", F.row_number().over(Window.orderBy(p))).withColumn("__n", F.count("*").over(Window.partitionBy()))
    raw = F.col(p) * F.col("__n") / F.col("__rank")
    low = F.min(raw).over(Window.orderBy(F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumn("q_value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), low))).drop("__rank", "__n")


def sign_flip(values: np.ndarray, seed: int, draws: int = 10_000) -> float:
    """Two-sided paired sign-flip permutation p-value; 1 for fewer than two values."""
    if len(values) < 2:
        return 1.0
    rng = np.random.default_rng(seed)
    observed, extreme = abs(float(np.mean(values))), 0
    block = max(1, 1_000_000 // len(values))  # signs in memory at a time
    for first in range(0, draws, block):
        signs = rng.choice((-1, 1), size=(min(block, draws - first), len(values)))
        extreme += np.count_nonzero(np.abs((signs * values).mean(axis=1)) >= observed)
    return float((1 + extreme) / (draws + 1))


def sign_flip_p(table: DataFrame, keys: list[str], unit: str, value: str, seed: Column, draws: int = 10_000) -> DataFrame:
    """keys, n_units and p_value of each group of rows; a group is one test, of one value a unit."""
    kinds = dict(table.dtypes)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(unit)[value].to_numpy(float)
        return pdf[keys].head(1).assign(n_units=len(x), p_value=sign_flip(x, int(pdf["__seed"].iloc[0]), draws))

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n_units long, p_value double"])
    return table.withColumn("__seed", seed).groupBy(*keys).applyInPandas(test, schema)


def period(years: dict[str, list[int]], r: Roles = R) -> Column:
    out = F.lit(None).cast("string")
    for name, ys in years.items():
        out = F.when(F.col(r.year).isin(ys), F.lit(name)).otherwise(out)
    return out


def paired_shares(counts: DataFrame, early: list[int], late: list[int], least: int, r: Roles = R) -> DataFrame:
    """unit, group, category: early and late share and their change, for units with ``least`` in both periods."""
    rows = counts.withColumn("period", period({"early": early, "late": late}, r)).filter("period IS NOT NULL")
    of = lambda p: F.coalesce(F.sum(F.when(F.col("period") == p, F.col(r.count))), F.lit(0))
    totals = rows.groupBy(r.unit, r.group).agg(of("early").alias("te"), of("late").alias("tl")).filter((F.col("te") >= least) & (F.col("tl") >= least) & (F.col("te") > 0) & (F.col("tl") > 0))
    cats = rows.select(r.group, r.category).distinct()
    n = rows.groupBy(r.unit, r.group, r.category).agg(of("early").alias("ne"), of("late").alias("nl"))
    grid = totals.join(cats, r.group).join(n, [r.unit, r.group, r.category], "left").na.fill(0, ["ne", "nl"])
    grid = grid.withColumns({"early": F.col("ne") / F.col("te"), "late": F.col("nl") / F.col("tl")})
    return grid.select(r.unit, r.group, r.category, "early", "late", (F.col("late") - F.col("early")).alias("change"))


def group_slopes(counts: DataFrame, r: Roles = R) -> DataFrame:
    """Least-squares slope of the share over the years in which the category was seen; two years at least."""
    y = counts.groupBy(r.group, r.year, r.category).agg(F.sum(r.count).alias("n"))
    y = y.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(r.group, r.year)))
    return y.groupBy(r.group, r.category).agg(F.count("*").alias("n_years"), F.regr_slope("share", F.col(r.year).cast("double")).alias("slope_per_year")).filter("n_years > 1")


def group_trends(counts: DataFrame, early: list[int], late: list[int], least: int, seed: int, draws: int = 10_000, r: Roles = R) -> DataFrame:
    """By group and category: pooled shares with binomial error, unit-paired change with error, p and q, slope."""
    counts = counts.filter(F.col(r.year).between(min(early), max(late)))
    rows = counts.withColumn("period", period({"early": early, "late": late}, r)).filter("period IS NOT NULL")
    of = lambda p: F.coalesce(F.sum(F.when(F.col("period") == p, F.col(r.count))), F.lit(0))
    n = rows.groupBy(r.group, r.category).agg(of("early").alias("early_n"), of("late").alias("late_n"))
    n = n.withColumns({f"{p}_total": F.sum(f"{p}_n").over(Window.partitionBy(r.group)) for p in ("early", "late")})
    n = n.withColumns({f"pooled_{p}_share": F.col(f"{p}_n") / F.nullif(F.col(f"{p}_total"), F.lit(0)) for p in ("early", "late")})
    se = F.sqrt(sum((F.col(f"pooled_{p}_share") * (1 - F.col(f"pooled_{p}_share")) / F.col(f"{p}_total") for p in ("early", "late")), F.lit(0.0)))
    n = n.withColumns({"pooled_change": F.col("pooled_late_share") - F.col("pooled_early_share"), "pooled_binomial_se": se})
    paired = paired_shares(counts, early, late, least, r)
    tests = paired.groupBy(r.group, r.category).agg(
        F.avg("early").alias("early_share"), F.avg("late").alias("late_share"), F.avg("change").alias("change"), (F.stddev_samp("change") / F.sqrt(F.count("*"))).alias("unit_change_se")
    )
    p = sign_flip_p(paired, [r.group, r.category], r.unit, "change", F.lit(seed) + F.crc32(F.concat_ws("-", r.group, F.col(r.category).cast("string")).cast("binary")) % 1_000_000, draws)
    out = n.join(tests, [r.group, r.category], "left").join(p, [r.group, r.category], "left").na.fill(1.0, ["p_value"]).na.fill(0, ["n_units"])
    return with_q_values(out).join(group_slopes(counts, r), [r.group, r.category], "left")


def unit_trends(counts: DataFrame, years: list[int], least: int, least_years: int, r: Roles = R) -> DataFrame:
    """By unit, group and category: slope and first and last share over the unit's usable years, absent categories 0."""
    rows = counts.filter(F.col(r.year).between(min(years), max(years)))
    totals = rows.groupBy(r.unit, r.group, r.year).agg(F.sum(r.count).alias("total")).filter(F.col("total") >= least)
    totals = totals.withColumn("n_years", F.count("*").over(Window.partitionBy(r.unit, r.group))).filter(F.col("n_years") >= least_years)
    n = rows.groupBy(r.unit, r.group, r.year, r.category).agg(F.sum(r.count).alias("n"))
    grid = totals.crossJoin(F.broadcast(rows.filter(F.col(r.category).isNotNull()).select(r.category).distinct())).join(n, [r.unit, r.group, r.year, r.category], "left")
    grid = grid.withColumn("share", F.coalesce("n", F.lit(0)) / F.col("total"))
    return grid.groupBy(r.unit, r.group, r.category).agg(
        F.count("*").alias("n_years"), F.min(r.year).alias("first_year"), F.max(r.year).alias("last_year"), F.regr_slope("share", F.col(r.year).cast("double")).alias("slope_per_year"),
        F.min_by("share", r.year).alias("first_share"), F.max_by("share", r.year).alias("last_share"),
    )


def null_distances(vectors: DataFrame, sizes: DataFrame, seed: int, draws: int = 2_000, r: Roles = R) -> DataFrame:
    """Units further from their peers than sampling explains: distance, the 95th percentile of distances of
    multinomial draws from the peers' mean, and the p-value. One task draws for one (unit, group)."""
    v = vectors.withColumn("peer", leave_one_out("share", [r.group, r.category])).filter("peer IS NOT NULL").join(sizes, [r.unit, r.group])
    v = v.withColumn("seed", F.lit(seed) + F.crc32(F.concat_ws("-", r.unit, r.group).cast("binary")))
    kinds = dict(v.dtypes)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(r.category)
        x, mean, n = pdf["share"].to_numpy(float), pdf["peer"].to_numpy(float), int(pdf[r.count].iloc[0])
        if n <= 0 or not mean.sum():
            return pdf.head(0)[[r.unit, r.group]].assign(n_observations=0, distance=0.0, null_p95=0.0, p_value=0.0)
        norm = np.linalg.norm(x) * np.linalg.norm(mean)
        distance = 1 - (float(x @ mean) / norm if norm else 0.0)
        p = mean / mean.sum()
        drawn = np.random.default_rng(int(pdf["seed"].iloc[0])).multinomial(n, p, size=draws) / n
        null = 1 - drawn @ p / (np.linalg.norm(drawn, axis=1) * np.linalg.norm(p))
        p95 = float(np.quantile(null, 0.95))
        out = pdf.head(1 if distance > p95 else 0)[[r.unit, r.group]]
        return out.assign(n_observations=n, distance=distance, null_p95=p95, p_value=float((1 + np.count_nonzero(null >= distance)) / (draws + 1)))

    return v.groupBy(r.unit, r.group).applyInPandas(test, f"{r.unit} {kinds[r.unit]}, {r.group} {kinds[r.group]}, n_observations long, distance double, null_p95 double, p_value double")


def dispersion_gap(vectors: DataFrame, seed: int, draws: int = 5_000, r: Roles = R) -> DataFrame:
    """Label-permutation test of the gap between two groups' mean pairwise distances.

    Distances are computed once; a permutation only re-reads them. Rows are units, categories columns: small
    whatever the counts came from.
    """

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=[r.group, r.unit], columns=r.category, values="share", fill_value=0.0).sort_index()
        labels = wide.index.get_level_values(0)
        names = sorted(set(labels))
        first = int((labels == names[0]).sum())
        if len(names) != 2 or min(first, len(wide) - first) < 2:
            return pd.DataFrame({"groups": [], "observed_gap": [], "p_value": [], "n_permutations": []})
        x = wide.to_numpy(float)
        norm = np.linalg.norm(x, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            d = 1 - x @ x.T / np.outer(norm, norm)

        def mean(rows: np.ndarray) -> float:
            return float(np.nanmean(d[np.ix_(rows, rows)][np.triu_indices(len(rows), 1)]))

        every = np.arange(len(x))
        observed = mean(every[:first]) - mean(every[first:])
        rng, extreme = np.random.default_rng(seed), 0
        for _ in range(draws):
            order = rng.permutation(len(x))
            extreme += abs(mean(order[:first]) - mean(order[first:])) >= abs(observed)
        return pd.DataFrame({"groups": ["-".join(map(str, names))], "observed_gap": [observed], "p_value": [(extreme + 1) / (draws + 1)], "n_permutations": [draws]})

    return vectors.groupBy(F.lit(1).alias("one")).applyInPandas(test, "groups string, observed_gap double, p_value double, n_permutations long")

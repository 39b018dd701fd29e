"""Who an item belongs to: sponsors' groups, memberships in time, positions in a hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attribute(sponsors: DataFrame, item: str, group: str = "grp", primary: str = "is_primary", majors: tuple[str, str] = ("D", "R")) -> DataFrame:
    """One group per item: that of its primary sponsors in a major group, else of any sponsor in one; both
    majors make it bipartisan, none unknown. One aggregation, whatever the number of sponsors."""
    a, b = (F.coalesce(F.col(group) == m, F.lit(False)) for m in majors)
    p = F.coalesce(F.col(primary), F.lit(False))
    flags = sponsors.groupBy(item).agg(F.bool_or(p & a).alias("pa"), F.bool_or(p & b).alias("pb"), F.bool_or(a).alias("aa"), F.bool_or(b).alias("ab"), F.count("*").alias("n_sponsors"))
    by_primary = F.col("pa") | F.col("pb")
    has_a, has_b = F.when(by_primary, F.col("pa")).otherwise(F.col("aa")), F.when(by_primary, F.col("pb")).otherwise(F.col("ab"))
    out = F.when(has_a & has_b, "bipartisan").when(has_a, majors[0]).when(has_b, majors[1]).otherwise("unknown")
    return flags.select(item, out.alias("sponsor_group"), "n_sponsors")


def latest_membership(memberships: DataFrame, person: str, start: str, value: str, order: str) -> DataFrame:
    """Each person's latest membership; of equal starts the later row. A missing start is the earliest."""
    began = F.struct(F.col(start).isNotNull().alias("known"), F.col(start).alias("start"), F.col(order).alias("order"))
    return memberships.groupBy(person).agg(F.max_by(value, began).alias(value))


def as_of(probes: DataFrame, intervals: DataFrame, person: str, at: str, start: str, end: str, value: str, order: str, probe_id: str) -> DataFrame:
    """The value of the interval that holds at a probe's time; else of the latest begun; else of the latest.

    Null bounds are open and a null time meets every interval; the latest start wins, then the first row. People
    without intervals get "unknown". The join is on the person, and one aggregation picks the interval.
    """
    i = intervals.select(F.col(person).alias("__p"), F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(value).alias("__v"), F.col(order).alias("__o"))
    j = probes.join(i, F.col(person) == F.col("__p"), "left")
    t = F.col(at)
    begun = t.isNull() | F.col("__s").isNull() | (F.col("__s") <= t)
    active = begun & (t.isNull() | F.col("__e").isNull() | (F.col("__e") >= t))
    rank = F.struct(active.cast("int").alias("a"), begun.cast("int").alias("b"), F.col("__s").isNotNull().cast("int").alias("k"), F.col("__s"), (-F.col("__o")).alias("o"))
    keep = [c for c in probes.columns if c != probe_id]
    picked = j.groupBy(probe_id, *keep).agg(F.max_by("__v", F.when(F.col("__p").isNotNull(), rank)).alias("found"))
    return picked.withColumn("found", F.coalesce("found", F.lit("unknown")))


def nearest_ancestor(nodes: DataFrame, wanted: list[str], depth: int = 32) -> DataFrame:
    """id and the class, among ``wanted``, of the nearest node on the way up (itself first); "unknown" where the
    way ends, meets a cycle, or is longer than ``depth``. nodes: id, class, parent.

    Each round halves the way that is left by jumping to the parent's parent, so a depth of 32 takes 5 joins.
    """
    at = F.lower(F.coalesce("class", F.lit("")))
    step = nodes.select("id", F.when(at.isin(wanted), at).alias("found"), F.when(~at.isin(wanted), F.col("parent")).alias("up"))
    hops = 1
    while hops < depth:
        above = step.select(F.col("id").alias("up"), F.col("found").alias("found_up"), F.col("up").alias("up_up"))
        step = step.join(above, "up", "left").select("id", F.coalesce("found", "found_up").alias("found"), F.when(F.coalesce("found", "found_up").isNull(), F.col("up_up")).alias("up"))
        hops *= 2
    return step.select("id", F.coalesce("found", F.lit("unknown")).alias("chamber"))


def recorded_outcome(classes: Column, chambers: Column) -> Column:
    """The highest stage that an item's action classes and the chambers that passed it record."""
    has = lambda c: F.array_contains(classes, c)
    in_ = lambda c: F.array_contains(chambers, c)
    return (
        F.when(has("became-law"), "became_law").when(has("executive-signature"), "signed").when(has("executive-veto") | has("executive-veto-line-item"), "vetoed")
        .when(has("executive-receipt"), "sent_to_executive").when((in_("upper") & in_("lower")) | in_("legislature"), "passed_legislature").when(F.size(chambers) > 0, "passed_one_chamber")
        .when(F.arrays_overlap(classes, F.array(*map(F.lit, ("failure", "withdrawal", "committee-failure")))), "recorded_failure_or_withdrawal")
        .when(F.size(classes) > 0, "introduced_or_pending").otherwise("no_action_data")
    )


def enacted(classes: Column) -> Column:
    return F.arrays_overlap(classes, F.array(*map(F.lit, ("became-law", "executive-signature", "veto-override-passage"))))


def collect_actions(actions: DataFrame, item: str, classes: str = "classes", chamber: str = "chamber") -> DataFrame:
    """Per item: the set of its action classes, the chambers that passed it, their number, stage and enactment.
    actions: item, classes (array), chamber. Only distinct classes and chambers are gathered, a bounded number."""
    passed = F.arrays_overlap(classes, F.array(F.lit("passage"), F.lit("informal-passage")))
    each = actions.select(item, F.explode_outer(classes).alias("c"), F.when(passed, F.col(chamber)).alias("p"))
    n = actions.groupBy(item).agg(F.count("*").alias("n_actions"))
    sets = each.groupBy(item).agg(F.array_sort(F.collect_set("c")).alias("classes"), F.array_sort(F.collect_set("p")).alias("chambers"))
    return sets.join(n, item).withColumns({"recorded_outcome": recorded_outcome(F.col("classes"), F.col("chambers")), "recorded_enacted": enacted(F.col("classes"))})


ADVANCED = ("passed_one_chamber", "passed_legislature", "sent_to_executive", "signed", "vetoed", "became_law")


def is_law_eligible(classification: Column) -> Column:
    """Ordinary bills: tagged bill, with no resolution or constitutional measure among the tags."""
    tags = F.transform(F.split(F.coalesce(classification, F.lit("")), r"\|"), lambda x: F.lower(F.trim(x)))
    return F.array_contains(tags, "bill") & ~F.exists(tags, lambda x: x.contains("resolution") | x.contains("constitutional"))


def outcome_rates(items: DataFrame, least: int, coverage: float) -> DataFrame:
    """Per unit and group: counts, coverage and rates, and whether they are enough to rely on.
    items: unit, grp, n_actions, recorded_outcome, recorded_enacted, n_votes."""
    t = items.groupBy("unit", "grp").agg(
        F.count("*").alias("n_bills"), F.count_if(F.coalesce("n_actions", F.lit(0)) > 0).alias("n_with_actions"), F.count_if(F.col("recorded_outcome").isin(*ADVANCED)).alias("n_advanced"),
        F.count_if(F.coalesce("recorded_enacted", F.lit(False))).alias("n_enacted"), F.count_if(F.coalesce("n_votes", F.lit(0)) > 0).alias("n_with_votes"),
    )
    t = t.withColumns({name: F.col(n) / F.col("n_bills") for name, n in (("action_coverage", "n_with_actions"), ("advancement_rate", "n_advanced"), ("enactment_rate", "n_enacted"), ("vote_coverage", "n_with_votes"))})
    return t.withColumn("reliable", (F.col("n_bills") >= least) & (F.col("action_coverage") >= coverage))


def matched_rates(rates: DataFrame, groups: list[str]) -> DataFrame:
    """Mean rates by group over units that are reliable for every group."""
    good = rates.filter(F.col("reliable") & F.col("grp").isin(groups))
    units = good.groupBy("unit").agg(F.count_distinct("grp").alias("k")).filter(F.col("k") == len(groups)).select("unit")
    means = [F.avg(c).alias(f"mean_{c}") for c in ("action_coverage", "advancement_rate", "enactment_rate", "vote_coverage")]
    return good.join(units, "unit", "left_semi").groupBy("grp").agg(F.count_distinct("unit").alias("n_units"), *means)


def rollcall_support(votes: DataFrame, passages: DataFrame, majors: tuple[str, str], least: int) -> DataFrame:
    """Yes shares by sponsor and voter group over passage votes with enough voters; over the units that have all
    four pairs, if all four occur. votes: vote_id, unit, sponsor_grp, voter_grp, opt, n; passages: vote_id."""
    v = votes.filter(F.col("sponsor_grp").isin(*majors) & F.col("voter_grp").isin(*majors) & F.col("opt").isin("yes", "no")).join(passages, "vote_id", "left_semi")
    per = v.groupBy("vote_id", "unit", "sponsor_grp", "voter_grp").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("opt") == "yes", F.col("n")).otherwise(0)) / F.sum("n")).alias("yes_share")).filter(F.col("n") >= least)
    pair = F.struct("sponsor_grp", "voter_grp")
    pairs = per.agg(F.count_distinct(pair).alias("pairs"))
    units = per.groupBy("unit").agg(F.count_distinct(pair).alias("held"))
    per = per.join(units, "unit").crossJoin(F.broadcast(pairs)).filter("pairs < 4 OR held = 4")
    return per.groupBy("sponsor_grp", "voter_grp").agg(F.count_distinct("vote_id").alias("n_votes"), F.count_distinct("unit").alias("n_units"), F.sum("n").alias("n_person_votes"), F.avg("yes_share").alias("mean_yes_share"))


def filing_year(session: Column, first: Column, lead: int = 2) -> Column:
    """The first action's year unless it is missing or precedes its session by more than ``lead`` years."""
    return F.when(first.isNull(), session).when(session.isNull(), first).when(first < session - lead, session).otherwise(first)


def reconcile(new: DataFrame, old: DataFrame, name: str, digest: str) -> DataFrame:
    """name and state (added, deleted, shared, revised) of every member of two snapshots."""
    a, b = new.select(name, F.col(digest).alias("__a")), old.select(name, F.col(digest).alias("__b"))
    state = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "deleted").when(F.col("__a") != F.col("__b"), "revised").otherwise("shared")
    return a.join(b, name, "full").select(name, state.alias("state"))


def status_of(n_confirmed: Column, n_candidates: Column, n_strong: Column, n_fetched: Column) -> Column:
    """The five stages of a search."""
    return (
        F.when(n_confirmed > 0, "found").when(n_fetched > 0, "candidates_rejected").when(n_strong > 0, "candidates_unfetched").when(n_candidates > 0, "no_strong_candidates").otherwise("no_candidates")
    )


def grid(units: DataFrame, groups: DataFrame, *tables: DataFrame, on: tuple[str, str] = ("unit", "grp")) -> DataFrame:
    """Every unit and group, with what each table knows of it: absence stays null."""
    out = units.select(on[0]).distinct().crossJoin(F.broadcast(groups.select(on[1]).distinct()))
    for t in tables:
        out = out.join(t, list(on), "left")
    return out


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")

"""Talk plans: sequence rules, coverage, and selection under a time budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values that results depend on.
ENDING_ROLES = ("conclusion", "takeaway")
METHOD_ROLES = ("method_overview", "method_component")
EVIDENCE_ROLES = ("experiments", "ablation", "analysis")
INSIGHT_ROLES = ("core_insight", "contributions")
SHARED_COVERAGE = (("problem", ("problem",)), ("core idea", INSIGHT_ROLES), ("method", METHOD_ROLES), ("evidence", EVIDENCE_ROLES), ("takeaway", ENDING_ROLES))
MODE_COVERAGE = {"paper-reading": (("research gap", ("existing_approaches", "gap")), ("critical assessment", ("limitations", "analysis"))), "own-research": (("motivation or gap", ("background", "gap")), ("limitations", ("limitations",)))}
ROLE_GROUPS = (("problem",), INSIGHT_ROLES, METHOD_ROLES, EVIDENCE_ROLES, ("limitations",), ENDING_ROLES)


def first_of(role: Column, order: Column, options) -> Column:
    return F.min(F.when(role.isin(*options), order))


def sequence_violations(units: DataFrame, group: str = "paper_id", role: str = "role", order: str = "order", opening: tuple = ("opening",), ending: tuple = ENDING_ROLES, before: tuple = ((("problem",), METHOD_ROLES), (INSIGHT_ROLES, METHOD_ROLES), (METHOD_ROLES, EVIDENCE_ROLES))) -> DataFrame:
    """(group, rule): an opening that is not first, a unit behind the ending, a stage before the one it builds on. A rule whose stage is absent is skipped."""
    w = Window.partitionBy(group).orderBy(order)
    ended = F.coalesce(F.max(F.col(role).isin(*ending)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    u = units.withColumn("__late", ended & ~F.col(role).isin(*ending))
    r, o = F.col(role), F.col(order)
    aggs = [(first_of(r, o, opening) > F.min(o)).alias("opening_first"), F.max("__late").alias("ending_last")]
    aggs += [(first_of(r, o, later) < first_of(r, o, earlier)).alias(f"order_{k}") for k, (earlier, later) in enumerate(before, 1)]
    rules = ["opening_first", "ending_last", *[f"order_{k}" for k in range(1, len(before) + 1)]]
    broken = u.groupBy(group).agg(*aggs).select(group, F.explode(F.array_compact(F.array(*[F.when(F.col(x), F.lit(x)) for x in rules]))).alias("rule"))
    return broken


def coverage_gaps(roles: DataFrame, labels: DataFrame, group: str = "paper_id") -> DataFrame:
    """Labels of which a group has no role. roles(group, role); labels(label, role), a fixed table, several roles a label. A group is one row with its labels from the first aggregate on."""
    every = labels.agg(F.collect_set("label")).scalar()
    have = roles.join(labels, "role", "left").groupBy(group).agg(F.collect_set("label").alias("have"))
    return have.select(group, F.explode(F.array_except(every, "have")).alias("label"))


def coverage_labels(spark, mode: str) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("pos"), F.lit(label).alias("label"), F.lit(r).alias("role")) for k, (label, rs) in enumerate((*SHARED_COVERAGE, *MODE_COVERAGE[mode])) for r in rs]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def required_units(units: DataFrame, group: str, role_group: str, importance: str, order: str) -> DataFrame:
    """Units with required: the most important, then earliest, of each group of roles; of all units where no role belongs to a group."""
    rank = F.row_number().over(Window.partitionBy(group, role_group).orderBy(F.desc(importance), order))
    alone = F.max(F.col(role_group).isNotNull()).over(Window.partitionBy(group))
    top = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(importance), order))
    return units.withColumn("required", F.when(alone, F.col(role_group).isNotNull() & (rank == 1)).otherwise(top == 1))


def narrative_minimum(units: DataFrame, group: str, seconds: str, budget: Column) -> DataFrame:
    """(group, minimum, budget) where the required units alone exceed the budget."""
    return units.where("required").groupBy(group).agg(F.sum(seconds).alias("minimum")).withColumn("budget", budget).where("minimum > budget")


def select_within_budget(units: DataFrame, group: str, item: str, importance: str, order: str, seconds: str, budget: Column) -> DataFrame:
    """(group, item, new_order): all required units, and the others by importance as long as they fit, renumbered in plan order.

    The fill is greedy: a unit that does not fit is passed over and does not count, so it is a fold over the group's sorted units,
    not a running sum. If all fit, all stay. Groups are plans: some tens of units.
    """
    unit = F.struct((-F.col(importance)).alias("i"), F.col(order).alias("o"), F.col(item).alias("id"), F.col(seconds).alias("s"))
    g = units.groupBy(group).agg(F.sum(seconds).alias("total"), F.coalesce(F.sum(F.when(F.col("required"), F.col(seconds))), F.lit(0)).cast("long").alias("base"), F.array_sort(F.collect_list(F.when(~F.col("required"), unit))).alias("rest"), F.collect_list(F.when(F.col("required"), F.struct(F.col(order).alias("o"), F.col(item).alias("id")))).alias("must"))
    g = g.withColumn("budget", budget)
    start = F.struct(F.col("base").alias("t"), F.col("must").alias("got"))
    step = lambda a, x: F.when((F.col("total") <= F.col("budget")) | (a["t"] + x["s"] <= F.col("budget")), F.struct((a["t"] + x["s"]).cast("long").alias("t"), F.concat(a["got"], F.array(F.struct(x["o"].alias("o"), x["id"].alias("id")))).alias("got"))).otherwise(a)
    got = F.array_sort(F.aggregate("rest", start, step, lambda a: a["got"]))
    return g.where("base <= budget OR total <= budget").select(group, F.posexplode(got).alias("p", "u")).select(group, F.col("u.id").alias(item), (F.col("p") + 1).alias("new_order"))

"""Grouped metrics, their spread over seeds, intervals, differences between contexts, and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["accuracy_mean", "pedagogical_score_mean", "silent_error_rate"]


def measures(when: Column | None = None, prefix: str = "") -> list[Column]:
    """Row count, accuracy, mean score, and rates of silent errors and of failed parses, of the rows where `when` holds."""

    def of(value: Column) -> Column:
        return value if when is None else F.when(when, value)

    failed = (~F.col("pred_parse_success")).cast("int")
    return [
        F.count(of(F.col("example_id"))).alias(f"{prefix}sample_count"),
        F.avg(of(F.col("is_correct").cast("int"))).alias(f"{prefix}accuracy_mean"),
        F.avg(of(F.col("overall_pedagogical_score"))).alias(f"{prefix}pedagogical_score_mean"),
        F.avg(of(F.col("is_silent_error").cast("int"))).alias(f"{prefix}silent_error_rate"),
        F.sum(of(failed)).alias(f"{prefix}parse_failure_pred_count"),
        F.avg(of(failed)).alias(f"{prefix}parse_failure_pred_rate"),
    ]


def metrics(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """measures() of each group with non-null keys, and more aggregates of the same pass."""
    rows = rows.dropna(subset=by) if by else rows
    return rows.groupBy(*by).agg(*measures(), *more)


def long_form(df: DataFrame, by: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.select(*by, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(by, values, name, value)


def normal_interval(mean: Column, deviation: Column, n: Column) -> tuple[Column, Column]:
    """mean -+ 1.96 deviations of the mean; with one value the interval is that value."""
    half = F.when(n > 1, deviation * 1.96 / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0))
    return mean - half, mean + half


def spread(values: DataFrame, by: list[str], *more: Column, value: str = "value", member: str = "seed") -> DataFrame:
    """Mean, sample deviation (0 for one value), normal interval and number of seeds of each group; nulls do not count."""
    out = values.groupBy(*by).agg(*more, F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count_distinct(F.when(F.col(value).isNotNull(), F.col(member))).alias("n_seeds"), F.count(value).alias("n_values"))
    low, high = normal_interval(F.col("mean"), F.col("std"), F.col("n_values"))
    return out.withColumn("ci_low", low).withColumn("ci_high", high)


def bootstrap(values: DataFrame, by: list[str], replicates: int = 2_000, alpha: float = 0.05, seed: int = 7, value: str = "value", order: str = "seed") -> DataFrame:
    """A bootstrap interval of each group's mean: order statistics alpha / 2 and 1 - alpha / 2 of the replicates' means.

    Draws come from SHA-256 of (seed, group, replicate, position), so they do not depend on the partitioning.  A group
    is one array of values (one a seed) and all of its replicates are drawn from that.
    """
    groups = values.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("v"))
    n = F.size("v")
    draws = groups.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("at", F.explode(F.sequence(F.lit(0), n - 1)))
    pick = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col("rep").cast("string"), F.col("at").cast("string")), 256), 1, 8), 16, 10).cast("long") % n
    means = draws.groupBy(*by, "rep").agg((F.sum(F.get("v", pick.cast("int"))) / F.count("*")).alias("m"))
    low, high = int(alpha / 2 * (replicates - 1)), int((1 - alpha / 2) * (replicates - 1))
    sorted_means = means.groupBy(*by).agg(F.sort_array(F.collect_list("m")).alias("m"))
    return sorted_means.select(*by, F.get("m", F.lit(low)).alias("boot_low"), F.get("m", F.lit(high)).alias("boot_high"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation of the rows with both values; null under three rows and where a side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.when(F.count(a) >= 3, F.try_divide(F.covar_samp(a, b), F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))))


def pair_deltas(table: DataFrame, by: list[str], order: list[str], label: str, names: tuple[str, str], values: list[str], apart: bool) -> DataFrame:
    """Later minus earlier row of each two rows of a group, in one pass over the table.

    A group's rows, one a run and generation or ratio, are gathered in order; apart: only rows whose label rises.
    """
    rows = table.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, *[v for v in values if v not in order]))).alias("r"))

    def two(a: Column, b: Column) -> Column:
        return F.struct(a[label].alias(names[0]), b[label].alias(names[1]), *[(b[v] - a[v]).alias(f"delta_{v}") for v in values])

    later = F.flatten(F.transform("r", lambda a, i: F.transform(F.slice("r", i + 2, F.size("r")), lambda b: two(a, b))))
    out = rows.select(*by, F.inline(later))
    return out.filter(F.col(names[0]) < F.col(names[1])) if apart else out


def generation_deltas(table: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Later minus earlier, for all pairs of generations of a group."""
    return pair_deltas(table, by, ["generation"], "generation", ("from_generation", "to_generation"), values, True)


def control_deltas(table: DataFrame, by: list[str], side: str, control: str, values: list[str]) -> DataFrame:
    """Each row minus its group's control row; groups without a control give no rows.  One window, no self-join."""
    place = Window.partitionBy(*by)
    rows = table.withColumns({f"_{v}": F.max(F.when(F.col(side) == control, F.col(v))).over(place) for v in values})
    rows = rows.withColumn("_has", F.max((F.col(side) == control).cast("int")).over(place)).filter((F.col("_has") == 1) & (F.col(side) != control))
    return rows.select(*by, side, *[(F.col(v) - F.col(f"_{v}")).alias(f"delta_{v}") for v in values])


def ordered_pairs(table: DataFrame, by: list[str], order: list[str], label: str, values: list[str]) -> DataFrame:
    """Later minus earlier rows of a group for all pairs of positions; rows that tie stay apart."""
    return pair_deltas(table, by, order, label, (f"low_{label}", f"high_{label}"), values, False)


def ranked(table: DataFrame, values: dict[str, bool], by: list[str] | None = None) -> DataFrame:
    """A rank for each value, 1 for the best, ties alike, null where the value is null.  values: name and whether more is better."""
    out = table
    for name, more in values.items():
        order = F.col(name).desc_nulls_last() if more else F.col(name).asc_nulls_last()
        out = out.withColumn(f"rank_{name}", F.when(F.col(name).isNotNull(), F.rank().over(Window.partitionBy(*(by or [])).orderBy(order))))
    return out


def reason_counts(rows: DataFrame, by: list[str], reason: str) -> DataFrame:
    """Rows of each reason.  Those without one are counted as 0 and then left out: a filter on the reason itself would be pushed down and spell it out in the scan."""
    return rows.groupBy(*by, reason).agg(F.count(reason).alias("n")).filter("n > 0")


def kept_and_rest(rows: DataFrame, by: list[str], state: str, values: list[str]) -> DataFrame:
    """Rows and means of each value, for each state of the rows (kept or not, or an action)."""
    return rows.groupBy(*by, state).agg(F.count("*").alias("n"), *[F.avg(F.col(v).cast("double")).alias(f"mean_{v}") for v in values])


def collapse_flags(table: DataFrame, by: list[str], good: dict[str, bool]) -> DataFrame:
    """For each metric and two generations of three: mean difference over seeds, interval, and what its sign says.

    good: whether more is better.  table: (seed, by, generation 0 to 2, metrics).
    """
    names = list(good)
    wide = table.groupBy("seed", *by).agg(*[F.max(F.when(F.col("generation") == g, F.col(m))).alias(f"{m}_{g}") for m in names for g in range(3)])
    steps = [(0, 1), (1, 2), (0, 2)]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(f"g{b}-g{a}").alias("step"), (F.col(f"{m}_{b}") - F.col(f"{m}_{a}")).cast("double").alias("value")) for m in names for a, b in steps])
    stats = spread(wide.select("seed", *by, F.inline(rows)), [*by, "metric", "step"])
    better = F.col("metric").isin([m for m in names if good[m]])
    up, down = F.col("ci_low") > 0, F.col("ci_high") < 0
    flag = F.when(F.col("n_values") < 2, "inconclusive").when((up & better) | (down & ~better), "improvement").when((down & better) | (up & ~better), "deterioration").otherwise("mixed")
    return stats.withColumn("flag", flag)

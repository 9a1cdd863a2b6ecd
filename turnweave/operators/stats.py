"""Robust means, paired tests and distributions."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from turnweave.functions.shared import materialize


def exact_quantiles(rows: DataFrame, keys: list[str], value: str | Column, at: dict[str, float]) -> DataFrame:
    """keys, n (values that are numbers) and under each name of ``at`` the exact quantile, linear between neighbours; groups without values have no row.

    Selection in two passes, in which no task holds a group.  A mergeable sketch of each group
    gives two cuts around each quantile.  Then values under the lower cut are only counted, those
    above the upper one are left out, and those between, a part of the group as small as a
    fraction of what a task reads, are counted by value and looked through in order.  The
    sketch's error is a fifth of the cuts' distance from the quantile, so that its rank is
    always between them; if it were not, that would be an error and no wrong value.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reach, shares = 1 / (4 * parts), list(at.values())
    bounds = [b for q in shares for b in (max(0.0, q - reach), min(1.0, q + reach))]
    values = rows.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    cuts = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_x", F.array(*map(F.lit, bounds)), F.lit(20 * parts)).alias("_cuts")).where("n > 0")
    same = lambda other: reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(other[f"_{i}"]) for i, k in enumerate(keys)))
    named = lambda df: df.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), *(c for c in df.columns if c not in keys))
    facing = named(cuts)
    joined = values.join(facing, same(facing)) if keys else values.crossJoin(F.broadcast(facing))  # one row without keys
    # where a cut is less than four values off there is nothing to cut
    whole, every = F.col("n") * reach < 4, range(len(shares))
    low, high = (lambda i: F.when(whole, float("-inf")).otherwise(F.col("_cuts")[2 * i])), (lambda i: F.when(whole, float("inf")).otherwise(F.col("_cuts")[2 * i + 1]))
    placed = joined.withColumns({f"_lo{i}": low(i) for i in every} | {f"_hi{i}": high(i) for i in every})
    within = lambda x, i: (F.col(x) >= F.col(f"_lo{i}")) & (F.col(x) <= F.col(f"_hi{i}"))
    # values outside all ranges fall together as null
    cell = F.when(reduce(lambda a, b: a | b, (within("_x", i) for i in every)), F.col("_x"))
    bounds = [F.max(f"_{end}{i}").alias(f"_{end}{i}") for end in ("lo", "hi") for i in every]
    counted = placed.groupBy(*keys, "n", cell.alias("v")).agg(F.count(F.lit(1)).alias("k"), *(F.count_if(F.col("_x") < F.col(f"_lo{i}")).alias(f"_under{i}") for i in every), *bounds)
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("q"), F.col(f"_under{i}").alias("under"), F.when(within("v", i), F.col("k")).alias("k")) for i in every)))
    listed = counted.select(*keys, "n", "v", sides.alias("c")).select(*keys, "n", "v", "c.*").where("under > 0 or k is not null")
    group = Window.partitionBy(*keys, "q")
    running = F.sum("k").over(group.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rank = F.element_at(F.array(*map(F.lit, shares)), F.col("q") + 1) * (F.col("n") - 1)
    upto = listed.withColumn("_upto", F.sum("under").over(group) + running).withColumn("_rank", rank)
    holds = lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("k"))
    of = upto.groupBy(*keys, "n", "q", "_rank").agg(F.max(F.when(holds(F.floor("_rank")), F.col("v"))).alias("low"), F.max(F.when(holds(F.ceil("_rank")), F.col("v"))).alias("high"))
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil("_rank") - F.col("_rank")) * F.col("low") + (F.col("_rank") - F.floor("_rank")) * F.col("high"))
    found = F.when(F.col("low").isNull() | F.col("high").isNull(), F.raise_error(F.lit("a quantile is outside its cuts"))).otherwise(between)
    return of.groupBy(*keys, "n").agg(*(F.max(F.when(F.col("q") == i, found)).alias(name) for i, name in enumerate(at)))


def robust_values(metrics: DataFrame, keys: list[str], mode: str = "none", k: float | None = None, share: float = 0.05, least: int = 3) -> DataFrame:
    """Values without outliers by group: none, iqr (1.5), mad (3.5), zscore (3), winsor or trim (``share`` at each end).

    Groups under ``least`` values, and those without spread for mad and zscore, stay as they
    are.  Percentiles are exact and linear.
    """
    v = metrics.where("value is not null and not isnan(value)")
    if mode not in ("none", "iqr", "mad", "zscore", "winsor", "trim"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "none":
        return v
    # only what the mode needs
    at = {"iqr": {"_q1": 0.25, "_q3": 0.75}, "mad": {"_med": 0.5}, "winsor": {"_lo": share, "_hi": 1 - share}, "trim": {"_lo": share, "_hi": 1 - share}}.get(mode, {})
    by = materialize(exact_quantiles(v, keys, "value", at), "quantiles").withColumnRenamed("n", "_n") if at else v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_mu"), F.stddev_samp("value").alias("_sd"))
    j = v.join(by, keys)
    small, x = F.col("_n") < least, F.col("value")
    if mode == "iqr":
        k = 1.5 if k is None else k
        reach = (F.col("_q3") - F.col("_q1")) * k
        j = j.where(small | x.between(F.col("_q1") - reach, F.col("_q3") + reach))
    elif mode == "mad":
        k = 3.5 if k is None else k
        dev = F.abs(x - F.col("_med"))
        mads = exact_quantiles(j, keys, dev, {"_mad": 0.5}).drop("n")
        j = j.join(mads, keys).where(small | (F.col("_mad") <= 0) | (dev / (F.col("_mad") * 1.4826) <= k)).drop("_mad")
    elif mode == "zscore":
        k = 3.0 if k is None else k
        j = j.where(small | (F.col("_sd") <= 0) | (F.abs((x - F.col("_mu")) / F.col("_sd")) <= k))
    elif mode == "winsor":
        j = j.withColumn("value", F.when(small, x).otherwise(F.least(F.greatest(x, F.col("_lo")), F.col("_hi"))))
    else:
        j = j.where(small | x.between(F.col("_lo"), F.col("_hi")))
    return j.select(*metrics.columns)


def robust_mean(metrics: DataFrame, mode: str = "none", **params) -> DataFrame:
    """Mean by phase and metric after ``robust_values``."""
    return robust_values(metrics, ["phase", "metric"], mode, **params).groupBy("phase", "metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def student(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d, c = (d if abs(d) > 1e-300 else 1e-300), (c if abs(c) > 1e-300 else 1e-300)
                d = 1 / d
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def t_quantile(p: float, df: float) -> float:
    """The t whose two-sided p is so much, by bisection."""
    lo, hi = 0.0, 1.0
    while student(hi, df) > p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if student(mid, df) > p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(n) or n < 1 else student(x, n) for x, n in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_level(df: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(n) or n < 1 else t_quantile(a, n) for n, a in zip(df, alpha, strict=True)], dtype="float64")


def paired_differences(metrics: DataFrame, trim: str | None = "mad", k: float | None = None, on: str = "diff") -> DataFrame:
    """Pairs (sample_id, metric, pair, before, after, value = difference) for pre_post and clean_post; of several values for one phase the largest counts.

    Trimming (mad or iqr; null pairs go) looks at the differences, or with ``on`` "both" at the
    values of both sides together: a pair stays if both of its values do.
    """
    wide = metrics.groupBy("sample_id", "metric").pivot("phase", ["pre", "post", "clean"]).agg(F.max("value"))
    listed = wide.select("sample_id", "metric", F.explode(F.array(*(F.struct(F.lit(f"{x}_post").alias("pair"), F.col(x).alias("before"), F.col("post").alias("after")) for x in ("pre", "clean")))).alias("p")).select("sample_id", "metric", "p.*")
    pairs = listed.withColumn("value", F.col("after") - F.col("before"))
    if trim is None:
        return pairs
    if on == "diff":
        return robust_values(pairs, ["metric", "pair"], trim, k)
    valid = pairs.where("value is not null")
    sides = valid.select("sample_id", "metric", "pair", F.explode(F.array("before", "after")).alias("value"))
    kept = robust_values(sides, ["metric", "pair"], trim, k).groupBy("metric", "pair", "sample_id").agg(F.count(F.lit(1)).alias("_sides")).where("_sides = 2")
    return valid.join(kept, ["metric", "pair", "sample_id"], "left_semi").select(*pairs.columns)


def paired_test(metrics: DataFrame, trim: str | None = "mad", k: float | None = None, alpha: float = 0.05, on: str = "diff") -> DataFrame:
    """Per metric and pair: n_raw, n_valid, n_used, means, sd, t, df, p, confidence bounds and d_z."""
    raw = paired_differences(metrics, None).groupBy("metric", "pair").agg(F.count(F.lit(1)).alias("n_raw"), F.count("value").alias("n_valid"))
    d = paired_differences(metrics, trim, k, on).where("value is not null").groupBy("metric", "pair").agg(
        F.count(F.lit(1)).alias("n_used"), F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"), F.avg("value").alias("mean_diff"), F.stddev_samp("value").alias("sd"))
    out = raw.join(d, ["metric", "pair"], "left").withColumn("df", F.col("n_used") - 1)
    error = F.col("sd") / F.sqrt("n_used")
    out = out.withColumn("t", F.when(F.col("sd") > 0, F.col("mean_diff") / error)).withColumn("d_z", F.when(F.col("sd") > 0, F.col("mean_diff") / F.col("sd")))
    reach = t_level(F.col("df").cast("double"), F.lit(alpha)) * error
    return out.withColumn("p", p_value("t", F.col("df").cast("double"))).withColumn("ci_low", F.col("mean_diff") - reach).withColumn("ci_high", F.col("mean_diff") + reach)


def holm(tests: DataFrame, p: str = "p", *ties: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Holm's step-down adjustment over the rows of each report, told by the columns ``by``; a report is a few rows of one task."""
    order = Window.partitionBy(*by).orderBy(p, *ties)
    n = F.count(p).over(Window.partitionBy(*by))
    ranked = tests.where(F.col(p).isNotNull()).withColumn("step", (n - F.row_number().over(order) + 1) * F.col(p))
    return ranked.withColumn("p_holm", F.max(F.least(F.lit(1.0), F.col("step"))).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def conclusion(alpha: float = 0.05) -> Column:
    """A sentence on each row of a paired test: direction, reliability, means, interval, t with its degrees of freedom, p, d_z and the pairs that were trimmed."""
    way = F.when(F.col("mean_diff") > 0, "rises").when(F.col("mean_diff") < 0, "falls").otherwise("stays")
    sure = F.when(F.col("p") < alpha, "reliably").otherwise("not reliably")
    shown_p = F.when(F.col("p") < 0.001, "<.001").otherwise(F.format_string("%.3f", "p"))
    said = F.format_string(
        "%s (%s): %s, %s; %.2f to %.2f, difference %.2f [%.2f, %.2f], t(%d)=%.2f, p=%s, d_z=%.2f", F.col("metric"), F.col("pair"), way, sure, F.col("mean_before"), F.col("mean_after"),
        F.col("mean_diff"), F.col("ci_low"), F.col("ci_high"), F.col("df"), F.col("t"), shown_p, F.col("d_z"),
    )
    trimmed = F.when(F.col("n_valid") > F.col("n_used"), F.format_string("; %d of %d pairs trimmed", F.col("n_valid") - F.col("n_used"), F.col("n_valid"))).otherwise("")
    return F.when(F.col("p").isNull(), F.format_string("%s (%s): too few pairs", "metric", "pair")).otherwise(F.concat(said, trimmed))


def distribution(rows: DataFrame, value: str, by: list[str] | None = None, under: float | None = None) -> DataFrame:
    """N, mean, median, population deviation, least and most, per group of ``by`` if given (then only groups with values); with ``under`` the share of values below it."""
    x = F.col(value).cast("double")
    told = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most")]
    if under is not None:
        told.append(F.avg((x < under).cast("int")).alias("share_under"))
    sums, medians = rows.groupBy(*(by or [])).agg(*told), exact_quantiles(rows, by or [], value, {"median": 0.5}).drop("n")
    joined = sums.join(medians, by) if by else sums.join(F.broadcast(medians), how="left")  # one row
    return joined.select(*(by or []), "n", "mean", "median", *(c for c in sums.columns if c not in ("n", "mean", *(by or []))))


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts between edges (the last bin is closed), per cent and running per cent; values outside don't count."""
    x, last = F.col(value), len(edges) - 2
    bin_ = F.when(x == edges[-1], last)
    for i in range(last + 1):
        bin_ = bin_.when((x >= edges[i]) & (x < edges[i + 1]), i)
    n = rows.select(bin_.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(last + 1)], "bin int, low double, high double")
    out = every.join(n, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy().orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row a bin
    return out.withColumn("pct", F.col("n") * 100 / F.sum("n").over(Window.partitionBy())).withColumn("cum_pct", F.sum("pct").over(order))

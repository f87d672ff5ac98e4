"""Panel inference: weekly regressions, HAC means, fixed effects, multiple testing, resampling."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fits
from .graph import components


def slope_by_week(panel: DataFrame, y: str, x: str, by: str = "week") -> DataFrame:
    """(week, coef, n, r2) of y on x with a constant, for weeks of 7 complete pairs or more whose x varies."""
    df = panel.select(by, y, x).dropna()
    out = df.groupBy(by).agg(F.regr_slope(y, x).alias("coef"), F.count(F.lit(1)).alias("n"), F.regr_r2(y, x).alias("r2"), F.min(x).alias("a"), F.max(x).alias("b"))
    return out.filter("n >= 7 and a < b").drop("a", "b")


def least_squares(panel: DataFrame, y: str, terms: list[str], by: str = "week", dummies: str | None = None, residual: bool = False) -> DataFrame:
    """Ordinary least squares in each group: (week, term, coef, n, r2), or with ``residual`` (week, entity, residual).

    Groups with fewer than k + 5 complete rows (k counts the constant and dummies) or without full rank are left out.
    ``dummies`` names a category, whose first value by name is the base and whose null is all zeros.
    """
    if residual:
        return fits.residuals(panel, y, terms, by).filter(F.col("residual").isNotNull()).select(by, "entity", "residual")
    models = [fits.Model({"model": y}, y, terms, dummies)]
    return fits.coefficients(fits.weekly_fits(panel, models, by), models).select(by, "term", "coef", "n", "r2")


def hac_mean(series: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """(by, mean, std, n, se, t): mean with a Newey-West error, Bartlett weights, lag floor(4 (n / 100) ^ (2 / 9)).

    Lags are rows, not calendar weeks: values are numbered and joined with those of each lag.
    """
    w = Window.partitionBy(*by)
    df = series.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("x"), F.row_number().over(w.orderBy(order)).alias("i"), F.avg(value).over(w).alias("mean"), F.count(F.lit(1)).over(w).alias("n"))
    df = df.withColumn("d", F.col("x") - F.col("mean")).withColumn("lag", F.least(F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))), F.col("n") - 1).cast("int"))
    pairs = df.withColumn("l", F.explode(F.expr("sequence(0, lag)"))).withColumn("j", F.col("i") - F.col("l"))
    other = df.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("i").alias("__i"), F.col("d").alias("__d"))
    on = F.col("j") == F.col("__i")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    weight = F.when(F.col("l") == 0, F.lit(1.0)).otherwise(2 * (1 - F.col("l") / (F.col("lag") + 1)))
    long = pairs.join(other, on).groupBy(*by).agg(F.sum(weight * F.col("d") * F.col("__d")).alias("s"))
    basic = df.groupBy(*by).agg(F.first("mean").alias("mean"), F.stddev_samp("x").alias("std"), F.first("n").alias("n"))
    out = basic.join(long, by) if by else basic.crossJoin(long)
    se = F.when(F.col("s") > 0, F.sqrt(F.col("s")) / F.col("n"))
    return out.withColumn("se", se).withColumn("t", F.when(F.col("n") >= 2, F.col("mean") / F.col("se"))).drop("s")


def t_test(value: Column) -> list[Column]:
    """mean, n and t of a one-sample test against 0, as aggregates."""
    n = F.count(value)
    return [F.avg(value).alias("mean"), n.alias("n"), F.when(n > 1, F.avg(value) / F.nullif(F.stddev_samp(value) / F.sqrt(n), F.lit(0.0))).alias("t")]


def student_p_column(t: str | Column, df: Column) -> Column:
    """Two-sided p-value of Student's t with a whole number of degrees of freedom: the finite series of its distribution.

    With theta = atan(t / sqrt(df)) the terms are products of cos(theta) ** 2 and ratios of odd and even numbers.
    """
    t = F.abs(F.col(t) if isinstance(t, str) else t)
    df = df.cast("int")
    theta = F.atan(t / F.sqrt(df))
    c2 = 1 / (1 + t * t / df)
    even = df % 2 == 0
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((df - 1) / 2).cast("int")))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        ratio_ = F.when(even, (2 * j - 1) / (2 * j)).otherwise((2 * j) / (2 * j + 1))
        term = F.when(j <= F.floor((df - 2) / 2), acc["term"] * c2 * ratio_).otherwise(F.lit(0.0))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(steps, zero, add)["sum"]
    inside = F.when(even, F.sin(theta) * total).when(df == 1, 2 * theta / F.lit(math.pi))
    inside = inside.otherwise(2 / F.lit(math.pi) * (theta + F.sin(theta) * F.cos(theta) * total))
    return F.when(t.isNotNull() & (df >= 1), F.greatest(F.lit(0.0), 1 - inside))


def normal_p_column(t: str | Column, terms: int = 200) -> Column:
    """Two-sided p-value of a standard normal statistic, by the series of positive terms of the error function."""
    t = F.abs(F.col(t) if isinstance(t, str) else t)
    x = F.least(t, F.lit(9.0)) / F.lit(math.sqrt(2))  # beyond 9 the result is 0 in double precision
    zero = F.struct(x.alias("term"), x.alias("sum"))
    add = lambda acc, k: F.struct((acc["term"] * 2 * x * x / (2 * k + 1)).alias("term"), (acc["sum"] + acc["term"] * 2 * x * x / (2 * k + 1)).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), zero, add)["sum"]
    return F.when(t.isNotNull(), F.greatest(F.lit(0.0), 1 - F.lit(2 / math.sqrt(math.pi)) * F.exp(-x * x) * total))


def summary(coefs: DataFrame, by: list[str], weeks: DataFrame) -> DataFrame:
    """hac_mean of weekly coefficients (by, week, coef, r2) with p, significant, avg_r2 and the weeks of ``weeks`` skipped."""
    n = weeks.select("week").distinct().agg(F.count(F.lit(1)).alias("__weeks"))
    fit = coefs.groupBy(*by).agg(F.avg("r2").alias("avg_r2"), F.countDistinct("week").alias("__held"))
    out = hac_mean(coefs, by, "coef", "week").join(fit, by).crossJoin(F.broadcast(n))  # one row
    out = out.withColumn("p", student_p_column("t", F.col("n") - 1)).withColumn("significant", F.coalesce(F.col("p") < 0.05, F.lit(False)))
    return out.withColumn("n_skipped", F.col("__weeks") - F.col("__held")).drop("__weeks", "__held")


def bh(df: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """Adds p_fdr: Benjamini-Hochberg adjusted p-values, in all or in each group."""
    w = Window.partitionBy(*(by or [])).orderBy(p)
    n = F.count(F.lit(1)).over(Window.partitionBy(*(by or [])))
    df = df.withColumn("__r", F.row_number().over(w)).withColumn("__a", F.col(p) * n / F.col("__r"))
    later = Window.partitionBy(*(by or [])).orderBy("__r").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn("p_fdr", F.least(F.lit(1.0), F.min("__a").over(later))).drop("__r", "__a")


def _without_effects(df: DataFrame, by: list[str], names: list[str], keep: Callable[[DataFrame], DataFrame], steps: int, each: int, least: float) -> tuple[DataFrame, DataFrame]:
    """``df`` with entity and week effects taken out of ``names``, and (by, residue) of each regression's solution.

    Entity effects leave by demeaning. Week effects then solve a system with a row for each week, whose matrix is never
    built: conjugate gradients, scaled by the weeks' numbers of rows, of all variables at once. A step spreads a value for
    each week over the table of (entity, week) counts and back; ``each`` steps stand between stored tables. ``residue``
    is what is left of the system's right side, relative, of the variable that is furthest from its solution.
    """
    counts = keep(df.groupBy(*by, "entity", "week").agg(F.count(F.lit(1)).alias("__c")))
    counts = keep(counts.withColumn("__s", F.col("__c") / F.sum("__c").over(Window.partitionBy(*by, "entity"))))
    own = Window.partitionBy(*by, "entity")
    centred = df.withColumns({c: F.col(c) - F.avg(c).over(own) for c in names})
    group = Window.partitionBy(*by)
    dot = lambda a, b: F.sum(a * b).over(group)
    start = centred.groupBy(*by, "week").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"r_{c}") for c in names])
    start = start.withColumns({f"p_{c}": F.col(f"r_{c}") / F.col("__n") for c in names}).withColumns({f"b_{c}": F.lit(0.0) for c in names})
    state = start.withColumns({f"z_{c}": dot(F.col(f"r_{c}"), F.col(f"p_{c}")) for c in names})
    state = keep(state.withColumns({f"o_{c}": F.col(f"z_{c}") for c in names}))
    residue = F.greatest(F.lit(0.0), *[F.sqrt(F.greatest(F.lit(0.0), F.col(f"z_{c}")) / F.greatest(F.col(f"o_{c}"), F.lit(1e-300))) for c in names])
    for _ in range(0, steps, each):
        q = state
        for _ in range(each):
            spread = counts.join(q.select(*by, "week", *[f"p_{c}" for c in names]), [*by, "week"])
            means = spread.groupBy(*by, "entity").agg(*[F.sum(F.col("__s") * F.col(f"p_{c}")).alias(f"m_{c}") for c in names])
            back = counts.join(means, [*by, "entity"]).groupBy(*by, "week").agg(*[F.sum(F.col("__c") * F.col(f"m_{c}")).alias(f"m_{c}") for c in names])
            q = q.join(back, [*by, "week"]).withColumns({f"a_{c}": F.col("__n") * F.col(f"p_{c}") - F.col(f"m_{c}") for c in names})
            # Without variation left, or once it is solved, nothing moves.
            go = {c: F.when(F.col(f"z_{c}") > F.col(f"o_{c}") * least**2, F.col(f"z_{c}") / F.nullif(dot(F.col(f"p_{c}"), F.col(f"a_{c}")), F.lit(0.0))) for c in names}
            q = q.withColumns({f"g_{c}": F.coalesce(x, F.lit(0.0)) for c, x in go.items()})
            q = q.withColumns({**{f"b_{c}": F.col(f"b_{c}") + F.col(f"g_{c}") * F.col(f"p_{c}") for c in names}, **{f"r_{c}": F.col(f"r_{c}") - F.col(f"g_{c}") * F.col(f"a_{c}") for c in names}})
            q = q.withColumns({f"y_{c}": dot(F.col(f"r_{c}"), F.col(f"r_{c}") / F.col("__n")) for c in names})
            q = q.withColumns({f"p_{c}": F.col(f"r_{c}") / F.col("__n") + F.coalesce(F.col(f"y_{c}") / F.nullif(f"z_{c}", F.lit(0.0)), F.lit(0.0)) * F.col(f"p_{c}") for c in names})
            q = q.select(*by, "week", "__n", *[F.col(f"{k}_{c}") for c in names for k in "bpro"], *[F.col(f"y_{c}").alias(f"z_{c}") for c in names])
        state = keep(q)
        left = state.agg(F.max(residue)).first()[0]
        if left is None or left <= 10 * least:
            break
    weeks = state.select(*by, "week", *[f"b_{c}" for c in names])
    free = centred.join(weeks, [*by, "week"]).withColumns({c: F.col(c) - F.col(f"b_{c}") for c in names}).drop(*[f"b_{c}" for c in names])
    return keep(free.withColumns({c: F.col(c) - F.avg(c).over(own) for c in names})), keep(state.groupBy(*by).agg(F.max(residue).alias("__residue")))


def two_way_fe(rows: DataFrame, by: list[str], y: str, x: str, controls: list[str], keep: Callable[[DataFrame], DataFrame], steps: int = 240, each: int = 4, least: float = 1e-12) -> DataFrame:
    """(by, coef, se, t, n, r2, note) of x for each regression: entity and week effects, errors clustered by week.

    ``rows`` has a row for each regression (``by``), entity and week. Effects leave by conjugate gradients (at most
    ``steps``, until what is left is ``least`` of the start); controls leave by the sums of products of what is left, a
    few numbers for each regression. Each component of entities and weeks that share no row has effects of its own, which the
    degrees of freedom count. A regression without enough rows or without variation of x gives nulls and a note; one
    whose effects have not converged gives its figures and says so.
    """
    names = [y, x, *controls]
    df = rows.select(*by, "entity", "week", *names).dropna()
    df = keep(df.withColumn("__y", F.col(y)))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("s"), F.countDistinct("week").alias("g"), F.var_pop("__y").alias("__var"), *[F.stddev_pop(c).alias(f"__{c}") for c in names])
    ends = df.select(*by, F.concat(F.lit("e"), F.col("entity").cast("string")).alias("a"), F.concat(F.lit("w"), F.col("week").cast("string")).alias("b"))
    parts = components(ends.distinct(), by, keep).groupBy(*by).agg(F.countDistinct("root").alias("__parts"))
    df, residue = _without_effects(df, by, names, keep, steps, each, least)
    sizes = sizes.join(parts, by).join(residue, by)
    products = {(i, j): F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j}
    found = []
    for r in df.groupBy(*by).agg(*products.values()).join(sizes, by).collect():  # a row for each regression
        gram = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
        k = len(names) - 1 + r["s"] + r["g"] - r["__parts"]
        scale = np.array([r[f"__{c}"] ** 2 * r["n"] for c in names])
        note = "too few rows" if r["n"] <= k or r["g"] < 2 else "no variation" if (np.diag(gram)[1:] <= 1e-12 * scale[1:]).any() else None
        slow = "not converged" if not note and r["__residue"] > 1e-8 else None
        take = np.linalg.lstsq(gram[2:, 2:], gram[2:, :2], rcond=None)[0] if controls and not note else np.zeros((len(controls), 2))
        found.append((*[r[c] for c in by], r["n"], r["g"], k, r["__var"], note or slow, note is None, *map(float, take[:, 0]), *map(float, take[:, 1])))
    kinds = dict(df.dtypes)
    parts = [f"__{side}{j}" for side in "yx" for j in range(len(controls))]
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "n bigint, g bigint, k bigint, __var double, note string, __good boolean", *[f"{p} double" for p in parts]])
    small = df.sparkSession.createDataFrame(found, schema)
    free = df.join(F.broadcast(small), by)  # a row for each regression
    for side, c in (("y", y), ("x", x)):
        out = F.col(c)
        for j, control in enumerate(controls):
            out = out - F.col(f"__{side}{j}") * F.col(control)
        free = free.withColumn(f"__free_{side}", out)
    slope = free.groupBy(*by).agg((F.sum(F.col("__free_x") * F.col("__free_y")) / F.nullif(F.sum(F.col("__free_x") * F.col("__free_x")), F.lit(0.0))).alias("coef"), F.sum(F.col("__free_x") * F.col("__free_x")).alias("__sxx"))
    slope = keep(slope)
    rest = F.col("__free_y") - F.col("coef") * F.col("__free_x")
    weekly = free.join(F.broadcast(slope), by).groupBy(*by, "week").agg(F.sum(F.col("__free_x") * rest).alias("__score"), F.sum(rest * rest).alias("__ssr"))
    total = weekly.groupBy(*by).agg(F.sum(F.col("__score") * F.col("__score")).alias("__meat"), F.sum("__ssr").alias("__ssr"))
    out = small.join(slope, by, "left").join(total, by, "left")
    n, g, k = (F.col(c) for c in ("n", "g", "k"))
    good = F.col("__good")
    se = F.sqrt(F.col("__meat")) / F.col("__sxx") * F.sqrt(g / (g - 1) * (n - 1) / (n - k))
    out = out.withColumn("coef", F.when(good, F.col("coef"))).withColumn("se", F.when(good, se))
    out = out.withColumn("t", F.col("coef") / F.nullif("se", F.lit(0.0))).withColumn("r2", F.when(good, 1 - F.col("__ssr") / F.nullif(F.col("__var") * n, F.lit(0.0))))
    return out.select(*by, "coef", "se", "t", "n", "r2", "note")


def draw(seed: int, resample: Column, place: Column, n: Column) -> Column:
    """A place from 0 to n - 1, drawn by a counter: 48 bits of a digest of the seed, the resample and the draw's number."""
    text = F.concat_ws(" ", F.lit(seed), resample, place)
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % n


def bootstrap(values: DataFrame, value: str, key: str, by: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """(by, low, high): percentile interval of the mean by resampling; null below two values.

    Values are numbered in order of ``key``; draw j of resample i takes the value whose number a digest of (seed, i, j)
    gives. So every draw is a row of its own, made and counted anywhere, and any engine draws the same.
    """
    known = values.select(by, key, value).filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    held = known.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    numbered = known.select(by, F.col(value).cast("double").alias("__v"), (F.row_number().over(Window.partitionBy(by).orderBy(key)) - 1).cast("long").alias("__k")).join(held, by)
    # Each value's row makes one draw of every resample: the draw's number is its own.
    draws = numbered.select(by, "__n", "__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__i"))
    draws = draws.select(by, "__i", draw(seed, F.col("__i"), F.col("__k"), F.col("__n")).alias("__k"))
    times = draws.groupBy(by, "__i", "__k").agg(F.count(F.lit(1)).alias("__times"))
    means = times.join(numbered, [by, "__k"]).groupBy(by, "__i").agg((F.sum(F.col("__times") * F.col("__v")) / F.first("__n")).alias("__mean"))
    # n means of a group meet, whatever the number of values.
    cuts = means.groupBy(by).agg(F.percentile("__mean", F.array(F.lit(0.025), F.lit(0.975))).alias("__q"))
    out = values.select(by).distinct().join(held, by, "left").join(cuts, by, "left")
    enough = F.col("__n") >= 2
    return out.select(by, F.when(enough, F.col("__q")[0]).alias("low"), F.when(enough, F.col("__q")[1]).alias("high"))


def rolling_hac(coefs: DataFrame, value: str = "coef", order: str = "week", window: int = 52, least: int = 10) -> DataFrame:
    """(week, mean, t) over each full trailing window of ``window`` values, the error as in hac_mean, as array folds."""
    w = Window.orderBy(order).rowsBetween(1 - window, 0)
    df = coefs.select(order, F.collect_list(value).over(w).alias("x"), F.count(F.lit(1)).over(w).alias("rows")).filter((F.col("rows") == window) & (F.size("x") >= least))
    n = F.size("x")
    df = df.withColumn("mean", F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / n)
    df = df.withColumn("d", F.transform("x", lambda v: v - F.col("mean"))).withColumn("lag", F.least(F.floor(4 * F.pow(F.size("d") / 100, F.lit(2 / 9))), F.size("d") - 1).cast("int"))
    product = lambda l: F.aggregate(F.zip_with(F.slice("d", l + 1, F.size("d") - l), F.slice("d", F.lit(1), F.size("d") - l), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)  # noqa: E731, E741
    s = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("lag")), lambda l: F.when(l == 0, 1.0).otherwise(2 * (1 - l / (F.col("lag") + 1))) * product(l)), F.lit(0.0), lambda a, v: a + v)
    df = df.withColumn("s", s)
    return df.select(order, "mean", F.when(F.col("s") > 0, F.col("mean") / (F.sqrt("s") / F.size("d"))).alias("t"))


"""Weekly regressions from sufficient statistics.

Many models and horizons are fitted in one pass: each row becomes a row for each regression, partial sums of products are
taken before the shuffle, and what is left is a small system for each week and regression, solved by Gauss-Jordan
elimination as array folds. No row of the panel leaves the JVM, and no task holds a week.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a week must have beyond its number of coefficients: a fixed value.
BUFFER = 5
#: What may be left of a regressor's variation, relative to itself, once the others are taken out, before it counts as dependent.
TOLERANCE = 1e-13


@dataclass(frozen=True)
class Model:
    """A regression of ``y`` on a constant, ``terms`` and, if given, effects of a category (null: as its first value)."""

    keys: dict[str, object]
    y: str
    terms: list[str]
    effects: str | None = None
    places: list[tuple[int, int]] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "places", [(i, j) for i in range(len(self.terms) + 1) for j in range(i, len(self.terms) + 1)])


def _known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def moments(panel: DataFrame, models: list[Model], by: str = "week") -> DataFrame:
    """(keys, by, n, categories, products, raw, means) of each regression and group, complete rows only.

    ``products`` are the sums of products of deviations from the category's means, in the order of ``Model.places`` with the
    terms first and y last; ``raw`` the sums of squares about the group's mean. Groups without a complete row are there
    with n = 0.
    """
    most = max(len(m.terms) for m in models)
    keys = list(models[0].keys)
    rows = []
    for m in models:
        held = _known(m.y)
        for t in m.terms:
            held = held & _known(t)
        values = [F.col(t).cast("double") for t in [*m.terms, m.y]]
        values += [F.lit(0.0)] * (most + 1 - len(values))
        effect = F.when(held, F.col(m.effects).cast("string")) if m.effects else F.lit(None).cast("string")
        rows.append(F.struct(*[F.lit(v).alias(k) for k, v in m.keys.items()], F.lit(len(m.terms)).alias("p"), effect.alias("effect"), F.when(held, F.array(*values)).alias("v")))
    columns = {by, *[c for m in models for c in (m.y, *m.terms, *([m.effects] if m.effects else []))]}
    long = panel.select(*sorted(columns)).select(by, F.explode(F.array(*rows)).alias("m")).select(by, "m.*")
    pairs = [(i, j) for i in range(most + 1) for j in range(i, most + 1)]
    v = lambda i: F.col("v")[i]
    sums = [F.count("v").alias("n"), *[F.coalesce(F.sum(v(i)), F.lit(0.0)).alias(f"s{i}") for i in range(most + 1)], *[F.coalesce(F.sum(v(i) * v(j)), F.lit(0.0)).alias(f"s{i}_{j}") for i, j in pairs]]
    each = long.groupBy(*keys, by, "p", "effect").agg(*sums)
    # Rows without a category stand with its first value, which is the base.
    base = F.min("effect").over(Window.partitionBy(*keys, by))
    totals = [F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(most + 1)], *[F.sum(f"s{i}_{j}").alias(f"s{i}_{j}") for i, j in pairs]]
    each = each.withColumn("effect", F.coalesce("effect", base)).groupBy(*keys, by, "p", "effect").agg(*totals)
    own = lambda i, j: F.col(f"s{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")
    within = [F.coalesce(F.sum(F.when(F.col("n") > 0, own(i, j))), F.lit(0.0)).alias(f"w{i}_{j}") for i, j in pairs]
    whole = [F.sum("n").alias("n"), F.count("effect").alias("categories"), *[F.sum(f"s{i}").alias(f"t{i}") for i in range(most + 1)], *[F.sum(f"s{i}_{i}").alias(f"t{i}_{i}") for i in range(most + 1)]]
    out = each.groupBy(*keys, by, "p").agg(*whole, *within)
    mean = lambda i: F.col(f"t{i}") / F.nullif(F.col("n"), F.lit(0).cast("long"))
    raw = F.array(*[F.col(f"t{i}_{i}") - F.col(f"t{i}") * mean(i) for i in range(most + 1)])
    full = F.array(*[F.array(*[F.col(f"w{min(i, j)}_{max(i, j)}") for j in range(most + 1)]) for i in range(most + 1)])
    return out.select(*keys, by, "p", "n", "categories", full.alias("products"), raw.alias("raw"), F.array(*[mean(i) for i in range(most + 1)]).alias("means"))


def _solved(products: Column, raw: Column, p: Column) -> Column:
    """Struct (m, rank) of the elimination: column p of row i of m is the coefficient of term i, if the rank is p."""
    def step(acc: Column, k: Column) -> Column:
        pivot = acc["m"][k][k]
        # What is left of the term's variation is held against that about the mean of its group.
        free = pivot > F.get(raw, k) * TOLERANCE
        line = F.transform(acc["m"][k], lambda x: x / pivot)
        swept = F.transform(acc["m"], lambda row, i: F.when(i == k, line).otherwise(F.zip_with(row, line, lambda x, y: x - F.get(row, k) * y)))
        return F.when(free, F.struct(swept.alias("m"), (acc["rank"] + 1).alias("rank"))).otherwise(acc)

    start = F.struct(products.alias("m"), F.lit(0).alias("rank"))
    return F.aggregate(F.sequence(F.lit(0), p - 1), start, step)


def weekly_fits(panel: DataFrame, models: list[Model], by: str = "week") -> DataFrame:
    """(keys, by, n, k, reason, coefs, means, r2): every regression in every group of ``panel``.

    ``reason`` is null for a fit, and says why there is none where rows are fewer than k + 5 (k counts constant, terms
    and categories but one) or the regressors are dependent; coefs and r2 are null then. ``coefs`` follow the terms;
    ``means`` are those of the terms and then of y. Rows with a null in y or a term take no part.
    """
    keys = list(models[0].keys)
    df = moments(panel, models, by)
    effects = F.greatest(F.lit(0), F.col("categories") - 1).cast("int")
    df = df.withColumn("k", (1 + F.col("p") + effects).cast("int")).withColumn("x", _solved(F.col("products"), F.col("raw"), F.col("p")))
    rank = (F.col("k") - F.col("p") + F.col("x.rank")).cast("int")
    reason = F.when(F.col("n") < F.col("k") + BUFFER, F.format_string("insufficient_obs n=%d k=%d", "n", "k"))
    reason = reason.when(rank < F.col("k"), F.format_string("rank_deficient rank=%d k=%d", rank, "k"))
    coefs = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.col("x.m")[i][F.col("p")])
    df = df.withColumn("reason", reason).withColumn("coefs", F.when(F.col("reason").isNull(), coefs))
    y = F.col("p")
    explained = F.aggregate(F.sequence(F.lit(0), F.col("p") - 1), F.lit(0.0), lambda sum_, i: sum_ + F.col("coefs")[i] * F.col("products")[i][y])
    rest, total = F.col("products")[y][y] - explained, F.get(F.col("raw"), y)
    r2 = F.when(F.col("reason").isNull() & (total > 0), 1 - rest / total)
    return df.select(*keys, by, "n", "k", "reason", "coefs", F.slice("means", F.lit(1), F.col("p") + 1).alias("means"), r2.alias("r2"))


def coefficients(fits: DataFrame, models: list[Model]) -> DataFrame:
    """A row for each coefficient of ``weekly_fits``: the keys, the group, term, coef, n, r2."""
    keys = list(models[0].keys)
    names = F.lit(None).cast("array<string>")
    for terms in {tuple(m.terms) for m in models}:
        here = F.lit(False)
        for m in models:
            if tuple(m.terms) == terms:
                match = F.lit(True)
                for k, v in m.keys.items():
                    match = match & (F.col(k) == v)
                here = here | match
        names = F.when(here, F.array(*map(F.lit, terms))).otherwise(names)
    kept = fits.filter(F.col("reason").isNull())
    others = [c for c in fits.columns if c not in (*keys, "n", "k", "reason", "coefs", "means", "r2")]
    return kept.select(*keys, *others, "n", "r2", F.posexplode("coefs").alias("at", "coef"), names.alias("names")).select(*keys, *others, F.get("names", "at").alias("term"), "coef", "n", "r2")


def residuals(panel: DataFrame, y: str, terms: list[str], by: str = "week") -> DataFrame:
    """``panel`` with ``residual`` of y on the terms in its group; null where a value is missing or there is no fit."""
    model = Model({"model": "residual"}, y, terms)
    fits = weekly_fits(panel, [model], by).filter(F.col("reason").isNull()).select(F.col(by).alias("__by"), "coefs", "means")
    out = panel.join(fits, F.col(by) == F.col("__by"), "left")
    rest = F.col(y) - F.col("means")[len(terms)]
    for i, t in enumerate(terms):
        rest = rest - F.col("coefs")[i] * (F.col(t) - F.col("means")[i])
    return out.withColumn("residual", rest).drop("__by", "coefs", "means")

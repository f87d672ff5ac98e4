"""Exact quantiles by selection, fixed effects on sparse designs, components."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import graph, inference, quantiles


@pytest.fixture
def keep(spark, tmp_path):
    made = []

    def stored(df):
        made.append(df)
        df.write.parquet(f"{tmp_path}/{len(made)}")
        return spark.read.parquet(f"{tmp_path}/{len(made)}")

    return stored


PROBABILITIES = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.95, 1.0]


@pytest.mark.parametrize("small,accuracy", [(50, 100), (7, 1000), (100_000, 10_000)])
def test_quantiles(spark, small, accuracy):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 1), rng.choice([1.0, 1.0, 1.0, 2.0, 5.0]), 10.0 ** rng.randrange(-300, 300), None, float(i)) for i in range(3_000)] + [(None, None, None, None, float("nan"))] * 9
    names = list("abcde")
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5), names, PROBABILITIES, small, accuracy)
    for k, n in enumerate(names):
        v = [r[k] for r in rows if r[k] is not None and r[k] == r[k]]
        if not v:
            assert got[n] == [None] * len(PROBABILITIES)
            continue
        v = sorted(v)
        for p, found in zip(PROBABILITIES, got[n]):
            at = p * (len(v) - 1)
            i = int(at)
            want = v[i] if at == i else (i + 1 - at) * v[i] + (at - i) * v[min(i + 1, len(v) - 1)]
            assert found == pytest.approx(want, rel=1e-12)


def test_quantiles_of_one_value_and_of_none(spark):
    one = spark.createDataFrame([(4,)], "x int")
    assert quantiles.exact_quantiles(one, ["x"], [0.0, 0.3, 1.0]) == {"x": [4.0, 4.0, 4.0]}
    assert quantiles.exact_quantiles(one.limit(0), ["x"], [0.5]) == {"x": [None]}


def dummies(rows, weeks_of, entities_of, y, x, controls):
    """Least squares with a dummy for each entity and week, errors clustered by week; the design may lack full rank."""
    e = np.array([[float(r[0] == v) for v in entities_of] for r in rows])
    w = np.array([[float(r[1] == v) for v in weeks_of] for r in rows])
    d = np.column_stack([e, w])
    rest = lambda v: v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
    z = np.column_stack([rest(np.array([r[i] for r in rows])) for i in (x, *controls)])
    t = rest(np.array([r[y] for r in rows]))
    beta = np.linalg.lstsq(z, t, rcond=None)[0]
    u = t - z @ beta
    inverse = np.linalg.inv(z.T @ z)
    scores = [z[[r[1] == v for r in rows]].T @ u[[r[1] == v for r in rows]] for v in weeks_of]
    meat = sum(np.outer(s, s) for s in scores)
    n, g = len(rows), len(weeks_of)
    k = z.shape[1] + np.linalg.matrix_rank(d)
    return beta[0], np.sqrt((inverse @ meat @ inverse)[0, 0] * g / (g - 1) * (n - 1) / (n - k))


def chain(n, seed=0, parts=1):
    """Entity i is seen in weeks i and i + 1 only, three times each, so that effects are linked through long chains."""
    rng = np.random.default_rng(seed)
    rows = []
    for part in range(parts):
        for i in range(n):
            for w in (i, i + 1):
                for _ in range(3):
                    x, c = rng.normal(size=2)
                    rows.append((f"p{part}e{i:03d}", part * 1000 + w, float(0.04 * x + 0.3 * c + 0.1 * i + rng.normal()), float(x), float(c)))
    return rows


@pytest.mark.parametrize("n,parts", [(25, 1), (8, 3)])
def test_fixed_effects_on_a_thin_chain(spark, keep, n, parts):
    rows = chain(n, parts=parts)
    coef, se = dummies(rows, sorted({r[1] for r in rows}), sorted({r[0] for r in rows}), 2, 3, [4])
    df = spark.createDataFrame(rows, "entity string, week int, y double, x double, c double").withColumn("model", F.lit("m"))
    got = inference.two_way_fe(df, ["model"], "y", "x", ["c"], keep).first()
    assert got.note is None and got.coef == pytest.approx(coef, rel=1e-7) and got.se == pytest.approx(se, rel=1e-6)


def test_effects_that_have_not_converged_say_so(spark, keep):
    df = spark.createDataFrame(chain(30), "entity string, week int, y double, x double, c double").withColumn("model", F.lit("m"))
    got = inference.two_way_fe(df, ["model"], "y", "x", ["c"], keep, steps=2, each=2).first()
    assert got.note == "not converged" and got.coef is not None and got.se is not None


def test_components(spark, keep):
    rng = random.Random(4)
    edges = [("g", f"n{a:03d}", f"n{a + 1:03d}") for a in range(60) if a % 17 != 3] + [("h", "n001", "n002"), ("h", "n002", "n001"), ("h", "x", "x")]
    rng.shuffle(edges)
    root = {}
    for g in "gh":
        nodes = sorted({n for b, *ends in edges if b == g for n in ends})
        of = {n: n for n in nodes}
        for _ in nodes:
            for b, p, q in edges:
                if b == g:
                    of[p] = of[q] = min(of[p], of[q])
        root |= {(g, n): r for n, r in of.items()}
    got = graph.components(spark.createDataFrame(edges, "g string, a string, b string"), ["g"], keep).collect()
    assert {(r.g, r.node): r.root for r in got} == root and len(got) == len(root)

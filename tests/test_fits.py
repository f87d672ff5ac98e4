"""Regressions from sufficient statistics against numpy on the rows themselves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import fits

MODELS = [fits.Model({"model": m, "horizon": h}, f"y{h}", terms, effects) for m, terms, effects in (("one", ["a"], None), ("two", ["a", "b"], None), ("effects", ["b", "c"], "g"), ("all", ["a", "b", "c"], "g")) for h in (1, 2)]


def rows(seed=0):
    rng = random.Random(seed)
    out = []
    for w in range(14):
        for i in range([0, 3, 7, 9, 12, 40][w % 6]):
            a, b, c = rng.gauss(3, 1), rng.gauss(-100, 2), rng.random()
            g = rng.choice(["p", "q", "r", None]) if w % 3 else rng.choice([None, "q"])
            if w == 5:
                b = 2 * a - 7  # dependent
            if w == 11:
                c = 4.0  # no variation
            y1, y2 = 2 * a - b + rng.gauss(0, 1), c * 5 + rng.gauss(0, 1)
            hole = rng.random()
            out.append((w, f"e{i}", g, None if hole < 0.05 else y1, math.nan if hole > 0.97 else y2, a, None if 0.4 < hole < 0.43 else b, c))
        if w % 6 == 0:
            out.append((w, "x", "p", None, None, 1.0, 1.0, 1.0))  # a week without a complete row
    return out


SCHEMA = "week int, entity string, g string, y1 double, y2 double, a double, b double, c double"


def brute(data, model):
    """{week: (n, k, reason, coefs, r2)} as least squares on a design matrix with dummies."""
    column = dict(zip(["week", "entity", "g", "y1", "y2", "a", "b", "c"], range(8)))
    out = {}
    for week in {r[0] for r in data}:
        held = [r for r in data if r[0] == week and all(r[column[x]] is not None and not math.isnan(r[column[x]]) for x in (model.y, *model.terms))]
        x = [[1.0, *[r[column[t]] for t in model.terms]] for r in held]
        if model.effects:
            names = sorted({r[2] for r in held if r[2] is not None})[1:]
            x = [[*line, *[float(r[2] == v) for v in names]] for line, r in zip(x, held)]
        k = len(x[0]) if x else 1 + len(model.terms)
        if len(held) < k + 5:
            out[week] = (len(held), k, f"insufficient_obs n={len(held)} k={k}", None, None)
            continue
        x, y = np.array(x), np.array([r[column[model.y]] for r in held])
        rank = np.linalg.matrix_rank(x)
        if rank < k:
            out[week] = (len(held), k, f"rank_deficient rank={rank} k={k}", None, None)
            continue
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        rest, total = ((y - x @ beta) ** 2).sum(), ((y - y.mean()) ** 2).sum()
        out[week] = (len(held), k, None, beta[1 : 1 + len(model.terms)], 1 - rest / total)
    return out


def test_fits(spark):
    data = rows()
    got = {(r.model, r.horizon, r.week): r for r in fits.weekly_fits(spark.createDataFrame(data, SCHEMA), MODELS).collect()}
    reasons = set()
    for m in MODELS:
        want = brute(data, m)
        for week, (n, k, reason, coefs, r2) in want.items():
            r = got.pop((m.keys["model"], m.keys["horizon"], week))
            assert (r.n, r.k, r.reason) == (n, k, reason)
            reasons.add(reason and reason.split()[0])
            if reason:
                assert r.coefs is None and r.r2 is None
            else:
                assert np.allclose(r.coefs, coefs, rtol=1e-8, atol=1e-10) and r.r2 == pytest.approx(r2, rel=1e-8, abs=1e-10)
    assert not got and reasons == {None, "insufficient_obs", "rank_deficient"}


def test_coefficients_by_term(spark):
    found = fits.weekly_fits(spark.createDataFrame(rows(), SCHEMA), MODELS)
    names = {(r.model, r.term) for r in fits.coefficients(found, MODELS).select("model", "term").distinct().collect()}
    assert names == {(m.keys["model"], t) for m in MODELS for t in m.terms}


def test_one_shuffle_of_the_rows(spark):
    """Partial sums are taken before the first exchange, and nothing runs in Python."""
    from contextlib import redirect_stdout
    from io import StringIO

    df = spark.createDataFrame(rows(), SCHEMA)
    text = StringIO()
    with redirect_stdout(text):
        fits.weekly_fits(spark.range(5).join(df, F.col("id") == F.col("week")).drop("id"), MODELS).explain()
    plan = text.getvalue()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Generate explode") == 1
    assert plan.index("partial_sum") > 0


def test_residuals(spark):
    data = rows()
    got = {(r.week, r.entity): r.residual for r in fits.residuals(spark.createDataFrame(data, SCHEMA), "y1", ["a", "b"]).collect()}
    assert len(got) == len(data)
    want = brute(data, fits.Model({"model": "x"}, "y1", ["a", "b"]))
    for w, (n, k, reason, coefs, _) in want.items():
        held = [r for r in data if r[0] == w and r[3] is not None and r[6] is not None]
        if reason:
            assert all(got[w, r[1]] is None for r in data if r[0] == w)
            continue
        x = np.array([[1.0, r[5], r[6]] for r in held])
        y = np.array([r[3] for r in held])
        rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert np.allclose([got[w, r[1]] for r in held], rest, atol=1e-8)


def test_fits_of_nothing(spark):
    assert fits.weekly_fits(spark.createDataFrame([], SCHEMA), MODELS).count() == 0

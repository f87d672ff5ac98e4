"""Exact quantiles of a whole table: selection by counts, no buffer of all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that are sorted at once, at the end.
SMALL = 50_000
#: Relative accuracy of the sketch that proposes brackets is one over this.
ACCURACY = 10_000


def _selected(df: DataFrame, wanted: dict[str, set[int]], bounds: dict[str, tuple[int, float, float]], small: int, accuracy: int) -> dict[tuple[str, int], float]:
    """The values at given places (from 0) of each column's order; bounds: number, least and largest of its values."""
    found: dict[tuple[str, int], float] = {}
    open_ = {(c, k): (0, bounds[c][0], bounds[c][1], bounds[c][2]) for c, places in wanted.items() for k in places}  # below, rows, low, high
    stuck: set[tuple[str, int]] = set()

    def inside(c: str, low: float, high: float) -> Column:
        return F.when((F.col(c) >= low) & (F.col(c) <= high), F.col(c))

    while True:
        for (c, k), (_, _, low, high) in list(open_.items()):
            if low == high:
                found[c, k] = low
                del open_[c, k]
        large = [x for x, (_, rows, _, _) in open_.items() if rows > small]
        if not large:
            break
        # A sketch of what lies in the bracket proposes a narrower one about the place, or one value where that was none ...
        proposals = []
        for c, k in large:
            below, rows, low, high = open_[c, k]
            at, wide = (k - below + 0.5) / rows, 0.0 if (c, k) in stuck else 2.0 / accuracy
            proposals.append(F.percentile_approx(inside(c, low, high), F.array(F.lit(max(0.0, at - wide)), F.lit(min(1.0, at + wide))), accuracy))
        cuts = df.agg(*[p.alias(f"p{i}") for i, p in enumerate(proposals)]).first()
        # ... and counts say whether the place is in it, before it or after it.
        counts = []
        for (c, k), cut in zip(large, cuts):
            x, (_, _, low, high) = F.col(c), open_[c, k]
            counts += [F.count_if((x >= low) & (x < cut[0])), F.count_if((x >= cut[0]) & (x <= cut[1])), F.max(F.when((x >= low) & (x < cut[0]), x)), F.min(F.when((x > cut[1]) & (x <= high), x))]
        seen = df.agg(*[x.alias(f"n{i}") for i, x in enumerate(counts)]).first()
        for i, (c, k) in enumerate(large):
            below, rows, low, high = open_[c, k]
            fewer, here, last, first = seen[4 * i : 4 * i + 4]
            if here == rows:
                stuck.add((c, k))
            elif k < below + fewer:
                open_[c, k] = (below, fewer, low, last)
            elif k < below + fewer + here:
                open_[c, k] = (below + fewer, here, *map(float, cuts[i]))
            else:
                open_[c, k] = (below + fewer + here, rows - fewer - here, first, high)
    if open_:
        sorted_ = df.agg(*[F.element_at(F.array_sort(F.collect_list(inside(c, low, high))), k - below + 1).alias(f"v{i}") for i, ((c, k), (below, _, low, high)) in enumerate(open_.items())]).first()
        found |= dict(zip(open_, sorted_))
    return found


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], small: int = SMALL, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """The interpolated quantiles of each numeric column over all rows; None for a column without values.

    Each order statistic is bracketed by a sketch, the bracket is checked by counts over all rows and narrowed until it
    holds ``small`` values at most (or one value, however often), which are sorted. Each round narrows a bracket by about
    ``accuracy`` / 4, so that two or three passes are enough for any number of rows. Nulls and NaN take no part.
    """
    clean = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    names = [f"c{i}" for i in range(len(columns))]
    ends = clean.agg(*[x.alias(f"{n}_{k}") for n in names for k, x in (("n", F.count(n)), ("a", F.min(n)), ("b", F.max(n)))]).first()
    bounds = {n: (ends[f"{n}_n"], ends[f"{n}_a"], ends[f"{n}_b"]) for n in names if ends[f"{n}_n"]}
    wanted = {n: {k for p in probabilities for at in [p * (rows - 1)] for k in (int(at), min(int(at) + 1, rows - 1))} for n, (rows, _, _) in bounds.items()}
    found = _selected(clean, wanted, bounds, small, accuracy)
    out: dict[str, list[float | None]] = {}
    for c, n in zip(columns, names):
        out[c] = [None] * len(probabilities)
        for i, p in enumerate(probabilities if n in bounds else []):
            at = p * (bounds[n][0] - 1)
            k = int(at)
            low, high = found[n, k], found[n, min(k + 1, bounds[n][0] - 1)]
            out[c][i] = low if at == k or low == high else (k + 1 - at) * low + (at - k) * high
    return out

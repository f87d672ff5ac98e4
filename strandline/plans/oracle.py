"""DuckDB SQL for the registered panel queries, composed of named common table expressions."""

from __future__ import annotations

import re


def r(x: str, places: int = 6) -> str:
    return f"(floor(({x}) * {10**places}.0::DOUBLE + 0.5) / {10**places}.0::DOUBLE)"


PAST, AHEAD, CTRL = (1, 4, 8, 12, 26), (1, 2, 4), ("past_4w", "past_12w", "volume_ratio_4w", "volatility_12w", "liquidity_rank")


def _roll(agg: str, n: int, least: int, of: str, by: str = "date") -> str:
    w = f"OVER (PARTITION BY entity ORDER BY {by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({of}) {w} >= {least} THEN {agg} {w} END"


def _wide(value: str, name: str, keys: tuple[int, ...]) -> str:
    return ", ".join(f"max(CASE WHEN n = {k} THEN {value} END) AS {name.format(k)}" for k in keys)


def _hac(source: str, by: str, value: str) -> str:
    """Newey-West mean of ``value`` in ``source`` by the columns ``by``, ordered by week."""
    part = f"PARTITION BY {by}" if by else ""
    same = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in by.split(",")) if by else "true"
    keys, group = (by + ", ", f"GROUP BY {by}") if by else ("", "")
    akeys = "".join(f"a.{c.strip()}, " for c in by.split(",")) if by else ""
    return f"""(WITH v AS (SELECT {keys}{value} AS x, row_number() OVER ({part} ORDER BY week) AS i, avg({value}) OVER ({part}) AS mean, count(*) OVER ({part}) AS n FROM {source} WHERE {value} IS NOT NULL),
d AS (SELECT *, x - mean AS d, least(floor(4 * pow(n / 100.0, 2.0 / 9)), n - 1)::INT AS lag FROM v),
p AS (SELECT {akeys}sum(CASE WHEN a.i = b.i THEN 1.0 ELSE 2 * (1 - (a.i - b.i)::DOUBLE / (a.lag + 1)) END * a.d * b.d) AS s FROM d a JOIN d b ON {same} AND b.i BETWEEN a.i - a.lag AND a.i {"GROUP BY " + akeys.rstrip(", ") if by else ""}),
q AS (SELECT {keys}any_value(mean) AS mean, stddev_samp(x) AS std, any_value(n) AS n FROM d {group})
SELECT {"q." + ", q.".join(c.strip() for c in by.split(",")) + ", " if by else ""}mean, std, n, CASE WHEN s > 0 THEN sqrt(s) / n END AS se, CASE WHEN n >= 2 THEN mean / (CASE WHEN s > 0 THEN sqrt(s) / n END) END AS t
FROM q {"JOIN p USING (" + by + ")" if by else "CROSS JOIN p"})"""


def _tercile(source: str, column: str, labels: tuple[str, str, str], out: str) -> str:
    return f"""SELECT s.*, CASE WHEN q[1] < q[2] AND q[2] < q[3] AND q[3] < q[4] AND {column} IS NOT NULL THEN CASE WHEN {column} <= q[2] THEN '{labels[0]}' WHEN {column} <= q[3] THEN '{labels[1]}' ELSE '{labels[2]}' END END AS {out}
FROM {source} s JOIN (SELECT week, quantile_cont({column}, [0.0, 1.0/3, 2.0/3, 1.0]) AS q FROM {source} GROUP BY week) USING (week)"""


def _ic(source: str, x: str, y: str) -> str:
    rank = lambda c: f"(rank() OVER (PARTITION BY week ORDER BY {c}) + (count(*) OVER (PARTITION BY week, {c}) - 1) / 2.0)"
    return f"""SELECT week, corr(rx, ry) AS ic, count(*) AS n FROM (SELECT week, {rank(x)} AS rx, {rank(y)} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY week
HAVING count(*) >= 10 AND stddev_samp(rx) > 0 AND stddev_samp(ry) > 0"""


def _slope(source: str, y: str, x: str = "z") -> str:
    return f"""SELECT week, regr_slope({y}, {x}) AS coef, count(*) AS n, regr_r2({y}, {x}) AS r2 FROM {source} WHERE {y} IS NOT NULL AND {x} IS NOT NULL GROUP BY week HAVING count(*) >= 7 AND min({x}) < max({x})"""


def _student(t: str, df: str) -> str:
    """Two-sided p-value of Student's t by its finite series, terms by way of the gamma function."""
    theta, c2 = f"atan(abs({t}) / sqrt({df}))", f"ln(1 / (1 + ({t}) * ({t}) / ({df})))"
    even = f"sin({theta}) * list_sum(list_transform(range(0, ({df}) // 2), lambda j: exp(lgamma(2.0 * j + 1) - 2 * lgamma(j + 1.0) - j * ln(4.0) + j * {c2})))"
    odd = f"2 / pi() * ({theta} + CASE WHEN {df} > 1 THEN sin({theta}) * cos({theta}) * list_sum(list_transform(range(0, (({df}) - 1) // 2), lambda j: exp(j * ln(4.0) + 2 * lgamma(j + 1.0) - lgamma(2.0 * j + 2) + j * {c2}))) ELSE 0 END)"
    return f"CASE WHEN {t} IS NOT NULL AND {df} >= 1 THEN greatest(0.0, 1 - CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END) END"


def _normal(t: str) -> str:
    x = f"(least(abs({t}), 9.0) / sqrt(2.0))"
    term = f"k * ln(2.0) + (2 * k + 1) * ln({x}) - lgamma(2.0 * k + 3) + (k + 1) * ln(2.0) + lgamma(k + 2.0)"
    return f"greatest(0.0, 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum(list_transform(range(0, 200), lambda k: exp({term}))))"


def _project(source: str, columns: list[str], others: list[str], part: str, passed: str) -> str:
    """``source`` with ``columns`` made orthogonal to each of ``others`` in turn, within ``part``."""
    for j, o in enumerate(others):
        left = [*others[j + 1 :], *columns]
        free = ", ".join(f"{v} - {o} * sum({v} * {o}) OVER w / nullif(sum({o} * {o}) OVER w, 0) AS {v}" for v in left)
        low = f"least(low, sum({o} * {o}) OVER w / nullif(sum({o}_raw * {o}_raw) OVER w, 0))"
        raws = ", ".join(f"{v}_raw" for v in [*others, *columns])
        source = f"(SELECT {passed}, {raws}, {low} AS low, {free} FROM {source} WINDOW w AS (PARTITION BY {part}))"
    return source


def _ols(source: str, y: str, target: str, others: list[str], effects: str | None = None) -> str:
    """(week, coef, n, r2) of ``target`` among the regressors of ``y`` in each week: every other one projected out first."""
    names = {**{f"o{i}": c for i, c in enumerate(others)}, "x": target, "y": y}
    complete = f"(SELECT week, {effects or "''"} AS effect, {', '.join(f'({c})::DOUBLE AS {k}' for k, c in names.items())} FROM {source} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in names.values())})"
    part = "week, effect"
    centred = f"(SELECT week, effect, 1.0::DOUBLE AS low, {', '.join(f'{k} - avg({k}) OVER (PARTITION BY {part}) AS {k}, {k} - avg({k}) OVER (PARTITION BY week) AS {k}_raw' for k in names)} FROM {complete})"
    free = _project(centred, ["x", "y"], [f"o{i}" for i in range(len(others))], "week", "week, effect")
    fit = f"(SELECT *, sum(x * y) OVER (PARTITION BY week) / nullif(sum(x * x) OVER (PARTITION BY week), 0) AS b FROM {free})"
    k = 1 + len(others) + 1
    return f"""SELECT week, any_value(b) AS coef, count(*) AS n, 1 - sum((y - b * x) * (y - b * x)) / nullif(sum(y_raw * y_raw), 0) AS r2 FROM {fit} GROUP BY week
HAVING count(*) >= {k} + count(DISTINCT effect) - 1 + 5 AND min(low) > 1e-13 AND sum(x * x) > 1e-13 * sum(x_raw * x_raw)"""


def _skipped(source: str, models: dict[str, list[str]], effects: dict[str, str]) -> str:
    """Weeks of ``source`` in which a model has too few complete rows, or regressors of which one is the others' combination."""
    out = []
    for m, terms in models.items():
        for n in AHEAD:
            held = " AND ".join(f"{c} IS NOT NULL" for c in (f"future_excess_{n}w", *terms))
            effect = effects.get(m, "NULL::VARCHAR")
            counts = f"(SELECT week, count(*) FILTER ({held}) AS n, {1 + len(terms)} + greatest(0, count(DISTINCT CASE WHEN {held} THEN {effect} END) - 1) AS k FROM {source} GROUP BY week)"
            fitted = f"(SELECT week FROM ({_ols(source, f'future_excess_{n}w', terms[0], terms[1:], effects.get(m))}))"
            out.append(f"SELECT '{m}' AS model, {n} AS horizon, week, n, CASE WHEN n < k + 5 THEN 'insufficient_obs n=' || n || ' k=' || k ELSE 'rank_deficient' END AS reason FROM {counts} WHERE week NOT IN {fitted}")
    return " UNION ALL ".join(out)


def _models(source: str, models: dict[str, list[str]], target: str = "z", effects: dict[str, str] | None = None, label: str = "model") -> str:
    return " UNION ALL ".join(f"SELECT *, '{m}' AS {label}, {n} AS horizon FROM ({_ols(source, f'future_excess_{n}w', target, others, (effects or {}).get(m))})" for m, others in models.items() for n in AHEAD)


def _fm(coefs: str, by: str, panel: str) -> str:
    """Summary of weekly coefficients: mean with its error and test, fit, skipped weeks."""
    return f"""SELECT h.*, avg_r2, {_student('t', '(n - 1)')} AS p, coalesce({_student('t', '(n - 1)')} < 0.05, false) AS significant, (SELECT count(DISTINCT week) FROM {panel}) - held AS n_skipped
FROM {_hac(coefs, by, 'coef')} h JOIN (SELECT {by}, avg(r2) AS avg_r2, count(DISTINCT week) AS held FROM {coefs} GROUP BY ALL) USING ({by})"""


def _each(template, model: str) -> str:
    return " UNION ALL ".join(f"SELECT *, '{model}' AS model, {n} AS horizon FROM ({template(n)})" for n in AHEAD)


_MARKET = "(SELECT date, close AS px FROM market)"
_PX = "(SELECT entity, date, adj AS px FROM adjusted)"

_FE = ("y", "x", "o0", "o1", "o2", "o3", "o4")

CTE = {
    "trades": "SELECT p_brand AS entity, l.* FROM lineitem l JOIN part ON l_partkey = p_partkey",
    "prices": "SELECT entity, substr(entity, 7, 1) AS industry, l_shipdate::DATE AS date, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / 100.0::DOUBLE / sum(l_quantity) AS close, sum(l_quantity) AS volume, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / 100.0::DOUBLE AS money, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM trades GROUP BY 1, 2, 3",
    "market": "SELECT date, sum(cents)::BIGINT / 100.0::DOUBLE / sum(volume) AS close FROM prices GROUP BY date",
    "weekly": "SELECT entity, (date_trunc('week', o_orderdate::DATE + INTERVAL 1 DAY) - INTERVAL 1 DAY)::DATE AS start, count(*)::DOUBLE AS svi FROM trades JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "annotated": "SELECT *, start + 6 AS period_end, start + 14 AS available_at, start + 14 AS signal_date FROM weekly",
    "rolled_svi": f"SELECT *, {_roll('avg(svi)', 52, 26, 'svi', 'start')} AS ma52, {_roll('stddev_samp(svi)', 52, 26, 'svi', 'start')} AS std52, {_roll('count(svi)', 52, 26, '*', 'start')} AS window_n FROM annotated",
    "attention": "SELECT *, svi / nullif(ma52, 0) - 1 AS shock, (svi - ma52) / nullif(std52, 0) AS z FROM rolled_svi",
    "dividends": "SELECT entity, date AS ex_date, before_price, before_price * 0.97::DOUBLE AS after_price FROM (SELECT entity, date, lag(close) OVER w AS before_price, lag(date) OVER w AS previous FROM prices WINDOW w AS (PARTITION BY entity ORDER BY date)) WHERE before_price IS NOT NULL AND year(date) <> year(previous)",
    "adjusted": "SELECT p.*, close * coalesce(product(f) OVER (PARTITION BY p.entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0) AS adj FROM prices p LEFT JOIN (SELECT entity, ex_date, after_price / before_price AS f FROM dividends) d ON p.entity = d.entity AND p.date = d.ex_date",
    "returns": "SELECT a.*, adj / nullif(lag(adj) OVER (PARTITION BY entity ORDER BY date), 0) - 1 AS ret, m.mkt FROM adjusted a LEFT JOIN (SELECT date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS mkt FROM market) m USING (date)",
    "features0": "SELECT *, " + ", ".join(f"{_roll(agg, n, least, of)} AS {name}" for name, agg, n, least, of in (
        ("vol_ma20", "avg(volume)", 20, 10, "volume"), ("vol_ma60", "avg(volume)", 60, 30, "volume"), ("cents20", "sum(cents)", 20, 10, "cents"), ("n20", "count(cents)", 20, 10, "cents"), ("volatility_20", "stddev_samp(ret)", 20, 10, "ret"), ("volatility_60", "stddev_samp(ret)", 60, 30, "ret"),
        ("high60", "max(adj)", 60, 30, "adj"), ("cov", "covar_samp(ret, mkt)", 130, 65, "CASE WHEN ret IS NOT NULL AND mkt IS NOT NULL THEN 1 END"), ("var", "var_samp(mkt)", 130, 65, "mkt"))) + " FROM returns",
    "features1": "SELECT *, cents20::BIGINT / (n20 * 100.0::DOUBLE) AS turnover_ma20, cov / nullif(var, 0) AS beta, adj / nullif(high60, 0) - 1 AS drawdown FROM features0",
    "features": f"SELECT *, {_roll('min(drawdown)', 60, 30, 'drawdown')} AS max_drawdown FROM features1",
    "signals0": "SELECT a.*, signal_date AS week, d.date AS first_tradeable_at FROM attention a ASOF JOIN prices d ON a.entity = d.entity AND a.signal_date <= d.date WHERE ma52 IS NOT NULL",
    "signals": "SELECT s.*, d.date AS feature_date, first_tradeable_at AS return_start, period_end AS z_window_end FROM signals0 s ASOF JOIN prices d ON s.entity = d.entity AND s.first_tradeable_at > d.date",
    "past_long": f"SELECT s.entity, s.week, n, CASE WHEN feature_date > d.date THEN p.px / nullif(d.px, 0) - 1 END AS r FROM (SELECT *, unnest([1, 4, 8, 12, 26]) AS n FROM signals) s JOIN {_PX} p ON p.entity = s.entity AND p.date = s.feature_date ASOF LEFT JOIN {_PX} d ON s.entity = d.entity AND s.feature_date - 7 * n >= d.date",
    "past": f"SELECT entity, week, {_wide(r('r', 4), 'past_{}w', PAST)} FROM past_long GROUP BY 1, 2",
    "skip": f"SELECT s.entity, s.week, CASE WHEN a.date > b.date THEN a.px / nullif(b.px, 0) - 1 END AS r FROM signals s ASOF LEFT JOIN {_PX} a ON s.entity = a.entity AND s.feature_date - 28 >= a.date ASOF LEFT JOIN {_PX} b ON s.entity = b.entity AND s.feature_date - 364 >= b.date",
    "mkt1": f"SELECT s.entity, s.week, CASE WHEN a.date > b.date THEN a.px / nullif(b.px, 0) - 1 END AS m FROM signals s ASOF LEFT JOIN {_MARKET} a ON s.feature_date >= a.date ASOF LEFT JOIN {_MARKET} b ON a.date - 7 >= b.date",
    "excess": f"SELECT *, {r('weekly_return - market_weekly_return', 4)} AS weekly_excess FROM (SELECT l.entity, l.week, {r('l.r', 4)} AS weekly_return, {r('m.m', 4)} AS market_weekly_return FROM past_long l JOIN mkt1 m ON l.entity = m.entity AND l.week = m.week WHERE n = 1)",
    "ahead_long": f"SELECT s.entity, s.week, n, e.date AS e, CASE WHEN e.date > s.first_tradeable_at THEN e.px / nullif(p.px, 0) - 1 END AS r, CASE WHEN me.date > ms.date THEN me.px / nullif(ms.px, 0) - 1 END AS m FROM (SELECT *, unnest([1, 2, 4]) AS n FROM signals) s JOIN {_PX} p ON p.entity = s.entity AND p.date = s.first_tradeable_at ASOF LEFT JOIN {_PX} e ON s.entity = e.entity AND s.first_tradeable_at + 7 * n <= e.date ASOF LEFT JOIN {_MARKET} ms ON s.first_tradeable_at <= ms.date ASOF LEFT JOIN {_MARKET} me ON ms.date + 7 * n <= me.date",
    "ahead": f"SELECT entity, week, {_wide('e', 'return_end_{}w', AHEAD)}, {_wide(r('r', 4), 'future_{}w', AHEAD)}, {_wide(r('r - m', 4), 'future_excess_{}w', AHEAD)} FROM ahead_long GROUP BY 1, 2",
    "panel0": f"""SELECT s.entity, f.industry, s.week, start, period_end, available_at, signal_date, first_tradeable_at, feature_date, return_start, z_window_end, date_diff('day', start, available_at)::INT AS lag_days, window_n, svi,
{r('ma52', 3)} AS ma52, {r('std52', 3)} AS std52, {r('shock', 4)} AS shock, {r('z', 4)} AS z, coalesce(z > 2, false) AS is_event_z2, coalesce(shock > 1, false) AS is_event_ratio,
weekly_return, market_weekly_return, weekly_excess, {r('k.r', 4)} AS past_52w_skip4w, past.* EXCLUDE (entity, week), ahead.* EXCLUDE (entity, week),
{r('CASE WHEN vol_ma20 > 0 THEN volume / vol_ma20 END', 4)} AS volume_ratio_4w, {r('CASE WHEN vol_ma60 > 0 THEN volume / vol_ma60 END', 4)} AS volume_ratio_12w, {r('turnover_ma20', 0)} AS turnover, {r('money', 0)} AS trading_value, {r('volatility_20', 4)} AS volatility_4w, {r('volatility_60', 4)} AS volatility_12w, {r('beta', 4)} AS beta_26w, {r('max_drawdown', 4)} AS max_drawdown_12w
FROM signals s JOIN excess x ON s.entity = x.entity AND s.week = x.week JOIN skip k ON s.entity = k.entity AND s.week = k.week JOIN past ON s.entity = past.entity AND s.week = past.week JOIN ahead ON s.entity = ahead.entity AND s.week = ahead.week JOIN features f ON s.entity = f.entity AND s.feature_date = f.date""",
    "panel": "SELECT *, CASE WHEN turnover IS NOT NULL THEN rank() OVER (PARTITION BY week ORDER BY turnover DESC NULLS LAST) + (count(*) OVER (PARTITION BY week, turnover) - 1) / 2.0 END AS liquidity_rank FROM panel0",
    "flow_days": "SELECT entity, l_shipdate::DATE AS date, " + ", ".join(f"sum(CASE WHEN l_returnflag = '{k}' THEN CASE WHEN l_linestatus = 'O' THEN l_quantity WHEN l_linestatus = 'F' THEN -l_quantity ELSE 0 END ELSE 0 END) AS {v}_net" for k, v in (("A", "foreign"), ("N", "trust"), ("R", "dealer"))) + ", sum(CASE WHEN l_linestatus = 'O' THEN l_quantity WHEN l_linestatus = 'F' THEN -l_quantity ELSE 0 END) AS total_net FROM trades GROUP BY 1, 2",
    "flow_rolled": "SELECT f.*, " + ", ".join(f"{_roll(f'sum({c})', n, least, c)} AS {c}_{w}" for c in ("foreign_net", "trust_net", "dealer_net", "total_net", "volume") for n, least, w in ((5, 3, "1w"), (20, 10, "4w"))) + " FROM (SELECT f.*, volume FROM flow_days f LEFT JOIN prices p USING (entity, date)) f",
    "panel_flow": "SELECT k.entity, k.week, " + ", ".join(f"{n}_net_1w AS {n}_value_1w, {n}_net_4w AS {n}_value_4w, {n}_net_1w / nullif(volume_1w, 0) AS {n}_ratio_1w, {n}_net_4w / nullif(volume_4w, 0) AS {n}_ratio_4w, {n}_net_4w * p.close AS {n}_money_4w" for n in ("foreign", "trust", "dealer", "total")) + " FROM panel k ASOF JOIN flow_rolled f ON k.entity = f.entity AND k.feature_date >= f.date ASOF LEFT JOIN prices p ON k.entity = p.entity AND k.feature_date >= p.date",
    "panel4": "SELECT k.*, f.* EXCLUDE (entity, week) FROM panel k LEFT JOIN panel_flow f ON k.entity = f.entity AND k.week = f.week",
    "flagged": "SELECT p.*, coalesce(z > cut, false) AS is_event_top FROM panel p JOIN (SELECT week, quantile_cont(z, 0.9) AS cut FROM panel GROUP BY week) USING (week)",
    "top_events": "SELECT entity, week, z, return_start, row_number() OVER (PARTITION BY entity ORDER BY week) AS i FROM flagged WHERE is_event_top",
    "kept": "SELECT e.* EXCLUDE (i) FROM top_events e JOIN kept_weeks k ON e.entity = k.entity AND e.week = k.kept",
    "kept_weeks": "SELECT DISTINCT entity, kept FROM fold WHERE kept = week",
    "fold": "SELECT entity, week, i, week AS kept FROM top_events WHERE i = 1 UNION ALL SELECT t.entity, t.week, t.i, CASE WHEN date_diff('day', f.kept, t.week) >= 28 THEN t.week ELSE f.kept END FROM fold f JOIN top_events t ON t.entity = f.entity AND t.i = f.i + 1",
    "kept_all": "SELECT k.definition, k.entity, k.week, f.return_start, row_number() OVER (PARTITION BY k.definition ORDER BY k.entity, k.week) - 1 AS event_id FROM (SELECT DISTINCT definition, entity, week FROM fold_all WHERE kept = week) k JOIN flagged f ON f.entity = k.entity AND f.week = k.week",
    "all_events": "SELECT definition, entity, week, row_number() OVER (PARTITION BY definition, entity ORDER BY week) AS i FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS definition, entity, week FROM flagged WHERE is_event_{d}" for d in ("z2", "ratio", "top")) + ")",
    "fold_all": "SELECT definition, entity, week, i, week AS kept FROM all_events WHERE i = 1 UNION ALL SELECT t.definition, t.entity, t.week, t.i, CASE WHEN date_diff('day', f.kept, t.week) >= 28 THEN t.week ELSE f.kept END FROM fold_all f JOIN all_events t ON t.definition = f.definition AND t.entity = f.entity AND t.i = f.i + 1",
    "days": "SELECT p.entity, p.date, p.close, m.close AS mclose FROM prices p JOIN market m USING (date)",
    "numbered": "SELECT *, row_number() OVER (ORDER BY entity, week) - 1 AS event_id FROM (SELECT DISTINCT entity, week, return_start FROM kept_all)",
    "after": "SELECT e.event_id, e.entity, e.week, o AS \"offset\", a.date AS s, b.date AS e FROM (SELECT *, unnest(generate_series(1, 8)) AS o FROM numbered) e ASOF JOIN days a ON e.entity = a.entity AND e.return_start + (7 * (o - 1))::INT <= a.date ASOF JOIN days b ON e.entity = b.entity AND e.return_start + (7 * o)::INT <= b.date",
    **{f"hop{k}": (f"SELECT e.*, d.date AS t0 FROM numbered e ASOF LEFT JOIN days d ON e.entity = d.entity AND e.return_start > d.date" if k == 0 else f"SELECT e.*, d.date AS t{k} FROM hop{k - 1} e ASOF LEFT JOIN days d ON e.entity = d.entity AND e.t{k - 1} - 7 >= d.date") for k in range(6)},
    "before": " UNION ALL ".join(f"SELECT event_id, entity, week, {-k} AS \"offset\", t{k + 1} AS s, t{k} AS e FROM hop5" for k in range(5)),
    "windows0": "SELECT w.*, b.close / nullif(a.close, 0) - 1 AS stock_return, b.mclose / nullif(a.mclose, 0) - 1 AS market_return FROM (SELECT * FROM after UNION ALL SELECT * FROM before) w JOIN days a ON w.entity = a.entity AND w.s = a.date JOIN days b ON w.entity = b.entity AND w.e = b.date WHERE w.e > w.s",
    "window_rows": "SELECT *, stock_return - market_return AS ar FROM windows0 WHERE stock_return - market_return IS NOT NULL",
    "windows_all": "SELECT k.definition, k.event_id, w.* EXCLUDE (event_id) FROM window_rows w JOIN kept_all k ON w.entity = k.entity AND w.week = k.week",
    "event_windows": "SELECT * EXCLUDE (definition) FROM windows_all WHERE definition = 'top'",
    "cars": "SELECT *, sum(ar) OVER w AS car, CASE WHEN \"offset\" >= 1 THEN sum(CASE WHEN \"offset\" >= 1 THEN ar END) OVER w END AS car_signal FROM windows_all WINDOW w AS (PARTITION BY definition, event_id ORDER BY \"offset\")",
    "final_cars": "SELECT definition, event_id, entity, week, car_signal AS car FROM cars JOIN (SELECT definition, max(\"offset\") AS last FROM windows_all WHERE \"offset\" >= 1 GROUP BY 1) USING (definition) WHERE \"offset\" = last",
    "final_car": "SELECT * EXCLUDE (definition) FROM final_cars WHERE definition = 'top'",
    "event_tests": f"""SELECT r.definition, n_raw, n_kept, n_stocks, max_same_week, c.mean, c.n, c.t, c.std, {_student('c.t', '(c.n - 1)')} AS p, h.n AS n_calendar_weeks, h.t AS t_clustered, {_student('h.t', '(h.n - 1)')} AS p_clustered
FROM (SELECT definition, count(*) AS n_raw FROM all_events GROUP BY 1) r JOIN (SELECT definition, count(*) AS n_kept, count(DISTINCT entity) AS n_stocks, max(same) AS max_same_week FROM (SELECT *, count(*) OVER (PARTITION BY definition, week) AS same FROM kept_all) GROUP BY 1) k USING (definition)
JOIN (SELECT definition, avg(car) AS mean, count(car) AS n, avg(car) / nullif(stddev_samp(car) / sqrt(count(car)), 0) AS t, stddev_samp(car) AS std FROM final_cars GROUP BY 1) c USING (definition)
JOIN {_hac('(SELECT definition, week, avg(car) AS car FROM final_cars GROUP BY 1, 2)', 'definition', 'car')} h USING (definition)""",
    "fm": _models("panel", {"M1": [], "M2": list(CTRL[:2]), "M3": list(CTRL[:4]), "M4": list(CTRL)}, effects={"M4": "industry"}),
    "flow_fm": _models("panel4", {"A": list(CTRL[:2]), "B": [*CTRL[:2], "total_ratio_4w"], "C": [*CTRL[:2], "foreign_ratio_4w", "trust_ratio_4w", "dealer_ratio_4w"], "D": [*CTRL[:2], "total_ratio_4w", "volume_ratio_4w", "volatility_12w"],
        "flow_shares": [*CTRL[:2], "total_value_4w"], "flow_money": [*CTRL[:2], "total_money_4w"], "flow_ratio": [*CTRL[:2], "total_ratio_4w"]}),
    "inter": " UNION ALL ".join(_models("(SELECT *, z * past_4w AS z_x_past, z * total_ratio_4w AS z_x_flow FROM panel4)", {t: [o for o in ("z", "past_4w", "past_12w", "total_ratio_4w", "z_x_past", "z_x_flow") if o != t]}, t, label="term") for t in ("z", "total_ratio_4w", "z_x_past", "z_x_flow")),
    "canonical": _models("panel", {"baseline": [], **{f"z + {x}": [x] for x in ("past_4w", "past_12w", "past_26w", "past_52w_skip4w", "past_1w")}}),
    "winsor": " UNION ALL ".join(f"SELECT p.* EXCLUDE (z), 'winsor_{t}' AS model, {'z' if t == '0.0' else f'CASE WHEN z IS NOT NULL THEN greatest(least(z, (SELECT quantile_cont(z, 1 - {t}) FROM panel)), (SELECT quantile_cont(z, {t}) FROM panel)) END'} AS z FROM panel p" for t in ("0.0", "0.01", "0.05")),
    "winsor_fm": " UNION ALL ".join(f"SELECT *, '{m}' AS model, {n} AS horizon FROM ({_slope(f'(SELECT * FROM winsor WHERE model = {chr(39)}{m}{chr(39)})', f'future_excess_{n}w')})" for m in ("winsor_0.0", "winsor_0.01", "winsor_0.05") for n in AHEAD),
    "fe_rows": "SELECT model, horizon, entity, week, y::DOUBLE AS y, z::DOUBLE AS x, " + ", ".join(f"{c}::DOUBLE AS o{i}" for i, c in enumerate(CTRL)) + " FROM (" + " UNION ALL ".join([*[f"SELECT 'M5' AS model, {n} AS horizon, entity, week, future_excess_{n}w AS y, z, {', '.join(CTRL)} FROM panel" for n in AHEAD], f"SELECT model, 4 AS horizon, entity, week, future_excess_4w AS y, z, {', '.join(CTRL)} FROM winsor"]) + ") WHERE y IS NOT NULL AND z IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in CTRL),
    "fe_it": "SELECT 0 AS it, * FROM fe_rows UNION ALL SELECT it + 1, model, horizon, entity, week, " + ", ".join(f"{v} - avg({v}) OVER (PARTITION BY model, horizon, entity) AS {v}" for v in _FE) + " FROM (SELECT it, model, horizon, entity, week, " + ", ".join(f"{v} - avg({v}) OVER (PARTITION BY model, horizon, week) AS {v}" for v in _FE) + " FROM fe_it WHERE it < 40)",
    "fe": f"""SELECT model, horizon, coef, sqrt(meat) / sxx * sqrt(g / (g - 1.0) * (n - 1.0) / (n - (1 + {1 + len(CTRL)} + s - 1 + g - 1))) AS se, n, 1 - ssr / (vary * n) AS r2 FROM (
SELECT model, horizon, any_value(coef) AS coef, sum(score * score) AS meat, sum(sxx) AS sxx, sum(ssr) AS ssr, count(*) AS g FROM (
SELECT model, horizon, week, any_value(b) AS coef, sum(x * (y - b * x)) AS score, sum(x * x) AS sxx, sum((y - b * x) * (y - b * x)) AS ssr FROM (
SELECT *, sum(x * y) OVER (PARTITION BY model, horizon) / sum(x * x) OVER (PARTITION BY model, horizon) AS b FROM {_project("(SELECT model, horizon, entity, week, 1.0::DOUBLE AS low, " + ", ".join(f"{v}, {v} AS {v}_raw" for v in _FE) + " FROM fe_it WHERE it = 40)", ["x", "y"], [f"o{i}" for i in range(len(CTRL))], "model, horizon", "model, horizon, entity, week")})
GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN (SELECT model, horizon, count(*) AS n, count(DISTINCT entity) AS s, var_pop(y) AS vary FROM fe_rows GROUP BY 1, 2) USING (model, horizon)""",
    "fe_tests": f"SELECT model, horizon, coef, se, coef / se AS t, n, r2, NULL::VARCHAR AS note, {_normal('coef / se')} AS p FROM fe",
    "residuals": "SELECT week, entity, y AS residual_z FROM (" + f"SELECT week, entity, y, low, count(*) OVER (PARTITION BY week) AS n FROM {_project('(SELECT week, entity, 1.0::DOUBLE AS low, ' + ', '.join(f'{k} - avg({k}) OVER (PARTITION BY week) AS {k}, {k} - avg({k}) OVER (PARTITION BY week) AS {k}_raw' for k in ('y', *[f'o{i}' for i in range(len(CTRL))])) + ' FROM (SELECT week, entity, z::DOUBLE AS y, ' + ', '.join(f'{c}::DOUBLE AS o{i}' for i, c in enumerate(CTRL)) + ' FROM panel WHERE z IS NOT NULL AND ' + ' AND '.join(f'{c} IS NOT NULL' for c in CTRL) + '))', ['y'], [f'o{i}' for i in range(len(CTRL))], 'week', 'week, entity')}" + f") WHERE n >= {1 + len(CTRL) + 5} AND low > 1e-13",
    "residual_panel": "SELECT p.*, residual_z FROM panel p LEFT JOIN residuals r ON p.entity = r.entity AND p.week = r.week",
    "residual_ics": _each(lambda n: _ic("residual_panel", "residual_z", f"future_excess_{n}w"), "residual_z"),
    "momentum": _tercile("panel", "past_4w", ("loser", "middle", "winner"), "momentum"),
    "double": _tercile("momentum", "z", ("low", "mid", "high"), "attention"),
    "m1": _slope("panel", "future_excess_4w"),
    "m1_all": _each(lambda n: _slope("panel", f"future_excess_{n}w"), "M1"),
    "ic_all": _each(lambda n: _ic("panel", "z", f"future_excess_{n}w"), "z"),
    "shock_all": _each(lambda n: _ic("panel", "shock", f"future_excess_{n}w"), "shock"),
    "placebo_panel": "SELECT *, lag(future_excess_1w) OVER (PARTITION BY entity ORDER BY week) AS placebo FROM panel",
    "prior": f"SELECT p.*, CASE WHEN a.date > b.date THEN a.px / nullif(b.px, 0) - 1 END AS prior FROM panel p ASOF LEFT JOIN {_PX} a ON p.entity = a.entity AND p.start - 1 > a.date ASOF LEFT JOIN {_PX} b ON p.entity = b.entity AND a.date - 7 >= b.date",
    "tests": "SELECT family, test, horizon, p FROM (SELECT 'event_study_caar' AS family, definition AS test, 8 AS horizon, p_clustered AS p FROM event_tests UNION ALL SELECT 'fama_macbeth', model, horizon, p FROM (" + _fm("fm", "model, horizon", "panel") + ") UNION ALL SELECT 'fama_macbeth', model, horizon, p FROM fe_tests WHERE model = 'M5' UNION ALL SELECT 'interaction_model', term, horizon, p FROM (" + _fm("inter", "term, horizon", "panel4") + "))",
    "pooled": "SELECT family, test, horizon, p, least(1.0, min(a) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_fdr FROM (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS a, row_number() OVER (ORDER BY p) AS k FROM tests)",
    "batch": "SELECT entity, floor((row_number() OVER (ORDER BY entity) - 1) / 4)::BIGINT AS batch FROM (SELECT DISTINCT entity FROM weekly WHERE entity <> 'Brand#11')",
}

_ASKED, _EARLIER = ("sha256('{\"availability_policy\":\"start+%dd\",\"geo\":\"TW\",\"timeframe\":\"today 5-y\"}')" % d for d in (14, 7))
CTE |= {
    "collected": f"SELECT w.entity, batch, batch + 1.0::DOUBLE AS scale_factor, 'today 5-y' AS timeframe, 'TW' AS geo, 'start+14d' AS availability_policy, {_ASKED} AS request_sha256, min(start) AS date_start, max(start) + 6 AS date_end, max(start) + 14 AS available_at_end, count(*) AS n_rows, sha256(w.entity || '|' || count(*) || '|' || sum(svi)::BIGINT) AS file_sha256, '' AS error FROM weekly w JOIN batch b ON w.entity = b.entity GROUP BY w.entity, batch",
    "spoilt": f"SELECT * REPLACE (CASE WHEN entity NOT IN ('Brand#13', 'Brand#14') THEN scale_factor END AS scale_factor, CASE WHEN entity = 'Brand#13' THEN 'timeout' ELSE error END AS error, CASE WHEN entity IN ('Brand#15', 'Brand#21') THEN 'start+7d' ELSE availability_policy END AS availability_policy, CASE WHEN entity <> 'Brand#21' THEN geo END AS geo, CASE WHEN entity = 'Brand#22' THEN {_EARLIER} ELSE request_sha256 END AS request_sha256, CASE WHEN entity = 'Brand#23' THEN '0' ELSE file_sha256 END AS file_sha256) FROM collected WHERE entity <> 'Brand#12'",
    "rounds": f"SELECT *, 1 AS collected_at FROM collected UNION ALL SELECT * REPLACE (NULL AS scale_factor, NULL AS date_start, NULL AS date_end, NULL AS available_at_end, 0 AS n_rows, NULL AS file_sha256, 'timeout' AS error), 2 FROM collected WHERE batch % 2 = 0 UNION ALL SELECT *, 3 FROM collected WHERE batch % 4 = 0",
}

_T = "avg({0}) AS mean, count({0}) AS n, CASE WHEN count({0}) > 1 THEN avg({0}) / nullif(stddev_samp({0}) / sqrt(count({0})), 0) END AS t"
_RULES = {
    "r01_start_not_sunday": "coalesce(dayofweek(start) <> 0, true)", "r02_period_end": "coalesce(period_end <> start + 6, true)", "r03_available_early": "available_at < start + 14", "r04_signal_before_available": "signal_date < available_at",
    "r05_traded_before_signal": "first_tradeable_at < signal_date", "r06_feature_not_before_trade": "feature_date >= first_tradeable_at", "r07_return_before_trade": "return_start < first_tradeable_at", "r08_return_in_period": "return_start <= period_end", "r09_z_window_late": "z_window_end > period_end",
    **{f"r10_return_end_{n}w": f"return_end_{n}w < return_start + {7 * n}" for n in AHEAD},
}
_count_rules = lambda source: " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({v}) AS n FROM {source}" for k, v in _RULES.items())
_summary = lambda ic: f"SELECT h.*, mean / nullif(std, 0) AS icir, positive_share, {_student('t', '(n - 1)')} AS p FROM {_hac(ic, 'model, horizon', 'ic')} h JOIN (SELECT model, horizon, avg((ic > 1e-9)::INT::DOUBLE) AS positive_share FROM {ic} GROUP BY 1, 2) USING (model, horizon)"
FINAL = {
    "weekly_svi": "SELECT entity, start, svi FROM weekly",
    "svi_annotated": "SELECT entity, start, svi, period_end, available_at, signal_date FROM annotated",
    "attention_features": "SELECT entity, start, svi, ma52, std52, window_n, shock, z FROM attention",
    "contract_violations": _count_rules("panel"),
    "contract_violations_broken": _count_rules("(SELECT * REPLACE (CASE WHEN date_diff('day', DATE '1970-01-04', week) % 49 = 0 THEN first_tradeable_at - 20 ELSE first_tradeable_at END AS first_tradeable_at) FROM panel)"),
    "trading_spine": "SELECT s.entity, s.day, b.date AS at_or_before, c.date AS strictly_before, a.date AS at_or_after FROM (SELECT entity, unnest(generate_series(min(date) - INTERVAL 450 DAY, max(date) + INTERVAL 450 DAY, INTERVAL 1 DAY))::DATE AS day FROM prices GROUP BY entity) s ASOF LEFT JOIN prices b ON s.entity = b.entity AND s.day >= b.date ASOF LEFT JOIN prices c ON s.entity = c.entity AND s.day > c.date ASOF LEFT JOIN prices a ON s.entity = a.entity AND s.day <= a.date",
    **{name: f"SELECT a.entity, a.start, a.signal_date, d.date AS found FROM attention a ASOF LEFT JOIN prices d ON a.entity = d.entity AND a.signal_date {op} d.date" for name, op in (("asof_backward", ">="), ("asof_forward", "<="), ("asof_strict", ">"))},
    "trailing_returns": "SELECT * FROM past",
    "skip_momentum": "SELECT * FROM skip",
    "forward_returns": "SELECT * FROM ahead",
    "excess_returns": "SELECT entity, week, weekly_return, market_weekly_return, weekly_excess FROM panel",
    "dividend_events": "SELECT * FROM dividends",
    "price_adjusted": "SELECT entity, date, close, adj FROM adjusted",
    "pct_change": "SELECT entity, date, ret, mkt FROM features",
    "rolling_liquidity": "SELECT entity, date, vol_ma20, vol_ma60, turnover_ma20 FROM features",
    "rolling_volatility": "SELECT entity, date, volatility_20, volatility_60 FROM features",
    "max_drawdown": "SELECT entity, date, drawdown, max_drawdown FROM features",
    "rolling_beta": "SELECT entity, date, beta FROM features",
    "panel_v03": "SELECT * EXCLUDE (signal_date, return_start, z_window_end) FROM panel",
    "liquidity_rank": "SELECT entity, week, turnover, liquidity_rank FROM panel",
    "coverage_manifest": "SELECT entity, coalesce(n_rows, 0) AS n_rows, coalesce(n_forward, 0) AS n_forward, CASE WHEN n_rows IS NULL THEN 'blocked_panel_build_error' WHEN n_rows < 26 THEN 'blocked_insufficient_history' WHEN n_forward < 26 THEN 'blocked_insufficient_forward_history' ELSE 'accepted' END AS status FROM (SELECT DISTINCT entity FROM weekly) LEFT JOIN (SELECT entity, count(*) AS n_rows, count(future_4w) AS n_forward FROM panel GROUP BY entity) USING (entity)",
    "panel_provenance": "SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_entities, min(week) AS first_week, max(week) AS last_week FROM panel",
    "panel_summary": "SELECT industry, count(*) AS n, count(DISTINCT entity) AS entities, min(week) AS first_week, max(week) AS last_week, min(z) AS z_min, max(z) AS z_max FROM panel GROUP BY industry",
    "flow_pivot": "SELECT * FROM flow_days",
    "flow_rolling": "SELECT * EXCLUDE (foreign_net, trust_net, dealer_net, total_net, volume) FROM flow_rolled",
    "panel_v04": "SELECT p.entity, p.week, f.* EXCLUDE (entity, week) FROM panel p LEFT JOIN panel_flow f ON p.entity = f.entity AND p.week = f.week",
    "flow_coverage": "SELECT entity, date_start, date_end, n_days, usable_weeks, weeks, 1 - usable_weeks::DOUBLE / weeks AS missing_rate FROM (SELECT entity, min(date) AS date_start, max(date) AS date_end, count(*) AS n_days FROM flow_days GROUP BY 1) LEFT JOIN (SELECT entity, count(total_ratio_4w) AS usable_weeks, count(*) AS weeks FROM panel4 GROUP BY 1) USING (entity)",
    "flow_correlation": " UNION ALL ".join(f"SELECT '{n}' AS name, corr(z, {n}_ratio_4w) AS r, count(*) FILTER (z IS NOT NULL AND {n}_ratio_4w IS NOT NULL) AS n FROM panel4" for n in ("foreign", "trust", "dealer", "total")),
    "event_flags": "SELECT entity, week, is_event_z2, is_event_ratio, is_event_top FROM flagged",
    "top_decile_events": "SELECT entity, week, z FROM top_events",
    "nonoverlap_events": "SELECT entity, week, z FROM kept",
    "calendar_clustering": "SELECT entity, week, count(*) OVER (PARTITION BY week) AS same_week FROM kept",
    "event_windows": "SELECT event_id, entity, week, \"offset\", s AS start_day, e AS end_day, stock_return, market_return, ar FROM event_windows",
    "caar_by_offset": "SELECT \"offset\", avg(ar) AS aar, avg(car) AS caar, avg(car_signal) AS caar_from_signal, count(car) AS n_events, CASE WHEN count(ar) > 1 THEN avg(ar) / nullif(stddev_samp(ar) / sqrt(count(ar)), 0) END AS aar_t FROM cars WHERE definition = 'top' GROUP BY 1",
    "caar_by_definition": "SELECT definition, \"offset\", avg(ar) AS aar, avg(car) AS caar, avg(car_signal) AS caar_from_signal, count(car) AS n_events, CASE WHEN count(ar) > 1 THEN avg(ar) / nullif(stddev_samp(ar) / sqrt(count(ar)), 0) END AS aar_t FROM cars GROUP BY 1, 2",
    "event_summary": "SELECT * FROM event_tests",
    "event_pvalues": "SELECT definition, mean, n, t, p FROM event_tests",
    "fm_weekly_controls": "SELECT * FROM fm WHERE model IN ('M2', 'M3')",
    "fm_weekly_industry": "SELECT * FROM fm WHERE model = 'M4'",
    "fm_summary": _fm("fm", "model, horizon", "panel"),
    "bootstrap_ci": "WITH v AS (SELECT definition, car, row_number() OVER (PARTITION BY definition ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY definition) AS n FROM final_cars WHERE car IS NOT NULL), d AS (SELECT definition, i, ('0x' || substr(md5('42 ' || i || ' ' || k), 1, 12))::BIGINT % n AS k FROM v, range(2000) r(i)), m AS (SELECT definition, i, avg(car) AS mean FROM d JOIN v USING (definition, k) GROUP BY 1, 2) SELECT definition, CASE WHEN any_value(n) >= 2 THEN quantile_cont(mean, 0.025) END AS low, CASE WHEN any_value(n) >= 2 THEN quantile_cont(mean, 0.975) END AS high FROM m JOIN (SELECT definition, count(*) AS n FROM v GROUP BY 1) USING (definition) GROUP BY 1",
    "fm_skipped_weeks": _skipped("(SELECT * REPLACE (CASE WHEN z > 0.5 THEN z END AS z) FROM panel)", {"M1": ["z"], "M2": ["z", *CTRL[:2]]}, {}),
    "fm_interaction": "SELECT *, 'E' AS model FROM inter",
    "interaction_summary": _fm("inter", "horizon, term", "panel4"),
    "flow_regressions": "SELECT * FROM flow_fm WHERE model NOT LIKE 'flow_%'",
    "flow_summary": _fm("(SELECT * FROM flow_fm WHERE model NOT LIKE 'flow_%')", "model, horizon", "panel4"),
    "flow_scaling": _fm("(SELECT * FROM flow_fm WHERE model LIKE 'flow_%')", "model, horizon", "panel4"),
    "fm_summary_pvalues": f"SELECT *, {_student('t', '(n - 1)')} AS p, {_student('t', '(n - 1)')} < 0.05 AS significant FROM " + _hac("m1_all", "model, horizon", "coef"),
    "canonical_momentum": _fm("canonical", "model, horizon", "panel"),
    "residual_attention": "SELECT entity, week, residual_z FROM residual_panel",
    "residual_ic": _summary("residual_ics"),
    "two_way_fe": "SELECT * FROM fe_tests WHERE model = 'M5'",
    "winsorized_fe": "SELECT * FROM fe_tests WHERE model <> 'M5'",
    "regression_with_fdr": "SELECT f.model, f.horizon, f.mean, f.t, p_fdr, p_fdr <= 0.1 AS reject_10, 1.96 * abs(f.mean) / abs(f.t) AS half_width FROM (" + _fm("fm", "model, horizon", "panel") + ") f JOIN pooled q ON q.family = 'fama_macbeth' AND q.test = f.model AND q.horizon = f.horizon",
    "events_with_fdr": "SELECT e.definition, e.mean, e.t_clustered, p_fdr, p_fdr <= 0.1 AS reject_10, p_fdr <= 0.05 AS reject_05 FROM event_tests e LEFT JOIN pooled q ON q.family = 'event_study_caar' AND q.test = e.definition",
    "manifest_entries": "SELECT entity, CASE WHEN n_weeks < 26 THEN 'error' ELSE 'ok' END AS status, n_weeks, first_week, last_week, CASE WHEN n_weeks < 26 THEN 'series too short' END AS error, sha256('{\"geo\":\"TW\",\"timeframe\":\"today 5-y\"}') AS request_sha256 FROM (SELECT entity, count(*) AS n_weeks, min(start) AS first_week, max(start) AS last_week FROM weekly GROUP BY 1)",
    "event_ttest": f"SELECT {_T.format('car')} FROM final_car",
    "car_date_clustered": "SELECT * FROM " + _hac("(SELECT week, avg(car) AS car FROM final_car GROUP BY week)", "", "car"),
    "weekly_terciles": "SELECT entity, week, momentum, attention FROM double",
    "double_sort": "SELECT momentum, attention, " + ", ".join(f"avg({v}) AS {v}_mean, stddev_samp({v}) AS {v}_std, count({v}) AS {v}_count, stddev_samp({v}) / sqrt(nullif(count({v}), 0)) AS {v}_se" for v in (f"future_excess_{n}w" for n in AHEAD)) + " FROM double WHERE momentum IS NOT NULL AND attention IS NOT NULL GROUP BY 1, 2",
    "double_sort_heatmap": "SELECT momentum, " + ", ".join(f"avg(CASE WHEN attention = '{a}' THEN future_excess_4w END) AS {a}" for a in ("low", "mid", "high")) + " FROM double WHERE momentum IS NOT NULL AND attention IS NOT NULL GROUP BY 1",
    "triple_sort": "SELECT momentum, attention, flow, " + ", ".join(f"avg(future_excess_{n}w) AS mean_{n}w, count(future_excess_{n}w) AS count_{n}w" for n in AHEAD) + " FROM (" + _tercile("(SELECT d.*, total_ratio_4w FROM double d JOIN panel4 p ON d.entity = p.entity AND d.week = p.week)", "total_ratio_4w", ("sell", "neutral", "buy"), "flow").replace("SELECT s.*,", "SELECT s.*,", 1) + ") WHERE momentum IS NOT NULL AND attention IS NOT NULL AND flow IS NOT NULL GROUP BY 1, 2, 3",
    "fm_weekly_m1": "SELECT * FROM m1",
    "fm_summary_hac": "SELECT * FROM " + _hac("m1_all", "model, horizon", "coef"),
    "ic_weekly": "SELECT * FROM ic_all",
    "ic_summary": _summary("ic_all"),
    "ic_attention_shock": _summary("shock_all"),
    "winsorized_fm": _fm("winsor_fm", "model, horizon", "panel"),
    "subperiod_fm": "WITH mid AS (SELECT list_sort(list(DISTINCT week))[count(DISTINCT week) // 2 + 1] AS mid FROM panel), halves AS (SELECT m1_all.* EXCLUDE (model), CASE WHEN week < mid THEN 'first' ELSE 'second' END AS model FROM m1_all, mid), span AS (SELECT CASE WHEN week < mid THEN 'first' ELSE 'second' END AS model, min(week) AS first_week, max(week) AS last_week FROM panel, mid GROUP BY 1) SELECT h.*, " + _student("t", "(n - 1)") + " AS p, first_week, last_week FROM " + _hac("halves", "model, horizon", "coef") + " h JOIN span USING (model)",
    "placebo_lag": f"SELECT {_T.format('ic')} FROM ({_ic('placebo_panel', 'z', 'placebo')})",
    "placebo_strict": f"SELECT {_T.format('ic')} FROM ({_ic('prior', 'z', 'prior')})",
    "bh_fdr_pooled": "SELECT *, p_fdr <= 0.1 AS reject_10, p_fdr <= 0.05 AS reject_05 FROM pooled",
    "bh_fdr_by_family": "SELECT *, p_fdr <= 0.1 AS reject_10, p_fdr <= 0.05 AS reject_05 FROM (SELECT family, test, horizon, p, least(1.0, min(a) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_fdr FROM (SELECT *, p * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p) AS a, row_number() OVER (PARTITION BY family ORDER BY p) AS k FROM tests))",
    "event_counts": "SELECT definition, raw, kept FROM (SELECT definition, count(*) AS raw FROM all_events GROUP BY 1) JOIN (SELECT definition, count(*) AS kept FROM fold_all WHERE kept = week GROUP BY 1) USING (definition)",
    "rolling_fm_hac": """WITH v AS (SELECT week, coef, row_number() OVER (ORDER BY week) AS i FROM m1),
w AS (SELECT a.week, b.i, b.coef, avg(b.coef) OVER (PARTITION BY a.week) AS mean, 52 AS n, 3 AS lag FROM v a JOIN v b ON b.i BETWEEN a.i - 51 AND a.i WHERE a.i >= 52),
p AS (SELECT x.week, any_value(x.mean) AS mean, sum(CASE WHEN x.i = y.i THEN 1.0 ELSE 2 * (1 - (x.i - y.i)::DOUBLE / 4) END * (x.coef - x.mean) * (y.coef - y.mean)) AS s FROM w x JOIN w y ON x.week = y.week AND y.i BETWEEN x.i - 3 AND x.i GROUP BY x.week)
SELECT week, mean, CASE WHEN s > 0 THEN mean / (sqrt(s) / 52) END AS t FROM p""",
    "event_activity": "SELECT ts::DATE AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2",
    "legacy_diff": "WITH base AS (SELECT entity, avg(past_4w) AS mean_return, count(past_4w)::DOUBLE AS n, avg(z) AS mean_z FROM panel GROUP BY 1), l AS (SELECT * FROM base WHERE entity <> 'Brand#11'), c AS (SELECT entity, mean_return * 0.5::DOUBLE AS mean_return, n FROM base WHERE entity <> 'Brand#55'), u AS (" + " UNION ALL ".join(f"SELECT coalesce(l.entity, c.entity) AS entity, '{m}' AS metric, l.{m} AS legacy, {'c.' + m if m != 'mean_z' else 'NULL::DOUBLE'} AS corrected, CASE WHEN l.entity IS NULL THEN 'blocked_missing_legacy_key' WHEN c.entity IS NULL THEN 'blocked_missing_corrected_key' ELSE '{'compared' if m != 'mean_z' else 'blocked_missing_corrected_metric'}' END AS status FROM l FULL JOIN c ON l.entity = c.entity" for m in ("mean_return", "n", "mean_z")) + ") SELECT *, CASE WHEN status = 'compared' THEN corrected - legacy END AS delta FROM u",
    "comparison_statuses": "WITH base AS (SELECT entity, avg(past_4w) AS mean_return, avg(z) AS mean_z FROM panel GROUP BY 1), wanted AS (SELECT unnest(['mean_return', 'mean_z']) AS m), tables AS (SELECT 'metric' AS name, true AS there, ['entity', 'mean_return'] AS has UNION ALL SELECT 'key', true, ['stock', 'mean_return', 'mean_z'] UNION ALL SELECT 'table', false, [] UNION ALL SELECT 'none', true, ['entity']), keyed AS (SELECT *, there AND list_contains(has, 'entity') AS comparable FROM tables), stopped AS (SELECT name, 'blocked_missing_table' AS status, 'corrected' AS missing FROM keyed WHERE NOT there UNION ALL SELECT name, 'blocked_missing_corrected_key', 'entity' FROM keyed WHERE there AND NOT comparable UNION ALL SELECT name, 'blocked_missing_corrected_metric', m FROM keyed, wanted WHERE comparable AND NOT list_contains(has, m) UNION ALL SELECT name, 'blocked_no_common_metrics', NULL FROM keyed WHERE comparable AND NOT list_has_any(has, ['mean_return', 'mean_z'])), long AS (UNPIVOT base ON mean_return, mean_z INTO NAME m VALUE v), cells AS (SELECT k.name, b.entity, w.m, a.v AS legacy, c.v AS corrected FROM keyed k, base b, wanted w LEFT JOIN long a ON a.entity = b.entity AND a.m = w.m LEFT JOIN long c ON c.entity = b.entity AND c.m = w.m WHERE k.comparable AND list_contains(k.has, w.m)) SELECT name, 'compared' AS status, NULL::VARCHAR AS missing, count(*) AS n, sum(corrected - legacy) AS delta FROM cells GROUP BY 1 UNION ALL SELECT name, status, missing, count(*), NULL FROM stopped GROUP BY 1, 2, 3",
    "coverage_statuses": "WITH interest AS (SELECT entity, CASE WHEN entity = 'Brand#11' THEN start + 1 ELSE start END AS start FROM weekly), quotes AS (SELECT entity, date, CASE WHEN entity <> 'Brand#12' THEN close END AS close FROM prices WHERE entity <> 'Brand#13'), rows_ AS (SELECT entity, CASE WHEN entity <> 'Brand#21' THEN future_excess_4w END AS ahead FROM panel WHERE entity <> 'Brand#14' AND (entity <> 'Brand#15' OR week < DATE '1996-01-01')), universe AS (SELECT DISTINCT entity FROM weekly UNION ALL SELECT 'Brand#99'), facts AS (SELECT u.entity, (SELECT count(*) FROM market) AS benchmark, (SELECT count(*) FROM interest i WHERE i.entity = u.entity) AS weeks, (SELECT count(*) FROM interest i WHERE i.entity = u.entity AND dayofweek(i.start) <> 0) AS odd_weeks, (SELECT count(*) FROM quotes q WHERE q.entity = u.entity) AS days, (SELECT count(*) FROM quotes q WHERE q.entity = u.entity AND (q.date IS NULL OR q.close IS NULL)) AS empty_days, (SELECT count(*) FROM rows_ r WHERE r.entity = u.entity) AS n, (SELECT count(r.ahead) FROM rows_ r WHERE r.entity = u.entity) AS n_ahead FROM universe u), judged AS (SELECT *, CASE WHEN benchmark = 0 THEN 'blocked_missing_benchmark' WHEN odd_weeks > 0 THEN 'blocked_invalid_trends_input' WHEN empty_days > 0 THEN 'blocked_invalid_price_input' WHEN weeks = 0 OR days = 0 THEN 'blocked_missing_raw_input' WHEN n = 0 THEN 'blocked_panel_build_error' WHEN n < 26 THEN 'blocked_insufficient_history' WHEN n_ahead < 26 THEN 'blocked_insufficient_forward_history' ELSE 'accepted' END AS status FROM facts), counted AS (SELECT *, status NOT IN ('blocked_missing_benchmark', 'blocked_invalid_trends_input', 'blocked_invalid_price_input', 'blocked_missing_raw_input') AS raw FROM judged) SELECT entity, status, CASE status WHEN 'blocked_missing_benchmark' THEN 'no benchmark' WHEN 'blocked_invalid_trends_input' THEN odd_weeks || ' weeks do not start on a Sunday' WHEN 'blocked_invalid_price_input' THEN empty_days || ' days without a date or close' WHEN 'blocked_missing_raw_input' THEN 'missing: ' || concat_ws(', ', CASE WHEN weeks = 0 THEN 'trends' END, CASE WHEN days = 0 THEN 'price' END) WHEN 'blocked_panel_build_error' THEN 'no row in the panel' WHEN 'blocked_insufficient_history' THEN 'only ' || n || ' rows in the panel' WHEN 'blocked_insufficient_forward_history' THEN 'only ' || n_ahead || ' rows with a forward return' ELSE '' END AS reason, weeks > 0 AS trends_present, days > 0 AS price_present, benchmark > 0 AS benchmark_present, CASE WHEN raw THEN n ELSE 0 END AS n_rows, CASE WHEN raw THEN n_ahead ELSE 0 END AS n_forward, 26 AS least FROM counted",
    "collection_errors": " UNION ALL ".join(f"SELECT coalesce(f.entity, s.entity) AS entity, CASE WHEN {h} IS NULL THEN 'no manifest' WHEN {h} <> {_ASKED} THEN 'manifest of another request' WHEN s.entity IS NULL THEN 'no entry' WHEN scale_factor IS NULL THEN 'failed: ' || coalesce(nullif(error, ''), 'no successful collection recorded') WHEN timeframe IS DISTINCT FROM 'today 5-y' OR geo IS DISTINCT FROM 'TW' OR availability_policy IS DISTINCT FROM 'start+14d' OR request_sha256 IS DISTINCT FROM {_ASKED} THEN 'stale/incompatible: ' || concat_ws(', ', CASE WHEN timeframe IS DISTINCT FROM 'today 5-y' THEN 'timeframe' END, CASE WHEN geo IS DISTINCT FROM 'TW' THEN 'geo' END, CASE WHEN availability_policy IS DISTINCT FROM 'start+14d' THEN 'availability_policy' END, CASE WHEN request_sha256 IS DISTINCT FROM {_ASKED} THEN 'request_sha256' END) WHEN f.entity IS NULL THEN 'no file' WHEN f.file_sha256 IS DISTINCT FROM s.file_sha256 THEN 'file hash mismatch' END AS error, '{name}' AS name FROM (SELECT entity, file_sha256 FROM collected WHERE entity <> 'Brand#24') f FULL JOIN spoilt s ON f.entity = s.entity" for name, h in (("current", _ASKED), ("earlier", _EARLIER), ("none", "NULL::VARCHAR"))),
    "collection_state": f"SELECT name, entity, batch, scale_factor, availability_policy, request_sha256, date_start, date_end, available_at_end, n_rows, file_sha256, collected_at::BIGINT AS collected_at, error FROM (SELECT 'same' AS name, * FROM (SELECT * FROM rounds QUALIFY row_number() OVER (PARTITION BY entity ORDER BY collected_at DESC) = 1) UNION ALL SELECT 'changed', * REPLACE ('start+7d' AS availability_policy, {_EARLIER} AS request_sha256), 4 FROM collected WHERE batch = 1)",
    "batch_assignment": "SELECT * FROM batch",
    "anchor_rescale": "WITH anchor AS (SELECT start, svi AS anchor FROM weekly WHERE entity = 'Brand#11'), seen AS (SELECT w.*, batch, anchor FROM weekly w JOIN batch USING (entity) LEFT JOIN anchor USING (start)), means AS (SELECT batch, CASE WHEN avg(anchor) > 0 THEN (SELECT avg(anchor) FROM anchor) / avg(anchor) ELSE 1.0 END AS scale FROM seen GROUP BY batch) SELECT entity, batch, avg(svi * scale) AS mean_scaled FROM seen JOIN means USING (batch) GROUP BY 1, 2",
    "repeat_stability": "WITH orders_ AS (SELECT p_brand AS entity, (date_trunc('week', o_orderdate::DATE + INTERVAL 1 DAY) - INTERVAL 1 DAY)::DATE AS start, count(DISTINCT l_orderkey)::DOUBLE AS svi FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), ships AS (SELECT p_brand AS entity, (date_trunc('week', l_shipdate::DATE + INTERVAL 1 DAY) - INTERVAL 1 DAY)::DATE AS start, count(*)::DOUBLE AS svi FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), both_ AS (SELECT entity, start, w.svi AS lines, o.svi AS orders, s.svi AS ships FROM weekly w JOIN orders_ o USING (entity, start) JOIN ships s USING (entity, start)), ranked AS (SELECT *, " + ", ".join(f"rank() OVER (PARTITION BY entity ORDER BY {c}) + (count(*) OVER (PARTITION BY entity, {c}) - 1) / 2.0 AS rank_{c}" for c in ("lines", "orders", "ships")) + " FROM both_) " + " UNION ALL ".join(f"SELECT entity, '{a}' AS first, '{b}' AS second, corr({a}, {b}) AS r, corr(rank_{a}, rank_{b}) AS rho, avg(abs({a} - {b})) AS mean_abs_diff, count(*) AS n FROM ranked GROUP BY entity" for a, b in (("lines", "orders"), ("lines", "ships"), ("orders", "ships"))),
    "strategy_metrics": "WITH t AS (" + _tercile("panel", "z", ("low", "mid", "high"), "attention") + "), w AS (SELECT attention, week, greatest(avg(future_excess_1w), -0.5) AS r FROM t WHERE attention IS NOT NULL AND future_excess_1w IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY attention ORDER BY week) AS log FROM w), q AS (SELECT *, max(log) OVER (PARTITION BY attention ORDER BY week) AS peak FROM p) SELECT attention, count(*) AS n_weeks, sum(ln(1 + r)) AS log_total, sum(ln(1 + r)) * 52 / count(*) AS log_annual, sqrt(52.0::DOUBLE) * avg(r) / nullif(stddev_samp(r), 0) AS sharpe, avg((r > 0)::INT::DOUBLE) AS win_rate, min(log - peak) AS max_log_drawdown, exp(min(log - peak)) - 1 AS max_drawdown FROM q GROUP BY 1",
}


def _needed(sql: str) -> list[str]:
    found: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                found.append(name)
                visit(CTE[name])

    visit(sql)
    return [n for n in CTE if n in found]


def _ordered(names: list[str]) -> list[str]:
    """Dependencies first; the recursive one may name itself."""
    out: list[str] = []

    def place(n: str) -> None:
        for m in names:
            if m != n and m not in out and re.search(rf"\b(?:FROM|JOIN)\s+{m}\b", CTE[n]):
                place(m)
        if n not in out:
            out.append(n)

    for n in names:
        place(n)
    return out


def oracle_sql() -> dict[str, str]:
    """Each query's SQL; doubles are rounded like the Spark side's."""
    out = {}
    for name, sql in FINAL.items():
        needed = _ordered(_needed(sql))
        recursive = "RECURSIVE " if {"fold", "fold_all", "fe_it"} & {*needed} else ""
        head = f"WITH {recursive}" + ", ".join(f"{n} AS ({CTE[n]})" for n in needed) + f", final AS ({sql}) " if needed else f"WITH final AS ({sql}) "
        out[name] = head + "SELECT " + _columns(name)
    return out


def _columns(name: str) -> str:
    """Round what is a double and pass on what is not."""
    if name in PLAIN:
        return "* FROM final"
    keep = KEEP.get(name, ())
    return f"COLUMNS(lambda c: c IN ({', '.join(repr(k) for k in (*ALWAYS, *keep))})), floor(COLUMNS(lambda c: c NOT IN ({', '.join(repr(k) for k in (*ALWAYS, *keep))})) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE FROM final"


#: Columns that are not doubles, by name.
ALWAYS = (
    "entity", "industry", "week", "start", "period_end", "available_at", "signal_date", "first_tradeable_at", "feature_date", "return_start", "z_window_end", "lag_days", "window_n", "is_event_z2", "is_event_ratio", "is_event_top", "return_end_1w", "return_end_2w", "return_end_4w",
    "rule", "n", "day", "at_or_before", "strictly_before", "at_or_after", "found", "ex_date", "date", "n_rows", "n_forward", "status", "n_entities", "first_week", "last_week", "entities", "date_start", "date_end", "n_days", "usable_weeks", "weeks", "name", "same_week",
    "event_id", "offset", "start_day", "end_day", "n_events", "momentum", "attention", "flow", "model", "horizon", "reject_10", "reject_05", "metric", "batch", "n_weeks", "event_type", "definition", "family", "test", "term", "note", "significant", "n_skipped", "n_raw", "n_kept", "n_stocks", "max_same_week", "n_calendar_weeks", "first", "second", "error", "request_sha256", "missing", *[f"future_excess_{k}w_count" for k in AHEAD], *[f"count_{k}w" for k in AHEAD],
)
#: Queries without a double.
PLAIN = ("collection_errors", "collection_state", "comparison_statuses", "fm_skipped_weeks", "event_counts", "contract_violations", "contract_violations_broken", "manifest_entries", "coverage_statuses", "trading_spine", "asof_backward", "asof_forward", "asof_strict", "coverage_manifest", "panel_provenance", "event_flags", "calendar_clustering", "weekly_terciles", "batch_assignment")
KEEP: dict[str, tuple[str, ...]] = {}

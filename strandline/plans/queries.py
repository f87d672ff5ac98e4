"""The registered panel queries. Doubles are rounded on output, so that results do not depend on the order of sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.expressions import half_width, ratio, rounded
from strandline.operators import asof, collection, crosssec, events, flows, governance, inference, panel
from strandline.sources import facts
from strandline.streaming.activity import activity

from .context import CONTROLS, HORIZONS, Context, context

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(f(context(spark, sf_dir)))

    REGISTRY[f.__name__] = run
    return f


def tidy(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])




# Weekly interest and the contract ------------------------------------------------------------------------------------


@query
def weekly_svi(c):
    return c.weekly


@query
def svi_annotated(c):
    return asof.annotate(c.weekly)


@query
def attention_features(c):
    return c.attention.select("entity", "start", "svi", "ma52", "std52", "window_n", "shock", "z")


@query
def contract_violations(c):
    return asof.count_violations(c.panel)


@query
def contract_violations_broken(c):
    """Rules counted on a panel broken on purpose: every 7th week is available late and traded early."""
    odd = F.pmod(F.datediff("week", F.lit("1970-01-04").cast("date")), F.lit(49)) == 0
    return asof.count_violations(c.panel.withColumn("first_tradeable_at", F.when(odd, F.date_sub("first_tradeable_at", 20)).otherwise(F.col("first_tradeable_at"))))


# As-of lookups and returns -------------------------------------------------------------------------------------------


@query
def trading_spine(c):
    return asof.spine(c.prices.select("entity", "date", "close")).select("entity", "day", "at_or_before", "strictly_before", "at_or_after")


def _targets(c: Context, column: str) -> DataFrame:
    return asof.snap(c.attention.select("entity", "start", "signal_date"), c.calendar, "entity", F.col("signal_date"), found=column)


@query
def asof_backward(c):
    return _targets(c, "at_or_before")


@query
def asof_forward(c):
    return _targets(c, "at_or_after")


@query
def asof_strict(c):
    return _targets(c, "strictly_before")


@query
def trailing_returns(c):
    return panel.past_returns(c.signals, c.calendar)


@query
def skip_momentum(c):
    return asof.skip_return(c.signals.select("entity", "week", "feature_date"), c.calendar, "entity", "feature_date", 52, 4, "r").select("entity", "week", "r")


@query
def forward_returns(c):
    return panel.ahead_returns(c.signals, c.calendar)


@query
def excess_returns(c):
    return c.panel.select("entity", "week", "weekly_return", "market_weekly_return", "weekly_excess")


# Prices --------------------------------------------------------------------------------------------------------------


@query
def dividend_events(c):
    return facts.dividends(c.prices)


@query
def price_adjusted(c):
    return c.adjusted.select("entity", "date", "close", "adj")


@query
def pct_change(c):
    return c.features.select("entity", "date", "ret", "mkt")


@query
def rolling_liquidity(c):
    return c.features.select("entity", "date", "vol_ma20", "vol_ma60", "turnover_ma20")


@query
def rolling_volatility(c):
    return c.features.select("entity", "date", "volatility_20", "volatility_60")


@query
def max_drawdown(c):
    return c.features.select("entity", "date", "drawdown", "max_drawdown")


@query
def rolling_beta(c):
    return c.features.select("entity", "date", "beta")


# The panel -----------------------------------------------------------------------------------------------------------

PANEL_COLUMNS = [
    "entity", "industry", "week", "start", "period_end", "available_at", "first_tradeable_at", "feature_date", "lag_days", "window_n", "svi", "ma52", "std52", "shock", "z", "is_event_z2", "is_event_ratio",
    "weekly_return", "market_weekly_return", "weekly_excess", *[f"past_{n}w" for n in panel.PAST], "past_52w_skip4w", *[f"{k}_{n}w" for k in ("return_end", "future", "future_excess") for n in panel.AHEAD],
    "volume_ratio_4w", "volume_ratio_12w", "turnover", "trading_value", "volatility_4w", "volatility_12w", "beta_26w", "max_drawdown_12w", "liquidity_rank",
]


@query
def panel_v03(c):
    return c.panel.select(*PANEL_COLUMNS)


@query
def liquidity_rank(c):
    return c.panel.select("entity", "week", "turnover", "liquidity_rank")


@query
def coverage_manifest(c):
    return panel.coverage(c.panel, c.weekly)


@query
def panel_provenance(c):
    return panel.provenance(c.panel)


@query
def panel_summary(c):
    """What a dashboard shows of the panel."""
    return c.panel.groupBy("industry").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"), F.min("week").alias("first_week"), F.max("week").alias("last_week"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


# Flows ---------------------------------------------------------------------------------------------------------------


@query
def flow_pivot(c):
    return c.flow_days


@query
def flow_rolling(c):
    return flows.rolled(c.flow_days, c.prices).select("entity", "date", *[f"{x}_{w}" for x in [*[f"{n}_net" for n in flows.NETS], "volume"] for w in ("1w", "4w")])


FLOW_COLUMNS = [f"{n}_{k}" for n in flows.NETS for k in ("value_1w", "value_4w", "ratio_1w", "ratio_4w", "money_4w")]


@query
def panel_v04(c):
    return c.panel4.select("entity", "week", *FLOW_COLUMNS)


@query
def flow_coverage(c):
    return flows.coverage(c.panel4, c.flow_days)


@query
def flow_correlation(c):
    """Correlation of attention with each investor class's share of volume."""
    pairs = [F.struct(F.lit(n).alias("name"), F.corr("z", f"{n}_ratio_4w").alias("r"), F.count(F.when(F.col("z").isNotNull() & F.col(f"{n}_ratio_4w").isNotNull(), 1)).alias("n")) for n in flows.NETS]
    return c.panel4.agg(F.array(*pairs).alias("a")).select(F.explode("a").alias("x")).select("x.*")


# Events --------------------------------------------------------------------------------------------------------------


@query
def event_flags(c):
    return events.flagged(c.panel).select("entity", "week", "is_event_z2", "is_event_ratio", "is_event_top")


@query
def top_decile_events(c):
    return events.flagged(c.panel).filter("is_event_top").select("entity", "week", "z")


@query
def nonoverlap_events(c):
    return c.kept_events.select("entity", "week", "z")


@query
def calendar_clustering(c):
    return c.kept_events.select("entity", "week", crosssec.clustering(c.kept_events).alias("same_week"))


@query
def event_windows(c):
    return c.event_windows.select("event_id", "entity", "week", "offset", F.col("start").alias("start_day"), F.col("end").alias("end_day"), "stock_return", "market_return", "ar")


@query
def caar_by_offset(c):
    return events.by_offset(c.event_windows).drop("definition")


@query
def caar_by_definition(c):
    return events.by_offset(c.all_windows)


@query
def event_summary(c):
    return c.event_tests


@query
def event_ttest(c):
    return events.final_car(c.event_windows).agg(*inference.t_test(F.col("car")))


@query
def event_counts(c):
    """Raw and kept events of each definition."""
    return c.event_tests.select("definition", F.col("n_raw").alias("raw"), F.col("n_kept").alias("kept"))


@query
def car_date_clustered(c):
    weeks = events.final_car(c.event_windows).groupBy("week").agg(F.avg("car").alias("car"))
    return inference.hac_mean(weeks, [], "car", "week")


@query
def event_pvalues(c):
    return c.event_tests.select("definition", "mean", "n", "t", "p")


@query
def bootstrap_ci(c):
    return inference.bootstrap(events.final_car(c.all_windows), "car", "event_id", "definition")


# Sorts ---------------------------------------------------------------------------------------------------------------


def _excess() -> list[str]:
    return [f"future_excess_{n}w" for n in HORIZONS]


def _double(c: Context) -> DataFrame:
    df = crosssec.tercile(c.panel, "past_4w", ("loser", "middle", "winner"), "momentum")
    return crosssec.tercile(df, "z", ("low", "mid", "high"), "attention")


@query
def weekly_terciles(c):
    return _double(c).select("entity", "week", "momentum", "attention")


@query
def double_sort(c):
    return crosssec.sort_portfolio(_double(c), ["momentum", "attention"], _excess())


@query
def double_sort_heatmap(c):
    cells = _double(c).dropna(subset=["momentum", "attention"])
    return cells.groupBy("momentum").agg(*[F.avg(F.when(F.col("attention") == a, F.col("future_excess_4w"))).alias(a) for a in ("low", "mid", "high")])


@query
def triple_sort(c):
    df = _double(c).join(c.panel4.select("entity", "week", "total_ratio_4w"), ["entity", "week"])
    df = crosssec.tercile(df, "total_ratio_4w", ("sell", "neutral", "buy"), "flow")
    df = df.dropna(subset=["momentum", "attention", "flow"])
    return df.groupBy("momentum", "attention", "flow").agg(*[x for n in HORIZONS for x in (F.avg(f"future_excess_{n}w").alias(f"mean_{n}w"), F.count(f"future_excess_{n}w").alias(f"count_{n}w"))])


# Regressions and inference -------------------------------------------------------------------------------------------


def _m1(c: Context) -> DataFrame:
    return inference.slope_by_week(c.panel, "future_excess_4w", "z")


@query
def fm_weekly_m1(c):
    return _m1(c)


def _long(parts: dict[tuple[str, int], DataFrame]) -> DataFrame:
    out = None
    for (model, n), df in parts.items():
        df = df.withColumn("model", F.lit(model)).withColumn("horizon", F.lit(n))
        out = df if out is None else out.unionByName(df)
    return out


@query
def fm_weekly_controls(c):
    return c.attention_models.filter("term = 'z' and model in ('M2', 'M3')").drop("term")


@query
def fm_weekly_industry(c):
    return c.attention_models.filter("term = 'z' and model = 'M4'").drop("term")


@query
def fm_summary(c):
    """Attention's mean weekly coefficient in each model and horizon, with error, test, fit and skipped weeks."""
    return inference.summary(c.attention_models.filter("term = 'z'"), ["model", "horizon"], c.panel)


@query
def fm_skipped_weeks(c):
    """Weeks without a fit among rows of high attention alone, each with its reason."""
    high = c.panel.withColumn("z", F.when(F.col("z") > 0.5, F.col("z")))
    found, _ = c.fits(high, {"M1": ["z"], "M2": ["z", *CONTROLS[:2]]})
    return found.filter("reason is not null").select("model", "horizon", "week", "n", "reason")


@query
def fm_interaction(c):
    return c.interaction_models.filter("term not in ('past_4w', 'past_12w')")


@query
def interaction_summary(c):
    return inference.summary(c.interaction_models.filter("term not in ('past_4w', 'past_12w')"), ["horizon", "term"], c.panel4)


@query
def flow_regressions(c):
    return c.flow_models.filter("term = 'z' and model in ('A', 'B', 'C', 'D')").drop("term")


@query
def flow_summary(c):
    return inference.summary(c.flow_models.filter("term = 'z' and model in ('A', 'B', 'C', 'D')"), ["model", "horizon"], c.panel4)


@query
def flow_scaling(c):
    """Whether attention's coefficient hangs on the unit of the flow control: shares, money or share of volume."""
    return inference.summary(c.flow_models.filter("term = 'z' and model like 'flow_%'"), ["model", "horizon"], c.panel4)


def _m1_all(c: Context) -> DataFrame:
    return _long({("M1", n): inference.slope_by_week(c.panel, f"future_excess_{n}w", "z") for n in HORIZONS})


@query
def fm_summary_hac(c):
    return inference.hac_mean(_m1_all(c), ["model", "horizon"], "coef", "week")


@query
def fm_summary_pvalues(c):
    s = inference.hac_mean(_m1_all(c), ["model", "horizon"], "coef", "week")
    return s.withColumn("p", inference.student_p_column("t", F.col("n") - 1)).withColumn("significant", F.col("p") < 0.05)


@query
def canonical_momentum(c):
    models = {"baseline": ["z"], **{f"z + {x}": ["z", x] for x in ("past_4w", "past_12w", "past_26w", "past_52w_skip4w", "past_1w")}}
    return inference.summary(c.regressions(c.panel, models).filter("term = 'z'"), ["model", "horizon"], c.panel)


def _ic(c: Context, factor: str) -> DataFrame:
    return _long({(factor, n): crosssec.rank_correlation(c.panel, factor, f"future_excess_{n}w") for n in HORIZONS})


@query
def ic_weekly(c):
    return _ic(c, "z")


def _ic_summary(ic: DataFrame) -> DataFrame:
    share = ic.groupBy("model", "horizon").agg(F.avg((F.col("ic") > 1e-9).cast("double")).alias("positive_share"))
    out = inference.hac_mean(ic, ["model", "horizon"], "ic", "week").withColumn("icir", ratio(F.col("mean"), F.col("std"))).join(share, ["model", "horizon"])
    return out.withColumn("p", inference.student_p_column("t", F.col("n") - 1))


@query
def ic_summary(c):
    return _ic_summary(_ic(c, "z"))


@query
def ic_attention_shock(c):
    return _ic_summary(_ic(c, "shock"))


@query
def residual_attention(c):
    return c.residual_panel.select("entity", "week", "residual_z")


@query
def residual_ic(c):
    ic = _long({("residual_z", n): crosssec.rank_correlation(c.residual_panel, "residual_z", f"future_excess_{n}w") for n in HORIZONS})
    return _ic_summary(ic)


@query
def two_way_fe(c):
    return c.effects_models.filter("model = 'M5'")


# Robustness ----------------------------------------------------------------------------------------------------------


@query
def winsorized_fm(c):
    """Attention clipped at its pooled quantiles (returns are not): weekly coefficients at three horizons."""
    parts = {(m, n): inference.slope_by_week(c.winsorized.filter(F.col("model") == m), f"future_excess_{n}w", "z") for m in ("winsor_0.0", "winsor_0.01", "winsor_0.05") for n in HORIZONS}
    return inference.summary(_long(parts), ["model", "horizon"], c.panel)


@query
def winsorized_fe(c):
    return c.effects_models.filter("model like 'winsor%'")


@query
def subperiod_fm(c):
    weeks = c.panel.agg(F.array_sort(F.collect_set("week")).alias("w")).select(F.element_at("w", F.floor(F.size("w") / 2).cast("int") + 1).alias("__mid"))
    half = F.when(F.col("week") < F.col("__mid"), "first").otherwise("second")
    df = _m1_all(c).join(F.broadcast(weeks)).withColumn("model", half)  # one row
    span = c.panel.join(F.broadcast(weeks)).groupBy(half.alias("model")).agg(F.min("week").alias("first_week"), F.max("week").alias("last_week"))
    return inference.hac_mean(df, ["model", "horizon"], "coef", "week").withColumn("p", inference.student_p_column("t", F.col("n") - 1)).join(span, "model")


@query
def rolling_fm_hac(c):
    return inference.rolling_hac(_m1(c))


@query
def placebo_lag(c):
    """Correlation of this week's attention with last row's forward return."""
    df = c.panel.withColumn("placebo", F.lag("future_excess_1w").over(Window.partitionBy("entity").orderBy("week")))
    return crosssec.rank_correlation(df, "z", "placebo").agg(*inference.t_test(F.col("ic")))


@query
def placebo_strict(c):
    """Correlation of attention with the return of the week before the observation began."""
    df = c.signals.select("entity", "week", "start")
    df = asof.snap(df, c.calendar, "entity", F.date_sub("start", 1), anchor="strictly_before").withColumn("n", F.lit(1))
    df = asof.trailing_return(df, c.calendar, "entity", "anchor", "n", "prior").select("entity", "week", "prior")
    return crosssec.rank_correlation(c.panel.join(df, ["entity", "week"]), "z", "prior").agg(*inference.t_test(F.col("ic")))


def _corrected(c: Context) -> DataFrame:
    df = inference.bh(c.tests, "p")
    return df.withColumn("reject_10", F.col("p_fdr") <= 0.1).withColumn("reject_05", F.col("p_fdr") <= 0.05)


@query
def bh_fdr_pooled(c):
    """All tests of the study corrected together."""
    return _corrected(c)


@query
def bh_fdr_by_family(c):
    df = inference.bh(c.tests, "p", ["family"])
    return df.withColumn("reject_10", F.col("p_fdr") <= 0.1).withColumn("reject_05", F.col("p_fdr") <= 0.05)


@query
def regression_with_fdr(c):
    """Attention's coefficients beside their corrected p-values, with half the width of a 95 % interval."""
    fdr = _corrected(c).filter("family = 'fama_macbeth'").select(F.col("test").alias("__test"), F.col("horizon").alias("__horizon"), "p_fdr", "reject_10")
    fm = inference.summary(c.attention_models.filter("term = 'z'"), ["model", "horizon"], c.panel).select("model", "horizon", "mean", "t")
    df = fm.join(fdr, (F.col("model") == F.col("__test")) & (F.col("horizon") == F.col("__horizon"))).drop("__test", "__horizon")
    return df.withColumn("half_width", half_width(F.col("mean"), F.col("t")))


@query
def events_with_fdr(c):
    fdr = _corrected(c).filter("family = 'event_study_caar'").select(F.col("test").alias("definition"), "p_fdr", "reject_10", "reject_05")
    return c.event_tests.select("definition", "mean", "t_clustered").join(fdr, "definition", "left")


# Governance and collection -------------------------------------------------------------------------------------------


@query
def legacy_diff(c):
    """Weekly mean returns before and after price adjustment, compared key by key; keys and a metric are missing on purpose."""
    base = c.panel.groupBy("entity").agg(F.avg("past_4w").alias("mean_return"), F.count("past_4w").cast("double").alias("n"), F.avg("z").alias("mean_z"))
    legacy = base.filter("entity <> 'Brand#11'")
    corrected = base.filter("entity <> 'Brand#55'").withColumn("mean_return", F.col("mean_return") * 0.5).drop("mean_z")
    return governance.compare(legacy, corrected, ["entity"], ["mean_return", "n", "mean_z"])


@query
def comparison_statuses(c):
    """Statuses of comparisons that lack a metric, a key column, a table, or any metric in common."""
    base = c.panel.groupBy("entity").agg(F.avg("past_4w").alias("mean_return"), F.avg("z").alias("mean_z"))
    pairs = {"metric": (base, base.drop("mean_z")), "key": (base, base.withColumnRenamed("entity", "stock")), "table": (base, None), "none": (base, base.select("entity"))}
    out = None
    for name, (a, b) in pairs.items():
        df = governance.compare_tables(c.spark, a, b, ["entity"], ["mean_return", "mean_z"]).withColumn("name", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out.groupBy("name", "status", "missing").agg(F.count(F.lit(1)).alias("n"), F.sum("delta").alias("delta"))


@query
def coverage_statuses(c):
    """Coverage from raw inputs that are broken on purpose: late starts, a close without value, no prices, a short panel."""
    universe = c.weekly.select("entity").distinct().unionByName(c.spark.createDataFrame([("Brand#99",)], "entity string"))
    interest = c.weekly.withColumn("start", F.when(F.col("entity") == "Brand#11", F.date_add("start", 1)).otherwise(F.col("start")))
    prices = c.prices.filter("entity <> 'Brand#13'").withColumn("close", F.when(F.col("entity") != "Brand#12", F.col("close")))
    rows = c.panel.filter("entity <> 'Brand#14' and (entity <> 'Brand#15' or week < date '1996-01-01')")
    rows = rows.withColumn("future_excess_4w", F.when(F.col("entity") != "Brand#21", F.col("future_excess_4w")))
    return panel.input_coverage(universe, interest, prices, c.market, rows)


@query
def batch_assignment(c):
    return governance.batches(c.weekly.select("entity").distinct(), "Brand#11")


@query
def anchor_rescale(c):
    """Series of each batch rescaled to the anchor's mean over all weeks by the anchor's mean over the batch's weeks."""
    batch = governance.batches(c.weekly.select("entity").distinct(), "Brand#11")
    anchor = c.weekly.filter("entity = 'Brand#11'").select("start", F.col("svi").alias("anchor"))
    all_weeks = anchor.agg(F.avg("anchor").alias("reference"))
    seen = c.weekly.join(batch, "entity").join(anchor, "start", "left")
    means = seen.groupBy("batch").agg(F.avg("anchor").alias("batch_mean")).join(F.broadcast(all_weeks))  # one row
    means = means.select("batch", governance.scale(F.col("reference"), F.col("batch_mean")).alias("scale"))
    return seen.join(means, "batch").groupBy("entity", "batch").agg(F.avg(F.col("svi") * F.col("scale")).alias("mean_scaled"))


@query
def repeat_stability(c):
    """Three readings of interest in the same weeks: correlations and mean difference of each pair."""
    return governance.repeat_stability({d: facts.weekly_interest(c.spark, c.sf_dir, d) for d in ("lines", "orders", "ships")})


@query
def manifest_entries(c):
    """Entries of the collection's manifest: a success for each series, an error where it is too short."""
    return governance.manifest_entries(c.weekly, {"geo": "TW", "timeframe": "today 5-y"}, least=26)


#: The request of the study's collection, and one that asks for an earlier use of the same values.
ASKED = {"timeframe": "today 5-y", "geo": "TW", "availability_policy": "start+14d"}
EARLIER = {**ASKED, "availability_policy": "start+7d"}


def _collected(c: Context, request: dict, at: int) -> DataFrame:
    """Entries of all series: their file is what their weeks say, their scale is that of their batch."""
    weeks = asof.annotate(c.weekly)
    said = F.concat_ws("|", "entity", F.count(F.lit(1)), F.sum("svi").cast("long"))
    files = c.weekly.groupBy("entity").agg(F.sha2(said, 256).alias("file_sha256")).withColumn("raw_file_sha256", F.lit(None).cast("string"))
    scales = governance.batches(c.weekly.select("entity").distinct(), "Brand#11").withColumn("scale_factor", F.col("batch") + 1.0)
    return collection.success_entries(weeks, files, scales, request, at)


@query
def collection_errors(c):
    """Why files of series must not be read, of a state with series that failed, were left out, or were collected otherwise."""
    whole = _collected(c, ASKED, 1)
    of = lambda *names: F.col("entity").isin(*names)
    state = whole.filter(~of("Brand#12"))
    state = state.withColumns({
        "scale_factor": F.when(~of("Brand#13", "Brand#14"), F.col("scale_factor")), "error": F.when(of("Brand#13"), "timeout").otherwise(F.col("error")),
        "availability_policy": F.when(of("Brand#15", "Brand#21"), EARLIER["availability_policy"]).otherwise(F.col("availability_policy")),
        "geo": F.when(~of("Brand#21"), F.col("geo")), "request_sha256": F.when(of("Brand#22"), governance.request_hash(EARLIER)).otherwise(F.col("request_sha256")),
        "file_sha256": F.when(of("Brand#23"), F.lit("0")).otherwise(F.col("file_sha256")),
    })
    found = whole.filter(~of("Brand#24")).select("entity", "file_sha256")
    header = c.spark.createDataFrame([(collection.VERSION, governance.request_hash(ASKED))], "version int, request_sha256 string")
    old = c.spark.createDataFrame([(collection.VERSION, governance.request_hash(EARLIER))], "version int, request_sha256 string")
    out = None
    for name, head in (("current", header), ("earlier", old), ("none", header.limit(0))):
        df = collection.errors(found, state, head, ASKED).withColumn("name", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


@query
def collection_state(c):
    """The state after three rounds: all series, failures of some, and successes of some of those; under either request."""
    first = _collected(c, ASKED, 1)
    failed = first.filter("batch % 2 = 0").select("entity", "batch", F.lit("timeout").alias("error"))
    again = _collected(c, ASKED, 3).filter("batch % 4 = 0")
    state = collection.upsert(collection.upsert(first, collection.error_entries(failed, ASKED, 2)), again)
    header = c.spark.createDataFrame([(collection.VERSION, governance.request_hash(ASKED))], "version int, request_sha256 string")
    kept = collection.current(state, header, ASKED).withColumn("name", F.lit("same"))
    reset = collection.upsert(collection.current(state, header, EARLIER), _collected(c, EARLIER, 4).filter("batch = 1")).withColumn("name", F.lit("changed"))
    both = kept.unionByName(reset)
    return both.select("name", "entity", "batch", "scale_factor", "availability_policy", "request_sha256", "date_start", "date_end", "available_at_end", "n_rows", "file_sha256", "collected_at", "error")


@query
def strategy_metrics(c):
    """Weekly mean excess return of each attention tercile: total, annualised, ratio to deviation, win rate, drawdown."""
    df = crosssec.tercile(c.panel, "z", ("low", "mid", "high"), "attention").dropna(subset=["attention", "future_excess_1w"])
    weekly = df.groupBy("attention", "week").agg(F.avg("future_excess_1w").alias("r"))
    w = Window.partitionBy("attention").orderBy("week").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = weekly.withColumn("r", F.greatest(F.col("r"), F.lit(-0.5))).withColumn("log", F.sum(F.log1p("r")).over(w))
    path = path.withColumn("peak", F.max("log").over(w))
    n = F.count(F.lit(1))
    return path.groupBy("attention").agg(n.alias("n_weeks"), F.sum(F.log1p("r")).alias("log_total"), (F.sum(F.log1p("r")) * 52 / n).alias("log_annual"), (F.sqrt(F.lit(52.0)) * F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0))).alias("sharpe"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.min(F.col("log") - F.col("peak")).alias("max_log_drawdown")).withColumn("max_drawdown", F.exp("max_log_drawdown") - 1)


@query
def event_activity(c):
    return activity(facts.table(c.spark, c.sf_dir, "events")).withColumn("start", F.to_date("start"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)



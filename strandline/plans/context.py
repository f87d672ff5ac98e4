"""Shared inputs of the registered queries: one lazily built, stored set of tables for a session and data folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import asof, crosssec, events, features, fits, flows, inference, panel
from strandline.sources import facts, store

_contexts: dict[tuple[str, str], Context] = {}

#: Controls of the full models, in the order in which models take them up.
CONTROLS = ["past_4w", "past_12w", "volume_ratio_4w", "volatility_12w", "liquidity_rank"]
HORIZONS = (1, 2, 4)


class Context:
    """Each table is built on first use; those that many queries read are stored."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        store.ship(spark)
        self.spark, self.sf_dir, self.folder, self.kept = spark, sf_dir, store.folder(spark), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Written once and read back: short plans, and nothing to recompute when an executor is lost."""
        self.kept += 1
        return store.save(df, f"{self.folder}/{self.kept}")

    @cached_property
    def prices(self) -> DataFrame:
        return self.keep(facts.daily(self.spark, self.sf_dir))

    @cached_property
    def market(self) -> DataFrame:
        return self.keep(facts.market(self.prices))

    @cached_property
    def weekly(self) -> DataFrame:
        return self.keep(facts.weekly_interest(self.spark, self.sf_dir))

    @cached_property
    def adjusted(self) -> DataFrame:
        return self.keep(features.adjusted(self.prices, facts.dividends(self.prices)))

    @cached_property
    def features(self) -> DataFrame:
        return self.keep(features.price_features(self.adjusted, self.market))

    @cached_property
    def attention(self) -> DataFrame:
        return features.attention(asof.annotate(self.weekly))

    @property
    def calendar(self) -> DataFrame:
        """Adjusted prices of the entities and the market's closes."""
        return self.adjusted.select("entity", "date", F.col("adj").alias("close")).unionByName(self.market.select("entity", "date", "close"))

    @cached_property
    def signals(self) -> DataFrame:
        return self.keep(panel.signals(self.attention, self.calendar))

    @cached_property
    def panel(self) -> DataFrame:
        """Asserted to look nowhere ahead before anything reads it."""
        return self.keep(asof.assert_contract(panel.build(self.attention, self.calendar, self.features)))

    @cached_property
    def residual_panel(self) -> DataFrame:
        return self.keep(fits.residuals(self.panel, "z", CONTROLS).withColumnRenamed("residual", "residual_z"))

    @cached_property
    def flow_days(self) -> DataFrame:
        return self.keep(flows.pivoted(facts.flow_facts(self.spark, self.sf_dir)))

    @cached_property
    def panel4(self) -> DataFrame:
        days = self.flow_days.select("entity", "date", F.lit(0.0).alias("close"))
        return self.keep(flows.panel_flows(self.panel, flows.rolled(self.flow_days, self.prices), days, self.prices.select("entity", "date", "close")))

    @cached_property
    def raw_events(self) -> DataFrame:
        return self.keep(events.defined(events.flagged(self.panel)))

    @cached_property
    def all_events(self) -> DataFrame:
        """Kept events of all definitions, numbered."""
        return self.keep(events.numbered(events.non_overlapping(self.raw_events, by=("definition", "entity"), keep=self.keep)))

    @cached_property
    def kept_events(self) -> DataFrame:
        return self.all_events.filter("definition = 'top'")

    @cached_property
    def all_windows(self) -> DataFrame:
        """Event windows of all definitions; an event of several is looked up once."""
        days = events.common_days(self.prices, self.market).select("entity", "date", "close")
        rows = events.windows(self.all_events, self.prices, self.market, days)
        return self.keep(self.all_events.select("definition", "event_id", "entity", "week").join(rows, ["entity", "week"]))

    @cached_property
    def event_windows(self) -> DataFrame:
        return self.all_windows.filter("definition = 'top'")

    def fits(self, frame: DataFrame, models: dict[str, list[str]], effects: dict[str, str] | None = None, horizons: tuple[int, ...] = HORIZONS) -> tuple[DataFrame, list[fits.Model]]:
        """Each model's weekly regressions of forward excess returns at each horizon, all from one pass over ``frame``."""
        specs = [fits.Model({"model": m, "horizon": n}, f"future_excess_{n}w", terms, (effects or {}).get(m)) for m, terms in models.items() for n in horizons]
        return self.keep(fits.weekly_fits(frame, specs)), specs

    def regressions(self, frame: DataFrame, models: dict[str, list[str]]) -> DataFrame:
        """(model, horizon, week, term, coef, n, r2) of ``fits``."""
        return fits.coefficients(*self.fits(frame, models))

    @cached_property
    def attention_fits(self) -> tuple[DataFrame, list[fits.Model]]:
        """Attention alone, with momentum, volume and volatility, liquidity rank and industry effects."""
        models = {"M1": ["z"], "M2": ["z", *CONTROLS[:2]], "M3": ["z", *CONTROLS[:4]], "M4": ["z", *CONTROLS]}
        return self.fits(self.panel, models, {"M4": "industry"})

    @cached_property
    def attention_models(self) -> DataFrame:
        """Weekly coefficients of the attention models."""
        return fits.coefficients(*self.attention_fits)

    @cached_property
    def flow_models(self) -> DataFrame:
        base = ["z", *CONTROLS[:2]]
        models = {
            "A": base, "B": [*base, "total_ratio_4w"], "C": [*base, "foreign_ratio_4w", "trust_ratio_4w", "dealer_ratio_4w"],
            "D": [*base, "total_ratio_4w", "volume_ratio_4w", "volatility_12w"],
            "flow_shares": [*base, "total_value_4w"], "flow_money": [*base, "total_money_4w"], "flow_ratio": [*base, "total_ratio_4w"],
        }
        return self.regressions(self.panel4, models)

    @cached_property
    def interaction_models(self) -> DataFrame:
        df = self.panel4.withColumn("z_x_past", F.col("z") * F.col("past_4w")).withColumn("z_x_flow", F.col("z") * F.col("total_ratio_4w"))
        return self.regressions(df, {"E": ["z", *CONTROLS[:2], "total_ratio_4w", "z_x_past", "z_x_flow"]})

    @cached_property
    def winsorized(self) -> DataFrame:
        """The panel with attention clipped at its pooled quantiles, once for each tail."""
        out = None
        for tail in ("0.0", "0.01", "0.05"):
            df = crosssec.winsorized(self.panel, ["z"], float(tail)).withColumn("model", F.lit(f"winsor_{tail}"))
            out = df if out is None else out.unionByName(df)
        return self.keep(out)

    @cached_property
    def effects_models(self) -> DataFrame:
        """Two-way fixed effects of all horizons, and of four weeks for each clipping of attention, in one computation."""
        names = ["entity", "week", "z", *CONTROLS]
        horizons = F.explode(F.array(*[F.struct(F.lit(n).alias("horizon"), F.col(f"future_excess_{n}w").alias("y")) for n in HORIZONS])).alias("h")
        rows = self.panel.select(F.lit("M5").alias("model"), *names, horizons).select("model", *names, "h.*")
        clipped = self.winsorized.select("model", *names, F.lit(4).alias("horizon"), F.col("future_excess_4w").alias("y"))
        fe = inference.two_way_fe(rows.unionByName(clipped), ["model", "horizon"], "y", "z", CONTROLS, self.keep)
        return self.keep(fe.withColumn("p", inference.normal_p_column("t")))

    @cached_property
    def tests(self) -> DataFrame:
        """(family, test, horizon, p): the tests that are corrected together."""
        car = self.event_tests.select(F.lit("event_study_caar").alias("family"), F.col("definition").alias("test"), F.lit(8).alias("horizon"), F.col("p_clustered").alias("p"))
        fm = inference.summary(self.attention_models.filter("term = 'z'"), ["model", "horizon"], self.panel)
        fm = fm.select("model", "horizon", "p").unionByName(self.effects_models.filter("model = 'M5'").select("model", "horizon", "p"))
        inter = inference.summary(self.interaction_models.filter("term not in ('past_4w', 'past_12w')"), ["term", "horizon"], self.panel4)
        fm = fm.select(F.lit("fama_macbeth").alias("family"), F.col("model").alias("test"), "horizon", "p")
        inter = inter.select(F.lit("interaction_model").alias("family"), F.col("term").alias("test"), "horizon", "p")
        return self.keep(car.unionByName(fm).unionByName(inter))

    @cached_property
    def event_tests(self) -> DataFrame:
        """One row for each event definition: counts, naive and date-clustered tests of the final cumulative return."""
        raw = self.raw_events.groupBy("definition").agg(F.count(F.lit(1)).alias("n_raw"))
        same = self.all_events.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("definition", "week")))
        kept = same.groupBy("definition").agg(F.count(F.lit(1)).alias("n_kept"), F.countDistinct("entity").alias("n_stocks"), F.max("same").alias("max_same_week"))
        car = events.final_car(self.all_windows)
        naive = car.groupBy("definition").agg(*inference.t_test(F.col("car")), F.stddev_samp("car").alias("std"))
        naive = naive.withColumn("p", inference.student_p_column("t", F.col("n") - 1))
        clustered = inference.hac_mean(car.groupBy("definition", "week").agg(F.avg("car").alias("car")), ["definition"], "car", "week")
        clustered = clustered.select("definition", F.col("n").alias("n_calendar_weeks"), F.col("t").alias("t_clustered"), inference.student_p_column("t", F.col("n") - 1).alias("p_clustered"))
        return self.keep(raw.join(kept, "definition").join(naive, "definition").join(clustered, "definition"))


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of what lies in the folder: other data, another context."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def context(spark: SparkSession, sf_dir: str) -> Context:
    """The context of a session and folder; a new one, and the old one's tables removed, where the data have changed."""
    key, stamp = (spark.sparkContext.applicationId, sf_dir), _stamp(spark, sf_dir)
    if key not in _contexts or _contexts[key].stamp != stamp:
        forget(spark, sf_dir)
        _contexts[key] = Context(spark, sf_dir)
        _contexts[key].stamp = stamp
    return _contexts[key]


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Remove the stored tables of a session and folder."""
    old = _contexts.pop((spark.sparkContext.applicationId, sf_dir), None)
    if old is not None:
        store.remove(spark, old.folder)

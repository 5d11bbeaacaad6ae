import warnings

import pytest

from barloom.operators.registry import LiveSignalNotAllowed, RuleRegistry, parse_rules, parse_signal_docstring
from barloom.operators.signals import SIGNALS, signal_frame
from barloom.queries_signals import READINGS, _TEXTS
from barloom.sources.bars import sample_ohlcv


@pytest.fixture(scope="module")
def bars(spark):
    from pyspark.sql import functions as F

    df = sample_ohlcv(spark, 220, trend="flat", volatility=0.03, seed=2).withColumn("volume", F.floor("volume").cast("double"))
    return df.select("*", *[F.expr(_TEXTS[c]).alias(c) for c in READINGS]).cache()


def test_counts():
    assert len(SIGNALS) == 264
    assert sum(s.kind == "TRIGGER" for s in SIGNALS.values()) == 128


def test_many_rules_in_one_plan(bars):
    names = [n for n, s in SIGNALS.items() if not s.live and not s.special]
    pick = names[::6]
    wide = signal_frame(bars, [(n, {}) for n in pick]).toPandas()
    assert len(wide) == 220 and wide[pick].notna().all().all()
    for n in pick[::9]:
        alone = signal_frame(bars, [(n, {})]).toPandas()
        assert (alone.sort_values("ts")[n].to_numpy() == wide.sort_values("ts")[n].to_numpy()).all()


def test_missing_columns_and_unknown_direction(bars):
    few = bars.select("symbol", "ts", "close")
    df = signal_frame(few, [("etf_inflow_spike", {}), ("adx_strong_trend", {}), ("ema_crossover", {"direction": "sideways"})]).toPandas()
    assert not df[["etf_inflow_spike", "adx_strong_trend", "ema_crossover"]].any().any()
    with pytest.raises(TypeError):
        signal_frame(few, [("rsi_oversold", {"windw": 3})])


def test_readings_hold_their_last_value(spark):
    import datetime as dt

    t = lambda i: dt.datetime(2024, 1, 1 + i)
    rows = [("a", t(0), -1.0), ("a", t(1), None), ("a", t(2), 2.0), ("a", t(3), None)]
    got = signal_frame(spark.createDataFrame(rows, "symbol string, ts timestamp, PerpFundingRate double"), [("funding_flip_positive", {})]).orderBy("ts").collect()
    assert [r.funding_flip_positive for r in got] == [False, False, True, True]


def test_registry(bars):
    r = RuleRegistry()
    assert len(r.names()) == 264 and r.has("apo_bullish") and "apo_bullish" not in r.names()
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert r.resolve("apo_bullish") == "macd_line_positive" and w
    assert r.describe("nothing") == {} and r.describe("atr_trailing_stop_long")["status"] == "deprecated"
    assert r.normalise({"name": "sma_crossover", "params": {"short_period": 3}})[1] == {"window_fast": 3}
    with pytest.raises(LiveSignalNotAllowed):
        r.validate_evaluation_mode("x_user_post_trigger", "historical")
    with pytest.raises(ValueError):
        r.validate_evaluation_mode("nothing", "historical")
    with pytest.raises(ValueError):
        r.register("mine", evaluation_mode="live")
    answer = r.evaluate({"name": "price_above_ema", "params": {}}, bars).collect()
    assert len(answer) == 1 and isinstance(answer[0].fired, bool)

    @r.register("always")
    def always(df):
        """Fires."""
        from pyspark.sql import functions as F

        return df.select("symbol", "ts", F.lit(True).alias("fired"))

    assert r.evaluate({"name": "always"}, bars).first().fired is True
    with pytest.raises(ValueError):
        r.register("rsi_oversold")


def test_live_rules():
    class Provider:
        def check_user_post_signal(self, **kw):
            return kw["username"] == "a"

        def check_topic_mention_signal(self, **kw):
            raise RuntimeError("down")

        def get_user_influence_score(self, username):
            return 60

        def detect_social_sentiment(self, **kw):
            return {"mention_volume": 6}

    r = RuleRegistry()
    assert r.evaluate({"name": "x_user_post_trigger", "params": {"username": "a"}}) is False  # nothing configured
    r.configure_provider(Provider)
    assert r.evaluate({"name": "x_user_post_trigger", "params": {"username": "a"}}) is True
    assert r.evaluate({"name": "x_topic_mention_trigger", "params": {"topic": "t"}}) is False
    assert r.evaluate({"name": "x_user_influence_filter", "params": {"username": "a"}}) is True
    assert r.evaluate({"name": "x_topic_sentiment_filter", "params": {"topic": "t"}}) is True
    assert r.evaluate({"name": "x_social_sentiment_trigger", "params": {"symbol": "t"}}) is False


def test_catalog_and_parsing(spark):
    assert RuleRegistry().catalog(spark).count() == 264
    assert parse_rules('{"name": "x"}') == [{"name": "x"}]
    d = parse_signal_docstring("Signal: demo\n\nType: TRIGGER\nRequires: close, volume\n\nArgs:\n    window (int): Bars. Range: 2-50. Default: 14.\n    mode (str): Kind. Options: a, b. Default: a.\n")
    assert d["name"] == "demo" and d["requires"] == ["close", "volume"] and d["params"]["window"]["default"] == "14" and d["params"]["mode"]["options"] == ["a", "b"]
    assert parse_signal_docstring("")["type"] is None

"""One query per signal over daily bars of lineitem (with derived alternative readings), and the rule catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators.multi_timeframe import slope_sql
from barloom.operators.registry import RuleRegistry
from barloom.operators.signals import SIGNALS, signal_frame, signal_sql
from barloom.oracle_signals import signal_oracle
from barloom.queries import register
from barloom.sources.bars import EVENT_BARS_SQL, LINEITEM_BARS_SQL, event_bars, lineitem_bars

#: Readings derived from the volume (whole numbers), each null now and then.
READINGS = {
    "SmartMoneyNetflow": ("(volume % 41) - 20", 7), "SmartMoneyHoldings": ("1000 + (volume % 101)", 11), "ExchangeNetflow": ("(volume % 37) - 18", 13), "WhaleNetInflow": ("(volume % 23) - 11", 17),
    "HolderConcentration": ("(volume % 100) / 100", 19), "TokenUnlockPressure": ("(volume % 50) / 500", 5), "PerpFundingRate": ("((volume % 31) - 15) / 1000", 9), "EtfNetFlow": ("(volume % 29) - 5", 8),
    "TreasuryUsd": ("1000000 + (volume % 97) * 1000", 6), "LendingRateSpread": ("(volume % 40) / 1000", 12), "SocialSentiment": ("((volume % 61) - 30) / 30", 10), "SocialAuthors": ("(volume % 90)", 14),
    "SocialNetBullShare": ("((volume % 53) - 26) / 26", 15), "HolderCount": ("5000 + (volume % 211)", 16), "WhaleHeldShare": ("(volume % 73) / 100", 18), "XPostCount": ("(volume % 300) * (volume % 3)", 997),
}
_TEXTS = {k: f"CASE WHEN CAST(volume AS BIGINT) % {n} = 1 THEN NULL ELSE CAST({v} AS DOUBLE) END" for k, (v, n) in READINGS.items()}
ALT_BARS_SQL = "SELECT *, " + ", ".join(f"{t} AS {k}" for k, t in _TEXTS.items()) + f" FROM ({LINEITEM_BARS_SQL})"


def alt_bars(spark, sf_dir, wanted):
    return lineitem_bars(spark, sf_dir).select("*", *[F.expr(_TEXTS[c]).alias(c) for c in wanted if c in _TEXTS])


def _signal(name: str) -> None:
    s = SIGNALS[name]
    hourly = s.special == "slope"
    if hourly:
        slope = slope_sql(EVENT_BARS_SQL, 86400, 10)
        sql = f"SELECT symbol, ts, coalesce({s.pred(s.params)} AND row_number() OVER (PARTITION BY symbol ORDER BY ts) >= 2, false) AS fired FROM ({slope})"
    else:
        bars_sql = ALT_BARS_SQL if set(s.requires) & set(_TEXTS) else LINEITEM_BARS_SQL
        sql = signal_oracle(name, bars_sql) or signal_sql(bars_sql, name)

    @register(f"sig_{name}", sql)
    def query(spark, sf_dir):
        bars = event_bars(spark, sf_dir) if hourly else alt_bars(spark, sf_dir, s.requires)
        return signal_frame(bars, [(name, {})]).withColumnRenamed(name, "fired")


for _name, _s in SIGNALS.items():
    if not _s.live:
        _signal(_name)


@register("rule_catalog")
def rule_catalog(spark, sf_dir):
    return RuleRegistry().catalog(spark)


@register("rule_evaluate", f"WITH base AS ({LINEITEM_BARS_SQL}) SELECT symbol, arg_max(fired, ts) AS fired FROM ({signal_sql('SELECT * FROM base', 'sma_crossover', {'window_fast': 5, 'window_slow': 20})}) GROUP BY symbol")
def rule_evaluate(spark, sf_dir):
    rule = {"name": "sma_crossover", "parameters": {"short_period": 5, "long_period": 20}}
    return RuleRegistry().evaluate(rule, lineitem_bars(spark, sf_dir))


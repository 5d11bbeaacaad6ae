"""One query per indicator over daily bars of lineitem, beside SQL: by hand for window indicators, with own recursions for scans."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barloom.operators import multi_timeframe as mtf
from barloom.operators.indicators import INDICATORS, compute, oracle, request
from barloom.oracle_indicators import indicator_oracle
from barloom.plans.scan_sql import swing_sql
from barloom.queries import register
from barloom.sources.bars import EVENT_BARS_SQL, LINEITEM_BARS_SQL, event_bars, lineitem_bars

#: Decimals compared: price levels 4; sums over the whole history 2; huge readings coarser.
DIGITS = {"HMA": 7, "ADI": 2, "OBV": 2, "VPT": 2, "ADOSC": 2, "KVO": 2, "KlingerVolumeOscillator": 2, "ForceIndex": 2, "EaseOfMovement": -5}
#: Exact readings that end in fives lie between two roundings; an odd divisor moves them off.
DIVISORS = {"EaseOfMovement": 3.14159}
#: Inputs of indicators that don't read bar columns by name.
INPUTS = {"SwingDelta": {"price": "close", "indicator": "volume"}, "Divergence": {"price": "close", "indicator": "volume"}, "SocialZScore": {"value": "volume"}, "SocialBaselineShift": {"value": "volume"}, "OnchainChange": {"value": "close"}}
PARAMS = {"VPT": {"smoothing_factor": 5}}


def _indicator(name: str):
    digits, inputs, params = DIGITS.get(name, 4), INPUTS.get(name), PARAMS.get(name)
    sql = oracle(LINEITEM_BARS_SQL, request(name, inputs, **(params or {})))
    sql = sql and sql.replace(", 6) AS", f", {digits}) AS")
    if name in ("SwingDelta", "Divergence"):
        head = swing_sql(f"WITH bars AS ({LINEITEM_BARS_SQL})", "bars", "close", "volume", 5, 10)
        sql = f"{head}\nSELECT symbol, ts, " + ", ".join(f"round(CAST({o} AS DOUBLE), {digits}) AS {o}" for o in INDICATORS[name].outputs) + " FROM deltas"
    sql = indicator_oracle(name, LINEITEM_BARS_SQL, INDICATORS[name].outputs, digits) or sql
    if by := DIVISORS.get(name):
        sql = re.sub(r"round\(CAST\((\w+) AS DOUBLE\)", rf"round(CAST(\1 AS DOUBLE) / {by}", sql)
    shown = {o: f"o_{o}" for o in INDICATORS[name].outputs}
    if name == "NVI":  # spans many orders of size: compared as its logarithm
        sql = re.sub(r"round\(CAST\((\w+) AS DOUBLE\)", r"round(ln(1 + \1)", sql)

    @register(f"ind_{name.lower()}", sql)
    def query(spark, sf_dir):
        df = compute(lineitem_bars(spark, sf_dir), name, params, inputs=inputs, prefix="o_")
        value = (lambda c: F.ln(1 + F.col(c))) if name == "NVI" else (lambda c: F.col(c) / by) if by else F.col
        return df.select("symbol", "ts", *[F.round(value(c), digits).alias(o) for o, c in shown.items()])


for _name in INDICATORS:
    _indicator(_name)

_SLOPE = mtf.slope_sql(EVENT_BARS_SQL, 86400, 10)


@register("ind_multitfslope", f"SELECT symbol, ts, round(higher_tf_slope, 8) AS higher_tf_slope FROM ({_SLOPE})")
def _slope(spark, sf_dir):
    df = mtf.multi_tf_slope(event_bars(spark, sf_dir), "1d", 10)
    return df.select("symbol", "ts", F.round("higher_tf_slope", 8).alias("higher_tf_slope"))


@register("ind_multitftrend", f"SELECT symbol, ts, CASE WHEN higher_tf_slope > 0 THEN 1.0 WHEN higher_tf_slope < 0 THEN -1.0 WHEN higher_tf_slope IS NOT NULL THEN 0.0 END AS higher_tf_trend FROM ({_SLOPE})")
def _trend(spark, sf_dir):
    return mtf.multi_tf_trend(event_bars(spark, sf_dir), "1d", 10).select("symbol", "ts", "higher_tf_trend")

"""All signals: boolean predicates per bar, declared over indicator outputs.

A signal names the columns it requires, its parameters, the fewest bars it needs, the indicators
it reads and a predicate text.  Undefined operands give False.  Signals over alternative data
(``parts``) compact each reading first: windows run over its non-null values and the last value
stays in force; a missing column gives False.  Several signals share one plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.text import frame, lag, num, row_no
from barloom.operators.indicators import Request, plan, request
from barloom.operators.multi_timeframe import multi_tf_slope
from barloom.plans.scan_sql import swing_sql
from barloom.plans.staging import to_spark, to_sql

TRIGGER, FILTER = "TRIGGER", "FILTER"


@dataclass(frozen=True)
class Signal:
    name: str
    kind: str
    requires: tuple[str, ...]
    params: dict
    least: Callable[[dict], int]
    uses: Callable[[dict], dict[str, Request]]
    pred: Callable[[dict], str]
    pre: Callable[[dict], dict[str, str]] | None = None
    parts: Callable[[dict], dict[str, tuple[str, dict[str, str]]]] | None = None
    category: str = ""
    disabled: bool = False
    deprecated: bool = False
    live: str | None = None
    special: str | None = None
    extra: dict = field(default_factory=dict)


SIGNALS: dict[str, Signal] = {}


def _least(spec, p):
    return spec(p) if callable(spec) else spec


def signal(name, kind, requires, params, least, uses, pred, **more):
    one = lambda x: x if callable(x) else (lambda p: x)
    SIGNALS[name] = Signal(name, kind, tuple(requires.split()), params, one(least), one(uses), one(pred), **more)


def up(a: str, b: str) -> str:
    return f"{lag(a)} <= {lag(b)} AND {a} > {b}"


def down(a: str, b: str) -> str:
    return f"{lag(a)} >= {lag(b)} AND {a} < {b}"


def up0(a: str, level: str = "0.0") -> str:
    return f"{lag(a)} <= {level} AND {a} > {level}"


def down0(a: str, level: str = "0.0") -> str:
    return f"{lag(a)} >= {level} AND {a} < {level}"


def by_direction(bullish: Callable, bearish: Callable) -> Callable[[dict], str]:
    """The predicate of the direction; any other direction never fires."""

    def pred(p):
        d = str(p["direction"]).lower()
        return bullish(p) if d == "bullish" else bearish(p) if d == "bearish" else "1 = 0"

    return pred


# averages

_AV = "averaging"
_MA = {  # name: indicator, output, columns, fast, slow, other parameters, least bars beyond the slow window
    "alma": ("ALMA", "alma", "close", 9, 21, {"offset": 0.85, "sigma": 6.0}), "dema": ("DEMA", "dema", "close", 9, 21, {}), "ema": ("EMA", "ema", "close", 9, 21, {}),
    "hma": ("HMA", "hma", "close", 9, 25, {}), "sma": ("SMA", "sma", "close", 9, 21, {}), "smma": ("SMMA", "smma", "close", 14, 50, {}), "t3": ("T3", "t3", "close", 5, 10, {"volume_factor": 0.7}),
    "tema": ("TEMA", "tema", "close", 9, 21, {}), "trima": ("TRIMA", "trima", "close", 10, 30, {}), "wma": ("WMA", "wma", "close", 9, 21, {}), "epma": ("EPMA", "epma", "close", 10, 30, {}),
    "vwma": ("VWMA", "vwma", "close volume", 9, 21, {}),
}


def _pair(ind, more):
    return lambda p: {"f": request(ind, window=p["window_fast"], **{k: p[k] for k in more}), "s": request(ind, window=p["window_slow"], **{k: p[k] for k in more})}


for _n, (_ind, _out, _cols, _fast, _slow, _more) in _MA.items():
    _params = {"window_fast": _fast, "window_slow": _slow, **_more}
    _bars = (lambda p: 6 * p["window_slow"] + 1) if _n == "t3" else (lambda p: p["window_slow"] + 1)
    signal(f"{_n}_cross_up", TRIGGER, _cols, _params, _bars, _pair(_ind, _more), up(f"f.{_out}", f"s.{_out}"), category=_AV)
    signal(f"{_n}_cross_down", TRIGGER, _cols, _params, _bars, _pair(_ind, _more), down(f"f.{_out}", f"s.{_out}"), category=_AV)
    if _n in ("ema", "sma"):
        _d = by_direction(lambda p, o=_out: up(f"f.{o}", f"s.{o}"), lambda p, o=_out: down(f"f.{o}", f"s.{o}"))
        signal(f"{_n}_crossover", TRIGGER, _cols, {**_params, "direction": "bullish"}, _bars, _pair(_ind, ()), _d, category=_AV)

for _n, _ind, _out, _cols, _params, _factor in (
    ("is_above_vwma", "VWMA", "vwma", "close volume", {"window": 20}, 1), ("is_above_alma", "ALMA", "alma", "close", {"window": 21, "offset": 0.85, "sigma": 6.0}, 1), ("is_above_dema", "DEMA", "dema", "close", {"window": 21}, 1),
    ("is_above_hma", "HMA", "hma", "close", {"window": 16}, 1), ("is_above_sma", "SMA", "sma", "close", {"window": 20}, 1), ("is_above_smma", "SMMA", "smma", "close", {"window": 14}, 1),
    ("is_above_t3", "T3", "t3", "close", {"window": 10, "volume_factor": 0.7}, 6), ("is_above_tema", "TEMA", "tema", "close", {"window": 21}, 1), ("is_above_trima", "TRIMA", "trima", "close", {"window": 20}, 1),
    ("is_above_epma", "EPMA", "epma", "close", {"window": 20}, 1), ("price_above_ema", "EMA", "ema", "close", {"window": 20}, 1), ("vwap_above", "VWAP", "vwap", "high low close volume", {"window": 14}, 1),
):
    signal(_n, FILTER, _cols, _params, lambda p, k=_factor: k * p["window"], lambda p, i=_ind: {"m": request(i, **p)}, f"close > m.{_out}", category=_AV)
signal("vwap_below", FILTER, "high low close volume", {"window": 14}, lambda p: p["window"], lambda p: {"m": request("VWAP", **p)}, "close < m.vwap", category=_AV)

_kama = ({"window": 10, "pow1": 2, "pow2": 30}, lambda p: p["window"] + max(p["pow1"], p["pow2"]), lambda p: {"k": request("KAMA", **p)})
signal("kama_cross_up", TRIGGER, "close", *_kama, up("close", "k.kama"), category=_AV)
signal("kama_cross_down", TRIGGER, "close", *_kama, down("close", "k.kama"), category=_AV)
_all = {"jaw": 13, "teeth": 8, "lips": 5, "jaw_offset": 8, "teeth_offset": 5, "lips_offset": 3}
for _n, _pred in (
    ("bearish", "g.lips < g.teeth AND g.teeth < g.jaw"), ("bullish", "g.lips > g.teeth AND g.teeth > g.jaw"),
    ("sleeping", "g.jaw IS NOT NULL AND g.teeth IS NOT NULL AND g.lips IS NOT NULL AND NOT (g.lips < g.teeth AND g.teeth < g.jaw) AND NOT (g.lips > g.teeth AND g.teeth > g.jaw)"),
):
    signal(f"alligator_{_n}", FILTER, "high low", _all, lambda p: p["jaw"] + p["jaw_offset"] + 1, lambda p: {"g": request("WilliamsAlligator", **p)}, _pred, category=_AV)
_mama = ({"fast_limit": 0.5, "slow_limit": 0.05, "warmup_bars": 64}, 2, lambda p: {"m": request("MAMA", **p)})
signal("is_above_mama", FILTER, "high low close", *_mama, "close > m.mama", category=_AV)
signal("mama_cross_up", TRIGGER, "high low close", *_mama, up("m.mama", "m.fama"), category=_AV)
signal("mama_cross_down", TRIGGER, "high low close", *_mama, down("m.mama", "m.fama"), category=_AV)

#: The windows of the ribbon.
RIBBON = (5, 8, 13, 21, 34, 55, 89, 144)


def _ribbon(p):
    return {f"r{i}": request("SMA", window=w) for i, w in enumerate(p["windows"])}


def _ordered(p, op):
    return " AND ".join(f"r{i}.sma {op} r{i + 1}.sma" for i in range(len(p["windows"]) - 1)) or "1 = 1"


def _defined(p):
    return " AND ".join(f"r{i}.sma IS NOT NULL" for i in range(len(p["windows"])))


for _n, _pred in (
    ("bearish", lambda p: f"{_defined(p)} AND {_ordered(p, '<')}"), ("bullish", lambda p: f"{_defined(p)} AND {_ordered(p, '>')}"),
    ("tangled", lambda p: f"{_defined(p)} AND NOT ({_ordered(p, '<')}) AND NOT ({_ordered(p, '>')})"),
):
    signal(f"ma_ribbon_{_n}", FILTER, "close", {"windows": RIBBON}, lambda p: max(p["windows"]), _ribbon, _pred, category=_AV)

_ich = {"window_tenkan": 9, "window_kijun": 26, "window_senkou": 52}
_ichimoku = lambda p: {"i": request("Ichimoku", window1=p["window_tenkan"], window2=p["window_kijun"], window3=p["window_senkou"], visual=False)}
signal("ichimoku_bullish", FILTER, "high low close", _ich, lambda p: p["window_senkou"], _ichimoku, "i.span_a IS NOT NULL AND i.span_b IS NOT NULL AND close > greatest(i.span_a, i.span_b)", category=_AV)
signal("ichimoku_bearish", FILTER, "high low close", _ich, lambda p: p["window_senkou"], _ichimoku, "i.span_a IS NOT NULL AND i.span_b IS NOT NULL AND close < least(i.span_a, i.span_b)", category=_AV)
signal("ichimoku_tk_cross", TRIGGER, "high low", {**_ich, "direction": "bullish"}, lambda p: p["window_senkou"] + 1, _ichimoku, by_direction(lambda p: up("i.conversion_line", "i.base_line"), lambda p: down("i.conversion_line", "i.base_line")), category=_AV)
signal("heikin_ashi_bullish", FILTER, "open high low close", {}, 1, {"h": request("HeikinAshi")}, "h.ha_close > h.ha_open", category=_AV)
signal("heikin_ashi_bearish", FILTER, "open high low close", {}, 1, {"h": request("HeikinAshi")}, "h.ha_close < h.ha_open", category=_AV)
_sar = ({"step": 0.02, "max_step": 0.2}, 3, lambda p: {"s": request("ParabolicSAR", step=p["step"], max_step=p["max_step"])})
signal("psar_bullish", FILTER, "high low close", *_sar, "s.psar < close", category=_AV)
signal("psar_bearish", FILTER, "high low close", *_sar, "s.psar > close", category=_AV)
signal("psar_reversal", TRIGGER, "high low close", {**_sar[0], "direction": "bullish"}, 4, _sar[2], by_direction(lambda p: f"{lag('s.psar')} > {lag('close')} AND s.psar < close", lambda p: f"{lag('s.psar')} < {lag('close')} AND s.psar > close"), category=_AV)

# flow

for _n, _ind, _cols in (("adi", "ADI", "high low close volume"), ("obv", "OBV", "close volume"), ("vpt", "VPT", "close volume")):
    for _side, _op in (("bearish", "<"), ("bullish", ">")):
        signal(f"{_n}_{_side}", FILTER, _cols, {"window": 20}, lambda p: p["window"], {"x": request(_ind)}, lambda p, n=_n, op=_op: f"x.{n} {op} {lag(f'x.{n}', p['window'] - 1)}", category="flow")
for _side, _op in (("bearish", "<"), ("bullish", ">")):
    signal(f"nvi_{_side}", FILTER, "close volume", {"window": 255}, lambda p: p["window"], lambda p: {"x": request("NVI", **p)}, f"x.nvi {_op} x.nvi_ema", category="flow")
signal("cumulative_return_positive", FILTER, "close", {"threshold": 0.0}, 2, {"x": request("CumulativeReturn")}, lambda p: f"x.cumulative_return > {num(p['threshold'])}", category="flow")
signal("cumulative_return_target", FILTER, "close", {"target": 10.0}, 2, {"x": request("CumulativeReturn")}, lambda p: f"x.cumulative_return >= {num(p['target'])}", category="flow")

# levels and thresholds of one indicator


def _levels(category, ind, cols, params, least, mapping, rows):
    """rows: name, kind, predicate template; {threshold} and other own parameters are filled in."""
    for name, kind, own, pred in rows:
        full = {**params, **own}
        uses = lambda p: {"x": request(ind, **{k: p[v] if isinstance(v, str) else v for k, v in mapping.items()})}
        text = lambda p, t=pred, o=own: t.format(**{k: num(p[k]) for k in o if isinstance(o[k], (int, float))})
        signal(name, kind, cols, full, least, uses, text, category=category)


_w = {"window": "window"}
_M, _O, _V = "momentum", "oscillator", "volatility"
_levels(_M, "ROC", "close", {"window": 12}, lambda p: p["window"], _w, [("roc_positive", FILTER, {"threshold": 0.0}, "x.roc > {threshold}"), ("roc_negative", FILTER, {"threshold": 0.0}, "x.roc < {threshold}")])
signal("roc_momentum_shift", TRIGGER, "close", {"window": 12, "direction": "bullish"}, lambda p: p["window"] + 1, lambda p: {"x": request("ROC", window=p["window"])}, by_direction(lambda p: up0("x.roc"), lambda p: down0("x.roc")), category=_M)
_ao = {"window1": "window_fast", "window2": "window_slow"}
_levels(_M, "AwesomeOscillator", "high low", {"window_fast": 5, "window_slow": 34}, lambda p: p["window_slow"], _ao, [("ao_bullish", FILTER, {"threshold": 0.0}, "x.ao > {threshold}"), ("ao_bearish", FILTER, {"threshold": 0.0}, "x.ao < {threshold}")])
signal("ao_zero_cross", TRIGGER, "high low", {"window_fast": 5, "window_slow": 34, "direction": "bullish"}, lambda p: p["window_slow"] + 1, lambda p: {"x": request("AwesomeOscillator", window1=p["window_fast"], window2=p["window_slow"])}, by_direction(lambda p: up0("x.ao"), lambda p: down0("x.ao")), category=_M)
_sfs = {"window_slow": 26, "window_fast": 12, "window_sign": 9}
_same = {k: k for k in _sfs}
_full = lambda p: p["window_slow"] + p["window_sign"]
for _n, _ind, _cols in (("ppo", "PPO", "close"), ("pvo", "PVO", "volume")):
    _levels(_M, _ind, _cols, _sfs, _full, _same, [(f"{_n}_bullish_cross", TRIGGER, {}, up(f"x.{_n}", f"x.{_n}_signal")), (f"{_n}_bearish_cross", TRIGGER, {}, down(f"x.{_n}", f"x.{_n}_signal"))])
_levels(_M, "MOM", "close", {"window": 10}, 1, _w, [("mom_bullish", FILTER, {}, "x.mom > 0"), ("mom_bearish", FILTER, {}, "x.mom < 0")])
_levels(_M, "MOM", "close", {"window": 10}, 2, _w, [("mom_cross_up", TRIGGER, {}, up0("x.mom")), ("mom_cross_down", TRIGGER, {}, down0("x.mom"))])
_line = {"window_fast": "window_fast", "window_slow": "window_slow"}
_levels(_M, "MACD", "close", {"window_fast": 12, "window_slow": 26}, lambda p: p["window_slow"], _line, [("macd_line_positive", FILTER, {}, "x.macd > 0"), ("macd_line_negative", FILTER, {}, "x.macd < 0")])
_levels(_M, "MACD", "close", {"window_fast": 12, "window_slow": 26}, lambda p: p["window_slow"] + 1, _line, [("macd_line_cross_up", TRIGGER, {}, up0("x.macd")), ("macd_line_cross_down", TRIGGER, {}, down0("x.macd"))])
_levels(_M, "MACD", "close", _sfs, _full, _same, [("macd_bearish_cross", TRIGGER, {}, down("x.macd", "x.signal")), ("macd_bullish_cross", TRIGGER, {}, up("x.macd", "x.signal")), ("macd_positive", FILTER, {}, "x.histogram > 0")])
_fs = {"fast": "fast", "slow": "slow"}
_levels(_M, "ADOSC", "high low close volume", {"fast": 3, "slow": 10}, lambda p: p["slow"] + 1, _fs, [("adosc_bearish", FILTER, {}, "x.adosc < 0"), ("adosc_bullish", FILTER, {}, "x.adosc > 0")])
_levels(_M, "ADOSC", "high low close volume", {"fast": 3, "slow": 10}, lambda p: p["slow"] + 2, _fs, [("adosc_cross_down", TRIGGER, {}, down0("x.adosc")), ("adosc_cross_up", TRIGGER, {}, up0("x.adosc"))])
_levels(_M, "DailyReturn", "close", {}, 2, {}, [("daily_return_negative", FILTER, {"threshold": 0.0}, "x.daily_return < {threshold}"), ("daily_return_positive", FILTER, {"threshold": 0.0}, "x.daily_return > {threshold}")])
_levels(_M, "EaseOfMovement", "high low volume", {"window": 14}, lambda p: p["window"], _w, [("eom_bearish", FILTER, {"threshold": 0.0}, "x.eom < {threshold}"), ("eom_bullish", FILTER, {"threshold": 0.0}, "x.eom > {threshold}")])
_levels(_M, "ForceIndex", "close volume", {"window": 13}, lambda p: p["window"], _w, [("force_bearish", FILTER, {"threshold": 0.0}, "x.fi < {threshold}"), ("force_bullish", FILTER, {"threshold": 0.0}, "x.fi > {threshold}")])
_kvo = {"fast": 34, "slow": 55, "signal_window": 13}
_levels(_M, "KVO", "high low close volume", _kvo, lambda p: p["slow"] + p["signal_window"] + 1, {k: k for k in _kvo}, [("kvo_bearish", FILTER, {}, "x.kvo < x.kvo_signal"), ("kvo_bullish", FILTER, {}, "x.kvo > x.kvo_signal")])
_levels(_M, "KVO", "high low close volume", _kvo, 2, {k: k for k in _kvo}, [("kvo_bearish_cross", TRIGGER, {}, down("x.kvo", "x.kvo_signal")), ("kvo_bullish_cross", TRIGGER, {}, up("x.kvo", "x.kvo_signal"))])
_levels(_M, "ADX", "high low close", {"window": 14}, lambda p: 2 * p["window"], _w, [("adx_bullish_di", FILTER, {}, "x.adx_pos > x.adx_neg"), ("adx_strong_trend", FILTER, {"threshold": 25.0}, "x.adx > {threshold}")])
_levels(_M, "Aroon", "high low", {"window": 25}, lambda p: p["window"], _w, [("aroon_down_trend", FILTER, {"threshold": 70.0}, "x.aroon_down > {threshold}"), ("aroon_up_trend", FILTER, {"threshold": 70.0}, "x.aroon_up > {threshold}")])
signal("aroon_crossover", TRIGGER, "high low", {"window": 25, "direction": "bullish"}, lambda p: p["window"] + 1, lambda p: {"x": request("Aroon", window=p["window"])}, by_direction(lambda p: up("x.aroon_up", "x.aroon_down"), lambda p: down("x.aroon_up", "x.aroon_down")), category=_M)
_levels(_M, "DPO", "close", {"window": 20}, lambda p: p["window"], _w, [("dpo_negative", FILTER, {}, "x.dpo < 0"), ("dpo_positive", FILTER, {}, "x.dpo > 0")])
_kst = {"roc1": 10, "roc2": 15, "roc3": 20, "roc4": 30, "window_sma1": 10, "window_sma2": 10, "window_sma3": 10, "window_sma4": 15, "nsig": 9}
_levels(_M, "KST", "close", _kst, lambda p: p["roc4"] + p["window_sma4"] + p["nsig"], {k.replace("_sma", ""): k for k in _kst}, [("kst_bearish_cross", TRIGGER, {}, down("x.kst", "x.kst_signal")), ("kst_bullish_cross", TRIGGER, {}, up("x.kst", "x.kst_signal"))])
signal(
    "mass_reversal_signal", TRIGGER, "high low", {"window_fast": 9, "window_slow": 25, "threshold_high": 27.0, "threshold_low": 26.5}, lambda p: p["window_slow"] + p["window_fast"],
    lambda p: {"x": request("MassIndex", window_fast=p["window_fast"], window_slow=p["window_slow"])}, f"cond AND NOT coalesce({lag('cond')}, 1 = 0)",
    pre=lambda p: {"cond": f"coalesce(max(x.mass_index) OVER ({frame(10)}) > {num(p['threshold_high'])} AND x.mass_index < {num(p['threshold_low'])}, 1 = 0)"}, category=_M,
)
_mtf = {"higher_tf": "1d", "window": 10, "slope_threshold": 0.0}
signal("multi_tf_trend_bearish", FILTER, "close", _mtf, 2, {}, lambda p: f"higher_tf_slope < -{num(p['slope_threshold'])}", category=_M, special="slope")
signal("multi_tf_trend_bullish", FILTER, "close", _mtf, 2, {}, lambda p: f"higher_tf_slope > {num(p['slope_threshold'])}", category=_M, special="slope")
_levels(_M, "TRIX", "close", {"window": 15}, lambda p: 3 * p["window"], {"window": "window", "window_sign": 9}, [("trix_bearish", FILTER, {"threshold": 0.0}, "x.trix < {threshold}"), ("trix_bullish", FILTER, {"threshold": 0.0}, "x.trix > {threshold}")])
_levels(_M, "Vortex", "high low close", {"window": 14}, lambda p: p["window"], _w, [("vortex_bearish", FILTER, {}, "x.vortex_neg > x.vortex_pos"), ("vortex_bullish", FILTER, {}, "x.vortex_pos > x.vortex_neg")])
signal("vortex_crossover", TRIGGER, "high low close", {"window": 14, "direction": "bullish"}, lambda p: p["window"] + 1, lambda p: {"x": request("Vortex", window=p["window"])}, by_direction(lambda p: up("x.vortex_pos", "x.vortex_neg"), lambda p: down("x.vortex_pos", "x.vortex_neg")), category=_M)
for _n, _pred in (  # a zero delta counts as the negative side
    ("rsi_bullish_divergence", "d.low_price_delta <= 0 AND d.low_indicator_delta > 0"), ("rsi_hidden_bullish_divergence", "d.low_price_delta > 0 AND d.low_indicator_delta <= 0"),
    ("rsi_bearish_divergence", "d.high_price_delta > 0 AND d.high_indicator_delta <= 0"), ("rsi_hidden_bearish_divergence", "d.high_price_delta <= 0 AND d.high_indicator_delta > 0"),
):
    signal(_n, TRIGGER, "close", {"rsi_window": 14, "swing_window": 5, "min_swing_distance": 10}, lambda p: p["rsi_window"] + 2 * p["swing_window"] + p["min_swing_distance"], {}, _pred, category=_M, special="rsi_swings")

# oscillators

_rsi = lambda p: p["window"] + 1
_levels(_O, "RSI", "close", {"window": 14}, _rsi, _w, [
    ("rsi_overbought", FILTER, {"threshold": 70.0}, "x.rsi > {threshold}"), ("rsi_oversold", FILTER, {"threshold": 30.0}, "x.rsi < {threshold}"),
    ("rsi_cross_up", TRIGGER, {"threshold": 50.0}, up0("x.rsi", "{threshold}")), ("rsi_cross_down", TRIGGER, {"threshold": 50.0}, down0("x.rsi", "{threshold}"))])
_st = {"window": 14, "smooth_window": 3}
_levels(_O, "StochasticOscillator", "high low close", _st, lambda p: p["window"], {k: k for k in _st}, [("stoch_overbought", FILTER, {"threshold": 80.0}, "x.stoch_k > {threshold}"), ("stoch_oversold", FILTER, {"threshold": 20.0}, "x.stoch_k < {threshold}")])
_sr = {"window": 14, "smooth1": 3, "smooth2": 3}
_levels(_O, "StochRSI", "close", _sr, lambda p: p["window"] + p["smooth1"] + p["smooth2"], {k: k for k in _sr}, [("stochrsi_overbought", FILTER, {"threshold": 0.8}, "x.stochrsi > {threshold}"), ("stochrsi_oversold", FILTER, {"threshold": 0.2}, "x.stochrsi < {threshold}")])
_levels(_O, "WilliamsR", "high low close", {"window": 14}, lambda p: p["window"], _w, [("williams_r_overbought", FILTER, {"threshold": -20.0}, "x.wr > {threshold}"), ("williams_r_oversold", FILTER, {"threshold": -80.0}, "x.wr < {threshold}")])
_levels(_O, "CMO", "close", {"window": 14}, _rsi, _w, [("cmo_overbought", FILTER, {"threshold": 50.0}, "x.cmo >= {threshold}"), ("cmo_oversold", FILTER, {"threshold": -50.0}, "x.cmo <= {threshold}")])
_levels(_O, "CMO", "close", {"window": 14}, lambda p: p["window"] + 2, _w, [("cmo_cross_up", TRIGGER, {"threshold": -50.0}, up0("x.cmo", "{threshold}")), ("cmo_cross_down", TRIGGER, {"threshold": 50.0}, down0("x.cmo", "{threshold}"))])
_ts = {"window_slow": 25, "window_fast": 13}
_levels(_O, "TSI", "close", _ts, lambda p: p["window_slow"] + p["window_fast"], {k: k for k in _ts}, [("tsi_bullish", FILTER, {"threshold": 0.0}, "x.tsi > {threshold}"), ("tsi_bearish", FILTER, {"threshold": 0.0}, "x.tsi < {threshold}")])
_levels(_O, "BOP", "open high low close", {}, 1, {}, [("bop_bullish", FILTER, {}, "x.bop > 0"), ("bop_bearish", FILTER, {}, "x.bop < 0")])
_levels(_O, "BOP", "open high low close", {}, 2, {}, [("bop_cross_up", TRIGGER, {}, up0("x.bop")), ("bop_cross_down", TRIGGER, {}, down0("x.bop"))])
_uo = {"window_short": 7, "window_medium": 14, "window_long": 28}
_levels(_O, "UltimateOscillator", "high low close", _uo, lambda p: p["window_long"], {"window1": "window_short", "window2": "window_medium", "window3": "window_long", "weight1": 4.0, "weight2": 2.0, "weight3": 1.0}, [("uo_overbought", FILTER, {"threshold": 70.0}, "x.ultimate_oscillator > {threshold}"), ("uo_oversold", FILTER, {"threshold": 30.0}, "x.ultimate_oscillator < {threshold}")])
_levels(_O, "CMF", "high low close volume", {"window": 20}, lambda p: p["window"], _w, [("cmf_bearish", FILTER, {"threshold": 0.0}, "x.cmf < {threshold}"), ("cmf_bullish", FILTER, {"threshold": 0.0}, "x.cmf > {threshold}")])
_levels(_O, "MFI", "high low close volume", {"window": 14}, lambda p: p["window"], _w, [("mfi_overbought", FILTER, {"threshold": 80.0}, "x.mfi > {threshold}"), ("mfi_oversold", FILTER, {"threshold": 20.0}, "x.mfi < {threshold}")])
_levels(_O, "CCI", "high low close", {"window": 20, "constant": 0.015}, lambda p: p["window"], {"window": "window", "constant": "constant"}, [("cci_overbought", FILTER, {"threshold": 100.0}, "x.cci > {threshold}"), ("cci_oversold", FILTER, {"threshold": -100.0}, "x.cci < {threshold}")])
_stc = {"window_slow": 50, "window_fast": 23, "cycle": 10, "smooth1": 3, "smooth2": 3}
_levels(_O, "STC", "close", _stc, lambda p: p["window_slow"] + p["cycle"], {k: k for k in _stc}, [("stc_overbought", FILTER, {"threshold": 75.0}, "x.stc > {threshold}"), ("stc_oversold", FILTER, {"threshold": 25.0}, "x.stc < {threshold}")])

# volatility

_bb = {"window": 20, "window_dev": 2}
_levels(_V, "BollingerBands", "close", _bb, lambda p: p["window"] + 1, {k: k for k in _bb}, [("bb_upper_breakout", TRIGGER, {}, up("close", "x.hband")), ("bb_lower_breakout", TRIGGER, {}, down("close", "x.lband")), ("bb_squeeze", TRIGGER, {"threshold": 5.0}, f"{lag('x.wband')} >= {{threshold}} AND x.wband < {{threshold}}")])
_levels(_V, "BollingerBands", "close", _bb, lambda p: p["window"], {k: k for k in _bb}, [("bb_above_upper", FILTER, {}, "close > x.hband"), ("bb_below_lower", FILTER, {}, "close < x.lband")])
_kc = {"window": 20, "window_atr": 10, "multiplier": 2.0}
_kcm = {"window": "window", "window_atr": "window_atr", "multiplier": "multiplier"}
_levels(_V, "KeltnerChannel", "high low close", _kc, lambda p: max(p["window"], p["window_atr"]), _kcm, [("kc_above_upper", FILTER, {}, "close > x.hband"), ("kc_below_lower", FILTER, {}, "close < x.lband")])
_levels(_V, "KeltnerChannel", "high low close", {**_kc, "original_version": False}, lambda p: max(p["window"], p["window_atr"]) + 1, {**_kcm, "original_version": "original_version"}, [("kc_upper_breakout", TRIGGER, {}, up("close", "x.hband")), ("kc_lower_breakout", TRIGGER, {}, down("close", "x.lband"))])
_levels(_V, "ATR", "high low close", {"window": 14}, lambda p: p["window"], _w, [("atr_high_volatility", FILTER, {"threshold_pct": 3.0}, "x.atr / nullif(close, 0) * 100 > {threshold_pct}")])
_levels(_V, "DonchianChannel", "high low close", {"window": 20}, lambda p: p["window"] + 2, _w, [("dc_upper_breakout", TRIGGER, {}, up("close", "x.hband")), ("dc_lower_breakout", TRIGGER, {}, down("close", "x.lband"))])
_levels(_V, "UlcerIndex", "close", {"window": 14}, lambda p: p["window"], _w, [("ulcer_high_risk", FILTER, {"threshold": 10.0}, "x.ulcer_index > {threshold}"), ("ulcer_low_risk", FILTER, {"threshold": 5.0}, "x.ulcer_index < {threshold}")])
_levels(_V, "NATR", "high low close", {"window": 14}, lambda p: p["window"] + 1, _w, [("natr_high_volatility", FILTER, {"threshold": 2.0}, "x.natr > {threshold}"), ("natr_low_volatility", FILTER, {"threshold": 1.0}, "x.natr < {threshold}")])
_at = {"window": 14, "multiplier": 3.0}
for _n, _kind, _bars, _pred in (
    ("long", FILTER, lambda p: p["window"] + 2, "x.direction = 1"), ("short", FILTER, lambda p: p["window"] + 2, "x.direction = -1"),
    ("flip_up", TRIGGER, 2, f"{lag('x.direction')} = -1 AND x.direction = 1"), ("flip_down", TRIGGER, 2, f"{lag('x.direction')} = 1 AND x.direction = -1"),
):
    signal(f"atr_trailing_stop_{_n}", _kind, "high low close", _at, _bars, lambda p: {"x": request("ATRTrailingStop", **p)}, _pred, category=_V, disabled=True, deprecated=True)
_sb = {"window": 20, "window_atr": 15, "multiplier": 2.0}
_levels(_V, "STARCBands", "high low close", _sb, lambda p: max(p["window"], p["window_atr"]) + 1, {k: k for k in _sb}, [("starc_upper_breakout", FILTER, {}, "close > x.starc_hband"), ("starc_lower_breakout", FILTER, {}, "close < x.starc_lband")])
_ve = {"window": 20, "multiplier": 2.0}
_levels(_V, "VolatilityEnvelope", "close", _ve, lambda p: p["window"] + 1, {k: k for k in _ve}, [("ve_above_upper", FILTER, {}, "close >= x.vstop_hband"), ("ve_below_lower", FILTER, {}, "close <= x.vstop_lband")])
_cl = {"window": 22, "multiplier": 3.0}
_levels(_V, "ChandelierLevels", "high low close", _cl, lambda p: p["window"], {k: k for k in _cl}, [("cl_below_high_offset", FILTER, {}, "close < x.high_offset"), ("cl_above_low_offset", FILTER, {}, "close > x.low_offset")])
_levels(_V, "ChandelierLevels", "high low close", _cl, lambda p: p["window"] + 1, {k: k for k in _cl}, [("cl_high_offset_break", TRIGGER, {}, down("close", "x.high_offset")), ("cl_low_offset_break", TRIGGER, {}, up("close", "x.low_offset"))])
_sq = {"bb_window": 20, "bb_std": 2.0, "kc_window": 20, "kc_atr_mult": 1.5, "mom_window": 12}
_levels(_V, "SqueezeDepth", "high low close", _sq, lambda p: max(p["bb_window"], p["kc_window"]) + 1, {k: k for k in _sq}, [("ttm_squeeze_active", FILTER, {}, "x.squeeze_depth > 0")])
_levels(_V, "SqueezeDepth", "high low close", _sq, 2, {k: k for k in _sq}, [
    ("ttm_squeeze_fired_bullish", TRIGGER, {}, f"{lag('x.squeeze_depth')} > 0 AND x.squeeze_depth <= 0 AND x.momentum > 0"), ("ttm_squeeze_fired_bearish", TRIGGER, {}, f"{lag('x.squeeze_depth')} > 0 AND x.squeeze_depth <= 0 AND x.momentum <= 0")])
_su = {"window": 10, "multiplier": 3.0}
_levels(_V, "SuperTrendTrail", "high low close", _su, lambda p: p["window"] + 1, {k: k for k in _su}, [("supertrend_long", FILTER, {}, "x.regime = 1"), ("supertrend_short", FILTER, {}, "x.regime = -1")])
_levels(_V, "SuperTrendTrail", "high low close", _su, 2, {k: k for k in _su}, [("supertrend_flip_up", TRIGGER, {}, f"{lag('x.regime')} = -1 AND x.regime = 1"), ("supertrend_flip_down", TRIGGER, {}, f"{lag('x.regime')} = 1 AND x.regime = -1")])

# candles: detectors as texts over a bar and the bars before it

_BULL, _BEAR = "close > open", "close < open"
_P = {c: lag(c) for c in ("open", "high", "low", "close")}
_Q = {c: lag(c, 2) for c in ("open", "high", "low", "close")}
_body, _range, _upper, _lower = "abs(close - open)", "(high - low)", "(high - greatest(open, close))", "(least(open, close) - low)"
_pbull, _pbear = f"{_P['close']} > {_P['open']}", f"{_P['close']} < {_P['open']}"
_body_in = {c: f"{f}(open, close) - {f}({_P['open']}, {_P['close']})" for c, f in (("lo", "least"), ("hi", "greatest"))}
_rel_ok = f"{_P['close']} <> 0"
_ratio = lambda x, by: f"{x} / nullif({by}, 0)"


def detectors(p: dict) -> dict[str, str]:
    """Texts of all candle patterns for parameters ``p`` (missing ones take their defaults)."""
    g = {"body_threshold": 0.1, "wick_threshold": 0.25, "upper_wick_max": 0.1, "lower_wick_max": 0.1, "wick_ratio": 2.0, "wick_tolerance": 0.05, "body_max": 0.3, "wick_min": 0.2, "min_penetration": 0.5, "require_gap": False, "tolerance": 0.01, "star_body": 0.3, "min_body_ratio": 0.5, "body_position": 0.33, "close_proximity": 0.25, "window": 7} | p
    n = {k: num(v) for k, v in g.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
    doji = f"{_range} > 0 AND {_body} <= {_range} * {n['body_threshold']}"
    mean20 = f"avg(high - low) OVER ({frame(20)})"
    two = lambda side, a, b: f"{_Q['close']} {a} {_Q['open']} AND {_P['close']} {b} {_P['open']}"
    sized = " AND ".join(f"abs({lag('close', k)} - {lag('open', k)}) >= ({lag('high', k)} - {lag('low', k)}) * {n['min_body_ratio']}" for k in range(3))
    star = f"abs({_P['close']} - {_P['open']}) <= ({_P['high']} - {_P['low']}) * {n['star_body']}"
    marubozu = f"{_range} > 0 AND {_upper} <= {_range} * {n['wick_tolerance']} AND {_lower} <= {_range} * {n['wick_tolerance']}"
    return {
        "doji": doji,
        "long_legged_doji": f"{doji} AND {_upper} >= {_range} * {n['wick_threshold']} AND {_lower} >= {_range} * {n['wick_threshold']}",
        "dragonfly_doji": f"{doji} AND {_upper} <= {_range} * {n['upper_wick_max']} AND {_lower} > {_body}",
        "gravestone_doji": f"{doji} AND {_lower} <= {_range} * {n['lower_wick_max']} AND {_upper} > {_body}",
        "hammer": f"{_body} > 0 AND {_lower} >= {_body} * {n['wick_ratio']} AND {_upper} <= {_body} * {n['upper_wick_max']}",
        "shooting_star": f"{_body} > 0 AND {_upper} >= {_body} * {n['wick_ratio']} AND {_lower} <= {_body} * {n['lower_wick_max']}",
        "marubozu_bullish": f"{marubozu} AND {_BULL}", "marubozu_bearish": f"{marubozu} AND {_BEAR}", "marubozu": f"{marubozu} AND close <> open",
        "spinning_top": f"{_range} > 0 AND {_body} <= {_range} * {n['body_max']} AND {_upper} >= {_range} * {n['wick_min']} AND {_lower} >= {_range} * {n['wick_min']}",
        "bullish_engulfing": f"{_pbear} AND {_BULL} AND {_rel_ok} AND {_body_in['lo']} < 0 AND {_body_in['hi']} > 0",
        "bearish_engulfing": f"{_pbull} AND {_BEAR} AND {_rel_ok} AND {_body_in['lo']} < 0 AND {_body_in['hi']} > 0",
        "bullish_harami": f"{_pbear} AND {_BULL} AND {_rel_ok} AND {_body_in['lo']} > 0 AND {_body_in['hi']} < 0",
        "bearish_harami": f"{_pbull} AND {_BEAR} AND {_rel_ok} AND {_body_in['lo']} > 0 AND {_body_in['hi']} < 0",
        "piercing_line": f"{_pbear} AND {_BULL} AND open < {_P['low' if g['require_gap'] else 'close']} AND close > {_P['close']} + ({_P['open']} - {_P['close']}) * {n['min_penetration']}",
        "dark_cloud_cover": f"{_pbull} AND {_BEAR} AND open > {_P['high' if g['require_gap'] else 'close']} AND close < {_P['close']} - ({_P['close']} - {_P['open']}) * {n['min_penetration']}",
        "tweezer_tops": f"abs(high - {_P['high']}) <= {mean20} * {n['tolerance']} AND {_pbull} AND {_BEAR}",
        "tweezer_bottoms": f"abs(low - {_P['low']}) <= {mean20} * {n['tolerance']} AND {_pbear} AND {_BULL}",
        "morning_star": f"{_Q['close']} < {_Q['open']} AND {star} AND {_BULL} AND close > ({_Q['open']} + {_Q['close']}) / 2",
        "evening_star": f"{_Q['close']} > {_Q['open']} AND {star} AND {_BEAR} AND close < ({_Q['open']} + {_Q['close']}) / 2",
        "three_white_soldiers": f"{two('', '>', '>')} AND {_BULL} AND {_P['close']} > {_Q['close']} AND close > {_P['close']} AND {_P['open']} >= {_Q['open']} AND {_P['open']} <= {_Q['close']} AND open >= {_P['open']} AND open <= {_P['close']} AND {sized}",
        "three_black_crows": f"{two('', '<', '<')} AND {_BEAR} AND {_P['close']} < {_Q['close']} AND close < {_P['close']} AND {_P['open']} <= {_Q['open']} AND {_P['open']} >= {_Q['close']} AND open <= {_P['open']} AND open >= {_P['close']} AND {sized}",
        "three_inside_up": f"{two('', '<', '>')} AND {_P['open']} > {_Q['close']} AND {_P['close']} < {_Q['open']} AND {_BULL} AND close > {_Q['open']}",
        "three_inside_down": f"{two('', '>', '<')} AND {_P['open']} < {_Q['close']} AND {_P['close']} > {_Q['open']} AND {_BEAR} AND close < {_Q['open']}",
        "inside_bar": f"{_rel_ok} AND high < {_P['high']} AND low > {_P['low']}", "outside_bar": f"{_rel_ok} AND high > {_P['high']} AND low < {_P['low']}",
        "bullish_pin_bar": f"{_body} > 0 AND {_lower} >= {_body} * {n['wick_ratio']} AND least(open, close) > low + {_range} * (1 - {n['body_position']})",
        "bearish_pin_bar": f"{_body} > 0 AND {_upper} >= {_body} * {n['wick_ratio']} AND greatest(open, close) < high - {_range} * (1 - {n['body_position']})",
        "two_bar_reversal_bullish": f"{_pbear} AND {_P['close']} - {_P['low']} <= ({_P['high']} - {_P['low']}) * {n['close_proximity']} AND {_BULL} AND high - close <= {_range} * {n['close_proximity']} AND low <= {_P['low']} AND close > {_P['open']}",
        "two_bar_reversal_bearish": f"{_pbull} AND {_P['high']} - {_P['close']} <= ({_P['high']} - {_P['low']}) * {n['close_proximity']} AND {_BEAR} AND close - low <= {_range} * {n['close_proximity']} AND high >= {_P['high']} AND close < {_P['open']}",
        "nr7": f"count(high - low) OVER ({frame(int(g['window']) - 1, 1)}) = {int(g['window']) - 1} AND {_range} < min(high - low) OVER ({frame(int(g['window']) - 1, 1)})",
    }


_four, _oc, _hl = "open high low close", "open close", "high low"
for _n, _detector, _cols, _params, _bars in (
    ("doji", "doji", _four, {"body_threshold": 0.1}, 1), ("long_legged_doji", "long_legged_doji", _four, {"body_threshold": 0.1, "wick_threshold": 0.25}, 1),
    ("dragonfly_doji", "dragonfly_doji", _four, {"body_threshold": 0.1, "upper_wick_max": 0.1}, 1), ("gravestone_doji", "gravestone_doji", _four, {"body_threshold": 0.1, "lower_wick_max": 0.1}, 1),
    ("hammer", "hammer", _four, {"wick_ratio": 2.0, "upper_wick_max": 0.1}, 1), ("shooting_star", "shooting_star", _four, {"wick_ratio": 2.0, "lower_wick_max": 0.1}, 1),
    ("hanging_man", "hammer", _four, {"wick_ratio": 2.0, "upper_wick_max": 0.1}, 1), ("inverted_hammer", "shooting_star", _four, {"wick_ratio": 2.0, "lower_wick_max": 0.1}, 1),
    ("marubozu_bullish", "marubozu_bullish", _four, {"wick_tolerance": 0.05}, 1), ("marubozu_bearish", "marubozu_bearish", _four, {"wick_tolerance": 0.05}, 1),
    ("spinning_top", "spinning_top", _four, {"body_max": 0.3, "wick_min": 0.2}, 1), ("bullish_engulfing", "bullish_engulfing", _oc, {}, 2), ("bearish_engulfing", "bearish_engulfing", _oc, {}, 2),
    ("bullish_harami", "bullish_harami", _oc, {}, 2), ("bearish_harami", "bearish_harami", _oc, {}, 2), ("piercing_line", "piercing_line", _four, {"min_penetration": 0.5, "require_gap": False}, 2),
    ("dark_cloud_cover", "dark_cloud_cover", _four, {"min_penetration": 0.5, "require_gap": False}, 2), ("tweezer_tops", "tweezer_tops", _four, {"tolerance": 0.01}, 2), ("tweezer_bottoms", "tweezer_bottoms", _four, {"tolerance": 0.01}, 2),
    ("morning_star", "morning_star", _four, {"body_threshold": 0.3}, 3), ("evening_star", "evening_star", _four, {"body_threshold": 0.3}, 3),
    ("three_white_soldiers", "three_white_soldiers", _four, {"min_body_ratio": 0.5}, 3), ("three_black_crows", "three_black_crows", _four, {"min_body_ratio": 0.5}, 3),
    ("three_inside_up", "three_inside_up", _oc, {}, 3), ("three_inside_down", "three_inside_down", _oc, {}, 3), ("inside_bar", "inside_bar", "high low close", {}, 2), ("outside_bar", "outside_bar", "high low close", {}, 2),
    ("bullish_pin_bar", "bullish_pin_bar", _four, {"wick_ratio": 2.0, "body_position": 0.33}, 1), ("bearish_pin_bar", "bearish_pin_bar", _four, {"wick_ratio": 2.0, "body_position": 0.33}, 1),
    ("two_bar_reversal_bullish", "two_bar_reversal_bullish", _four, {"close_proximity": 0.25}, 2), ("two_bar_reversal_bearish", "two_bar_reversal_bearish", _four, {"close_proximity": 0.25}, 2),
    ("nr7", "nr7", _hl, {"window": 7}, lambda p: p["window"]),
):
    _star = {"body_threshold": "star_body"} if _n.endswith("star") and _n != "shooting_star" else {}
    signal(f"{_n}_trigger", TRIGGER, _cols, _params, _bars, {}, lambda p, d=_detector, s=_star: detectors({s.get(k, k): v for k, v in p.items()})[d], category="pattern", deprecated=_n in ("hanging_man", "shooting_star"))

for _n, _bars, _members in (
    ("bullish_pattern_recent", 2, "hammer shooting_star bullish_engulfing bullish_harami piercing_line dragonfly_doji tweezer_bottoms bullish_pin_bar morning_star three_white_soldiers three_inside_up"),
    ("bearish_pattern_recent", 2, "hammer shooting_star bearish_engulfing bearish_harami dark_cloud_cover gravestone_doji tweezer_tops bearish_pin_bar evening_star three_black_crows three_inside_down"),
    ("reversal_pattern_bullish", 2, "hammer shooting_star bullish_engulfing piercing_line dragonfly_doji morning_star"), ("reversal_pattern_bearish", 2, "hammer shooting_star bearish_engulfing dark_cloud_cover gravestone_doji evening_star"),
    ("continuation_pattern_bullish", 3, "three_white_soldiers three_inside_up"), ("continuation_pattern_bearish", 3, "three_black_crows three_inside_down"),
    ("indecision_pattern_recent", 2, "doji spinning_top inside_bar nr7"), ("strong_body_recent", 1, "marubozu"),
):
    _any = " OR ".join(f"coalesce({detectors({})[m]}, 1 = 0)" for m in _members.split())
    signal(_n, FILTER, _four, {"window": 5}, _bars, {}, lambda p: f"max(hit) OVER ({frame(p['window'])}) = 1", pre=lambda p, a=_any: {"hit": f"CASE WHEN {a} THEN 1 ELSE 0 END"}, category="pattern")

# alternative data: each part is computed on the non-null rows of its column, as the reading ``v``

_mean, _sd = "avg(v) OVER ({f})", "stddev_samp(v) OVER ({f})"


def _alt(name, kind, column, params, least, values, pred, category, **more):
    """values: columns over the compacted reading, as texts or a function of the parameters."""
    parts = lambda p: {"a": (column, values(p) if callable(values) else values)}
    signal(name, kind, column, params, least, {}, pred, parts=parts, category=category, **more)


def _z(p, by="window"):
    prior = frame(p[by], 1)
    return {"v0": "v", "z": f"CASE WHEN count(v) OVER ({prior}) = {p[by]} AND stddev_samp(v) OVER ({prior}) > 0 THEN (v - avg(v) OVER ({prior})) / stddev_samp(v) OVER ({prior}) END", "full": f"CASE WHEN count(v) OVER ({prior}) = {p[by]} THEN 1 END"}


def _full_mean(p, f="avg"):
    return {"m": f"CASE WHEN count(v) OVER ({frame(p['window'])}) = {p['window']} THEN {f}(v) OVER ({frame(p['window'])}) END"}


_w1, _w0 = (lambda p: p["window"] + 1), (lambda p: p["window"])
_D, _C, _S = "defi_pro", "onchain", "social"
_mean_cross = lambda p: {"v0": "v", "m": f"CASE WHEN count(v) OVER ({frame(p['window'])}) = {p['window']} THEN avg(v) OVER ({frame(p['window'])}) END", "v1": lag("v"), "m1": f"CASE WHEN count(v) OVER ({frame(p['window'], 1)}) = {p['window']} THEN avg(v) OVER ({frame(p['window'], 1)}) END"}
_alt("token_unlock_pressure_low", FILTER, "TokenUnlockPressure", {"threshold": 0.02}, 1, {"v0": "v"}, lambda p: f"a.v0 <= {num(p['threshold'])}", _D)
_alt("token_unlock_cliff_ahead", TRIGGER, "TokenUnlockPressure", {"window": 30, "z_threshold": 2.0, "min_pressure": 0.03}, _w1, _z, lambda p: f"a.full = 1 AND a.v0 >= {num(p['min_pressure'])} AND coalesce(a.z >= {num(p['z_threshold'])}, 1 = 1)", _D)
_alt("funding_negative_regime", FILTER, "PerpFundingRate", {"window": 14}, _w0, _full_mean, "a.m < 0", _D)
_alt("funding_flip_positive", TRIGGER, "PerpFundingRate", {}, 2, {"v0": "v", "v1": lag("v")}, "a.v1 <= 0 AND a.v0 > 0", _D)
_alt("etf_inflow_streak", FILTER, "EtfNetFlow", {"window": 5}, _w0, lambda p: _full_mean(p, "min"), "a.m > 0", _D)
_alt("etf_inflow_spike", TRIGGER, "EtfNetFlow", {"window": 20, "z_threshold": 2.0}, _w1, _z, lambda p: f"a.v0 > 0 AND a.z >= {num(p['z_threshold'])}", _D)
_alt("treasury_growing", FILTER, "TreasuryUsd", {"window": 14}, _w1, lambda p: {"v0": "v", "v1": lag("v", p["window"])}, "a.v0 > a.v1", _D)
_alt("treasury_accumulation_trigger", TRIGGER, "TreasuryUsd", {"window": 20}, _w1, _mean_cross, "a.v1 <= a.m1 AND a.v0 > a.m", _D)
_alt("lending_spread_low", FILTER, "LendingRateSpread", {"threshold": 0.02}, 1, {"v0": "v"}, lambda p: f"a.v0 <= {num(p['threshold'])}", _D)
_alt("lending_spread_widening", TRIGGER, "LendingRateSpread", {"window": 20}, _w1, _mean_cross, "a.v1 <= a.m1 AND a.v0 > a.m", _D)
_alt("smart_money_inflow_spike", TRIGGER, "SmartMoneyNetflow", {"window": 20, "z_threshold": 2.0}, _w1, _z, lambda p: f"a.v0 > 0 AND a.z >= {num(p['z_threshold'])}", _C)
_alt("smart_money_holdings_cross", TRIGGER, "SmartMoneyHoldings", {"window": 20}, _w1, _mean_cross, "a.v1 <= a.m1 AND a.v0 > a.m", _C)
_alt("smart_money_net_positive", FILTER, "SmartMoneyNetflow", {"window": 14}, _w0, lambda p: _full_mean(p, "sum"), "a.m > 0", _C)
_alt("smart_money_holdings_rising", FILTER, "SmartMoneyHoldings", {"window": 14}, _w1, lambda p: {"v0": "v", "v1": lag("v", p["window"])}, "a.v0 > a.v1", _C)
_alt("exchange_outflow_spike", TRIGGER, "ExchangeNetflow", {"window": 20, "z_threshold": 2.0}, _w1, _z, lambda p: f"a.v0 < 0 AND a.z <= -{num(p['z_threshold'])}", _C)
_alt("exchange_net_outflow", FILTER, "ExchangeNetflow", {"window": 14}, _w0, lambda p: _full_mean(p, "sum"), "a.m < 0", _C)
_alt("whale_accumulation_trigger", TRIGGER, "WhaleNetInflow", {"window": 7}, _w1, _mean_cross, "a.m1 <= 0 AND a.m > 0", _C)
_alt("whale_net_accumulation", FILTER, "WhaleNetInflow", {"window": 14}, _w0, lambda p: _full_mean(p, "sum"), "a.m > 0", _C)
_alt("holder_concentration_low", FILTER, "HolderConcentration", {"threshold": 0.5}, 1, {"v0": "v"}, lambda p: f"a.v0 < {num(p['threshold'])}", _C)
_alt("holder_concentration_falling", FILTER, "HolderConcentration", {"window": 14}, _w1, lambda p: {"v0": "v", "v1": lag("v", p["window"])}, "a.v0 < a.v1", _C)
_old = {"disabled": True, "deprecated": True}
_growth = lambda p: {"g": f"CASE WHEN {lag('v', p['window'])} > 0 THEN 100.0 * (v / {lag('v', p['window'])} - 1.0) END", "d": f"v - {lag('v', p['window'])}"}
_roc = lambda n: {"r": f"100.0 * (v - {lag('v', n)}) / nullif({lag('v', n)}, 0)"}
_alt("holder_growth_trend", FILTER, "HolderCount", {"window": 14, "min_growth_pct": 1.0}, _w1, _growth, lambda p: f"a.g >= {num(p['min_growth_pct'])}", _C, **_old)
signal("whale_share_divergence", TRIGGER, "close WhaleHeldShare", {"window": 7, "min_drop_pct": 5.0, "min_share_rise": 0.0}, _w1, {}, lambda p: f"c.r <= -{num(p['min_drop_pct'])} AND a.d > {num(p['min_share_rise'])}", parts=lambda p: {"c": ("close", _roc(p["window"])), "a": ("WhaleHeldShare", _growth(p))}, category=_C, **_old)


def _zscore(v: str, n: int) -> str:
    f = frame(n, 1)
    return f"CASE WHEN count({v}) OVER ({f}) = {n} AND stddev_samp({v}) OVER ({f}) > {num(1e-12)} * greatest(abs(avg({v}) OVER ({f})), 1.0) THEN ({v} - avg({v}) OVER ({f})) / stddev_samp({v}) OVER ({f}) END"


def _shift(p):
    recent, base = frame(p["window"]), frame(p["window_baseline"], p["window"])
    return {"s": f"CASE WHEN count(v) OVER ({recent}) = {p['window']} AND count(v) OVER ({base}) = {p['window_baseline']} THEN avg(v) OVER ({recent}) - avg(v) OVER ({base}) END"}


for _n, _pred in (("surge", lambda p: f"a.z >= {num(p['z_threshold'])}"), ("capitulation", lambda p: f"a.z <= -{num(p['z_threshold'])}")):
    signal(f"social_sentiment_{_n}", TRIGGER, "SocialSentiment SocialAuthors", {"window": 30, "z_threshold": 2.0, "min_authors": 20}, _w1, {}, lambda p, q=_pred: f"{q(p)} AND c.v0 >= {num(p['min_authors'])}", parts=lambda p: {"a": ("SocialSentiment", {"z": _zscore("v", p["window"])}), "c": ("SocialAuthors", {"v0": "v"})}, category=_S, **_old)
_base = {"window": 7, "window_baseline": 60}
_wb = lambda p: p["window"] + p["window_baseline"]
_alt("social_crowd_bullish", FILTER, "SocialNetBullShare", {**_base, "margin": 0.0}, _wb, _shift, lambda p: f"a.s > {num(p['margin'])}", _S, **_old)
_alt("social_crowd_cooling", FILTER, "SocialNetBullShare", {**_base, "margin": 0.0}, _wb, _shift, lambda p: f"a.s <= -{num(p['margin'])}", _S, **_old)
signal("social_price_divergence", TRIGGER, "close SocialNetBullShare", {"window": 7, "min_drop_pct": 3.0, "window_baseline": 60}, _wb, {}, lambda p: f"c.r <= -{num(p['min_drop_pct'])} AND a.s >= -{num(1e-9)}", parts=lambda p: {"c": ("close", _roc(p["window"])), "a": ("SocialNetBullShare", _shift(p))}, category=_S)
# post counts keep their gaps: a null among the bars read gives False
_posts = "ln(1.0 + greatest(XPostCount, 0.0))"
_count = {"lx": f"CASE WHEN XPostCount IS NOT NULL THEN {_posts} END"}
signal("x_post_count_spike", TRIGGER, "XPostCount", {"window": 48, "z_threshold": 3.0, "min_count": 20, "x_query": "all"}, _w1, {}, lambda p: f"({_zscore('lx', p['window'])}) >= {num(p['z_threshold'])} AND XPostCount >= {num(p['min_count'])}", pre=lambda p: _count, category=_S)
signal(
    "x_attention_elevated", FILTER, "XPostCount", {"window": 6, "window_baseline": 72, "min_ratio": 1.5, "x_query": "all"}, _wb, {},
    lambda p: f"count(XPostCount) OVER ({frame(p['window'] + p['window_baseline'])}) = {p['window'] + p['window_baseline']} AND avg(XPostCount) OVER ({frame(p['window_baseline'], p['window'])}) > 0 AND avg(XPostCount) OVER ({frame(p['window'])}) / nullif(avg(XPostCount) OVER ({frame(p['window_baseline'], p['window'])}), 0) >= {num(p['min_ratio'])}", category=_S,
)
signal(
    "x_attention_price_divergence", TRIGGER, "close XPostCount", {"window_price": 24, "min_drop_pct": 5.0, "window": 72, "z_threshold": 2.0, "x_query": "all"}, lambda p: max(p["window"], p["window_price"]) + 1, {},
    lambda p: f"c.r <= -{num(p['min_drop_pct'])} AND ({_zscore('lx', p['window'])}) >= {num(p['z_threshold'])}", pre=lambda p: _count, parts=lambda p: {"c": ("close", _roc(p["window_price"]))}, category=_S,
)

# live signals ask a provider; they are no columns
for _n, _kind, _params in (
    ("x_user_post_trigger", TRIGGER, {"username": None, "topic": None, "max_age_hours": 1}), ("x_topic_mention_trigger", TRIGGER, {"topic": None, "min_mentions": 3, "min_followers": 10000, "time_window_hours": 1}),
    ("x_social_sentiment_trigger", TRIGGER, {"symbol": None, "threshold": 70.0, "time_window_hours": 24}), ("x_user_influence_filter", FILTER, {"username": None, "min_influence_score": 50.0}),
    ("x_topic_sentiment_filter", FILTER, {"topic": None, "min_sentiment": 60.0}),
):
    signal(_n, _kind, "", _params, 0, {}, "1 = 0", category=_S, live="x")


# evaluation

_DOTTED = re.compile(r"\b(\w+)\.(\w+)\b(?!')")


def _fill(text: str, names: dict[str, dict[str, str]]) -> str:
    return _DOTTED.sub(lambda m: names[m[1]][m[2]] if m[1] in names and m[2] in names[m[1]] else m[0], text)


def resolve_params(s: Signal, params: dict | None) -> dict:
    unknown = set(params or {}) - set(s.params)
    if unknown:
        raise TypeError(f"{s.name}: unknown parameters {sorted(unknown)}")
    return {**s.params, **(params or {})}


def _compacted(s: Signal, p: dict) -> dict[str, tuple[str, dict[str, str]]]:
    return s.parts(p) if s.parts else {}


def _with_parts(df: DataFrame, tag: str, parts: dict) -> tuple[DataFrame, dict]:
    """Readings computed on their non-null rows and held until the next one."""
    names = {}
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    for alias, (column, values) in parts.items():
        held = f"{tag}_{alias}"
        small = df.select("symbol", "ts", F.expr(f"try_cast(`{column}` AS DOUBLE)").alias("v")).where("v is not null and not isnan(v)")
        small = small.select("symbol", "ts", F.struct(*[F.expr(t).cast("double").alias(k) for k, t in values.items()]).alias(held))
        df = df.join(small, ["symbol", "ts"], "left").withColumn(held, F.last(held, True).over(w))
        names[alias] = {k: f"{held}.{k}" for k in values}
    return df, names


def signal_frame(bars: DataFrame, rules: list[tuple[str, dict]]) -> DataFrame:
    """``symbol, ts`` and one boolean column per rule (named by the signal; repeated names get a number)."""
    todo = [(SIGNALS[n], resolve_params(SIGNALS[n], p)) for n, p in rules]
    if live := [s.name for s, _ in todo if s.live]:
        raise ValueError(f"live signals are no columns: {live}")
    lost = [not set(s.requires) <= set(bars.columns) for s, _ in todo]
    requests, owner = [], []
    for i, (s, p) in enumerate(todo):
        if not lost[i]:
            for alias, r in s.uses(p).items():
                requests.append(r)
                owner.append((i, alias))
            if s.special == "rsi_swings":
                requests.append(request("RSI", window=p["rsi_window"]))
                owner.append((i, "rsi"))
    builders, out = plan(requests)
    df = to_spark(bars.select(*[c for c in bars.columns if c in {"symbol", "ts"} | {x for s, _ in todo for x in s.requires}]), builders)
    names: dict[int, dict] = {}
    for (i, alias), n in zip(owner, out):
        names.setdefault(i, {})[alias] = n
    pre, preds = {}, []
    for i, (s, p) in enumerate(todo):
        if lost[i]:
            continue
        if s.special == "slope":
            col = f"slope_{i}"
            df = multi_tf_slope(df, p["higher_tf"], p["window"]).withColumnRenamed("higher_tf_slope", col)
            names.setdefault(i, {})[""] = {}
            s = Signal(**{**s.__dict__, "pred": lambda q, f=s.pred, c=col: f(q).replace("higher_tf_slope", c)})
            todo[i] = (s, p)
        if s.special == "rsi_swings":
            r = request("SwingDelta", {"price": "close", "indicator": names[i]["rsi"]["rsi"]}, swing_window=p["swing_window"], min_swing_distance=p["min_swing_distance"])
            b, o = plan([r])
            if not set(o[0].values()) <= set(df.columns):
                df = to_spark(df, b)
            names[i]["d"] = o[0]
        if s.parts:
            df, extra = _with_parts(df, f"alt{i}", s.parts(p))
            names.setdefault(i, {}).update(extra)
        for k, text in (s.pre(p) if s.pre else {}).items():
            pre[f"pre{i}_{k}"] = _fill(text, names.get(i, {}))
    if pre:
        df = df.select("*", *[F.expr(t).alias(k) for k, t in pre.items()])
    used: dict[str, int] = {}
    for i, (s, p) in enumerate(todo):
        used[s.name] = used.get(s.name, 0) + 1
        label = s.name if used[s.name] == 1 else f"{s.name}_{used[s.name]}"
        if lost[i]:
            preds.append(F.lit(False).alias(label))
            continue
        text = s.pred(p)
        for k in s.pre(p) if s.pre else ():
            text = re.sub(rf"\b{k}\b", f"pre{i}_{k}", text)
        text = _fill(text, names.get(i, {}))
        preds.append(F.expr(f"coalesce(({text}) AND {row_no()} >= {int(s.least(p))}, false)").alias(label))
    return df.select("symbol", "ts", *preds)


def signal_sql(bars_sql: str, name: str, params: dict | None = None) -> str | None:
    """DuckDB text of one signal; None where an indicator has no SQL form."""
    s = SIGNALS[name]
    p = resolve_params(s, params)
    if s.special == "rsi_swings":
        builders, out = plan([request("RSI", window=p["rsi_window"])])
        ctes, n = to_sql("bars", builders)
        text = _DOTTED.sub(lambda m: m[2] if m[1] == "d" else m[0], s.pred(p))
        head = swing_sql(f"WITH bars AS ({bars_sql}),\n{ctes.replace('0.0D', '0.0')}", f"s{n}", "close", out[0]["rsi"], p["swing_window"], p["min_swing_distance"])
        return f"{head}\nSELECT symbol, ts, coalesce(({text}) AND {row_no()} >= {int(s.least(p))}, false) AS fired FROM deltas"
    if s.special or s.live:
        return None
    uses = s.uses(p)
    builders, out = plan(list(uses.values()))
    made = to_sql("bars", builders)
    if made is None:
        return None
    ctes, n = made
    names = dict(zip(uses, out))
    last, joins, more = f"s{n}", "", ""
    for alias, (column, values) in _compacted(s, p).items():
        more += f",\n{alias} AS (SELECT symbol, ts, " + ", ".join(f"{t} AS {k}" for k, t in values.items()) + f" FROM (SELECT symbol, ts, {column} AS v FROM bars WHERE {column} IS NOT NULL))"
        joins += f" ASOF LEFT JOIN {alias} ON b.symbol = {alias}.symbol AND b.ts >= {alias}.ts"
        names[alias] = {k: f"{alias}_{k}" for k in values}
    cols = "".join(f", {a}.{k} AS {a}_{k}" for a, (_, v) in _compacted(s, p).items() for k in v)
    pre = "".join(f", {_fill(t, names)} AS {k}" for k, t in (s.pre(p) if s.pre else {}).items())
    text = _fill(s.pred(p), names)
    ctes = ctes.replace("0.0D", "0.0")
    return f"WITH RECURSIVE bars AS ({bars_sql}),\n{ctes}{more},\nj AS (SELECT b.*{cols} FROM {last} b{joins}),\nk AS (SELECT *{pre} FROM j)\nSELECT symbol, ts, coalesce(({text}) AND {row_no()} >= {int(s.least(p))}, false) AS fired FROM k"


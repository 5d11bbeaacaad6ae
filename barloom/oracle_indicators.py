"""SQL of the window indicators at their default parameters, written by hand beside the engine's own texts.

An entry is a list of projections, each over the one before; the first sees the bars numbered by
``n``.  ``[20]`` is the frame of the last 20 bars, ``[w]`` the whole order, ``[all]`` all bars so far.
"""

from __future__ import annotations

import re

_ORDER = "PARTITION BY symbol ORDER BY ts"
_TP = "(high + low + close) / 3"
_WMA = "CASE WHEN len(list({x}) [{k}]) = {k} THEN list_inner_product(list({x}) [{k}], range(1, {k} + 1)::DOUBLE[]) / ({k} * ({k} + 1) / 2) END"
_CLV = "CASE WHEN high > low THEN (2 * close - high - low) / (high - low) ELSE 0 END"


def _wma(x: str, k: int) -> str:
    return _WMA.format(x=x, k=k)


def _full(k: int, text: str, after: int = 0) -> str:
    return f"CASE WHEN n >= {k + after} THEN {text} END"


_TRUE = "greatest(high, coalesce(lag(close) [w], high)) - least(low, coalesce(lag(close) [w], low))"

TABLE: dict[str, list[dict[str, str]]] = {
    "UltimateOscillator": [
        {"bp": "close - least(low, lag(close) [w])", "tr": _TRUE},
        {f"a{k}": _full(k, f"sum(bp) [{k}] / nullif(sum(tr) [{k}], 0)") for k in (7, 14, 28)},
        {"ultimate_oscillator": "CASE WHEN n > 28 THEN 100 * (4 * a7 + 2 * a14 + a28) / 7 END"},
    ],
    "StochasticOscillator": [{"stoch_k": _full(14, "(close - min(low) [14]) / nullif(max(high) [14] - min(low) [14], 0) * 100")}, {"stoch_d": "CASE WHEN count(stoch_k) [3] = 3 THEN avg(stoch_k) [3] END"}],
    "ROC": [{"roc": "(close / lag(close, 12) [w] - 1) * 100"}],
    "AwesomeOscillator": [{"ao": _full(34, "(sum(high) [5] + sum(low) [5]) / 10 - (sum(high) [34] + sum(low) [34]) / 68")}],
    "WilliamsR": [{"wr": _full(14, "(close - max(high) [14]) / nullif(max(high) [14] - min(low) [14], 0) * 100")}],
    "MOM": [{"mom": "close - lag(close, 10) [w]"}],
    "BOP": [{"bop": "(close - open) / nullif(high - low, 0)"}],
    "CMO": [
        {"move": "coalesce(close - lag(close) [w], 0)"},
        {"cmo": _full(14, "100 * sum(move) [14] / nullif(sum(abs(move)) [14], 0)")},
    ],
    "SMA": [{"sma": _full(20, "sum(close) [20] / 20")}],
    "WMA": [{"wma": _wma("close", 20)}],
    "TRIMA": [{"half": _full(10, "sum(close) [10] / 10")}, {"trima": "CASE WHEN count(half) [11] = 11 THEN sum(half) [11] / 11 END"}],
    "EPMA": [{"epma": _full(20, "regr_intercept(close, n) [20] + regr_slope(close, n) [20] * n")}],
    "HMA": [{"a": _wma("close", 8), "b": _wma("close", 16)}, {"raw": "2 * a - b"}, {"hma": "CASE WHEN count(raw) [4] = 4 THEN (raw * 4 + lag(raw) [w] * 3 + lag(raw, 2) [w] * 2 + lag(raw, 3) [w]) / 10 END"}],
    "ALMA": [{"bell": "list_transform(range(0, 21), lambda i: exp(-pow(i - 17, 2) / (2 * pow(21 / 6.0, 2))))"}, {"alma": _full(21, "list_inner_product(list(close) [21], bell) / list_sum(bell)")}],
    "Aroon": [
        {"highs": "list(high) [26]", "lows": "list(low) [26]"},
        {"aroon_up": "CASE WHEN n >= 26 THEN (list_position(highs, list_max(highs)) - 1) * 4.0 END", "aroon_down": "CASE WHEN n >= 26 THEN (list_position(lows, list_min(lows)) - 1) * 4.0 END"},
        {"aroon_indicator": "aroon_up - aroon_down"},
    ],
    "Ichimoku": [
        {"conversion_line": _full(9, "(max(high) [9] + min(low) [9]) / 2"), "base_line": _full(26, "(max(high) [26] + min(low) [26]) / 2"), "span_b": _full(52, "(max(high) [52] + min(low) [52]) / 2")},
        {"span_a": "(conversion_line + base_line) / 2"},
    ],
    "KST": [
        {f"r{k}": f"close / lag(close, {k}) [w] - 1" for k in (10, 15, 20, 30)},
        {f"m{k}": f"CASE WHEN count(r{k}) [{w}] = {w} THEN avg(r{k}) [{w}] END" for k, w in ((10, 10), (15, 10), (20, 10), (30, 15))},
        {"kst": "100 * (m10 + 2 * m15 + 3 * m20 + 4 * m30)"}, {"kst_signal": "CASE WHEN count(kst) [9] = 9 THEN avg(kst) [9] END"}, {"kst_diff": "kst - kst_signal"},
    ],
    "DPO": [{"dpo": _full(20, "lag(close, 11) [w] - sum(close) [20] / 20")}],
    "CCI": [
        {"tp": _TP}, {"tps": "list(tp) [20]"}, {"m": "list_avg(tps)"},
        {"cci": _full(20, "(tp - m) / nullif(0.015 * list_avg(list_transform(tps, lambda x: abs(x - m))), 0)")},
    ],
    "Vortex": [
        {"up": "abs(high - lag(low) [w])", "dn": "abs(low - lag(high) [w])", "tr": _TRUE},
        {"vortex_pos": _full(14, "sum(up) [14] / nullif(sum(tr) [14], 0)", 1), "vortex_neg": _full(14, "sum(dn) [14] / nullif(sum(tr) [14], 0)", 1)}, {"vortex_diff": "vortex_pos - vortex_neg"},
    ],
    "BollingerBands": [
        {"mavg": _full(20, "sum(close) [20] / 20"), "sd": _full(20, "stddev_pop(close) [20]")}, {"hband": "mavg + 2 * sd", "lband": "mavg - 2 * sd"},
        {"wband": "400 * sd / nullif(mavg, 0)", "pband": "(close - lband) / nullif(4 * sd, 0)"},
    ],
    "DonchianChannel": [
        {"hband": "CASE WHEN n > 20 THEN max(high) OVER (ORDER_ ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END", "lband": "CASE WHEN n > 20 THEN min(low) OVER (ORDER_ ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END"},
        {"mband": "(hband + lband) / 2"}, {"wband": "(hband - lband) / nullif(mband, 0) * 100", "pband": "(close - lband) / nullif(hband - lband, 0)"},
    ],
    "UlcerIndex": [{"top": "max(close) [14]"}, {"fall": "pow(100 * (close / top - 1), 2)"}, {"ulcer_index": _full(14, "sqrt(sum(fall) [14] / 14)")}],
    "TrueRange": [{"true_range": _TRUE}],
    "VolatilityEnvelope": [
        {"pc": "lag(close) [w]"}, {"ret": "close / pc - 1"}, {"sd": "CASE WHEN count(ret) [20] = 20 THEN stddev_samp(ret) [20] END"},
        {"vstop_hband": "pc * (1 + 2 * sd)", "vstop_lband": "pc * (1 - 2 * sd)"},
    ],
    "ADI": [{"adi": f"sum(({_CLV}) * volume) [all]"}],
    "OBV": [{"side": "CASE WHEN close > lag(close) [w] THEN 1 WHEN close < lag(close) [w] THEN -1 ELSE 0 END"}, {"obv": "sum(side * volume) [all]"}],
    "CMF": [{"cmf": _full(20, f"sum(({_CLV}) * volume) [20] / nullif(sum(volume) [20], 0)")}],
    "EaseOfMovement": [{"eom": "((high + low) - (lag(high) [w] + lag(low) [w])) * (high - low) * 50000000 / nullif(volume, 0)"}, {"sma_eom": "CASE WHEN count(eom) [14] = 14 THEN avg(eom) [14] END"}],
    "VPT": [{"flow": "(close / lag(close) [w] - 1) * volume"}, {"total": "CASE WHEN n > 1 THEN sum(flow) [all] END"}, {"vpt": "CASE WHEN count(total) [5] = 5 THEN avg(total) [5] END"}],
    "MFI": [
        {"tp": _TP}, {"up": "CASE WHEN tp > lag(tp) [w] THEN tp * volume ELSE 0 END", "dn": "CASE WHEN tp < lag(tp) [w] THEN tp * volume ELSE 0 END"},
        {"mfi": _full(14, "100 * sum(up) [14] / nullif(sum(up) [14] + sum(dn) [14], 0)")},
    ],
    "VWAP": [{"vwap": _full(14, f"sum(({_TP}) * volume) [14] / nullif(sum(volume) [14], 0)")}],
    "VWMA": [{"vwma": _full(20, "sum(close * volume) [20] / nullif(sum(volume) [20], 0)")}],
    "CandleGeometry": [
        {"signed_body": "close - open", "range": "high - low", "upper_wick": "least(high - open, high - close)", "lower_wick": "least(open - low, close - low)"},
        {"body": "abs(signed_body)"}, {"body_ratio": "CASE WHEN range = 0 THEN 0 ELSE body / range END"},
    ],
    "DailyReturn": [{"daily_return": "(close / lag(close) [w] - 1) * 100"}],
    "DailyLogReturn": [{"daily_log_return": "100 * ln(close / lag(close) [w])"}],
    "CumulativeReturn": [{"cumulative_return": "(close / first_value(close) [w] - 1) * 100"}],
    "SocialZScore": [
        {"past": "list(volume) OVER (ORDER_ ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"}, {"m": "list_avg(past)", "sd": "list_stddev_samp(past)"},
        {"zscore": "CASE WHEN len(past) = 30 AND sd > 1e-12 * greatest(abs(m), 1) THEN (volume - m) / sd END"},
    ],
    "SocialBaselineShift": [
        {"recent": _full(7, "sum(volume) [7] / 7"), "past": "list(volume) OVER (ORDER_ ROWS BETWEEN 66 PRECEDING AND 7 PRECEDING)"}, {"baseline": "CASE WHEN len(past) = 60 THEN list_avg(past) END"},
        {"shift": "recent - baseline", "ratio": "CASE WHEN baseline > 0 THEN recent / baseline END"},
    ],
    "OnchainChange": [{"old": "lag(close, 14) [w]"}, {"change": "close - old", "pct_change": "CASE WHEN old > 0 THEN (close - old) / old * 100 END"}],
}


def indicator_oracle(name: str, bars_sql: str, outputs: tuple[str, ...], digits: int) -> str | None:
    """DuckDB text of an indicator by the table above; None for indicators that aren't in it."""
    if name not in TABLE:
        return None
    parts = [f"s0 AS (SELECT *, row_number() OVER ({_ORDER}) AS n FROM ({bars_sql}))"]
    for i, columns in enumerate(TABLE[name]):
        parts.append(f"s{i + 1} AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM s{i})")
    text = ", ".join(parts).replace("ORDER_", _ORDER).replace("[w]", f"OVER ({_ORDER})").replace("[all]", f"OVER ({_ORDER} ROWS UNBOUNDED PRECEDING)")
    text = re.sub(r"(?<=\)) \[(\d+)\]", lambda m: f" OVER ({_ORDER} ROWS {int(m[1]) - 1} PRECEDING)", text)
    return f"WITH {text} SELECT symbol, ts, " + ", ".join(f"round(CAST({o} AS DOUBLE), {digits}) AS {o}" for o in outputs) + f" FROM s{len(parts) - 1}"

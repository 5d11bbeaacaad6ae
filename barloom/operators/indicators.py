"""All indicators, each as a short list of window and scan stages.

An indicator reads the columns named in ``reads`` (renamable), takes ``params`` (a default of
``None`` must be given) and writes ``outputs``.  Undefined values are NULL: before a full window,
on a zero range of per-bar readings, and where a divisor is 0.  (symbol, ts) must be unique;
rows are ordered by ts.  Empty frames give empty frames; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import floor, sqrt

from pyspark.sql import DataFrame

from barloom.functions import text as t
from barloom.functions.text import alma_weights, div, epma_weights, fir, frame, lag, num, rolling, row_no, running, sma, wma_weights
from barloom.plans.staging import Builder, ema, ewm, to_spark, to_sql

OHLC = ("open", "high", "low", "close")
HLC = ("high", "low", "close")


@dataclass(frozen=True)
class Indicator:
    name: str
    reads: tuple[str, ...]
    params: dict
    outputs: tuple[str, ...]
    build: Callable[..., None]

    def resolve(self, params: dict | None) -> dict:
        given = dict(params or {})
        unknown = set(given) - set(self.params)
        if unknown:
            raise ValueError(f"{self.name}: unknown parameters {sorted(unknown)}")
        full = {**self.params, **given}
        missing = [k for k, v in full.items() if v is None and k not in _OPTIONAL.get(self.name, ())]
        if missing:
            raise ValueError(f"{self.name}: missing parameters {missing}")
        return full


INDICATORS: dict[str, Indicator] = {}
_OPTIONAL = {"VPT": ("smoothing_factor",)}


def indicator(name: str, reads, outputs: str, **params):
    reads = (reads,) if isinstance(reads, str) else tuple(reads)

    def keep(f):
        INDICATORS[name] = Indicator(name, reads, params, tuple(outputs.split()), f)
        return f

    return keep


@dataclass(frozen=True)
class Request:
    """An indicator with parameters and, optionally, other input columns."""

    name: str
    params: tuple = ()
    inputs: tuple = ()

    def builder(self) -> Builder:
        spec = INDICATORS[self.name]
        p = spec.resolve(dict(self.params))
        tag = "_".join(str(v).replace(".", "p").replace("-", "m") for v in (*p.values(), *dict(self.inputs).values()))
        b = Builder(f"{self.name.lower()}_{tag}" if tag else self.name.lower(), {c: dict(self.inputs).get(c, c) for c in spec.reads})
        spec.build(b, **p)
        return b


def request(name: str, inputs: dict | None = None, **params) -> Request:
    return Request(name, tuple(sorted(params.items())), tuple(sorted((inputs or {}).items())))


def plan(requests: list[Request]) -> tuple[list[Builder], list[dict[str, str]]]:
    """Builders of the distinct requests, and for each request its output columns by name."""
    made: dict[Request, Builder] = {}
    names = []
    for r in requests:
        if r not in made:
            made[r] = r.builder()
        names.append({o: made[r].names[o] for o in INDICATORS[r.name].outputs})
    return list(made.values()), names


def compute(bars: DataFrame, name: str, params: dict | None = None, *, inputs: dict | None = None, prefix: str = "") -> DataFrame:
    """``bars`` with the indicator's outputs as columns ``prefix + output``."""
    return compute_frame(bars, [(prefix, request(name, inputs, **(params or {})))])


def compute_frame(bars: DataFrame, wanted: list[tuple[str, Request]]) -> DataFrame:
    """A feature matrix: the outputs of several requests, computed together and aligned on (symbol, ts)."""
    for _, r in wanted:
        missing = [c for c in (dict(r.inputs).get(x, x) for x in INDICATORS[r.name].reads) if c not in bars.columns]
        if missing:
            raise ValueError(f"{r.name}: missing data {missing}")
    builders, names = plan([r for _, r in wanted])
    df = to_spark(bars, builders)
    clash = {p + o for p, r in wanted for o in INDICATORS[r.name].outputs}
    return df.selectExpr(*[f"`{c}`" for c in bars.columns if c not in clash], *[f"CAST(`{n[o]}` AS DOUBLE) AS `{p}{o}`" for (p, r), n in zip(wanted, names) for o in INDICATORS[r.name].outputs])


def oracle(bars_sql: str, r: Request) -> str | None:
    """DuckDB text of the same request; None where a scan has no SQL form."""
    builders, names = plan([r])
    made = to_sql("bars", builders)
    if made is None:
        return None
    ctes, n = made
    return f"WITH RECURSIVE bars AS ({bars_sql}),\n{ctes.replace('0.0D', '0.0')}\nSELECT symbol, ts, " + ", ".join(f"round(CAST({g} AS DOUBLE), 6) AS {o}" for o, g in names[0].items()) + f" FROM s{n}"


# shared pieces


def _true_range(b: Builder) -> None:
    b.sql(tr=f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))")


def _atr(b: Builder, n: int, out: str = "atr") -> None:
    """True range, seeded by the mean of the first n, then smoothed by 1/n."""
    _true_range(b)
    b.sql(atr_in=f"CASE WHEN {row_no()} = {n} THEN avg(tr) OVER ({frame(n)}) WHEN {row_no()} > {n} THEN tr END")
    b.scan(ewm(out, "atr_in", 1 / n, 1))


def _rsi(b: Builder, n: int) -> None:
    b.sql(d=f"close - {lag('close')}")
    b.sql(up="CASE WHEN d > 0 THEN d ELSE 0.0 END", dn="CASE WHEN d < 0 THEN -d ELSE 0.0 END")
    b.scan(ewm("au", "up", 1 / n, n), ewm("ad", "dn", 1 / n, n))
    b.sql(rsi=f"CASE WHEN ad = 0 AND au > 0 THEN 100.0 WHEN ad = 0 THEN NULL ELSE 100.0 - 100.0 / (1.0 + {div('au', 'ad')}) END")


# momentum


@indicator("RSI", "close", "rsi", window=14)
def _(b, window):
    _rsi(b, window)


@indicator("TSI", "close", "tsi", window_slow=25, window_fast=13)
def _(b, window_slow, window_fast):
    b.sql(d=f"close - {lag('close')}")
    b.sql(a="abs(d)")
    b.scan(ema("d1", "d", window_slow), ema("d2", "d1", window_fast), ema("a1", "a", window_slow), ema("a2", "a1", window_fast), ("tsi", "calc", "100 * div(d2, a2)"))


@indicator("UltimateOscillator", HLC, "ultimate_oscillator", window1=7, window2=14, window3=28, weight1=4.0, weight2=2.0, weight3=1.0)
def _(b, window1, window2, window3, weight1, weight2, weight3):
    pc = lag("close")
    b.sql(bp=f"CASE WHEN {pc} IS NOT NULL THEN close - least(low, {pc}) END", tr=f"greatest(high - low, abs(high - {pc}), abs(low - {pc}))")
    part = {f"a{i}": div(rolling("sum", "bp", n), rolling("sum", "tr", n)) for i, n in enumerate((window1, window2, window3), 1)}
    b.sql(**part)
    b.sql(ultimate_oscillator=f"100.0 * ({num(weight1)} * a1 + {num(weight2)} * a2 + {num(weight3)} * a3) / {num(weight1 + weight2 + weight3)}")


@indicator("StochasticOscillator", HLC, "stoch_k stoch_d", window=14, smooth_window=3)
def _(b, window, smooth_window):
    b.sql(hh=rolling("max", "high", window), ll=rolling("min", "low", window))
    b.sql(stoch_k=f"100.0 * {div('close - ll', 'hh - ll')}")
    b.sql(stoch_d=sma("stoch_k", smooth_window))


@indicator("KAMA", "close", "kama", window=10, pow1=2, pow2=30)
def _(b, window, pow1, pow2):
    b.sql(step=f"abs(close - {lag('close')})", move=f"abs(close - {lag('close', window)})", n=row_no(), mean=sma("close", window))
    b.sql(path=rolling("sum", "step", window))
    fast, slow = 2 / (pow1 + 1), 2 / (pow2 + 1)
    b.sql(rate=f"CASE WHEN n > {window} THEN power(coalesce({div('move', 'path')}, 0.0) * {num(fast - slow)} + {num(slow)}, 2) END", seed=f"CASE WHEN n = {window} THEN mean END")
    b.scan((["kama"], "Adaptive", (), ["close", "rate", "seed"]))


@indicator("ROC", "close", "roc", window=12)
def _(b, window):
    b.sql(roc=f"100.0 * {div('close - ' + lag('close', window), lag('close', window))}")


@indicator("AwesomeOscillator", ("high", "low"), "ao", window1=5, window2=34)
def _(b, window1, window2):
    b.sql(m="0.5 * (high + low)")
    b.sql(ao=f"({sma('m', window1)}) - ({sma('m', window2)})")


@indicator("WilliamsR", HLC, "wr", window=14)
def _(b, window):
    b.sql(hh=rolling("max", "high", window), ll=rolling("min", "low", window))
    b.sql(wr=f"-100.0 * {div('hh - close', 'hh - ll')}")


@indicator("StochRSI", "close", "stochrsi stochrsi_k stochrsi_d", window=14, smooth1=3, smooth2=3)
def _(b, window, smooth1, smooth2):
    _rsi(b, window)
    b.sql(lo=rolling("min", "rsi", window), hi=rolling("max", "rsi", window))
    b.sql(stochrsi=div("rsi - lo", "hi - lo"))
    b.sql(stochrsi_k=sma("stochrsi", smooth1))
    b.sql(stochrsi_d=sma("stochrsi_k", smooth2))


def _percent_oscillator(b, x, out, slow, fast, sign):
    b.scan(ema("f", x, fast), ema("s", x, slow), (out, "calc", "100 * div(f - s, s)"), ema(f"{out}_signal", out, sign), (f"{out}_hist", "calc", f"{out} - {out}_signal"))


@indicator("PPO", "close", "ppo ppo_signal ppo_hist", window_slow=26, window_fast=12, window_sign=9)
def _(b, window_slow, window_fast, window_sign):
    _percent_oscillator(b, "close", "ppo", window_slow, window_fast, window_sign)


@indicator("PVO", "volume", "pvo pvo_signal pvo_hist", window_slow=26, window_fast=12, window_sign=9)
def _(b, window_slow, window_fast, window_sign):
    _percent_oscillator(b, "volume", "pvo", window_slow, window_fast, window_sign)


@indicator("MOM", "close", "mom", window=10)
def _(b, window):
    b.sql(mom=f"close - {lag('close', window)}")


@indicator("BOP", OHLC, "bop")
def _(b):
    b.sql(bop=div("close - open", "high - low"))


@indicator("CMO", "close", "cmo", window=14)
def _(b, window):
    b.sql(d=f"close - {lag('close')}")
    b.sql(up="CASE WHEN d > 0 THEN d ELSE 0.0 END", dn="CASE WHEN d < 0 THEN -d ELSE 0.0 END")
    b.sql(u=rolling("sum", "up", window), v=rolling("sum", "dn", window))
    b.sql(cmo=f"100.0 * {div('u - v', 'u + v')}")


# trend


@indicator("SMA", "close", "sma", window=20)
def _(b, window):
    b.sql(sma=sma("close", window))


@indicator("EMA", "close", "ema", window=20)
def _(b, window):
    b.scan(ema("ema", "close", window))


@indicator("WMA", "close", "wma", window=20)
def _(b, window):
    b.sql(wma=fir("close", wma_weights(window)))


@indicator("DEMA", "close", "dema", window=20)
def _(b, window):
    b.scan(ema("e1", "close", window), ema("e2", "e1", window), ("dema", "calc", "2 * e1 - e2"))


@indicator("TEMA", "close", "tema", window=20)
def _(b, window):
    b.scan(ema("e1", "close", window), ema("e2", "e1", window), ema("e3", "e2", window), ("tema", "calc", "3 * e1 - 3 * e2 + e3"))


@indicator("TRIMA", "close", "trima", window=20)
def _(b, window):
    n1, n2 = ((window + 1) // 2,) * 2 if window % 2 else (window // 2, window // 2 + 1)
    b.sql(inner_mean=sma("close", n1))
    b.sql(trima=sma("inner_mean", n2))


@indicator("SMMA", "close", "smma", window=14)
def _(b, window):
    b.scan(ewm("smma", "close", 1 / window, window))


@indicator("EPMA", "close", "epma", window=20)
def _(b, window):
    b.sql(epma=fir("close", epma_weights(window)))


@indicator("HMA", "close", "hma", window=16)
def _(b, window):
    b.sql(half=fir("close", wma_weights(window // 2)), full_mean=fir("close", wma_weights(window)))
    b.sql(raw="2.0 * half - full_mean")
    b.sql(hma=fir("raw", wma_weights(floor(sqrt(window)))))


@indicator("ALMA", "close", "alma", window=21, offset=0.85, sigma=6.0)
def _(b, window, offset, sigma):
    b.sql(alma=fir("close", alma_weights(window, offset, sigma)))


@indicator("T3", "close", "t3", window=10, volume_factor=0.7)
def _(b, window, volume_factor):
    a = volume_factor
    c = (-(a**3), 3 * a**2 + 3 * a**3, -6 * a**2 - 3 * a - 3 * a**3, 1 + 3 * a + a**3 + 3 * a**2)
    chain = [ema(f"e{i}", "close" if i == 1 else f"e{i - 1}", window) for i in range(1, 7)]
    b.scan(*chain, ("t3", "calc", f"({c[0]!r}) * e6 + ({c[1]!r}) * e5 + ({c[2]!r}) * e4 + ({c[3]!r}) * e3"))


@indicator("MAMA", ("high", "low"), "mama fama", fast_limit=0.5, slow_limit=0.05, warmup_bars=64)
def _(b, fast_limit, slow_limit, warmup_bars):
    b.sql(price="(high + low) / 2.0")
    b.scan((["mama", "fama"], "Mesa", (fast_limit, slow_limit, warmup_bars), ["price"]))


@indicator("MACD", "close", "macd signal histogram", window_slow=26, window_fast=12, window_sign=9)
def _(b, window_slow, window_fast, window_sign):
    b.scan(ema("f", "close", window_fast), ema("s", "close", window_slow), ("macd", "calc", "f - s"), ema("signal", "macd", window_sign), ("histogram", "calc", "macd - signal"))


@indicator("Aroon", ("high", "low"), "aroon_up aroon_down aroon_indicator", window=25)
def _(b, window):
    n = window
    b.sql(hh=rolling("max", "high", n + 1), ll=rolling("min", "low", n + 1))

    def since(x, best):  # the oldest of equal extremes counts
        return f"CASE WHEN {best} IS NULL THEN NULL " + " ".join(f"WHEN {lag(x, k)} = {best} THEN {num(100 * (n - k) / n)}" for k in range(n, -1, -1)) + " END"

    b.sql(aroon_up=since("high", "hh"), aroon_down=since("low", "ll"))
    b.sql(aroon_indicator="aroon_up - aroon_down")


@indicator("TRIX", "close", "trix trix_signal", window=15, window_sign=9)
def _(b, window, window_sign):
    b.scan(ema("e1", "close", window), ema("e2", "e1", window), ema("e3", "e2", window))
    b.sql(trix=f"100.0 * {div('e3 - ' + lag('e3'), lag('e3'))}")
    b.scan(ema("trix_signal", "trix", window_sign))


@indicator("MassIndex", ("high", "low"), "mass_index", window_fast=9, window_slow=25)
def _(b, window_fast, window_slow):
    b.sql(spread="high - low")
    b.scan(ema("e1", "spread", window_fast), ema("e2", "e1", window_fast), ("ratio", "calc", "div(e1, e2)"))
    b.sql(mass_index=rolling("sum", "ratio", window_slow))


@indicator("Ichimoku", ("high", "low"), "conversion_line base_line span_a span_b", window1=9, window2=26, window3=52, visual=False)
def _(b, window1, window2, window3, visual):
    mid = {f"m{i}": f"0.5 * (({rolling('max', 'high', n)}) + ({rolling('min', 'low', n)}))" for i, n in enumerate((window1, window2, window3), 1)}
    b.sql(**mid)
    b.sql(conversion_line="m1", base_line="m2", a="0.5 * (m1 + m2)", b="m3")
    if visual:  # shifted ahead; the gap holds the mean of the whole series
        w = "PARTITION BY symbol"
        b.sql(span_a=f"CASE WHEN {row_no()} <= {window2} THEN avg(a) OVER ({w}) ELSE {lag('a', window2)} END", span_b=f"CASE WHEN {row_no()} <= {window2} THEN avg(b) OVER ({w}) ELSE {lag('b', window2)} END")
    else:
        b.sql(span_a="a", span_b="b")


@indicator("KST", "close", "kst kst_signal kst_diff", roc1=10, roc2=15, roc3=20, roc4=30, window1=10, window2=10, window3=10, window4=15, nsig=9)
def _(b, roc1, roc2, roc3, roc4, window1, window2, window3, window4, nsig):
    b.sql(**{f"r{i}": div(f"close - {lag('close', n)}", lag("close", n)) for i, n in enumerate((roc1, roc2, roc3, roc4), 1)})
    b.sql(**{f"m{i}": sma(f"r{i}", n) for i, n in enumerate((window1, window2, window3, window4), 1)})
    b.sql(kst="100.0 * (m1 + 2.0 * m2 + 3.0 * m3 + 4.0 * m4)")
    b.sql(kst_signal=sma("kst", nsig))
    b.sql(kst_diff="kst - kst_signal")


@indicator("DPO", "close", "dpo", window=20)
def _(b, window):
    b.sql(dpo=f"{lag('close', int(0.5 * window) + 1)} - ({sma('close', window)})")


@indicator("CCI", HLC, "cci", window=20, constant=0.015)
def _(b, window, constant):
    b.sql(tp="(high + low + close) / 3.0")
    b.sql(m=sma("tp", window))
    b.sql(mad="(" + " + ".join(f"abs({lag('tp', k)} - m)" for k in range(window)) + f") / {num(window)}")
    b.sql(cci=div("tp - m", f"{num(constant)} * mad"))


@indicator("ADX", HLC, "adx adx_pos adx_neg", window=14)
def _(b, window):
    n, pc = window, lag("close")
    up, down = f"(high - {lag('high')})", f"({lag('low')} - low)"
    b.sql(
        no=row_no(), tr=f"CASE WHEN {pc} IS NOT NULL THEN greatest(high, {pc}) - least(low, {pc}) END",
        pos=f"CASE WHEN {up} > {down} AND {up} > 0 THEN {up} ELSE 0.0 END", neg=f"CASE WHEN {down} > {up} AND {down} > 0 THEN {down} ELSE 0.0 END",
    )
    # Wilder sums start from the total of the first n + 1 bars
    b.sql(**{f"{x}_in": f"CASE WHEN no = {n + 1} THEN sum({x}) OVER ({frame(n + 1)}) / {num(n)} WHEN no > {n + 1} THEN {x} END" for x in ("tr", "pos", "neg")})
    b.scan(ewm("tr_w", "tr_in", 1 / n, 1), ewm("pos_w", "pos_in", 1 / n, 1), ewm("neg_w", "neg_in", 1 / n, 1))
    b.sql(p=f"100.0 * {div('pos_w', 'tr_w')}", q=f"100.0 * {div('neg_w', 'tr_w')}")
    b.sql(dx=f"100.0 * {div('abs(p - q)', 'p + q')}")
    b.sql(dx_in=f"CASE WHEN no = {2 * n} THEN avg(dx) OVER ({frame(n)}) WHEN no > {2 * n} THEN dx END", adx_pos=f"CASE WHEN no > {n + 1} THEN p END", adx_neg=f"CASE WHEN no > {n + 1} THEN q END")
    b.scan(ewm("adx", "dx_in", 1 / n, 1))


@indicator("Vortex", HLC, "vortex_pos vortex_neg vortex_diff", window=14)
def _(b, window):
    _true_range(b)
    b.sql(a=f"abs(high - {lag('low')})", c=f"abs(low - {lag('high')})")
    total = rolling("sum", "tr", window)
    b.sql(vortex_pos=div(rolling("sum", "a", window), total), vortex_neg=div(rolling("sum", "c", window), total))
    b.sql(vortex_diff="vortex_pos - vortex_neg")


@indicator("PSAR", HLC, "psar psar_up psar_down psar_up_indicator psar_down_indicator", step=0.02, max_step=0.2)
def _(b, step, max_step):
    b.scan((["level", "af", "side"], "StopAndReverse", (step, max_step), list(HLC)))
    b.sql(psar="coalesce(level, close)", psar_up="CASE WHEN side > 0 THEN level END", psar_down="CASE WHEN side < 0 THEN level END")
    flag = lambda x: f"CASE WHEN {x} IS NOT NULL AND {lag(x)} IS NULL THEN 1.0 ELSE 0.0 END"
    b.sql(psar_up_indicator=flag("psar_up"), psar_down_indicator=flag("psar_down"))


@indicator("STC", "close", "stc", window_slow=50, window_fast=23, cycle=10, smooth1=3, smooth2=3)
def _(b, window_slow, window_fast, cycle, smooth1, smooth2):
    b.scan(ema("f", "close", window_fast), ema("s", "close", window_slow), ("macd", "calc", "f - s"))
    b.sql(lo1=rolling("min", "macd", cycle), hi1=rolling("max", "macd", cycle))
    b.sql(k1=f"100.0 * {div('macd - lo1', 'hi1 - lo1')}")
    b.scan(ema("d1", "k1", smooth1))
    b.sql(lo2=rolling("min", "d1", cycle), hi2=rolling("max", "d1", cycle))
    b.sql(k2=f"100.0 * {div('d1 - lo2', 'hi2 - lo2')}")
    b.scan(ema("stc", "k2", smooth2))


def _swings(b: Builder, window: int) -> None:
    """Strict extremes of price and indicator, paired: for each price swing far enough from the last one, the nearest indicator swings of both."""
    w = window
    b.sql(no=row_no())
    ahead = f"{t.W} ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING"
    behind = f"{t.W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING"
    cols = {}
    for x in ("price", "indicator"):
        whole = f"count({x}) OVER ({behind}) = count(*) OVER ({behind}) AND count({x}) OVER ({ahead}) = count(*) OVER ({ahead})"
        cols[f"{x}_low"] = f"CASE WHEN {whole} AND {x} < min({x}) OVER ({behind}) AND {x} < min({x}) OVER ({ahead}) THEN no END"
        cols[f"{x}_high"] = f"CASE WHEN {whole} AND {x} > max({x}) OVER ({behind}) AND {x} > max({x}) OVER ({ahead}) THEN no END"
    b.sql(**cols)
    upto, later = f"{t.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "PARTITION BY symbol ORDER BY ts DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    # values ride along in running extremes of (number, value): the last swing is the greatest number, the next one the least
    near = {}
    for s in ("low", "high"):
        near[f"before_{s}"] = f"max(indicator_{s}) OVER ({upto})"
        near[f"after_{s}"] = f"min(indicator_{s}) OVER ({later})"
        near[f"held_{s}"] = f"max(CASE WHEN indicator_{s} IS NOT NULL THEN struct(no AS n, indicator AS v) END) OVER ({upto}).v"
        near[f"next_{s}"] = f"min(CASE WHEN indicator_{s} IS NOT NULL THEN struct(no AS n, indicator AS v) END) OVER ({later}).v"
    b.sql(**near)
    pick = {}
    for s in ("low", "high"):
        behind_is_nearer = f"before_{s} IS NOT NULL AND (after_{s} IS NULL OR no - before_{s} <= after_{s} - no)"
        pick[f"near_{s}"] = f"CASE WHEN {behind_is_nearer} THEN before_{s} ELSE after_{s} END"
        pick[f"near_v_{s}"] = f"CASE WHEN {behind_is_nearer} THEN held_{s} ELSE next_{s} END"
    b.sql(**pick)
    prev = f"{t.W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    b.sql(**{f"prior_{s}": f"max(CASE WHEN price_{s} IS NOT NULL THEN struct(no AS n, price AS p, near_{s} AS i, near_v_{s} AS v) END) OVER ({prev})" for s in ("low", "high")})


def _swing_deltas(b: Builder, window: int, least: int) -> None:
    """Deltas at the bar that confirms a pair: ``window`` bars behind the later of the price and the indicator swing."""
    _swings(b, window)
    made = {}
    for s in ("low", "high"):
        ok = f"price_{s} IS NOT NULL AND no - prior_{s}.n >= {least} AND near_{s} <> prior_{s}.i"
        made[f"fire_{s}"] = f"CASE WHEN {ok} THEN struct(no AS n, greatest(no, near_{s}) + {window} AS at, price - prior_{s}.p AS dp, near_v_{s} - prior_{s}.v AS di) END"
    b.sql(**made)


@indicator("SwingDelta", ("price", "indicator"), "low_price_delta low_indicator_delta high_price_delta high_indicator_delta", swing_window=5, min_swing_distance=10)
def _(b, swing_window, min_swing_distance):
    _swing_deltas(b, swing_window, min_swing_distance)
    b.stages.append(("scatter", {o: (b.names[f"fire_{o.split('_')[0]}"], "dp" if "price" in o else "di", b._own(o)) for o in ("low_price_delta", "low_indicator_delta", "high_price_delta", "high_indicator_delta")}, b.names["no"]))


@indicator("Divergence", ("price", "indicator"), "regular_bullish regular_bearish hidden_bullish hidden_bearish", swing_window=5, min_swing_distance=10)
def _(b, swing_window, min_swing_distance):
    # each firing pair sets a flag and none is taken back, unlike deltas, of which the later pair's stay
    _swing_deltas(b, swing_window, min_swing_distance)
    f, g = b.names["fire_low"], b.names["fire_high"]
    flags = {"regular_bullish": (f, "dp < 0 AND di > 0"), "hidden_bullish": (f, "dp > 0 AND di < 0"), "regular_bearish": (g, "dp > 0 AND di < 0"), "hidden_bearish": (g, "dp < 0 AND di > 0")}
    b.stages.append(("flags", {k: (c, p, b._own(k)) for k, (c, p) in flags.items()}, b.names["no"]))


@indicator("HeikinAshi", OHLC, "ha_open ha_high ha_low ha_close")
def _(b):
    b.sql(ha_close="(open + high + low + close) / 4.0")
    b.sql(feed=f"CASE WHEN {row_no()} = 1 THEN (open + close) / 2.0 ELSE {lag('ha_close')} END")
    b.scan(ewm("ha_open", "feed", 0.5, 1))
    b.sql(ha_high="greatest(high, ha_open, ha_close)", ha_low="least(low, ha_open, ha_close)")


@indicator("WilliamsAlligator", ("high", "low"), "jaw teeth lips", jaw=13, teeth=8, lips=5, jaw_offset=8, teeth_offset=5, lips_offset=3)
def _(b, jaw, teeth, lips, jaw_offset, teeth_offset, lips_offset):
    b.sql(m="(high + low) / 2.0")
    b.scan(*[ewm(f"{k}_now", "m", 1 / n, n) for k, n in (("jaw", jaw), ("teeth", teeth), ("lips", lips))])
    b.sql(jaw=lag("jaw_now", jaw_offset), teeth=lag("teeth_now", teeth_offset), lips=lag("lips_now", lips_offset))


@indicator("SuperTrend", HLC, "supertrend direction long_band short_band", window=10, multiplier=3.0)
def _(b, window, multiplier):
    _ratchet(b, window, multiplier)
    late = f"no > {window}"
    b.sql(direction=f"CASE WHEN {late} THEN side END", long_band=f"CASE WHEN {late} AND side = 1 THEN lo END", short_band=f"CASE WHEN {late} AND side = -1 THEN up END")
    b.sql(supertrend="coalesce(long_band, short_band)")


def _ratchet(b: Builder, window: int, multiplier: float) -> None:
    _atr(b, window)
    b.sql(upper0=f"(high + low) / 2.0 + {num(multiplier)} * atr", lower0=f"(high + low) / 2.0 - {num(multiplier)} * atr", no=row_no())
    b.scan((["side", "up", "lo"], "Ratchet", (), ["close", "upper0", "lower0"]))


@indicator("ParabolicSAR", HLC, "psar af", step=0.02, max_step=0.2)
def _(b, step, max_step):
    b.scan((["psar", "af", "side"], "StopAndReverse", (step, max_step), list(HLC)))


# volatility


@indicator("ATR", HLC, "atr", window=14)
def _(b, window):
    _atr(b, window)


def _bollinger(b: Builder, n: int, dev: float, pre: str = "") -> None:
    b.sql(**{f"{pre}mavg": sma("close", n), f"{pre}sd": rolling("stddev_pop", "close", n)})
    b.sql(**{f"{pre}hband": f"{pre}mavg + {num(dev)} * {pre}sd", f"{pre}lband": f"{pre}mavg - {num(dev)} * {pre}sd"})


@indicator("BollingerBands", "close", "mavg hband lband wband pband", window=20, window_dev=2)
def _(b, window, window_dev):
    _bollinger(b, window, window_dev)
    b.sql(wband=f"100.0 * {div('hband - lband', 'mavg')}", pband=div("close - lband", "hband - lband"))


def _keltner(b: Builder, n: int, n_atr: int, mult: float, pre: str = "") -> None:
    _atr(b, n_atr, f"{pre}atr")
    b.scan(ema(f"{pre}mband", "close", n))
    b.sql(**{f"{pre}hband": f"{pre}mband + {num(mult)} * {pre}atr", f"{pre}lband": f"{pre}mband - {num(mult)} * {pre}atr"})


@indicator("KeltnerChannel", HLC, "mband hband lband wband pband", window=20, window_atr=10, original_version=False, multiplier=2)
def _(b, window, window_atr, original_version, multiplier):
    if original_version:
        if (window_atr, multiplier) != (10, 2):
            raise ValueError("window_atr and multiplier have no meaning in the original version")
        b.sql(tp="(high + low + close) / 3.0", h0="(4.0 * high - 2.0 * low + close) / 3.0", l0="(-2.0 * high + 4.0 * low + close) / 3.0")
        b.sql(mband=sma("tp", window), hband=sma("h0", window), lband=sma("l0", window))
    else:
        _keltner(b, window, window_atr, multiplier)
    b.sql(wband=f"100.0 * {div('hband - lband', 'mband')}", pband=div("close - lband", "hband - lband"))


@indicator("DonchianChannel", HLC, "hband lband mband wband pband", window=20, include_current_bar=False)
def _(b, window, include_current_bar):
    back = 0 if include_current_bar else 1
    b.sql(hband=rolling("max", "high", window, back), lband=rolling("min", "low", window, back))
    b.sql(mband="(hband + lband) / 2.0")
    b.sql(wband=f"100.0 * {div('hband - lband', 'mband')}", pband=div("close - lband", "hband - lband"))


@indicator("UlcerIndex", "close", "ulcer_index", window=14)
def _(b, window):
    b.sql(top=f"max(close) OVER ({frame(window)})")
    b.sql(r2=f"power(100.0 * {div('close - top', 'top')}, 2)")
    b.sql(ulcer_index=f"sqrt({sma('r2', window)})")


@indicator("TrueRange", HLC, "true_range")
def _(b):
    b.sql(true_range=f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))")


@indicator("NATR", HLC, "natr", window=14)
def _(b, window):
    _atr(b, window)
    b.sql(natr=f"100.0 * {div('atr', 'close')}")


@indicator("ATRTrailingStop", HLC, "trailing_stop direction", window=14, multiplier=3.0)
def _(b, window, multiplier):
    _atr(b, window)
    b.sql(reach=f"{num(multiplier)} * atr")
    b.scan((["trailing_stop", "direction"], "TrailingStop", (window,), ["close", "reach"]))


@indicator("STARCBands", HLC, "starc_mid starc_hband starc_lband", window=20, window_atr=15, multiplier=2)
def _(b, window, window_atr, multiplier):
    _atr(b, window_atr)
    b.sql(starc_mid=sma("close", window))
    b.sql(starc_hband=f"starc_mid + {num(multiplier)} * atr", starc_lband=f"starc_mid - {num(multiplier)} * atr")


@indicator("VolatilityEnvelope", "close", "vstop_hband vstop_lband", window=20, multiplier=2)
def _(b, window, multiplier):
    b.sql(pc=lag("close"), ret=div(f"close - {lag('close')}", lag("close")))
    b.sql(sd=rolling("stddev_samp", "ret", window))
    b.sql(vstop_hband=f"pc + pc * sd * {num(multiplier)}", vstop_lband=f"pc - pc * sd * {num(multiplier)}")


def _squeeze(b: Builder, bb_window, bb_std, kc_window, kc_atr_mult, mom_window) -> None:
    _bollinger(b, bb_window, bb_std, "bb_")
    _keltner(b, kc_window, kc_window, kc_atr_mult, "kc_")
    b.sql(hh=rolling("max", "high", mom_window), ll=rolling("min", "low", mom_window), mid_mean=sma("close", mom_window))
    b.sql(raw="close - ((hh + ll) / 2.0 + mid_mean) / 2.0")
    b.sql(momentum=fir("raw", epma_weights(mom_window)))


@indicator("TTMSqueeze", HLC, "squeeze_on squeeze_fired momentum", bb_window=20, bb_std=2.0, kc_window=20, kc_atr_mult=1.5, mom_window=12)
def _(b, **p):
    _squeeze(b, **p)
    b.sql(squeeze_on="CASE WHEN bb_hband < kc_hband AND bb_lband > kc_lband THEN 1.0 ELSE 0.0 END")
    b.sql(squeeze_fired=f"CASE WHEN squeeze_on = 0 AND {lag('squeeze_on')} = 1 THEN 1.0 ELSE 0.0 END")


@indicator("SqueezeDepth", HLC, "squeeze_depth momentum", bb_window=20, bb_std=2.0, kc_window=20, kc_atr_mult=1.5, mom_window=12)
def _(b, **p):
    _squeeze(b, **p)
    b.sql(squeeze_depth="least(kc_hband - bb_hband, bb_lband - kc_lband)")


@indicator("ChandelierLevels", HLC, "high_offset low_offset", window=22, multiplier=3)
def _(b, window, multiplier):
    _atr(b, window)
    b.sql(high_offset=f"({rolling('max', 'high', window)}) - {num(multiplier)} * atr", low_offset=f"({rolling('min', 'low', window)}) + {num(multiplier)} * atr")


@indicator("SuperTrendBands", HLC, "upper_band lower_band", window=10, multiplier=3.0)
def _(b, window, multiplier):
    _atr(b, window)
    b.sql(upper_band=f"(high + low) / 2.0 + {num(multiplier)} * atr", lower_band=f"(high + low) / 2.0 - {num(multiplier)} * atr")


@indicator("SuperTrendTrail", HLC, "regime upper_trail lower_trail", window=10, multiplier=3.0)
def _(b, window, multiplier):
    _ratchet(b, window, multiplier)
    b.sql(regime=f"CASE WHEN no > {window} THEN side END", upper_trail="up", lower_trail="lo")


# volume


def _clv() -> str:
    return f"coalesce({div('(close - low) - (high - close)', 'high - low')}, 0.0) * volume"


@indicator("ADI", (*HLC, "volume"), "adi")
def _(b):
    b.sql(flow=_clv())
    b.sql(adi=running("sum", "flow"))


@indicator("OBV", ("close", "volume"), "obv")
def _(b):
    b.sql(flow=f"coalesce(sign(close - {lag('close')}), 0.0) * volume")
    b.sql(obv=running("sum", "flow"))


@indicator("CMF", (*HLC, "volume"), "cmf", window=20)
def _(b, window):
    b.sql(flow=_clv())
    b.sql(cmf=div(rolling("sum", "flow", window), rolling("sum", "volume", window)))


@indicator("ForceIndex", ("close", "volume"), "fi", window=13)
def _(b, window):
    b.sql(force=f"(close - {lag('close')}) * volume")
    b.scan(ema("fi", "force", window))


@indicator("EaseOfMovement", ("high", "low", "volume"), "eom sma_eom", window=14)
def _(b, window):
    b.sql(eom=f"100000000.0 * {div(f'((high - {lag("high")}) + (low - {lag("low")})) * (high - low)', '2.0 * volume')}")
    b.sql(sma_eom=sma("eom", window))


@indicator("VPT", ("close", "volume"), "vpt", smoothing_factor=None)
def _(b, smoothing_factor):
    b.sql(flow=f"{div(f'close - {lag("close")}', lag('close'))} * volume")
    b.sql(total=running("sum", "flow"))
    b.sql(vpt=sma("total", smoothing_factor) if smoothing_factor else "total")


@indicator("NVI", ("close", "volume"), "nvi nvi_ema", window=255)
def _(b, window):
    b.sql(f=f"CASE WHEN volume < {lag('volume')} THEN coalesce({div('close', lag('close'))}, 1.0) ELSE 1.0 END")
    b.sql(neg="CASE WHEN f < 0 THEN 1 ELSE 0 END", ln_f="CASE WHEN f <> 0 THEN ln(abs(f)) END", zero="CASE WHEN f = 0 THEN 1 ELSE 0 END")
    b.sql(nvi=f"CASE WHEN {running('max', 'zero')} = 1 THEN 0.0 ELSE 1000.0 * exp({running('sum', 'ln_f')}) * CASE WHEN {running('sum', 'neg')} % 2 = 1 THEN -1.0 ELSE 1.0 END END")
    b.scan(ema("nvi_ema", "nvi", window, 1))


@indicator("MFI", (*HLC, "volume"), "mfi", window=14)
def _(b, window):
    b.sql(tp="(high + low + close) / 3.0")
    b.sql(up=f"CASE WHEN tp > {lag('tp')} THEN tp * volume ELSE 0.0 END", dn=f"CASE WHEN tp < {lag('tp')} THEN tp * volume ELSE 0.0 END")
    b.sql(u=rolling("sum", "up", window), v=rolling("sum", "dn", window))
    b.sql(mfi=f"CASE WHEN v = 0 AND u > 0 THEN 100.0 WHEN v = 0 THEN NULL ELSE 100.0 - 100.0 / (1.0 + {div('u', 'v')}) END")


@indicator("VWAP", (*HLC, "volume"), "vwap", window=14)
def _(b, window):
    b.sql(pv="(high + low + close) / 3.0 * volume")
    b.sql(vwap=div(rolling("sum", "pv", window), rolling("sum", "volume", window)))


@indicator("VWMA", ("close", "volume"), "vwma", window=20)
def _(b, window):
    b.sql(pv="close * volume")
    b.sql(vwma=div(rolling("sum", "pv", window), rolling("sum", "volume", window)))


@indicator("ADOSC", (*HLC, "volume"), "adosc", fast=3, slow=10)
def _(b, fast, slow):
    b.sql(flow=_clv())
    b.sql(adi=running("sum", "flow"))
    b.scan(ema("f", "adi", fast), ema("s", "adi", slow), ("adosc", "calc", "f - s"))


def _kvo_tail(b: Builder, x: str, fast: int, slow: int, signal_window: int) -> None:
    b.scan(ema("f", x, fast), ema("s", x, slow), ("kvo", "calc", "f - s"), ema("kvo_signal", "kvo", signal_window))


@indicator("KVO", (*HLC, "volume"), "kvo kvo_signal", fast=34, slow=55, signal_window=13)
def _(b, fast, slow, signal_window):
    b.sql(tp="(high + low + close) / 3.0")
    b.sql(vf=f"volume * sign(tp - {lag('tp')})")
    _kvo_tail(b, "vf", fast, slow, signal_window)


@indicator("KlingerVolumeOscillator", (*HLC, "volume"), "kvo kvo_signal", fast=34, slow=55, signal_window=13)
def _(b, fast, slow, signal_window):
    b.sql(tp="(high + low + close) / 3.0", dm="high - low")
    b.scan((["vf"], "VolumeForce", (), ["tp", "dm", "volume"]))
    _kvo_tail(b, "vf", fast, slow, signal_window)


# candles, returns, readings


@indicator("CandleRaw", OHLC, "open high low close")
def _(b):
    b.sql(**{c: c for c in OHLC})


@indicator("CandleGeometry", OHLC, "body signed_body range upper_wick lower_wick body_ratio")
def _(b):
    b.sql(body="abs(close - open)", signed_body="close - open", range="high - low", upper_wick="high - greatest(open, close)", lower_wick="least(open, close) - low")
    b.sql(body_ratio=f"CASE WHEN range = 0 THEN 0.0 ELSE {div('body', 'range')} END")


@indicator("CandleRelation", OHLC, "body_low_delta body_high_delta range_low_delta range_high_delta body_size_ratio range_size_ratio gap range_overlap")
def _(b):
    b.sql(**{f"p_{c}": lag(c) for c in OHLC})
    share = lambda x: f"100.0 * {div(x, 'p_close')}"
    ratio = lambda x, y: f"CASE WHEN {y} = 0 THEN 0.0 ELSE {div(x, y)} END"
    b.sql(
        body_low_delta=share("least(open, close) - least(p_open, p_close)"), body_high_delta=share("greatest(open, close) - greatest(p_open, p_close)"),
        range_low_delta=share("low - p_low"), range_high_delta=share("high - p_high"),
        body_size_ratio=ratio("abs(close - open)", "abs(p_close - p_open)"), range_size_ratio=ratio("(high - low)", "(p_high - p_low)"),
        gap=share("open - p_close"), range_overlap=f"CASE WHEN p_close IS NOT NULL THEN {share('least(high, p_high) - greatest(low, p_low)')} END",
    )


@indicator("DailyReturn", "close", "daily_return")
def _(b):
    b.sql(daily_return=f"100.0 * ({div('close', lag('close'))} - 1.0)")


@indicator("DailyLogReturn", "close", "daily_log_return")
def _(b):
    b.sql(l="CASE WHEN close > 0 THEN ln(close) END")
    b.sql(daily_log_return=f"100.0 * (l - {lag('l')})")


@indicator("CumulativeReturn", "close", "cumulative_return")
def _(b):
    b.sql(cumulative_return=f"100.0 * ({div('close', f'first_value(close) OVER ({t.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} - 1.0)")


@indicator("SocialZScore", "value", "zscore", window=30)
def _(b, window):
    b.sql(m=sma("value", window, 1), sd=rolling("stddev_samp", "value", window, 1))
    b.sql(zscore=f"CASE WHEN sd > {num(1e-12)} * greatest(abs(m), 1.0) THEN {div('value - m', 'sd')} END")


@indicator("SocialBaselineShift", "value", "recent baseline shift ratio", window=7, window_baseline=60)
def _(b, window, window_baseline):
    b.sql(recent=sma("value", window), baseline=sma("value", window_baseline, window))
    b.sql(shift="recent - baseline", ratio=f"CASE WHEN baseline > 0 THEN {div('recent', 'baseline')} END")


@indicator("OnchainChange", "value", "pct_change change", window=14)
def _(b, window):
    old = lag("value", window)
    b.sql(pct_change=f"CASE WHEN {old} > 0 THEN 100.0 * ({div('value', old)} - 1.0) END", change=f"value - {old}")


ALIASES = {"VolatilityStop": "VolatilityEnvelope", "ChandelierExit": "ChandelierLevels"}

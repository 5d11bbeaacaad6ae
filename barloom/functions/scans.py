"""Kernels of sequential scans.  Each keeps its state between batches, so a symbol of any length runs in constant memory."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

NAN = float("nan")


class Ewm:
    """Exponential mean seeded by the first value; gaps let the old weight decay; null until ``least`` values were seen."""

    def __init__(self, alpha: float, least: int):
        self.alpha, self.least, self.mean, self.gap, self.seen = alpha, least, None, 0, 0

    def step(self, x):
        there = ~np.isnan(x)
        first = int(np.argmax(there)) if there.any() else len(x)
        if self.mean is None or first == len(x):
            y = pd.Series(x).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()
            if self.mean is not None:
                y[:] = self.mean
        else:
            # the level so far weighs (1 - alpha) to the power of the rows since its last value, the next value alpha
            old = (1 - self.alpha) ** (self.gap + first + 1)
            blend = (old * self.mean + self.alpha * x[first]) / (old + self.alpha)
            rest = x[first:].copy()
            rest[0] = blend
            y = np.full(len(x), self.mean)
            y[first:] = pd.Series(rest).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()
        count = self.seen + np.cumsum(there)
        if len(x):
            self.seen = int(count[-1])
            if not np.isnan(y[-1]):
                self.mean = y[-1]
            at = np.flatnonzero(there)
            self.gap = self.gap + len(x) if not len(at) else len(x) - 1 - int(at[-1])
        return (np.where(count >= self.least, y, np.nan),)


class Adaptive:
    """A level that starts at ``seed`` and moves towards x by the share ``rate``."""

    def __init__(self):
        self.level = NAN

    def step(self, x, rate, seed):
        out = np.full(len(x), np.nan)
        level = self.level
        for i in range(len(x)):
            if math.isnan(level):
                level = seed[i]
            elif not math.isnan(rate[i]):
                level += rate[i] * (x[i] - level)
            out[i] = level
        self.level = level
        return (out,)


class Mesa:
    """Adaptive mean whose rate follows the phase change of a Hilbert transform (zero seeds, starts at the seventh bar)."""

    def __init__(self, fast: float, slow: float, warmup: int):
        self.fast, self.slow, self.warmup, self.n = fast, slow, warmup, 0
        self.hist = {k: [0.0] * 7 for k in ("price", "smooth", "det", "i1", "q1")}
        self.s = dict(i2=0.0, q2=0.0, re=0.0, im=0.0, period=0.0, phase=0.0, mama=0.0, fama=0.0)

    def _hilbert(self, key: str, gain: float) -> float:
        h = self.hist[key]
        return gain * (0.0962 * (h[0] - h[6]) + 0.5769 * (h[2] - h[4]))

    def _push(self, key: str, v: float) -> None:
        self.hist[key] = [v, *self.hist[key][:6]]

    def step(self, x):
        mama, fama = np.full(len(x), np.nan), np.full(len(x), np.nan)
        s, p = self.s, self.hist
        for i, v in enumerate(x):
            self._push("price", v)
            if self.n >= 6:
                gain = 0.075 * s["period"] + 0.54
                q = p["price"]
                self._push("smooth", 0.4 * q[0] + 0.3 * q[1] + 0.2 * q[2] + 0.1 * q[3])
                self._push("det", self._hilbert("smooth", gain))
                self._push("q1", self._hilbert("det", gain))
                self._push("i1", p["det"][3])
                i2 = 0.2 * (p["i1"][0] - self._hilbert("q1", gain)) + 0.8 * s["i2"]
                q2 = 0.2 * (p["q1"][0] + self._hilbert("i1", gain)) + 0.8 * s["q2"]
                s["re"] = 0.2 * (i2 * s["i2"] + q2 * s["q2"]) + 0.8 * s["re"]
                s["im"] = 0.2 * (i2 * s["q2"] - q2 * s["i2"]) + 0.8 * s["im"]
                s["i2"], s["q2"] = i2, q2
                period = 360.0 / math.degrees(math.atan(s["im"] / s["re"])) if s["im"] and s["re"] else 0.0
                last = s["period"]
                period = max(min(period, 1.5 * last), 0.67 * last)
                period = min(max(period, 6.0), 50.0)
                s["period"] = 0.2 * period + 0.8 * last
                phase = math.degrees(math.atan(p["q1"][0] / p["i1"][0])) if p["i1"][0] else 0.0
                rate = max(min(self.fast / max(s["phase"] - phase, 1.0), self.fast), self.slow)
                s["phase"] = phase
                s["mama"] += rate * (v - s["mama"])
                s["fama"] += 0.5 * rate * (s["mama"] - s["fama"])
            else:
                for k in ("smooth", "det", "q1", "i1"):
                    self._push(k, 0.0)
            if self.n >= self.warmup:
                mama[i], fama[i] = s["mama"], s["fama"]
            self.n += 1
        return mama, fama


class StopAndReverse:
    """Parabolic stop-and-reverse: level, acceleration and direction (+1, -1); null on the first two bars."""

    def __init__(self, step: float, most: float):
        self.by, self.most = step, most
        self.side, self.af, self.n = 1, step, 0
        self.top = self.bottom = self.level = NAN
        self.highs, self.lows = [NAN, NAN], [NAN, NAN]  # of the two bars before, older first

    def step(self, high, low, close):
        n = len(close)
        level, af, side = np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan)
        for i in range(n):
            h, l = high[i], low[i]
            if self.n == 0:
                self.top, self.bottom = h, l
            elif self.n == 1:
                self.level = close[i]
            else:
                up = self.side > 0
                target, shield = (self.top, self.lows) if up else (self.bottom, self.highs)
                at = self.level + self.af * (target - self.level)
                if (l < at) if up else (h > at):
                    at, self.side, self.af = target, -self.side, self.by
                    if up:
                        self.bottom = l
                    else:
                        self.top = h
                else:
                    if (h > self.top) if up else (l < self.bottom):
                        self.af = min(self.af + self.by, self.most)
                        if up:
                            self.top = h
                        else:
                            self.bottom = l
                    for bar in shield:  # the older bar binds first
                        if (bar < at) if up else (bar > at):
                            at = bar
                            break
                self.level = at
                level[i], af[i], side[i] = at, self.af, self.side
            self.highs, self.lows = [self.highs[1], h], [self.lows[1], l]
            self.n += 1
        return level, af, side


class Ratchet:
    """Bands that only tighten while the regime lasts; the regime flips when the close leaves the band of the bar before."""

    def __init__(self):
        self.regime, self.upper, self.lower, self.n = 1, NAN, NAN, 0

    def step(self, close, upper, lower):
        n = len(close)
        regime, up, low = np.full(n, np.nan), upper.copy(), lower.copy()
        for i in range(n):
            if self.n:
                if close[i] > self.upper:
                    self.regime = 1
                elif close[i] < self.lower:
                    self.regime = -1
                elif self.regime == 1:
                    if low[i] < self.lower:
                        low[i] = self.lower
                elif up[i] > self.upper:
                    up[i] = self.upper
                regime[i] = self.regime
            self.upper, self.lower = up[i], low[i]
            self.n += 1
        return regime, up, low


class TrailingStop:
    """A stop at ``reach`` from the close that follows the trend and flips when the close crosses it; starts at bar ``start``."""

    def __init__(self, start: int):
        self.start, self.n, self.side, self.stop, self.last = start, 0, 0, NAN, NAN

    def step(self, close, reach):
        n = len(close)
        stop, side = np.full(n, np.nan), np.zeros(n)
        for i in range(n):
            c = close[i]
            if self.n == self.start:
                self.side = 1 if c >= self.last else -1
                self.stop = c - self.side * reach[i]
            elif self.n > self.start:
                here = c - self.side * reach[i]
                if self.side * (c - self.stop) < 0:
                    self.side = -self.side
                    self.stop = c - self.side * reach[i]
                else:
                    self.stop = max(self.stop, here) if self.side > 0 else min(self.stop, here)
            if self.n >= self.start:
                stop[i], side[i] = self.stop, self.side
            self.last = c
            self.n += 1
        return stop, side


class VolumeForce:
    """Volume force with the cumulative measure that restarts when the trend of the typical price turns."""

    def __init__(self):
        self.trend, self.cm, self.dm, self.tp, self.n = 1.0, NAN, NAN, NAN, 0

    def step(self, tp, dm, volume):
        out = np.zeros(len(tp))
        for i in range(len(tp)):
            if self.n == 0:
                self.cm = dm[i]
            else:
                trend = 1.0 if tp[i] > self.tp else -1.0
                self.cm = (self.cm if trend == self.trend else self.dm) + dm[i]
                self.trend = trend
                if self.cm != 0:
                    out[i] = volume[i] * abs(2.0 * (dm[i] / self.cm - 1.0)) * trend * 100.0
            self.tp, self.dm = tp[i], dm[i]
            self.n += 1
        return (out,)


KERNELS = {c.__name__: c for c in (Ewm, Adaptive, Mesa, StopAndReverse, Ratchet, TrailingStop, VolumeForce)}

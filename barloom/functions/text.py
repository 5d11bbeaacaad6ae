"""SQL expression text over bars: ``symbol`` partitions, ``ts`` orders, undefined is NULL.

Frames are gated as in rolling statistics with a full window: a frame of n rows has a value only
if it holds n non-null values.  Divisions by zero give NULL.
"""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY ts"


def frame(n: int, back: int = 0) -> str:
    """The n rows that end ``back`` rows before the current one."""
    last = f"{back} PRECEDING" if back else "CURRENT ROW"
    return f"{W} ROWS BETWEEN {n - 1 + back} PRECEDING AND {last}"


def lag(x: str, n: int = 1) -> str:
    return x if n == 0 else f"lag({x}, {n}) OVER ({W})"


def rolling(f: str, x: str, n: int, back: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER ({frame(n, back)}) = {n} THEN {f}({x}) OVER ({frame(n, back)}) END"


def sma(x: str, n: int, back: int = 0) -> str:
    return rolling("avg", x, n, back)


def running(f: str, x: str) -> str:
    return f"{f}({x}) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def row_no() -> str:
    return f"row_number() OVER ({W})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0.0D))"


def fir(x: str, weights: list[float]) -> str:
    """Weighted sum of the last values, oldest weight first; NULL unless all are there."""
    n = len(weights)
    return "(" + " + ".join(f"{num(w)} * {lag(x, n - 1 - i)}" for i, w in enumerate(weights)) + ")"


def num(v) -> str:
    """A double literal that both dialects read alike."""
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def wma_weights(n: int) -> list[float]:
    return [i / (n * (n + 1) / 2) for i in range(1, n + 1)]


def epma_weights(n: int) -> list[float]:
    """End point of the least-squares line through n values."""
    return [(6 * i + 4 - 2 * n) / (n * (n + 1)) for i in range(n)]


def alma_weights(n: int, offset: float, sigma: float) -> list[float]:
    from math import exp, floor

    m = floor(offset * (n - 1))
    w = [exp(-0.5 * (sigma / n * (i - m)) ** 2) for i in range(n)]
    return [x / sum(w) for x in w]

"""Sequential kernels as recursive SQL, for comparison on another engine."""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY ts"


def kernel_sql(kind: str, args: tuple, inputs: list[str], outs: list[str], src: str, name: str) -> list[str] | None:
    """CTE texts that add ``outs`` to the relation ``src`` as relation ``name``; None for a kernel without a text."""
    x = f"{name}_x"
    base = f"{x} AS MATERIALIZED (SELECT *, row_number() OVER ({W}) AS k_rn FROM {src})"

    def walk(states: str, first: str, step: str, where: str = "x.k_rn = 1") -> str:
        return f"{name}_r(symbol, k_rn, {states}) AS (SELECT x.symbol, x.k_rn, {first} FROM {x} x WHERE {where} UNION ALL SELECT x.symbol, x.k_rn, {step} FROM {name}_r r JOIN {x} x ON x.symbol = r.symbol AND x.k_rn = r.k_rn + 1)"

    def done(values: str) -> str:
        return f"{name} AS (SELECT x.* EXCLUDE (k_rn), {values} FROM {x} x LEFT JOIN {name}_r r ON r.symbol = x.symbol AND r.k_rn = x.k_rn)"

    if kind == "Adaptive":
        v, rate, seed = inputs
        step = f"CASE WHEN r.level IS NULL THEN x.{seed} WHEN x.{rate} IS NOT NULL THEN r.level + x.{rate} * (x.{v} - r.level) ELSE r.level END"
        return [base, walk("level", f"CAST(x.{seed} AS DOUBLE)", step), done(f"r.level AS {outs[0]}")]
    if kind == "Ratchet":
        c, u, lo = (f"x.{i}" for i in inputs)
        above, below = f"coalesce({c} > r.up, false)", f"coalesce({c} < r.lo, false)"
        side = f"CASE WHEN {above} THEN 1 WHEN {below} THEN -1 ELSE r.side END"
        up = f"CASE WHEN NOT {above} AND NOT {below} AND r.side = -1 AND {u} > r.up THEN r.up ELSE {u} END"
        low = f"CASE WHEN NOT {above} AND NOT {below} AND r.side = 1 AND {lo} < r.lo THEN r.lo ELSE {lo} END"
        return [base, walk("side, up, lo", f"1, {u}, {lo}", f"{side}, {up}, {low}"), done(f"CASE WHEN x.k_rn > 1 THEN r.side END AS {outs[0]}, r.up AS {outs[1]}, r.lo AS {outs[2]}")]
    if kind == "TrailingStop":
        (start,), (c, reach) = args, (f"x.{i}" for i in inputs)
        flip = f"r.side * ({c} - r.stop) < 0"
        stop = f"CASE WHEN {flip} THEN {c} + r.side * {reach} WHEN r.side = 1 THEN greatest(r.stop, {c} - {reach}) ELSE least(r.stop, {c} + {reach}) END"
        prior = f"(SELECT p.{inputs[0]} FROM {x} p WHERE p.symbol = x.symbol AND p.k_rn = {start})"
        side0 = f"CASE WHEN {c} >= {prior} THEN 1 ELSE -1 END"
        first = f"{side0}, {c} - ({side0}) * {reach}"
        return [base, walk("side, stop", first, f"CASE WHEN {flip} THEN -r.side ELSE r.side END, {stop}", f"x.k_rn = {start + 1}"), done(f"r.stop AS {outs[0]}, coalesce(r.side, 0) AS {outs[1]}")]
    if kind == "VolumeForce":
        tp, dm, vol = inputs
        x2 = f"{x} AS MATERIALIZED (SELECT *, coalesce(lag(k_t) OVER ({W}), 1) AS k_pt FROM (SELECT *, row_number() OVER ({W}) AS k_rn, CASE WHEN lag({tp}) OVER ({W}) IS NULL THEN 1 WHEN {tp} > lag({tp}) OVER ({W}) THEN 1 ELSE -1 END AS k_t FROM {src}))"
        step = f"CASE WHEN x.k_t = x.k_pt THEN r.cm ELSE r.dm END + x.{dm}, x.{dm}"
        value = f"CASE WHEN x.k_rn = 1 OR r.cm = 0 THEN 0 ELSE x.{vol} * abs(2 * (x.{dm} / r.cm - 1)) * x.k_t * 100 END AS {outs[0]}"
        return [x2, walk("cm, dm", f"x.{dm}, x.{dm}", step), f"{name} AS (SELECT x.* EXCLUDE (k_rn, k_t, k_pt), {value} FROM {x} x JOIN {name}_r r ON r.symbol = x.symbol AND r.k_rn = x.k_rn)"]
    if kind == "StopAndReverse":
        (by, most), (h, lo, c) = args, inputs
        x2 = f"{x} AS MATERIALIZED (SELECT *, row_number() OVER ({W}) AS k_rn, lag({h}) OVER ({W}) AS k_h1, lag({h}, 2) OVER ({W}) AS k_h2, lag({lo}) OVER ({W}) AS k_l1, lag({lo}, 2) OVER ({W}) AS k_l2 FROM {src})"
        at = "(r.level + r.af * (CASE WHEN r.side = 1 THEN r.top ELSE r.bottom END - r.level))"
        flip = f"(CASE WHEN r.side = 1 THEN x.{lo} < {at} ELSE x.{h} > {at} END)"
        wider = f"(CASE WHEN r.side = 1 THEN x.{h} > r.top ELSE x.{lo} < r.bottom END)"
        level = (
            f"CASE WHEN {flip} THEN CASE WHEN r.side = 1 THEN r.top ELSE r.bottom END "
            f"WHEN r.side = 1 THEN CASE WHEN x.k_l2 < {at} THEN x.k_l2 WHEN x.k_l1 < {at} THEN x.k_l1 ELSE {at} END "
            f"ELSE CASE WHEN x.k_h2 > {at} THEN x.k_h2 WHEN x.k_h1 > {at} THEN x.k_h1 ELSE {at} END END"
        )
        step = (
            f"CASE WHEN {flip} THEN -r.side ELSE r.side END, CASE WHEN {flip} THEN CAST({by!r} AS DOUBLE) WHEN {wider} THEN least(r.af + {by!r}, {most!r}) ELSE r.af END, "
            f"CASE WHEN r.side = 1 THEN CASE WHEN NOT {flip} AND {wider} THEN x.{h} ELSE r.top END ELSE CASE WHEN {flip} THEN x.{h} ELSE r.top END END, "
            f"CASE WHEN r.side = -1 THEN CASE WHEN NOT {flip} AND {wider} THEN x.{lo} ELSE r.bottom END ELSE CASE WHEN {flip} THEN x.{lo} ELSE r.bottom END END, {level}"
        )
        first = f"1, CAST({by!r} AS DOUBLE), x.k_h1, x.k_l1, x.{c}"
        late = "x.k_rn > 2"
        values = f"CASE WHEN {late} THEN r.level END AS {outs[0]}, CASE WHEN {late} THEN r.af END AS {outs[1]}, CASE WHEN {late} THEN r.side END AS {outs[2]}"
        return [x2, walk("side, af, top, bottom, level", first, step, "x.k_rn = 2"), f"{name} AS (SELECT x.* EXCLUDE (k_rn, k_h1, k_h2, k_l1, k_l2), {values} FROM {x} x LEFT JOIN {name}_r r ON r.symbol = x.symbol AND r.k_rn = x.k_rn)"]
    return None


def swing_sql(ctes: str, src: str, price: str, reading: str, window: int, least: int) -> str:
    """CTEs up to ``deltas``: the swing pairs by joins of the swing tables, one value per (symbol, bar, side); the later pair stays."""
    behind, ahead = f"{W} ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING", f"{W} ROWS BETWEEN 1 FOLLOWING AND {window} FOLLOWING"

    def flag(c, f, op):
        whole = " AND ".join(f"count({c}) OVER ({w}) = count(*) OVER ({w})" for w in (behind, ahead))
        return f"{c} {op} {f}({c}) OVER ({behind}) AND {c} {op} {f}({c}) OVER ({ahead}) AND {whole}"

    marks = ", ".join(f"({flag(c, f, op)}) AS {k}_{s}" for s, f, op in (("low", "min", "<"), ("high", "max", ">")) for k, c in (("p", price), ("i", reading)))
    out = f"{ctes},\nw0 AS (SELECT symbol, ts, {price} AS price, {reading} AS reading, row_number() OVER ({W}) AS no, {marks} FROM {src})"
    for s in ("low", "high"):
        out += f""",
p_{s} AS (SELECT symbol, no, price, lag(no) OVER (PARTITION BY symbol ORDER BY no) AS no1, lag(price) OVER (PARTITION BY symbol ORDER BY no) AS price1 FROM w0 WHERE p_{s}),
i_{s} AS (SELECT symbol, no, reading FROM w0 WHERE i_{s}),
n_{s} AS (SELECT p.symbol, p.no, arg_min(i.no, abs(i.no - p.no) + i.no * 1e-9) AS near FROM p_{s} p JOIN i_{s} i USING (symbol) GROUP BY 1, 2),
d_{s} AS (SELECT p.symbol, greatest(p.no, b.near) + {window} AS fire, p.no, p.price - p.price1 AS dp, y.reading - x.reading AS di
  FROM p_{s} p JOIN n_{s} a ON a.symbol = p.symbol AND a.no = p.no1 JOIN n_{s} b ON b.symbol = p.symbol AND b.no = p.no
  JOIN i_{s} x ON x.symbol = p.symbol AND x.no = a.near JOIN i_{s} y ON y.symbol = p.symbol AND y.no = b.near WHERE p.no - p.no1 >= {least} AND a.near <> b.near)"""
    last = lambda s: f"(SELECT symbol, fire, arg_max(dp, no) AS dp, arg_max(di, no) AS di, max(CASE WHEN dp < 0 AND di > 0 THEN 1 ELSE 0 END) AS down_up, max(CASE WHEN dp > 0 AND di < 0 THEN 1 ELSE 0 END) AS up_down FROM d_{s} GROUP BY 1, 2)"
    return (
        out
        + f",\ndeltas AS (SELECT w0.symbol, w0.ts, w0.no, l.dp AS low_price_delta, l.di AS low_indicator_delta, h.dp AS high_price_delta, h.di AS high_indicator_delta, coalesce(l.down_up, 0) AS regular_bullish, coalesce(l.up_down, 0) AS hidden_bullish, coalesce(h.up_down, 0) AS regular_bearish, coalesce(h.down_up, 0) AS hidden_bearish FROM w0 LEFT JOIN {last('low')} l ON l.symbol = w0.symbol AND l.fire = w0.no LEFT JOIN {last('high')} h ON h.symbol = w0.symbol AND h.fire = w0.no)"
    )

"""From indicator requests to one staged Spark plan, or to one SQL text.

An indicator is a list of stages: SQL stages add columns by window expressions, scan stages add
columns by sequential kernels.  Requests are deduplicated; all SQL stages that are ready share one
projection (Catalyst plans windows of equal partitioning and order in one pass), all scans that
are ready share one streaming pass over the sorted partitions.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scans import KERNELS
from barloom.plans.scan_sql import kernel_sql

_NAME = re.compile(r"(?<![\w'.])([A-Za-z_]\w*)(?!\s*\()")


@dataclass
class Builder:
    """Collects the stages of one indicator; local names become unique column names."""

    prefix: str
    names: dict[str, str]
    stages: list = field(default_factory=list)

    def _global(self, text: str) -> str:
        return _NAME.sub(lambda m: self.names.get(m[1], m[1]), text)

    def _own(self, name: str) -> str:
        self.names[name] = f"{self.prefix}__{name}"
        return self.names[name]

    def sql(self, **columns: str) -> None:
        """One projection; its expressions see the columns of earlier stages only."""
        texts = {k: self._global(v) for k, v in columns.items()}
        self.stages.append(("sql", {self._own(k): v for k, v in texts.items()}))

    def scan(self, *steps: tuple) -> None:
        """Steps of one pass: ``(outs, kernel, args, inputs)`` or ``(out, "calc", text)``; later steps see earlier ones."""
        done = []
        for s in steps:
            if s[1] == "calc":
                text = self._global(s[2])
                done.append(([self._own(s[0])], "calc", text, []))
            else:
                inputs = [self._global(x) for x in s[3]]
                done.append(([self._own(o) for o in s[0]], s[1], tuple(s[2]), inputs))
        if self.stages and self.stages[-1][0] == "scan":
            self.stages[-1][1].extend(done)
        else:
            self.stages.append(("scan", done))


def ewm(out: str, src: str, alpha: float, least: int) -> tuple:
    return ([out], "Ewm", (alpha, least), [src])


def ema(out: str, src: str, span: int, least: int | None = None) -> tuple:
    return ewm(out, src, 2 / (span + 1), span if least is None else least)


def _div(a, b):
    return np.divide(a, b, out=np.full(np.shape(a), np.nan), where=b != 0)


def _scan_inputs(steps: list) -> list[str]:
    made, need = set(), []
    for outs, kind, args, inputs in steps:
        used = [n.id for n in ast.walk(ast.parse(args, mode="eval")) if isinstance(n, ast.Name) and n.id != "div"] if kind == "calc" else inputs
        need += [u for u in used if u not in made and u not in need]
        made.update(outs)
    return need


def _scan(df: DataFrame, steps: list, keep: set[str]) -> DataFrame:
    """One pass over (symbol, ts) order; symbols are hashed to tasks, each streams through in batches."""
    inputs = _scan_inputs(steps)
    outs = [o for s in steps for o in s[0]]

    def run(batches):
        now, state = object(), None
        for pdf in batches:
            symbols = pdf["symbol"].to_numpy(object)
            cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1 if len(symbols) else []
            made = {o: np.full(len(pdf), np.nan) for o in outs}
            given = {c: pdf[c].to_numpy(np.float64, na_value=np.nan) for c in inputs}
            for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
                if a == b:
                    continue
                if symbols[a] != now:
                    now, state = symbols[a], [None if s[1] == "calc" else KERNELS[s[1]](*s[2]) for s in steps]
                env = {c: v[a:b] for c, v in given.items()}
                for (names, kind, args, ins), kernel in zip(steps, state):
                    if kernel is None:
                        got = (eval(args, {"div": _div}, env),)  # noqa: S307 - text of this package
                    else:
                        got = kernel.step(*[env[c] for c in ins])
                    for name, v in zip(names, got):
                        env[name] = made[name][a:b] = v
            yield pd.concat([pdf, pd.DataFrame(made, index=pdf.index)], axis=1)

    cols = [c for c in df.columns if c in keep]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols] + [f"`{o}` double" for o in outs])
    ordered = df.select(*cols).repartition("symbol").sortWithinPartitions("symbol", "ts")
    return ordered.mapInPandas(run, schema)


def _rounds(requests: list[Builder]) -> list[tuple[str, object]]:
    """Stages of all requests in joint rounds."""
    todo, rounds = [list(b.stages) for b in requests], []
    while any(todo):
        while any(t and t[0][0] == "sql" for t in todo):
            columns: dict[str, str] = {}
            for t in todo:
                if t and t[0][0] == "sql":
                    columns.update(t.pop(0)[1])
            rounds.append(("sql", columns))
        steps = []
        for t in todo:
            if t and t[0][0] == "scan":
                steps += t.pop(0)[1]
        if steps:
            rounds.append(("scan", steps))
            continue
        for t in todo:
            if t:
                rounds.append((t[0][0], t.pop(0)[1:]))
    return rounds


def to_spark(bars: DataFrame, requests: list[Builder]) -> DataFrame:
    df = bars
    for kind, what in _rounds(requests):
        if kind == "sql":
            df = df.select("*", *[F.expr(v).alias(k) for k, v in what.items()])
        elif kind == "scan":
            df = _scan(df, what, set(df.columns))
        else:
            df = _scatter(df, *what, flags=kind == "flags")
    return df


def _scatter(df: DataFrame, outs: dict[str, tuple[str, str, str]], no: str, flags: bool) -> DataFrame:
    """Values of struct columns put at the row their ``at`` names; of several the one of the greatest ``n`` stays (a flag: any)."""
    for source in dict.fromkeys(c for c, _, _ in outs.values()):
        mine = [(how, out) for c, how, out in outs.values() if c == source]
        aggs = [
            F.max(F.expr(f"CASE WHEN {re.sub(r'\b(dp|di)\b', rf'{source}.\1', how)} THEN 1.0D ELSE 0.0D END")).alias(out) if flags else F.max_by(F.col(f"{source}.{how}"), F.col(f"{source}.n")).alias(out)
            for how, out in mine
        ]
        hits = df.where(F.col(source).isNotNull()).groupBy("symbol", F.col(f"{source}.at").cast("int").alias(no)).agg(*aggs)
        df = df.join(hits, ["symbol", no], "left")
        if flags:
            df = df.withColumns({out: F.coalesce(out, F.lit(0.0)) for _, out in mine})
    return df


# the same stages as SQL text: exponential means become sums of weighted values


def _calc_sql(node) -> str:
    if isinstance(node, ast.Expression):
        return _calc_sql(node.body)
    if isinstance(node, ast.BinOp):
        op = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}[type(node.op)]
        return f"({_calc_sql(node.left)} {op} {_calc_sql(node.right)})"
    if isinstance(node, ast.UnaryOp):
        return f"(-{_calc_sql(node.operand)})"
    if isinstance(node, ast.Call):
        a, b = map(_calc_sql, node.args)
        return f"({a} / nullif({b}, 0))"
    return node.id if isinstance(node, ast.Name) else f"CAST('{float(node.value)!r}' AS DOUBLE)"


def to_sql(bars_cte: str, requests: list[Builder]) -> tuple[str, int] | None:
    """CTE text ``s0 .. sN`` over a relation, and N; None if a stage has no SQL form."""
    from math import ceil, log

    parts, n = [f"s0 AS (SELECT * FROM {bars_cte})"], 0
    whole = "PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    for kind, what in _rounds(requests):
        if kind == "sql":
            n += 1
            parts.append(f"s{n} AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in what.items()) + f" FROM s{n - 1})")
            continue
        if kind != "scan":
            return None
        for outs, how, args, inputs in what:
            n += 1
            if how == "calc":
                parts.append(f"s{n} AS (SELECT *, {_calc_sql(ast.parse(args, mode='eval'))} AS {outs[0]} FROM s{n - 1})")
            elif how == "Ewm":
                alpha, least = args
                x, o = inputs[0], outs[0]
                # position from the first value on (values have no gaps behind it)
                parts.append(f"s{n} AS (SELECT *, count({x}) OVER ({whole}) - 1 AS {o}_r FROM s{n - 1})")
                n += 1
                if alpha >= 1:
                    value = x
                elif alpha > 0.15:
                    k = ceil(40 / -log(1 - alpha))
                    last = f"list({x} * CASE WHEN {o}_r = 0 THEN 1.0 ELSE {alpha!r} END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"
                    value = f"list_sum(list_transform(list_reverse({last}), lambda v, i: v * pow({1 - alpha!r}, i - 1)))"
                else:
                    value = f"pow({1 - alpha!r}, {o}_r) * sum({x} * CASE WHEN {o}_r = 0 THEN 1.0 ELSE {alpha!r} END * pow({1 - alpha!r}, -{o}_r)) OVER ({whole})"
                parts.append(f"s{n} AS (SELECT *, CASE WHEN {o}_r + 1 >= {least} THEN {value} END AS {o} FROM s{n - 1})")
            else:
                texts = kernel_sql(how, args, inputs, outs, f"s{n - 1}", f"s{n}")
                if texts is None:
                    return None
                parts += texts
    return ",\n".join(parts), n

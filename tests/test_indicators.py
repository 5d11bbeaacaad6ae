import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from barloom.functions import scans
from barloom.operators.indicators import INDICATORS, compute, compute_frame, request
from barloom.operators.multi_timeframe import asof_join, multi_tf_slope
from barloom.sources.bars import canonical_columns, csv_bars, sample_ohlcv

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    return sample_ohlcv(spark, 260, trend="flat", seed=4).unionByName(sample_ohlcv(spark, 150, seed=9, symbol="B")).cache()


def local(df, symbol="SAMPLE"):
    return df.where(f"symbol = '{symbol}'").orderBy("ts").toPandas()


def test_every_indicator_runs_on_empty_and_short_frames(spark):
    empty = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, 10.0)], SCHEMA)
    extra = {"price": "close", "indicator": "volume", "value": "close"}
    wanted = [(f"{n}_", request(n, {k: v for k, v in extra.items() if k in s.reads} or None)) for n, s in INDICATORS.items()]
    for df, n in ((empty, 0), (one, 1)):
        assert compute_frame(df, wanted).count() == n


def test_missing_data_and_parameters(bars):
    with pytest.raises(ValueError, match="missing data"):
        compute(bars.drop("volume"), "OBV")
    with pytest.raises(ValueError, match="unknown parameters"):
        compute(bars, "SMA", {"wndow": 3})


def test_extra_and_clashing_columns_pass(bars):
    df = compute(bars.withColumnRenamed("volume", "sma"), "SMA", {"window": 3})
    assert df.columns.count("sma") == 1 and "open" in df.columns


def test_nulls_close_the_window(spark):
    rows = [("a", dt.datetime(2024, 1, i + 1), None, None, None, None if i == 4 else float(i), None) for i in range(10)]
    got = [r.sma for r in compute(spark.createDataFrame(rows, SCHEMA), "SMA", {"window": 3}).orderBy("ts").collect()]
    assert got == [None, None, 1.0, 2.0, None, None, None, 6.0, 7.0, 8.0]


@pytest.mark.parametrize("cut", [(7,), (1, 2, 30), (100,)])
def test_ewm_carries_its_state(cut):
    x = np.random.default_rng(1).normal(size=120)
    x[[0, 1, 30, 31, 32, 99]] = np.nan
    for alpha, least in ((0.1, 1), (2 / 3, 4)):
        k, got, at = scans.Ewm(alpha, least), [], 0
        for c in [*cut, 120]:
            got.append(k.step(x[at:c])[0])
            at = c
        want = pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean()
        np.testing.assert_allclose(np.concatenate(got), want, rtol=1e-12)


def test_mesa_against_arrays(bars):
    """The equations written over whole arrays."""
    pdf = local(compute(bars, "MAMA", {"warmup_bars": 0}))
    x = ((pdf.high + pdf.low) / 2).to_numpy()
    n = len(x)
    sm, de, q1, i1, i2, q2, re, im, pe, ph, ma, fa = (np.zeros(n) for _ in range(12))
    fir = lambda a, i: 0.0962 * a[i] + 0.5769 * a[i - 2] - 0.5769 * a[i - 4] - 0.0962 * a[i - 6]
    for i in range(6, n):
        g = 0.075 * pe[i - 1] + 0.54
        sm[i] = (4 * x[i] + 3 * x[i - 1] + 2 * x[i - 2] + x[i - 3]) / 10
        de[i] = g * fir(sm, i)
        q1[i], i1[i] = g * fir(de, i), de[i - 3]
        i2[i] = 0.2 * (i1[i] - g * fir(q1, i)) + 0.8 * i2[i - 1]
        q2[i] = 0.2 * (q1[i] + g * fir(i1, i)) + 0.8 * q2[i - 1]
        re[i] = 0.2 * (i2[i] * i2[i - 1] + q2[i] * q2[i - 1]) + 0.8 * re[i - 1]
        im[i] = 0.2 * (i2[i] * q2[i - 1] - q2[i] * i2[i - 1]) + 0.8 * im[i - 1]
        p = 360 / math.degrees(math.atan(im[i] / re[i])) if im[i] and re[i] else 0
        p = min(p, 1.5 * pe[i - 1])
        p = min(max(p, 0.67 * pe[i - 1], 6), 50)
        pe[i] = 0.2 * p + 0.8 * pe[i - 1]
        ph[i] = math.degrees(math.atan(q1[i] / i1[i])) if i1[i] else 0
        a = min(max(0.5 / max(ph[i - 1] - ph[i], 1), 0.05), 0.5)
        ma[i] = a * x[i] + (1 - a) * ma[i - 1]
        fa[i] = a / 2 * ma[i] + (1 - a / 2) * fa[i - 1]
    np.testing.assert_allclose(pdf.mama, ma, rtol=1e-9)
    np.testing.assert_allclose(pdf.fama, fa, rtol=1e-9)


def test_rsi_against_pandas(bars):
    pdf = local(compute(bars, "RSI", {"window": 14}))
    d = pdf.close.diff()
    up, dn = d.where(d > 0, 0.0), (-d).where(d < 0, 0.0)
    a, b = (s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for s in (up, dn))
    np.testing.assert_allclose(pdf.rsi.to_numpy(float), (100 - 100 / (1 + a / b)).to_numpy(), rtol=1e-10)


def test_answers_do_not_depend_on_later_bars(bars):
    """Cutting the frame leaves earlier values as they were."""
    cut = local(bars).ts.iloc[199]
    for name in ("MACD", "ADX", "KAMA", "ParabolicSAR", "SuperTrendTrail", "STC", "KlingerVolumeOscillator"):
        whole = local(compute(bars, name)).iloc[:200]
        part = local(compute(bars.where(f"ts <= timestamp'{cut}'"), name))
        for o in INDICATORS[name].outputs:
            np.testing.assert_allclose(part[o].to_numpy(float), whole[o].to_numpy(float), rtol=1e-9)


def test_asof_and_slope(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    left = spark.createDataFrame([("a", t(0)), ("a", t(2)), ("a", t(4)), ("b", t(4))], "symbol string, ts timestamp")
    right = spark.createDataFrame([("a", t(1), 1.0), ("a", t(3), None), ("a", t(4), 3.0)], "symbol string, ts timestamp, v double")
    got = {(r.symbol, r.ts): r.v for r in asof_join(left, right, "v").collect()}
    assert got == {("a", t(0)): None, ("a", t(2)): 1.0, ("a", t(4)): 3.0, ("b", t(4)): None}
    rows = [("a", t(i), float(i % 7 + i / 10)) for i in range(24 * 20)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    got = multi_tf_slope(df, "1d", 5).orderBy("ts").toPandas().higher_tf_slope.to_numpy(float)
    s = pd.Series([r[2] for r in rows], index=[r[1] for r in rows])
    h = s.resample("1d", label="right", closed="right").last().dropna()
    e = h.ewm(span=5, adjust=False, min_periods=5).mean()
    want = (e.diff() / e.abs().rolling(5, min_periods=1).mean()).reindex(s.index, method="ffill").to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("timestamp,Open,high,low,close,volume\n2024-01-01 00:00:00,1,2,0.5,x,3\n")
    r = csv_bars(spark, str(tmp_path / "x.csv"), "s").first()
    assert (r.open, r.close, r.volume) == (1.0, None, 3.0)
    assert canonical_columns(spark.createDataFrame([(1, 2)], "Close int, Other int")).columns == ["close", "Other"]
    with pytest.raises(ValueError):
        sample_ohlcv(spark, trend="sideways")

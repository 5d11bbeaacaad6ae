"""SQL of the signals at their default parameters, written by hand beside the engine's own texts.

A line of ``_TABLE`` is ``name | fewest bars | indicators | condition``.  ``a=SMA(9).sma`` binds
an indicator's output to a column; ``prev(x)`` is ``x`` one bar back.  Candle patterns and
alternative readings are whole conditions over bars numbered by ``n``.
"""

from __future__ import annotations

import re

from barloom.operators.indicators import INDICATORS, plan, request
from barloom.plans.staging import to_sql

_W = "OVER (PARTITION BY symbol ORDER BY ts)"

_TABLE = """
kama_cross_up | 40 | k=KAMA(10,2,30).kama | prev(close) <= prev(k) AND close > k
kama_cross_down | 40 | k=KAMA(10,2,30).kama | prev(close) >= prev(k) AND close < k
is_above_vwma | 20 | k=VWMA(20).vwma | close > k
vwap_above | 14 | k=VWAP(14).vwap | close > k
vwap_below | 14 | k=VWAP(14).vwap | close < k
alligator_bearish | 22 | j=WilliamsAlligator(13,8,5,8,5,3).jaw; t=WilliamsAlligator(13,8,5,8,5,3).teeth; l=WilliamsAlligator(13,8,5,8,5,3).lips | l < t AND t < j
alligator_bullish | 22 | j=WilliamsAlligator(13,8,5,8,5,3).jaw; t=WilliamsAlligator(13,8,5,8,5,3).teeth; l=WilliamsAlligator(13,8,5,8,5,3).lips | l > t AND t > j
alligator_sleeping | 22 | j=WilliamsAlligator(13,8,5,8,5,3).jaw; t=WilliamsAlligator(13,8,5,8,5,3).teeth; l=WilliamsAlligator(13,8,5,8,5,3).lips | j IS NOT NULL AND t IS NOT NULL AND l IS NOT NULL AND (l <= t OR t <= j) AND (l >= t OR t >= j)
is_above_alma | 21 | k=ALMA(21,0.85,6.0).alma | close > k
is_above_dema | 21 | k=DEMA(21).dema | close > k
is_above_hma | 16 | k=HMA(16).hma | close > k
is_above_sma | 20 | k=SMA(20).sma | close > k
is_above_smma | 14 | k=SMMA(14).smma | close > k
is_above_t3 | 60 | k=T3(10,0.7).t3 | close > k
is_above_tema | 21 | k=TEMA(21).tema | close > k
is_above_trima | 20 | k=TRIMA(20).trima | close > k
is_above_epma | 20 | k=EPMA(20).epma | close > k
price_above_ema | 20 | k=EMA(20).ema | close > k
ichimoku_bullish | 52 | a=Ichimoku(9,26,52,False).span_a; b=Ichimoku(9,26,52,False).span_b | close > a AND close > b
ichimoku_bearish | 52 | a=Ichimoku(9,26,52,False).span_a; b=Ichimoku(9,26,52,False).span_b | close < a AND close < b
ichimoku_tk_cross | 53 | a=Ichimoku(9,26,52,False).conversion_line; b=Ichimoku(9,26,52,False).base_line | prev(a) <= prev(b) AND a > b
heikin_ashi_bullish | 1 | a=HeikinAshi().ha_close; b=HeikinAshi().ha_open | a - b > 0
heikin_ashi_bearish | 1 | a=HeikinAshi().ha_close; b=HeikinAshi().ha_open | b - a > 0
psar_bullish | 3 | k=ParabolicSAR(0.02,0.2).psar | k < close
psar_bearish | 3 | k=ParabolicSAR(0.02,0.2).psar | k > close
psar_reversal | 4 | k=ParabolicSAR(0.02,0.2).psar | prev(k) > prev(close) AND k < close
adi_bearish | 20 | k=ADI().adi | k < prev(k, 19)
adi_bullish | 20 | k=ADI().adi | k > prev(k, 19)
obv_bearish | 20 | k=OBV().obv | k < prev(k, 19)
obv_bullish | 20 | k=OBV().obv | k > prev(k, 19)
vpt_bearish | 20 | k=VPT(None).vpt | k < prev(k, 19)
vpt_bullish | 20 | k=VPT(None).vpt | k > prev(k, 19)
cumulative_return_positive | 2 | k=CumulativeReturn().cumulative_return | k > 0
cumulative_return_target | 2 | k=CumulativeReturn().cumulative_return | k >= 10
nvi_bearish | 255 | a=NVI(255).nvi; b=NVI(255).nvi_ema | a < b
nvi_bullish | 255 | a=NVI(255).nvi; b=NVI(255).nvi_ema | a > b
roc_positive | 12 | k=ROC(12).roc | k > 0
roc_negative | 12 | k=ROC(12).roc | k < 0
roc_momentum_shift | 13 | k=ROC(12).roc | prev(k) <= 0 AND k > 0
ao_bullish | 34 | k=AwesomeOscillator(5,34).ao | k > 0
ao_bearish | 34 | k=AwesomeOscillator(5,34).ao | k < 0
ao_zero_cross | 35 | k=AwesomeOscillator(5,34).ao | prev(k) <= 0 AND k > 0
ppo_bullish_cross | 35 | a=PPO(26,12,9).ppo; b=PPO(26,12,9).ppo_signal | prev(a) <= prev(b) AND a > b
ppo_bearish_cross | 35 | a=PPO(26,12,9).ppo; b=PPO(26,12,9).ppo_signal | prev(a) >= prev(b) AND a < b
pvo_bullish_cross | 35 | a=PVO(26,12,9).pvo; b=PVO(26,12,9).pvo_signal | prev(a) <= prev(b) AND a > b
pvo_bearish_cross | 35 | a=PVO(26,12,9).pvo; b=PVO(26,12,9).pvo_signal | prev(a) >= prev(b) AND a < b
mom_bullish | 1 | k=MOM(10).mom | k > 0
mom_bearish | 1 | k=MOM(10).mom | k < 0
mom_cross_up | 2 | k=MOM(10).mom | prev(k) <= 0 AND k > 0
mom_cross_down | 2 | k=MOM(10).mom | prev(k) >= 0 AND k < 0
macd_line_positive | 26 | k=MACD(26,12,9).macd | k > 0
macd_line_negative | 26 | k=MACD(26,12,9).macd | k < 0
macd_line_cross_up | 27 | k=MACD(26,12,9).macd | prev(k) <= 0 AND k > 0
macd_line_cross_down | 27 | k=MACD(26,12,9).macd | prev(k) >= 0 AND k < 0
macd_bullish_cross | 35 | a=MACD(26,12,9).macd; b=MACD(26,12,9).signal | prev(a) <= prev(b) AND a > b
macd_bearish_cross | 35 | a=MACD(26,12,9).macd; b=MACD(26,12,9).signal | prev(a) >= prev(b) AND a < b
macd_positive | 35 | a=MACD(26,12,9).macd; b=MACD(26,12,9).signal | a > b
adosc_bearish | 11 | k=ADOSC(3,10).adosc | k < 0
adosc_bullish | 11 | k=ADOSC(3,10).adosc | k > 0
adosc_cross_down | 12 | k=ADOSC(3,10).adosc | prev(k) >= 0 AND k < 0
adosc_cross_up | 12 | k=ADOSC(3,10).adosc | prev(k) <= 0 AND k > 0
daily_return_negative | 2 | k=DailyReturn().daily_return | k < 0
daily_return_positive | 2 | k=DailyReturn().daily_return | k > 0
eom_bearish | 14 | k=EaseOfMovement(14).eom | k < 0
eom_bullish | 14 | k=EaseOfMovement(14).eom | k > 0
force_bearish | 13 | k=ForceIndex(13).fi | k < 0
force_bullish | 13 | k=ForceIndex(13).fi | k > 0
kvo_bearish | 69 | a=KVO(34,55,13).kvo; b=KVO(34,55,13).kvo_signal | a < b
kvo_bullish | 69 | a=KVO(34,55,13).kvo; b=KVO(34,55,13).kvo_signal | a > b
kvo_bearish_cross | 2 | a=KVO(34,55,13).kvo; b=KVO(34,55,13).kvo_signal | prev(a) >= prev(b) AND a < b
kvo_bullish_cross | 2 | a=KVO(34,55,13).kvo; b=KVO(34,55,13).kvo_signal | prev(a) <= prev(b) AND a > b
adx_bullish_di | 28 | a=ADX(14).adx_pos; b=ADX(14).adx_neg | a > b
adx_strong_trend | 28 | k=ADX(14).adx | k > 25
aroon_crossover | 26 | a=Aroon(25).aroon_up; b=Aroon(25).aroon_down | prev(a) <= prev(b) AND a > b
aroon_down_trend | 25 | k=Aroon(25).aroon_down | k > 70
aroon_up_trend | 25 | k=Aroon(25).aroon_up | k > 70
dpo_negative | 20 | k=DPO(20).dpo | k < 0
dpo_positive | 20 | k=DPO(20).dpo | k > 0
kst_bearish_cross | 54 | a=KST(10,15,20,30,10,10,10,15,9).kst; b=KST(10,15,20,30,10,10,10,15,9).kst_signal | prev(a) >= prev(b) AND a < b
kst_bullish_cross | 54 | a=KST(10,15,20,30,10,10,10,15,9).kst; b=KST(10,15,20,30,10,10,10,15,9).kst_signal | prev(a) <= prev(b) AND a > b
trix_bearish | 45 | k=TRIX(15,9).trix | k < 0
trix_bullish | 45 | k=TRIX(15,9).trix | k > 0
vortex_bearish | 14 | a=Vortex(14).vortex_pos; b=Vortex(14).vortex_neg | b > a
vortex_bullish | 14 | a=Vortex(14).vortex_pos; b=Vortex(14).vortex_neg | a > b
vortex_crossover | 15 | a=Vortex(14).vortex_pos; b=Vortex(14).vortex_neg | prev(a) <= prev(b) AND a > b
rsi_overbought | 15 | k=RSI(14).rsi | k > 70
rsi_oversold | 15 | k=RSI(14).rsi | k < 30
rsi_cross_up | 15 | k=RSI(14).rsi | prev(k) <= 50 AND k > 50
rsi_cross_down | 15 | k=RSI(14).rsi | prev(k) >= 50 AND k < 50
stoch_overbought | 14 | k=StochasticOscillator(14,3).stoch_k | k > 80
stoch_oversold | 14 | k=StochasticOscillator(14,3).stoch_k | k < 20
stochrsi_overbought | 20 | k=StochRSI(14,3,3).stochrsi | k > 0.8
stochrsi_oversold | 20 | k=StochRSI(14,3,3).stochrsi | k < 0.2
williams_r_overbought | 14 | k=WilliamsR(14).wr | k > -20
williams_r_oversold | 14 | k=WilliamsR(14).wr | k < -80
cmo_overbought | 15 | k=CMO(14).cmo | k >= 50
cmo_oversold | 15 | k=CMO(14).cmo | k <= -50
cmo_cross_up | 16 | k=CMO(14).cmo | prev(k) <= -50 AND k > -50
cmo_cross_down | 16 | k=CMO(14).cmo | prev(k) >= 50 AND k < 50
tsi_bullish | 38 | k=TSI(25,13).tsi | k > 0
tsi_bearish | 38 | k=TSI(25,13).tsi | k < 0
bop_bullish | 1 | | close > open AND high <> low
bop_bearish | 1 | | close < open AND high <> low
bop_cross_up | 2 | | prev(close) <= prev(open) AND prev(high) <> prev(low) AND close > open AND high <> low
bop_cross_down | 2 | | prev(close) >= prev(open) AND prev(high) <> prev(low) AND close < open AND high <> low
uo_overbought | 28 | k=UltimateOscillator(7,14,28,4.0,2.0,1.0).ultimate_oscillator | k > 70
uo_oversold | 28 | k=UltimateOscillator(7,14,28,4.0,2.0,1.0).ultimate_oscillator | k < 30
cmf_bearish | 20 | k=CMF(20).cmf | k < 0
cmf_bullish | 20 | k=CMF(20).cmf | k > 0
mfi_overbought | 14 | k=MFI(14).mfi | k > 80
mfi_oversold | 14 | k=MFI(14).mfi | k < 20
cci_overbought | 20 | k=CCI(20,0.015).cci | k > 100
cci_oversold | 20 | k=CCI(20,0.015).cci | k < -100
stc_overbought | 60 | k=STC(50,23,10,3,3).stc | k > 75
stc_oversold | 60 | k=STC(50,23,10,3,3).stc | k < 25
bb_upper_breakout | 21 | k=BollingerBands(20,2).hband | prev(close) <= prev(k) AND close > k
bb_lower_breakout | 21 | k=BollingerBands(20,2).lband | prev(close) >= prev(k) AND close < k
bb_squeeze | 21 | k=BollingerBands(20,2).wband | prev(k) >= 5 AND k < 5
bb_above_upper | 20 | k=BollingerBands(20,2).hband | close > k
bb_below_lower | 20 | k=BollingerBands(20,2).lband | close < k
kc_above_upper | 20 | k=KeltnerChannel(20,10,False,2.0).hband | close > k
kc_below_lower | 20 | k=KeltnerChannel(20,10,False,2.0).lband | close < k
kc_upper_breakout | 21 | k=KeltnerChannel(20,10,False,2.0).hband | prev(close) <= prev(k) AND close > k
kc_lower_breakout | 21 | k=KeltnerChannel(20,10,False,2.0).lband | prev(close) >= prev(k) AND close < k
atr_high_volatility | 14 | k=ATR(14).atr | k * 100 > 3 * close
dc_upper_breakout | 22 | k=DonchianChannel(20,False).hband | prev(close) <= prev(k) AND close > k
dc_lower_breakout | 22 | k=DonchianChannel(20,False).lband | prev(close) >= prev(k) AND close < k
ulcer_high_risk | 14 | k=UlcerIndex(14).ulcer_index | k > 10
ulcer_low_risk | 14 | k=UlcerIndex(14).ulcer_index | k < 5
natr_high_volatility | 15 | k=NATR(14).natr | k > 2
natr_low_volatility | 15 | k=NATR(14).natr | k < 1
atr_trailing_stop_long | 16 | k=ATRTrailingStop(14,3.0).direction | k = 1
atr_trailing_stop_short | 16 | k=ATRTrailingStop(14,3.0).direction | k = -1
atr_trailing_stop_flip_up | 2 | k=ATRTrailingStop(14,3.0).direction | prev(k) = -1 AND k = 1
atr_trailing_stop_flip_down | 2 | k=ATRTrailingStop(14,3.0).direction | prev(k) = 1 AND k = -1
starc_upper_breakout | 21 | k=STARCBands(20,15,2.0).starc_hband | close > k
starc_lower_breakout | 21 | k=STARCBands(20,15,2.0).starc_lband | close < k
ve_above_upper | 21 | k=VolatilityEnvelope(20,2.0).vstop_hband | close >= k
ve_below_lower | 21 | k=VolatilityEnvelope(20,2.0).vstop_lband | close <= k
cl_below_high_offset | 22 | k=ChandelierLevels(22,3.0).high_offset | close < k
cl_above_low_offset | 22 | k=ChandelierLevels(22,3.0).low_offset | close > k
cl_high_offset_break | 23 | k=ChandelierLevels(22,3.0).high_offset | prev(close) >= prev(k) AND close < k
cl_low_offset_break | 23 | k=ChandelierLevels(22,3.0).low_offset | prev(close) <= prev(k) AND close > k
ttm_squeeze_active | 21 | k=SqueezeDepth(20,2.0,20,1.5,12).squeeze_depth | k > 0
ttm_squeeze_fired_bullish | 22 | k=SqueezeDepth(20,2.0,20,1.5,12).squeeze_depth; m=SqueezeDepth(20,2.0,20,1.5,12).momentum | prev(k) > 0 AND k <= 0 AND m > 0
ttm_squeeze_fired_bearish | 22 | k=SqueezeDepth(20,2.0,20,1.5,12).squeeze_depth; m=SqueezeDepth(20,2.0,20,1.5,12).momentum | prev(k) > 0 AND k <= 0 AND m <= 0
supertrend_long | 11 | k=SuperTrendTrail(10,3.0).regime | k = 1
supertrend_short | 11 | k=SuperTrendTrail(10,3.0).regime | k = -1
supertrend_flip_up | 2 | k=SuperTrendTrail(10,3.0).regime | prev(k) = -1 AND k = 1
supertrend_flip_down | 2 | k=SuperTrendTrail(10,3.0).regime | prev(k) = 1 AND k = -1
"""

#: Crossings of a fast and a slow average: name, indicator, output, the two parameter lists, fewest bars.
_CROSSES = """
vwma VWMA vwma 9 21 22
alma ALMA alma 9,0.85,6.0 21,0.85,6.0 22
dema DEMA dema 9 21 22
ema EMA ema 9 21 22
hma HMA hma 9 25 26
sma SMA sma 9 21 22
smma SMMA smma 14 50 51
t3 T3 t3 5,0.7 10,0.7 61
tema TEMA tema 9 21 22
trima TRIMA trima 10 30 31
wma WMA wma 9 21 22
epma EPMA epma 10 30 31
"""

_RIBBON = [5, 8, 13, 21, 34, 55, 89, 144]

#: Candle patterns over this bar, the bar before (o1, h1, l1, c1) and the one before that (o2, ...).  ``b`` is the body, ``r`` the range, ``u`` and ``d`` the wicks.
_CANDLES = {
    "doji": (1, "r > 0 AND b <= 0.1 * r"),
    "long_legged_doji": (1, "r > 0 AND b <= 0.1 * r AND u >= 0.25 * r AND d >= 0.25 * r"),
    "dragonfly_doji": (1, "r > 0 AND b <= 0.1 * r AND u <= 0.1 * r AND d > b"),
    "gravestone_doji": (1, "r > 0 AND b <= 0.1 * r AND d <= 0.1 * r AND u > b"),
    "hammer": (1, "b > 0 AND d >= 2 * b AND u <= 0.1 * b"),
    "hanging_man": (1, "b > 0 AND d >= 2 * b AND u <= 0.1 * b"),
    "shooting_star": (1, "b > 0 AND u >= 2 * b AND d <= 0.1 * b"),
    "inverted_hammer": (1, "b > 0 AND u >= 2 * b AND d <= 0.1 * b"),
    "marubozu_bullish": (1, "r > 0 AND u <= 0.05 * r AND d <= 0.05 * r AND close > open"),
    "marubozu_bearish": (1, "r > 0 AND u <= 0.05 * r AND d <= 0.05 * r AND close < open"),
    "spinning_top": (1, "r > 0 AND b <= 0.3 * r AND u >= 0.2 * r AND d >= 0.2 * r"),
    "bullish_engulfing": (2, "c1 < o1 AND open < c1 AND close > o1 AND c1 <> 0"),
    "bearish_engulfing": (2, "c1 > o1 AND open > c1 AND close < o1 AND c1 <> 0"),
    "bullish_harami": (2, "c1 < o1 AND close > open AND open > c1 AND close < o1 AND c1 <> 0"),
    "bearish_harami": (2, "c1 > o1 AND close < open AND open < c1 AND close > o1 AND c1 <> 0"),
    "piercing_line": (2, "c1 < o1 AND close > open AND open < c1 AND close > (c1 + o1) / 2"),
    "dark_cloud_cover": (2, "c1 > o1 AND close < open AND open > c1 AND close < (c1 + o1) / 2"),
    "tweezer_tops": (2, "abs(high - h1) <= 0.01 * r20 AND c1 > o1 AND close < open"),
    "tweezer_bottoms": (2, "abs(low - l1) <= 0.01 * r20 AND c1 < o1 AND close > open"),
    "morning_star": (3, "c2 < o2 AND abs(c1 - o1) <= 0.3 * (h1 - l1) AND close > open AND 2 * close > o2 + c2"),
    "evening_star": (3, "c2 > o2 AND abs(c1 - o1) <= 0.3 * (h1 - l1) AND close < open AND 2 * close < o2 + c2"),
    "three_white_soldiers": (3, "c2 > o2 AND c1 > o1 AND close > open AND c2 < c1 AND c1 < close AND o1 BETWEEN o2 AND c2 AND open BETWEEN o1 AND c1 AND b >= r / 2 AND c1 - o1 >= (h1 - l1) / 2 AND c2 - o2 >= (h2 - l2) / 2"),
    "three_black_crows": (3, "c2 < o2 AND c1 < o1 AND close < open AND c2 > c1 AND c1 > close AND o1 BETWEEN c2 AND o2 AND open BETWEEN c1 AND o1 AND b >= r / 2 AND o1 - c1 >= (h1 - l1) / 2 AND o2 - c2 >= (h2 - l2) / 2"),
    "three_inside_up": (3, "c2 < o2 AND c1 > o1 AND o1 > c2 AND c1 < o2 AND close > open AND close > o2"),
    "three_inside_down": (3, "c2 > o2 AND c1 < o1 AND o1 < c2 AND c1 > o2 AND close < open AND close < o2"),
    "inside_bar": (2, "high < h1 AND low > l1 AND c1 <> 0"),
    "outside_bar": (2, "high > h1 AND low < l1 AND c1 <> 0"),
    "bullish_pin_bar": (1, "b > 0 AND d >= 2 * b AND d > 0.67 * r"),
    "bearish_pin_bar": (1, "b > 0 AND u >= 2 * b AND u > 0.67 * r"),
    "two_bar_reversal_bullish": (2, "c1 < o1 AND c1 - l1 <= 0.25 * (h1 - l1) AND close > open AND high - close <= 0.25 * r AND low <= l1 AND close > o1"),
    "two_bar_reversal_bearish": (2, "c1 > o1 AND h1 - c1 <= 0.25 * (h1 - l1) AND close < open AND close - low <= 0.25 * r AND high >= h1 AND close < o1"),
    "nr7": (7, "n > 6 AND r < least_before"),
}
#: The patterns of each family, looked for on the last five bars; those of three bars count from the third bar on.
_FAMILIES = {
    "bullish_pattern_recent": (2, "hammer inverted_hammer bullish_engulfing bullish_harami piercing_line dragonfly_doji tweezer_bottoms bullish_pin_bar morning_star three_white_soldiers three_inside_up"),
    "bearish_pattern_recent": (2, "hanging_man shooting_star bearish_engulfing bearish_harami dark_cloud_cover gravestone_doji tweezer_tops bearish_pin_bar evening_star three_black_crows three_inside_down"),
    "reversal_pattern_bullish": (2, "hammer inverted_hammer bullish_engulfing piercing_line dragonfly_doji morning_star"),
    "reversal_pattern_bearish": (2, "hanging_man shooting_star bearish_engulfing dark_cloud_cover gravestone_doji evening_star"),
    "continuation_pattern_bullish": (3, "three_white_soldiers three_inside_up"),
    "continuation_pattern_bearish": (3, "three_black_crows three_inside_down"),
    "indecision_pattern_recent": (2, "doji spinning_top inside_bar nr7"),
    "strong_body_recent": (1, "marubozu_bullish marubozu_bearish"),
}
_CANDLE_BARS = """candles AS (SELECT *, abs(close - open) AS b, high - low AS r, CASE WHEN close > open THEN high - close ELSE high - open END AS u, CASE WHEN close > open THEN open - low ELSE close - low END AS d,
  row_number() OVER w AS n, lag(open) OVER w AS o1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(close) OVER w AS c1, lag(open, 2) OVER w AS o2, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, lag(close, 2) OVER w AS c2,
  sum(high - low) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) / least(20, row_number() OVER w) AS r20m, min(high - low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS least_before
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), marked AS (SELECT *, CASE WHEN n >= 20 THEN r20m END AS r20 FROM candles)"""

#: Alternative readings: column, fewest bars, columns over the readings that are there, condition on what was read last (``r``).
_READINGS = {
    "token_unlock_pressure_low": ("TokenUnlockPressure", 1, "v", "r.v <= 0.02"),
    "token_unlock_cliff_ahead": ("TokenUnlockPressure", 31, "v, list(v) OVER z AS past", "r.v >= 0.03 AND len(r.past) = 30 AND (coalesce(list_stddev_samp(r.past), 0) = 0 OR r.v - list_avg(r.past) >= 2 * list_stddev_samp(r.past))"),
    "funding_negative_regime": ("PerpFundingRate", 14, "list(v) OVER (ORDER_ ROWS 13 PRECEDING) AS last", "len(r.last) = 14 AND list_sum(r.last) < 0"),
    "funding_flip_positive": ("PerpFundingRate", 2, "v, lag(v) OVER (ORDER_) AS v1", "r.v1 <= 0 AND r.v > 0"),
    "etf_inflow_streak": ("EtfNetFlow", 5, "list(v) OVER (ORDER_ ROWS 4 PRECEDING) AS last", "len(r.last) = 5 AND list_min(r.last) > 0"),
    "etf_inflow_spike": ("EtfNetFlow", 21, "v, list(v) OVER z AS past", "r.v > 0 AND len(r.past) = 20 AND list_stddev_samp(r.past) > 0 AND r.v - list_avg(r.past) >= 2 * list_stddev_samp(r.past)"),
    "treasury_growing": ("TreasuryUsd", 15, "v, lag(v, 14) OVER (ORDER_) AS old", "r.v > r.old"),
    "treasury_accumulation_trigger": ("TreasuryUsd", 21, "v, lag(v) OVER (ORDER_) AS v1, list(v) OVER (ORDER_ ROWS 20 PRECEDING) AS last", "len(r.last) = 21 AND r.v1 * 20 <= list_sum(r.last[1:20]) AND r.v * 20 > list_sum(r.last[2:21])"),
    "lending_spread_low": ("LendingRateSpread", 1, "v", "r.v <= 0.02"),
    "lending_spread_widening": ("LendingRateSpread", 21, "v, lag(v) OVER (ORDER_) AS v1, list(v) OVER (ORDER_ ROWS 20 PRECEDING) AS last", "len(r.last) = 21 AND r.v1 <= list_avg(r.last[1:20]) AND r.v > list_avg(r.last[2:21])"),
    "smart_money_inflow_spike": ("SmartMoneyNetflow", 21, "v, list(v) OVER z AS past", "r.v > 0 AND len(r.past) = 20 AND list_stddev_samp(r.past) > 0 AND r.v - list_avg(r.past) >= 2 * list_stddev_samp(r.past)"),
    "smart_money_holdings_cross": ("SmartMoneyHoldings", 21, "v, lag(v) OVER (ORDER_) AS v1, list(v) OVER (ORDER_ ROWS 20 PRECEDING) AS last", "len(r.last) = 21 AND r.v1 * 20 <= list_sum(r.last[1:20]) AND r.v * 20 > list_sum(r.last[2:21])"),
    "smart_money_net_positive": ("SmartMoneyNetflow", 14, "list(v) OVER (ORDER_ ROWS 13 PRECEDING) AS last", "len(r.last) = 14 AND list_sum(r.last) > 0"),
    "smart_money_holdings_rising": ("SmartMoneyHoldings", 15, "v, lag(v, 14) OVER (ORDER_) AS old", "r.v > r.old"),
    "exchange_outflow_spike": ("ExchangeNetflow", 21, "v, list(v) OVER z AS past", "r.v < 0 AND len(r.past) = 20 AND list_stddev_samp(r.past) > 0 AND r.v - list_avg(r.past) <= -2 * list_stddev_samp(r.past)"),
    "exchange_net_outflow": ("ExchangeNetflow", 14, "list(v) OVER (ORDER_ ROWS 13 PRECEDING) AS last", "len(r.last) = 14 AND list_sum(r.last) < 0"),
    "whale_accumulation_trigger": ("WhaleNetInflow", 8, "list(v) OVER (ORDER_ ROWS 7 PRECEDING) AS last", "len(r.last) = 8 AND list_sum(r.last[1:7]) <= 0 AND list_sum(r.last[2:8]) > 0"),
    "whale_net_accumulation": ("WhaleNetInflow", 14, "list(v) OVER (ORDER_ ROWS 13 PRECEDING) AS last", "len(r.last) = 14 AND list_sum(r.last) > 0"),
    "holder_concentration_low": ("HolderConcentration", 1, "v", "r.v < 0.5"),
    "holder_concentration_falling": ("HolderConcentration", 15, "v, lag(v, 14) OVER (ORDER_) AS old", "r.v < r.old"),
    "holder_growth_trend": ("HolderCount", 15, "v, lag(v, 14) OVER (ORDER_) AS old", "r.old <> 0 AND (r.v - r.old) / r.old * 100 >= 1"),
    "social_crowd_bullish": ("SocialNetBullShare", 67, "list(v) OVER (ORDER_ ROWS 66 PRECEDING) AS last", "len(r.last) = 67 AND list_avg(r.last[61:67]) > list_avg(r.last[1:60])"),
    "social_crowd_cooling": ("SocialNetBullShare", 67, "list(v) OVER (ORDER_ ROWS 66 PRECEDING) AS last", "len(r.last) = 67 AND list_avg(r.last[61:67]) <= list_avg(r.last[1:60])"),
}

#: Two readings, each held on its own: (column, columns over it) twice, fewest bars, condition on ``r`` and ``q``.
_SPREAD = "len(r.past) = 30 AND list_stddev_samp(r.past) > 1e-12 * greatest(abs(list_avg(r.past)), 1)"
_PAIRS = {
    "whale_share_divergence": (("close", "v, lag(v, 7) OVER (ORDER_) AS old"), ("WhaleHeldShare", "v, lag(v, 7) OVER (ORDER_) AS old"), 8, "100 * (r.v - r.old) <= -5 * r.old AND q.v > q.old"),
    "social_sentiment_surge": (("SocialSentiment", "v, list(v) OVER (ORDER_ ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS past"), ("SocialAuthors", "v"), 31, _SPREAD + " AND r.v - list_avg(r.past) >= 2 * list_stddev_samp(r.past) AND q.v >= 20"),
    "social_sentiment_capitulation": (("SocialSentiment", "v, list(v) OVER (ORDER_ ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS past"), ("SocialAuthors", "v"), 31, _SPREAD + " AND list_avg(r.past) - r.v >= 2 * list_stddev_samp(r.past) AND q.v >= 20"),
    "social_price_divergence": (("close", "v, lag(v, 7) OVER (ORDER_) AS old"), ("SocialNetBullShare", "list(v) OVER (ORDER_ ROWS 66 PRECEDING) AS last"), 67, "100 * (r.v - r.old) <= -3 * r.old AND len(q.last) = 67 AND list_avg(q.last[61:67]) - list_avg(q.last[1:60]) >= -1e-9"),
}
#: Post counts keep their gaps: any null among the bars read gives False.  ``x`` are the counts of the last bars, oldest first, ``l`` their logs.
_POSTS = {
    "x_post_count_spike": (49, "list_count(x) = 49 AND x[49] >= 20 AND list_stddev_samp(l[1:48]) > 1e-12 * greatest(abs(list_avg(l[1:48])), 1) AND l[49] - list_avg(l[1:48]) >= 3 * list_stddev_samp(l[1:48])"),
    "x_attention_elevated": (78, "list_count(x) = 78 AND list_avg(x[1:72]) > 0 AND list_avg(x[73:78]) / list_avg(x[1:72]) >= 1.5"),
    "x_attention_price_divergence": (73, "list_count(x) = 73 AND 100 * (close - before) <= -5 * before AND list_stddev_samp(l[1:72]) > 1e-12 * greatest(abs(list_avg(l[1:72])), 1) AND l[73] - list_avg(l[1:72]) >= 2 * list_stddev_samp(l[1:72])"),
}


def _bindings() -> dict[str, tuple[int, list[tuple[str, str, list, str]], str]]:
    out = {}
    lines = [x.split("|") for x in _TABLE.strip().splitlines()]
    for x in _CROSSES.strip().splitlines():
        name, indicator, output, fast, slow, least = x.split()
        use = f"a={indicator}({fast}).{output}; b={indicator}({slow}).{output}"
        lines += [[f"{name}_cross_up", least, use, "prev(a) <= prev(b) AND a > b"], [f"{name}_cross_down", least, use, "prev(a) >= prev(b) AND a < b"]]
        if name in ("ema", "sma"):
            lines.append([f"{name}_crossover", least, use, "prev(a) <= prev(b) AND a > b"])
    ribbon = "; ".join(f"s{n}=SMA({n}).sma" for n in _RIBBON)
    chain = lambda op: " AND ".join(f"s{m} {op} s{n}" for m, n in zip(_RIBBON, _RIBBON[1:]))
    lines += [["ma_ribbon_bullish", "144", ribbon, chain(">")], ["ma_ribbon_bearish", "144", ribbon, chain("<")], ["ma_ribbon_tangled", "144", ribbon, f"s144 IS NOT NULL AND NOT ({chain('>')}) AND NOT ({chain('<')})"]]
    for name, least, use, text in lines:
        bound = []
        for part in filter(None, (u.strip() for u in use.split(";"))):
            alias, indicator, args, output = re.fullmatch(r"(\w+)=(\w+)\((.*)\)\.(\w+)", part).groups()
            bound.append((alias, indicator, [None if a == "None" else a == "True" if a in ("True", "False") else float(a) if "." in a else int(a) for a in args.split(",") if a], output))
        out[name.strip()] = (int(least), bound, text.strip())
    return out


_BOUND = _bindings()


def signal_oracle(name: str, bars_sql: str) -> str | None:
    """DuckDB text of a signal by the tables above; None for signals that aren't in them."""
    end = "SELECT symbol, ts, coalesce({}, false) AS fired FROM {}"
    if name in _BOUND:
        least, bound, text = _BOUND[name]
        requests = [request(i, **dict(zip(INDICATORS[i].params, args))) for _, i, args, _ in bound]
        builders, outs = plan(requests)
        ctes, n = to_sql("bars", builders)
        cols = "".join(f", {o[out]} AS {alias}" for (alias, _, _, out), o in zip(bound, outs))
        text = re.sub(r"prev\((\w+), (\d+)\)", rf"lag(\1, \2) {_W}", re.sub(r"prev\((\w+)\)", rf"lag(\1) {_W}", text))
        keep = "symbol, ts, open, high, low, close, volume"
        return f"WITH RECURSIVE bars AS ({bars_sql}), {ctes.replace('0.0D', '0.0')}, bound AS (SELECT {keep}{cols}, row_number() {_W} AS bar_no FROM s{n}) " + end.format(f"(bar_no >= {least} AND {text})", "bound")
    if name.removesuffix("_trigger") in _CANDLES:
        least, text = _CANDLES[name.removesuffix("_trigger")]
        return f"WITH bars AS ({bars_sql}), {_CANDLE_BARS} " + end.format(f"(n >= {least} AND {text})", "marked")
    if name in _FAMILIES:
        least, members = _FAMILIES[name]
        hit = " OR ".join(f"coalesce({_CANDLES[m][1]}, false)" for m in members.split())
        recent = "bool_or(hit) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING)"
        return f"WITH bars AS ({bars_sql}), {_CANDLE_BARS}, hits AS (SELECT *, {hit} AS hit FROM marked) " + end.format(f"(n >= {least} AND {recent})", "hits")
    if name in _READINGS:
        column, least, values, text = _READINGS[name]
        order = "PARTITION BY symbol ORDER BY ts"
        window = {31: 30, 21: 20}.get(least, 1)
        values = values.replace("OVER z", f"OVER ({order} ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)").replace("ORDER_", order)
        there = f"r AS (SELECT symbol, ts, {values} FROM (SELECT symbol, ts, {column} AS v FROM bars WHERE {column} IS NOT NULL))"
        numbered = f"numbered AS (SELECT symbol, ts, row_number() {_W} AS n FROM bars)"
        return f"WITH bars AS ({bars_sql}), {there}, {numbered} SELECT b.symbol, b.ts, coalesce(b.n >= {least} AND {text}, false) AS fired FROM numbered b ASOF LEFT JOIN r ON b.symbol = r.symbol AND b.ts >= r.ts"
    order = "PARTITION BY symbol ORDER BY ts"
    if name in _PAIRS:
        *parts, least, text = _PAIRS[name]
        there = [f"{alias} AS (SELECT symbol, ts, {values.replace('ORDER_', order)} FROM (SELECT symbol, ts, {column} AS v FROM bars WHERE {column} IS NOT NULL))" for alias, (column, values) in zip("rq", parts)]
        joined = " ".join(f"ASOF LEFT JOIN {a} ON b.symbol = {a}.symbol AND b.ts >= {a}.ts" for a in "rq")
        return f"WITH bars AS ({bars_sql}), {', '.join(there)}, numbered AS (SELECT symbol, ts, row_number() {_W} AS n FROM bars) SELECT b.symbol, b.ts, coalesce(b.n >= {least} AND {text}, false) AS fired FROM numbered b {joined}"
    if name in _POSTS:
        n, text = _POSTS[name]
        posts = f"p AS (SELECT symbol, ts, close, lag(close, 24) {_W} AS before, list(XPostCount) OVER ({order} ROWS {n - 1} PRECEDING) AS x FROM bars), q AS (SELECT *, list_transform(x, lambda v: ln(1 + greatest(v, 0))) AS l FROM p)"
        return f"WITH bars AS ({bars_sql}), {posts} " + end.format(f"(len(x) = {n} AND {text})", "q")
    if name == "mass_reversal_signal":
        builders, outs = plan([request("MassIndex", window_fast=9, window_slow=25)])
        ctes, n = to_sql("bars", builders)
        bulge = f"c AS (SELECT symbol, ts, row_number() {_W} AS n, list_max(list({outs[0]['mass_index']}) OVER ({order} ROWS 9 PRECEDING)) > 27 AND {outs[0]['mass_index']} < 26.5 AS cond FROM s{n})"
        return f"WITH RECURSIVE bars AS ({bars_sql}), {ctes.replace('0.0D', '0.0')}, {bulge} " + end.format(f"(n >= 34 AND cond AND NOT coalesce(lag(cond) {_W}, false))", "c")
    return None

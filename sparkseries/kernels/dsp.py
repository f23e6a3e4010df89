"""Recursive filters and change detectors."""

from __future__ import annotations

import numpy as np


def ema(v: np.ndarray, span: int) -> np.ndarray:
    """Exponential average with weight 2 / (span + 1), starting at the first value; NaN carries it forward."""
    a, out, last = 2.0 / (span + 1), np.empty(len(v)), np.nan
    for i, x in enumerate(v):
        if not np.isnan(x):
            last = x if np.isnan(last) else last + a * (x - last)
        out[i] = last
    return out


def macd(v: np.ndarray, fast: int = 6, slow: int = 13, signal: int = 5) -> dict[str, np.ndarray]:
    line = ema(v, fast) - ema(v, slow)
    sig = ema(line, signal)
    hist = line - sig
    return {"macd": line, "macd_signal": sig, "macd_hist": hist, "macd_slope": np.diff(hist, prepend=hist[:1])}


def _two_pole(gain: np.ndarray, b1: float, b2: float, head: np.ndarray | None = None) -> np.ndarray:
    """y[i] = gain[i] + b1 * y[i - 1] + b2 * y[i - 2] from i = 2 on; the first two are ``head`` (or 0)."""
    y = np.zeros(len(gain))
    if head is not None:
        y[:2] = head[:2]
    for i in range(2, len(gain)):
        y[i] = gain[i] + b1 * y[i - 1] + b2 * y[i - 2]
    return y


def high_pass_weight(period: int) -> float:
    w = 0.707 * 2 * np.pi / period
    return 1 - (np.cos(w) + np.sin(w) - 1) / np.cos(w)


def smoother_weights(period: int) -> tuple[float, float]:
    """Weights of the last two outputs of the smoother."""
    decay = np.exp(-np.sqrt(2) * np.pi / period)
    return 2 * decay * np.cos(np.sqrt(2) * np.pi / period), -decay * decay


def high_pass(v: np.ndarray, period: int) -> np.ndarray:
    """Two-pole high-pass filter: takes out swings longer than ``period``."""
    k = high_pass_weight(period)
    bend = np.zeros(len(v))
    bend[2:] = v[2:] - 2 * v[1:-1] + v[:-2]
    return _two_pole(((1 + k) / 2) ** 2 * bend, 2 * k, -k * k)


def super_smoother(v: np.ndarray, period: int, keep_head: bool = False) -> np.ndarray:
    """Two-pole smoother of neighbour means: takes out swings shorter than ``period``."""
    b1, b2 = smoother_weights(period)
    mean = np.zeros(len(v))
    mean[1:] = (v[1:] + v[:-1]) / 2
    return _two_pole((1 - b1 - b2) * mean, b1, b2, v if keep_head else None)


def roofing(v: np.ndarray, high: int = 48, low: int = 10) -> np.ndarray:
    return super_smoother(high_pass(v, high), low)


def fisher(v: np.ndarray, period: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Fisher transform of the place in the last ``period`` values, with its value one row before as signal."""
    n, x, out = len(v), 0.0, np.zeros(len(v))
    for i in range(period, n):
        part = v[i - period + 1 : i + 1]
        low, high = part.min(), part.max()
        place = 2 * ((v[i] - low) / (high - low) - 0.5) if high > low else 0.0
        x = min(0.999, max(-0.999, 0.33 * place + 0.67 * x))
        out[i] = (np.arctanh(x) + out[i - 1]) / 2
    return out, np.concatenate([[np.nan], out[:-1]])[:n]


def sinewave(v: np.ndarray, high: int = 40, low: int = 10) -> np.ndarray:
    """Even-better-sinewave regime in [-1, 1]: the filtered wave over the root of its two-row power, smoothed."""
    f = roofing(v, high, low)
    power = np.zeros(len(f))
    power[1:] = (f[1:] ** 2 + f[:-1] ** 2) / 2
    wave = np.clip(np.divide(f, np.sqrt(power), out=np.zeros(len(f)), where=power > 0), -1, 1)
    out = np.zeros(len(f))
    for i in range(1, len(f)):
        out[i] = 0.67 * wave[i] + 0.33 * out[i - 1]
    return out


def itrend(v: np.ndarray, period: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Instantaneous trend line and its trigger, which leads by two rows."""
    line = super_smoother(v, period, keep_head=True)
    trigger = line.copy()
    trigger[2:] = 2 * line[2:] - line[:-2]
    return line, trigger


def hurst(v: np.ndarray, first: int = 4) -> float:
    """Hurst exponent by rescaled range over window sizes that grow by half; 0.5 for less than 20 values."""
    n, size, points = len(v), first, []
    if n < 20:
        return 0.5
    while size <= n // 2:
        parts = v[: n // size * size].reshape(-1, size)
        walk = np.cumsum(parts - parts.mean(axis=1, keepdims=True), axis=1)
        spread, sigma = walk.max(axis=1) - walk.min(axis=1), parts.std(axis=1, ddof=1)
        if (sigma > 0).any():
            points.append((np.log(size), np.log((spread[sigma > 0] / sigma[sigma > 0]).mean())))
        size = max(int(size * 1.5), size + 1)
    if len(points) < 3:
        return 0.5
    x, y = np.array(points).T
    return float(np.clip(np.polyfit(x, y, 1)[0], 0, 1))


def rolling_hurst(v: np.ndarray, window: int = 48, step: int = 12) -> np.ndarray:
    """Hurst exponent of the ``window`` values before every ``step``-th row, held in between; 0.5 before the first."""
    out, last = np.full(len(v), 0.5), 0.5
    for i in range(window, len(v)):
        if i % step == 0 and v[i - window : i].std() > 0:
            last = hurst(v[i - window : i])
        out[i] = last
    return out


def cusum(v: np.ndarray, h: float = 1.0, drift: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-sided cumulative sums (up, down, alarm): limit and drift in population deviations of the series; a sum
    that passes its limit starts again from 0, and the down side raises the alarm."""
    sigma = v.std() or 1.0
    up, down, alarm = np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(v), bool)
    for i in range(1, len(v)):
        up[i] = max(0.0, up[i - 1] + v[i] - drift * sigma)
        down[i] = min(0.0, down[i - 1] + v[i] + drift * sigma)
        alarm[i] = down[i] < -h * sigma
        up[i], down[i] = (0.0 if up[i] > h * sigma else up[i]), (0.0 if alarm[i] else down[i])
    return up, down, alarm

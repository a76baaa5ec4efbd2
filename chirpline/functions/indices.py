"""The spectral indices of one spectrogram that fits a task, with numpy: an amplitude matrix of bins by frames.

The same indices for spectrograms of any length are those of ``operators.spectral``.
"""

from __future__ import annotations

import math

import numpy as np

from chirpline.functions import kernels as kn

TINY = np.finfo(float).tiny
LOW, MID, HIGH = (0.0, 1000.0), (1000.0, 10000.0), (10000.0, 20000.0)
NAMES = (
    "MEANf VARf SKEWf KURTf NBPEAKS LEQf ENRf BGNf SNRf Hf EAS ECU ECV EPS EPS_KURT EPS_SKEW ACI NDSI rBA AnthroEnergy BioEnergy BI ROU ADI AEI LFC MFC HFC "
    "ACTspFract ACTspCount ACTspMean EVNspFract EVNspMean EVNspCount TFSD H_Havrda H_Renyi H_pairedShannon H_gamma H_GiniSimpson RAOQ AGI nROI aROI"
).split()


def decibels(x: np.ndarray | float, factor: float = 10.0) -> np.ndarray:
    return factor * np.log10(np.maximum(np.abs(x), TINY))


def entropy(v: np.ndarray) -> float:
    """Shannon entropy over ln n of positive values; 0 for one value, 1 for zeros alone."""
    s = v.sum()
    if len(v) == 1:
        return 0.0
    if s == 0:
        return 1.0
    return float((math.log(max(s, TINY)) - (v * np.log(np.maximum(v, TINY))).sum() / s) / math.log(len(v)))


def running_mean(v: np.ndarray, n: int) -> np.ndarray:
    """Centred mean; the end values repeat beyond the ends."""
    return np.convolve(np.pad(v, (n // 2, n - 1 - n // 2), mode="edge"), np.ones(n) / n, "valid")


def moments(v: np.ndarray) -> tuple[float, ...]:
    d, n = v - v.mean(), len(v)
    s = math.sqrt((d * d).mean())
    skew, kurt = (float((d**k).sum() / (n - 1) / s**k) if s and n > 1 else math.nan for k in (3, 4))
    return float(v.mean()), s * s, skew, kurt


def ratio(a: float, b: float) -> float:
    return a / b if b else math.nan


class Axis:
    """The frequency axis: n bins, df Hz apart."""

    def __init__(self, n: int, df: float):
        self.n, self.df, self.top = n, df, (n - 1) * df

    def nearest(self, f: float) -> int:
        return int(np.argmin(np.abs(np.arange(self.n) * self.df - f)))

    def band(self, lo: float, hi: float) -> slice:
        return slice(self.nearest(lo), self.nearest(hi) + 1)

    def steps(self, spectrum: np.ndarray, step: float) -> np.ndarray:
        """Means over left-closed steps from 0, times the mean number of bins a step; NaN for steps without bins."""
        n = math.ceil((self.top + step) / step) - 1
        b = np.floor(np.arange(self.n) * self.df / step).astype(int)
        inside = b < n
        count = np.bincount(b[inside], minlength=n).astype(float)
        sums = np.bincount(b[inside], spectrum[inside], minlength=n)
        return np.divide(sums, count, out=np.full(n, math.nan), where=count > 0) * count.mean()


def loud_shares(loud: np.ndarray, axis: Axis, lo: float, hi: float, step: float) -> np.ndarray:
    """Share of loud cells per band; snapped bands share their edge bins."""
    return np.array([loud[axis.band(lo + step * b, lo + step * (b + 1))].mean() for b in range(int((hi - lo) // step))])


def event_rows(active: np.ndarray, least: int, dt: float) -> np.ndarray:
    """Per bin the share, mean duration and rate of runs of at least ``least`` frames: an array of three rows."""
    n, t = active.shape
    edge = np.diff(np.pad(active.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    length = np.nonzero(edge == -1)[1] - start
    row, length = row[length >= least], length[length >= least]
    count, kept = np.bincount(row, minlength=n), np.bincount(row, length, minlength=n)
    mean = np.divide(kept * dt, count, out=np.zeros(n), where=count > 0)
    return np.array([kept / t, mean, count / ((t - 1) * dt) if t > 1 else np.zeros(n)])


def regions(power: np.ndarray, df: float, dt: float, seed: float, low: float, min_duration: float = 0.025, min_bw: float = 50.0, flim_min: float = 50.0, max_ratio: float = 10.0) -> tuple[float, float]:
    """ROIs per minute and the share of the picture they cover in percent; see ``operators.features.region_index``."""
    level = np.clip(decibels(power), -96, 0) + 96
    level = np.maximum(level - level.mean(axis=0), 0)
    level = np.maximum(level - np.median(level, axis=1, keepdims=True), 0)
    parts = kn.label(level > low)
    n, t = level.shape
    strong = np.zeros(parts.max() + 1, bool)
    strong[parts[level > seed]] = True
    strong[0] = False
    f, x = np.nonzero(strong[parts])
    which = parts[f, x]
    m = len(strong)
    low_y, low_x, high_y, high_x = np.full(m, n), np.full(m, t), np.full(m, -1), np.full(m, -1)
    for at, v, fold in ((low_y, f, np.minimum), (low_x, x, np.minimum), (high_y, f, np.maximum), (high_x, x, np.maximum)):
        fold.at(at, which, v)
    area = np.bincount(which, minlength=m)
    boxed = strong & (area >= min_duration * min_bw)
    high, wide = (high_y - low_y) * df, (high_x - low_x) * dt
    sized = boxed & (wide >= min_duration) & (high >= min_bw)
    erased = low_y <= max(1, round(flim_min / df))
    narrow = (high_y - low_y) < max_ratio * (high_x - low_x)
    return ratio(float((sized & ~erased & narrow).sum()), (t - 1) * dt / 60), float(area[boxed & ~(sized & erased)].sum() / (n * t) * 100)


def spectral_indices(a: np.ndarray, df: float, dt: float, centres: list[float], threshold: float = 3.0, gain_db: float = 42.0, seed: float = 13.0, low: float = 6.0) -> list[float]:
    """The values of ``NAMES``; NaN where an index isn't defined. ``centres`` are those of the third octaves on the axis."""
    n, t = a.shape
    axis, p = Axis(n, df), a * a
    power, amp = p.mean(axis=1), np.sqrt(p.mean(axis=1))
    out: dict[str, float] = dict(zip(("MEANf", "VARf", "SKEWf", "KURTf"), moments(amp)))
    out["NBPEAKS"] = float(kn.number_of_peaks(decibels(amp, 20), df))
    pressure = amp / 10 ** (-35 / 20) / 10 ** (gain_db / 20)
    out["LEQf"] = float(10 * np.log10(np.maximum(pressure**2, TINY).sum() / 20e-6**2))

    median = np.median(p, axis=1)
    out["ENRf"] = float(decibels(power.sum()))
    out["BGNf"] = float(decibels(running_mean(running_mean(median, 25), 5).sum()))
    out["SNRf"] = out["ENRf"] - out["BGNf"]
    out["Hf"] = entropy(power)

    least = p.min(axis=1)
    norm = np.where(median > least, median - least, p.max())
    e = np.maximum((p - median[:, None]) / np.where(norm == 0, math.nan, norm)[:, None], 1)
    e = np.where(np.isnan(e), 1.0, e)
    level, wide = decibels(e), axis.band(MID[0], HIGH[1])
    mean, var = e[wide].mean(axis=1), e[wide].var(axis=1)
    out |= {"EAS": 1 - entropy(mean), "ECU": 1 - entropy(var), "ECV": 1 - entropy(var / mean)}

    nb = wide.stop - wide.start
    f = (wide.start + np.argmax(e[wide], axis=0)) * df
    f = f[(f >= MID[0]) & (f <= HIGH[1])]
    bucket = np.minimum(np.floor((f - MID[0]) / ((HIGH[1] - MID[0]) / nb)), nb - 1).astype(int)
    q = np.bincount(bucket, minlength=nb) / max(len(f), 1)
    d, some = q - 1 / nb, q > 0
    sd = math.sqrt((d * d).mean())
    out["EPS"] = float(1 + (q[some] * np.log(q[some])).sum() / math.log(nb)) if len(f) and nb > 1 else math.nan
    out |= {name: float((d**k).sum() / (nb - 1) / sd**k) if sd and nb > 1 else math.nan for name, k in (("EPS_KURT", 4), ("EPS_SKEW", 3))}

    step = np.abs(np.diff(a, axis=1))
    total = a.sum(axis=1)
    out["ACI"] = float((step.sum(axis=1)[total > 0] / total[total > 0]).sum())
    by_1000 = axis.steps(power, LOW[1] - LOW[0])
    near = lambda x: int(np.argmin(np.abs(np.arange(len(by_1000)) * 1000.0 - x)))
    bio, anthro = (float(np.nansum(by_1000[near(b[0]) : near(b[1]) + 1])) for b in (MID, LOW))
    out |= {"NDSI": ratio(bio - anthro, bio + anthro), "rBA": ratio(bio, anthro), "AnthroEnergy": anthro, "BioEnergy": bio}
    spectrum = decibels(a.mean(axis=1) / a.max(), 20)[axis.band(*MID)] if a.max() else np.full(1, math.nan)
    out["BI"] = float((spectrum - spectrum.min()).sum() / df)
    out["ROU"] = float((np.diff(a, 2, axis=1) ** 2).sum())

    loud = decibels(a / a.max(), 20) >= -50 if a.max() else np.zeros(a.shape, bool)
    share = loud_shares(loud, axis, LOW[0], MID[1], 1000)
    out["ADI"] = entropy(share) * math.log(len(share))
    share = np.sort(loud_shares(loud, axis, LOW[0], MID[1], 500))
    k = len(share)
    out["AEI"] = float((2 * (share * np.arange(1, k + 1)).sum() / share.sum() - (k + 1)) / k) if share.sum() else 0.0

    active, strong = level >= threshold, level > threshold
    fraction = active.mean(axis=1)
    out |= {name: float(fraction[axis.band(*b)].mean()) for name, b in (("LFC", LOW), ("MFC", MID), ("HFC", HIGH))}
    out |= {"ACTspFract": float(fraction.mean()), "ACTspCount": float(active.sum(axis=1).mean()), "ACTspMean": float(10 * np.log10(e[strong].mean())) if strong.any() else 0.0}
    out |= dict(zip(("EVNspFract", "EVNspMean", "EVNspCount"), (float(x.mean()) for x in event_rows(active, 4, dt))))

    g, reach = decibels(a, 1), 2**0.1666666
    fn = np.arange(n) * df
    octaves = np.array([g[(fn >= c / reach) & (fn <= c * reach)].sum(axis=0) for c in centres]).reshape(len(centres), t)
    cross = np.abs(np.diff(np.diff(octaves, axis=1), axis=0)).sum(axis=1)
    band = [int(np.argmin(np.abs(np.array(centres[:-1]) - x))) for x in MID] if len(centres) > 1 else [0, 0]
    out["TFSD"] = float(cross[band[0] : band[1] + 1].sum() / cross.sum()) if cross.sum() else 0.0

    m = np.maximum(power / power.sum(), TINY) if power.sum() else np.full(n, math.nan)
    out["H_Havrda"] = float((1 - (m**3).sum()) / 3)
    out["H_Renyi"] = float(np.log((m**3).sum()) / -2)
    out["H_pairedShannon"] = float(-(m * np.log(m)).sum() - ((1 - m) * np.log(np.maximum(1 - m, TINY))).sum())
    out["H_gamma"] = float((1 - (m ** (1 / 3)).sum() ** 3) / -3)
    out["H_GiniSimpson"] = float(1 - (m * m).sum())
    held = np.flatnonzero(~np.isnan(by_1000))
    shares = np.cumsum(by_1000[held]) / by_1000[held].sum()
    out["RAOQ"] = float(2 * (shares[:-1] * (1 - shares[:-1]) * np.diff(held)).sum() / (held[-1] - held[0]) * 2 * math.sqrt(2)) if len(held) > 1 else math.nan
    out["AGI"] = float((step.mean(axis=1) / np.maximum(np.median(step, axis=1), TINY)).mean()) if t > 1 else math.nan
    out["nROI"], out["aROI"] = regions(p, df, dt, seed, low)
    return [out[name] for name in NAMES]


def peak_counts(image: np.ndarray, threshold: float, distance: int, start: int, end: int) -> np.ndarray:
    """Local maxima per bin of the frames from start to end: cells that equal the maximum of their square, lie above the threshold and ``distance`` cells inside the picture."""
    return peak_mask(image, threshold, distance)[:, start:end].sum(axis=1)


def peak_mask(image: np.ndarray, threshold: float, distance: int) -> np.ndarray:
    n, t = image.shape
    out = np.zeros(image.shape, bool)
    w = 2 * distance + 1
    if n < w or t < w:
        return out
    top = np.lib.stride_tricks.sliding_window_view(np.lib.stride_tricks.sliding_window_view(image, w, axis=0).max(axis=-1), w, axis=1).max(axis=-1)
    inner = image[distance : n - distance, distance : t - distance]
    out[distance : n - distance, distance : t - distance] = (inner == top) & (inner > threshold)
    return out

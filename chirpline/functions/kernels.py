"""Numpy kernels for what is no set operation: transforms, filters, peaks, labels and image filters.

Images are matrices of frequency bins by frames. Everything here is a function of arrays and runs
inside Arrow or pandas functions.
"""

from __future__ import annotations

import math

import numpy as np


def hann(n: int) -> np.ndarray:
    """The periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def segments(x: np.ndarray, nperseg: int, hop: int) -> np.ndarray:
    if len(x) < nperseg:
        return np.empty((0, nperseg))
    return np.lib.stride_tricks.sliding_window_view(x, nperseg)[::hop]


def stft_power(x: np.ndarray, nperseg: int, noverlap: int | None = None) -> np.ndarray:
    """Power spectrogram, bins by frames.

    Each frame loses its mean and gets a Hann window; amplitudes are scaled by the density factor
    1 / sqrt(fs sum w^2) and sqrt(2 fs / nperseg), in which fs cancels. The last bin is dropped,
    and frames beyond n // hop - 1.
    """
    hop = nperseg - (nperseg // 2 if noverlap is None else noverlap)
    return frame_power(segments(np.asarray(x, float), nperseg, hop)[: max(len(x) // hop - 1, 0)], nperseg)


def frame_spectrum(frames: np.ndarray, nperseg: int) -> np.ndarray:
    """Complex spectra of frames that are cut already, one a row, scaled so that their squared magnitude is ``stft_power``."""
    w = hann(nperseg)
    frames = (frames - frames.mean(axis=1, keepdims=True)) * w if len(frames) else frames
    return np.fft.rfft(frames, axis=1)[:, : nperseg // 2] * math.sqrt(2 / (nperseg * (w @ w)))


def frame_power(frames: np.ndarray, nperseg: int) -> np.ndarray:
    """``stft_power`` of frames that are cut already, one a row."""
    return (np.abs(frame_spectrum(frames, nperseg)) ** 2).T


def welch(x: np.ndarray, fs: float, nperseg: int, noverlap: int | None = None, scaling: str = "spectrum") -> tuple[np.ndarray, np.ndarray]:
    """One-sided power of segments without their means, averaged: (power, frequency)."""
    w = hann(nperseg)
    frames = segments(np.asarray(x, float), nperseg, nperseg - (nperseg // 2 if noverlap is None else noverlap))
    frames = (frames - frames.mean(axis=1, keepdims=True)) * w
    power = (np.abs(np.fft.rfft(frames, axis=1)) ** 2).mean(axis=0)
    power /= w.sum() ** 2 if scaling == "spectrum" else fs * (w @ w)
    power[1 : None if nperseg % 2 else -1] *= 2
    return power, np.fft.rfftfreq(nperseg, 1 / fs)


def periodogram(x: np.ndarray, fs: float, scaling: str = "spectrum") -> tuple[np.ndarray, np.ndarray]:
    return welch(x, fs, len(x), 0, scaling)


def analytic_envelope(x: np.ndarray) -> np.ndarray:
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * h))


def resample(x: np.ndarray, fs: float, target: float) -> np.ndarray:
    """Fourier resampling to round(n target / fs) samples."""
    n, m = len(x), int(round(len(x) * target / fs))
    if n == m:
        return np.asarray(x, float)
    spectrum = np.fft.rfft(x)
    keep = min(n, m)
    out = np.zeros(m // 2 + 1, complex)
    out[: keep // 2 + 1] = spectrum[: keep // 2 + 1]
    if keep % 2 == 0:
        out[keep // 2] *= 2 if m < n else 0.5
        if m < n:
            out[keep // 2] = out[keep // 2].real
    return np.fft.irfft(out, m) * (m / n)


def polyphase_taps(up: int, down: int) -> np.ndarray:
    """Low-pass taps for a change of rate by up / down: a sinc with a Kaiser window of beta 5, ten samples of the slower side to each half, gain ``up`` at zero."""
    most = max(up, down)
    m = np.arange(-10 * most, 10 * most + 1)
    h = np.sinc(m / most) * np.kaiser(len(m), 5.0)
    return h / h.sum() * up


def resample_polyphase(x: np.ndarray, fs: int, target: int) -> np.ndarray:
    """Resampling to ceil(n up / down) samples through a polyphase filter, without delay; what lies beyond the ends is zero."""
    g = math.gcd(int(fs), int(target))
    up, down = int(target) // g, int(fs) // g
    x = np.asarray(x, float)
    if up == down or not len(x):
        return x
    h = polyphase_taps(up, down)
    at = np.arange(-(-len(x) * up // down)) * down + len(h) // 2
    out = np.zeros(len(at))
    for phase in range(up):
        mine = np.flatnonzero(at % up == phase)
        if len(mine):
            out[mine] = np.convolve(x, h[phase::up])[at[mine] // up]
    return out


def iir_gain(f: np.ndarray, fs: float, cut: tuple[float, ...], order: int, kind: str, design: str = "butter", ripple: float = 1.0, atten: float = 40.0) -> np.ndarray:
    """Squared magnitude of a digital filter by bilinear transform with prewarping.

    ``design`` is ``butter``, ``cheby1`` with ``ripple`` dB in the pass band, or ``cheby2`` with
    ``atten`` dB beyond the cut frequencies.
    """
    w = np.tan(np.pi * np.asarray(f, float) / fs)
    c = [math.tan(math.pi * x / fs) for x in cut]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        if kind == "lowpass":
            u = w / c[0]
        elif kind == "highpass":
            u = c[0] / w
        else:
            u = (w * w - c[0] * c[1]) / (w * (c[1] - c[0]))
            u = 1 / u if kind == "bandstop" else u
        u = np.nan_to_num(np.abs(u), nan=np.inf, posinf=np.inf)
        if design == "butter":
            return 1 / (1 + u ** (2 * order))
        if design not in ("cheby1", "cheby2"):
            raise ValueError(f"unknown design {design}")
        v = u if design == "cheby1" else 1 / u
        t = np.where(v <= 1, np.cos(order * np.arccos(np.minimum(v, 1))), np.cosh(order * np.arccosh(np.maximum(v, 1))))
        if design == "cheby1":
            return 1 / (1 + (10 ** (ripple / 10) - 1) * t * t)
        rest = 1 / (10 ** (atten / 10) - 1)
        return np.where(np.isinf(t), 1.0, rest * t * t / (1 + rest * t * t))


def zero_phase_iir(x: np.ndarray, fs: float, cut: tuple[float, ...], order: int = 4, kind: str = "bandpass", design: str = "butter", ripple: float = 1.0, atten: float = 40.0) -> np.ndarray:
    """Forward and backward filtering: the squared magnitude applied in the frequency domain.

    The signal is extended oddly at both ends by its own length less one, which stands for the
    start values of the recursion.
    """
    x = np.asarray(x, float)
    n = len(x)
    if n < 2:
        return x
    ext = np.concatenate((2 * x[0] - x[:0:-1], x, 2 * x[-1] - x[-2::-1]))
    f = np.fft.rfftfreq(len(ext), 1 / fs)
    return np.fft.irfft(np.fft.rfft(ext) * iir_gain(f, fs, cut, order, kind, design, ripple, atten), len(ext))[n - 1 : 2 * n - 1]


def kaiser_sinc_taps(cut: tuple[float, float], fs: float, atten: float = 80, transition_bw: float = 0.05, bandpass: bool = True) -> np.ndarray:
    """Taps of a Kaiser-windowed sinc filter; the number of taps follows from the attenuation and transition width."""
    width = (cut[1] - cut[0]) * transition_bw / (0.5 * fs)
    beta = 0.1102 * (atten - 8.7) if atten > 50 else 0.5842 * (atten - 21) ** 0.4 + 0.07886 * (atten - 21) if atten > 21 else 0.0
    n = math.ceil((atten - 7.95) / 2.285 / (math.pi * width) + 1)
    if not bandpass and n % 2 == 0:
        n += 1
    m = np.arange(n) - (n - 1) / 2
    low, high = (c / (0.5 * fs) for c in cut)
    sides = high * np.sinc(high * m) - low * np.sinc(low * m)
    h = sides if bandpass else np.sinc(m) - sides
    return h * np.kaiser(n, beta)


def causal_fir(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The filter's delay stays in the result."""
    n = len(x) + len(taps) - 1
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(taps, n), n)[: len(x)]


def mirrored_fir(x: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Centred convolution by the window's sum after mirroring half a window at both ends."""
    h = len(window) // 2
    ext = np.concatenate((x[:h][::-1], x, x[len(x) - h :][::-1])) if h else x
    y = np.convolve(ext, window, mode="same") / window.sum()
    return y[h : len(y) - h] if h else y


def ricker(width: float, half: int) -> np.ndarray:
    t = np.arange(-half, half + 1) / width
    return 2 / (math.sqrt(3) * math.pi**0.25) * (1 - t * t) * np.exp(-t * t / 2) / math.sqrt(width)


def cwt_rois(x: np.ndarray, fs: float, flims: tuple[float, float], tlen: float, th: float = 0.0) -> list[tuple[float, float]]:
    """Onset and offset (s) of sounds of about ``tlen`` seconds in a band.

    Bandpass, mean square in windows of at most 5 % of tlen, one Mexican-hat scale, threshold.
    """
    y = causal_fir(np.asarray(x, float), kaiser_sinc_taps(flims, fs, 80, 0.8))
    wl = max(1, int(2 ** math.floor(math.log2(tlen * fs * 0.05))))
    y = np.pad(y, (0, wl - len(y) % wl), "reflect") if len(y) > wl else np.pad(y, (0, wl - len(y) % wl))
    energy = (y.reshape(-1, wl) ** 2).mean(axis=1)
    t = (np.arange(len(energy)) + 0.5) * wl / fs
    width = max(1, round(tlen * fs / wl / 2))
    pad = 5 * width
    padded = np.pad(energy, pad, "reflect") if len(energy) > 1 else np.pad(energy, pad, "edge")
    kernel = ricker(width, 8 * width)
    c = np.convolve(padded, kernel, mode="full")[8 * width : 8 * width + len(padded)][pad : pad + len(energy)]
    step = np.diff((c > th).astype(int))
    on, off = t[np.flatnonzero(step > 0)] + t[0], t[np.flatnonzero(step < 0)] + t[0]
    if not len(on) or not len(off):
        return []
    if off[0] < on[0]:
        on = np.insert(on, 0, 0.0)
    if on[-1] > off[-1]:
        off = np.append(off, len(x) / fs)
    return [(round(a, 5), round(b, 5)) for a, b in zip(on, off)]


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Middles of strict local maxima; a plateau counts once, edges don't."""
    edges = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.concatenate(([0], edges + 1)), np.concatenate((edges, [len(x) - 1]))
    level = x[starts]
    inner = np.zeros(len(starts), bool)
    inner[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (starts[inner] + ends[inner]) // 2


def _last_higher(x: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a larger value, -1 if none; with a stack, in one pass."""
    out, stack = np.empty(len(x), int), []
    for i, v in enumerate(x.tolist()):
        while stack and x[stack[-1]] <= v:
            stack.pop()
        out[i] = stack[-1] if stack else -1
        stack.append(i)
    return out


def prominences(x: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prominence and the bases to both sides: the lowest points before a higher value, the nearest of equal ones."""
    n = len(x)
    before = _last_higher(x) if len(peaks) else np.empty(0, int)
    after = n - 1 - _last_higher(x[::-1])[::-1] if len(peaks) else np.empty(0, int)
    left, right = np.zeros(len(peaks), int), np.zeros(len(peaks), int)
    for k, p in enumerate(peaks):
        left[k] = p - np.argmin(x[before[p] + 1 : p + 1][::-1])
        right[k] = p + np.argmin(x[p : after[p]])
    return (x[peaks] - np.maximum(x[left], x[right])) if len(peaks) else np.zeros(0), left, right


def find_peaks(x: np.ndarray, height: float | None = None, distance: float | None = None, prominence: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Peaks by height, then distance (higher ones first), then prominence: (peaks, left bases, right bases)."""
    peaks = local_maxima(np.asarray(x, float))
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance is not None and distance > 1:
        d, keep = math.ceil(distance), np.ones(len(peaks), bool)
        for i in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[i]:
                near = np.abs(peaks - peaks[i]) < d
                near[i] = False
                keep[near] = False
        peaks = peaks[keep]
    p, left, right = prominences(x, peaks)
    if prominence is not None:
        ok = p >= prominence
        peaks, left, right = peaks[ok], left[ok], right[ok]
    return peaks, left, right


def number_of_peaks(s: np.ndarray, df: float, min_freq_dist: float = 200, slopes: tuple[float | None, float | None] = (1, 1), prominence: float = 0, height: float | None = None) -> int:
    peaks, left, right = find_peaks(s, height, min_freq_dist / df, prominence)
    ok = np.ones(len(peaks), bool)
    if slopes[0] is not None:
        ok &= s[peaks] - s[left] >= slopes[0]
    if slopes[1] is not None:
        ok &= s[peaks] - s[right] > slopes[1]
    return int(ok.sum())


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected components, numbered from 1 in row-major order of their first cell."""
    rows, cols = mask.shape
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    runs: list[tuple[int, int, int]] = []
    before: list[int] = []
    for r in range(rows):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask[r].astype(np.int8), [0]))))
        here = []
        j = 0
        for a, b in zip(edge[::2], edge[1::2]):
            k = len(runs)
            runs.append((r, int(a), int(b)))
            parent.append(k)
            here.append(k)
            while j < len(before) and runs[before[j]][2] < a:
                j += 1
            i = j
            while i < len(before) and runs[before[i]][1] <= b:
                x, y = root(before[i]), root(k)
                parent[max(x, y)] = min(x, y)
                i += 1
        before = here
    out = np.zeros(mask.shape, np.int64)
    number: dict[int, int] = {}
    for k, (r, a, b) in enumerate(runs):
        out[r, a:b] = number.setdefault(root(k), len(number) + 1)
    return out


def _box_sums(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sums over all places of a box, from sums over rows and columns."""
    s = np.pad(image, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)
    return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]


def match_template(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Zero-mean normalised cross-correlation of a template with all places where it fits.

    The sums of a place come from running sums and the products from a transform over time, bin by
    bin, so nothing larger than the image is made.
    """
    h, w = template.shape
    t = template - template.mean()
    n = image.shape[1] + w - 1
    spectra, flipped = np.fft.rfft(image, n, axis=1), np.fft.rfft(t[:, ::-1], n, axis=1)
    places = image.shape[0] - h + 1
    cross = np.array([np.fft.irfft((spectra[i : i + h] * flipped).sum(axis=0), n)[w - 1 : image.shape[1]] for i in range(places)])
    shifted = image - image.mean()  # small sums keep their digits
    variance = _box_sums(shifted**2, h, w) - _box_sums(shifted, h, w) ** 2 / (h * w)
    bottom = np.sqrt(np.maximum(variance, 0) * (t * t).sum())
    return np.divide(cross, bottom, out=np.zeros_like(cross), where=bottom > np.finfo(float).eps * max(1.0, float(np.abs(image).max(initial=0)) ** 2))


def template_score(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Correlation at each frame, edges padded so that there is one value for each: mean over the free bins."""
    w = template.shape[1]
    half = w // 2
    return match_template(np.pad(image, ((0, 0), (half, half if w % 2 else half - 1)), mode="edge"), template).mean(axis=0)


def grey_opening(x: np.ndarray, structure: np.ndarray) -> np.ndarray:
    """Erosion then dilation with a weighted structure; beyond the ends the values are mirrored with the edge repeated."""
    n = len(structure)
    left = n // 2
    right = n - 1 - left
    pad = lambda v, a, b: np.pad(v, (a, b), mode="symmetric")
    eroded = (np.lib.stride_tricks.sliding_window_view(pad(x, left, right), n) - structure).min(axis=1)
    return (np.lib.stride_tricks.sliding_window_view(pad(eroded, right, left), n) + structure[::-1]).max(axis=1)


def reconstruct(seed: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Morphological reconstruction by dilation of the seed under the mask, 8-connected."""
    current = np.minimum(seed, mask)
    while True:
        p = np.pad(current, 1, mode="edge")
        grown = np.maximum.reduce([p[i : i + current.shape[0], j : j + current.shape[1]] for i in range(3) for j in range(3)])
        grown = np.minimum(grown, mask)
        if np.array_equal(grown, current):
            return current
        current = grown


def remove_background_morpho(sxx: np.ndarray, q: float = 0.1) -> np.ndarray:
    return np.maximum(sxx - reconstruct(sxx - np.quantile(sxx, q), sxx), 0)


def gaussian_kernel(std: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * std + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / std) ** 2)
    return k / k.sum()


def gaussian_blur(im: np.ndarray, std: float, mode: str = "edge") -> np.ndarray:
    k = gaussian_kernel(std)
    r = len(k) // 2
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        im = np.lib.stride_tricks.sliding_window_view(np.pad(im, pad, mode=mode), len(k), axis=axis) @ k
    return im


def closing(mask: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Binary closing with a rectangle."""

    def slide(m: np.ndarray, f, fill: int) -> np.ndarray:
        for axis, n in ((0, rows), (1, cols)):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (n // 2, n - 1 - n // 2)
            m = f(np.lib.stride_tricks.sliding_window_view(np.pad(m, pad, constant_values=fill), n, axis=axis), axis=-1)
        return m

    return slide(slide(mask, np.max, 0)[::-1, ::-1], np.min, 1)[::-1, ::-1]


def gabor(frequency: float, theta: float, bandwidth: float = 1, gamma: float = 2, n_stds: float = 3) -> np.ndarray:
    """Complex Gabor kernel of which the constant part is removed."""
    spread = math.sqrt(math.log(2) / 2) / math.pi * (2**bandwidth + 1) / (2**bandwidth - 1)
    sy = spread / frequency
    sx = sy / gamma
    c, s = math.cos(theta), math.sin(theta)
    reach = lambda a, b: math.ceil(max(abs(n_stds * a), abs(n_stds * b), 1))
    x0, y0 = reach(sx * c, sy * s), reach(sy * c, sx * s)
    y, x = np.mgrid[-y0 : y0 + 1, -x0 : x0 + 1]
    u, v = x * c + y * s, y * c - x * s
    bell = np.exp(-0.5 * ((u / sx) ** 2 + (v / sy) ** 2)) / (2 * math.pi * sx * sy)
    wave = bell * np.exp(2j * math.pi * frequency * u)
    return wave - bell * (wave.sum() / bell.sum())


# Presets of the filter bank.
SHAPE_PRESETS = {
    "low": {"ntheta": 2, "bandwidth": 0.8, "frequency": (0.35, 0.5), "gamma": 2, "npyr": 4},
    "med": {"ntheta": 4, "bandwidth": 0.8, "frequency": (0.35, 0.5), "gamma": 2, "npyr": 6},
    "high": {"ntheta": 8, "bandwidth": 0.8, "frequency": (0.35, 0.5), "gamma": 2, "npyr": 6},
}


def shape_options(preset: str | dict) -> dict:
    """The options of a preset, or a preset of one's own with all of ntheta, bandwidth, frequency, gamma and npyr."""
    if isinstance(preset, str):
        return SHAPE_PRESETS[preset]
    if set(preset) != set(SHAPE_PRESETS["low"]):
        raise ValueError(f"a preset has {', '.join(SHAPE_PRESETS['low'])}")
    return preset


def bank(preset: str | dict = "low") -> list[tuple[float, float, np.ndarray]]:
    """(theta, frequency, kernel) of a preset, angles outermost."""
    o = shape_options(preset)
    thetas = [k / o["ntheta"] * math.pi for k in range(o["ntheta"])]
    return [(t, f, gabor(f, t, o["bandwidth"], o["gamma"])) for t in thetas for f in o["frequency"]]


def convolve_mirrored(im: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Same-size convolution; beyond the edges the image is mirrored with the edge repeated."""
    h, w = kernel.shape
    p = np.pad(im, ((h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2)), mode="symmetric")
    shape = (p.shape[0] + h - 1, p.shape[1] + w - 1)
    full = np.fft.irfft2(np.fft.rfft2(p, shape) * np.fft.rfft2(kernel, shape), shape)
    return full[h - 1 : h - 1 + im.shape[0], w - 1 : w - 1 + im.shape[1]]


def zoom(im: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear resizing with pixel centres aligned."""
    for axis, n in enumerate(shape):
        m = im.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        lo = np.minimum(at.astype(int), max(m - 2, 0))
        hi = np.minimum(lo + 1, m - 1)
        w = (at - lo).reshape([-1 if a == axis else 1 for a in (0, 1)])
        im = np.take(im, lo, axis) * (1 - w) + np.take(im, hi, axis) * w
    return im


def shape_responses(im: np.ndarray, preset: str | dict = "low") -> list[np.ndarray]:
    """Magnitudes of all filters on all levels of a Gaussian pyramid, scaled back to the image's size."""
    out, level, filters = [], np.asarray(im, float), bank(preset)
    for k in range(shape_options(preset)["npyr"]):
        if k:
            if min(level.shape) < 2:
                break
            level = zoom(gaussian_blur(level, 2 / 3, "symmetric"), tuple(math.ceil(n / 2) for n in level.shape))
        spread = level.std()
        z = (level - level.mean()) / (spread if spread > 0 else 1)
        for _, _, kernel in filters:
            r = np.hypot(convolve_mirrored(z, kernel.real), convolve_mirrored(z, kernel.imag))
            out.append(r if k == 0 else zoom(r, im.shape))
    return out

"""Small numpy helpers used inside Arrow kernels: FFT filters, envelope, detectors.

A digital filter made by the bilinear transform has the response of its analog
prototype at s = j 2 fs tan(w / 2 fs). So responses are evaluated on the FFT
grid directly and applied to zero-padded data.
"""

from __future__ import annotations

import numpy as np

# Weighting poles in Hz.
F1, F2, F3, F4 = 20.598997, 107.65265, 737.86223, 12194.217
FAST_S, SLOW_S, IMPULSE_S, HOLD_S = 0.125, 1.0, 0.035, 1.5


def _s(frequency, fs):
    """Point of the analog plane a digital frequency stands for."""
    w = np.minimum(np.pi * np.asarray(frequency, float) / fs, np.pi / 2 - 1e-9)
    return 2j * fs * np.tan(w)


def _warp(frequency, fs):
    if frequency >= fs / 2:
        return 2 * np.pi * frequency
    return 2 * fs * np.tan(np.pi * frequency / fs)


def weighting_response(frequency, fs, kind):
    """Response of the A or C weighting filter; 1 at 1 kHz in magnitude."""
    if kind == "Z":
        return np.ones(np.shape(frequency), complex)
    w1, w2, w3, w4 = (_warp(f, fs) for f in (F1, F2, F3, F4))

    def raw(f):
        s = _s(f, fs)
        common = ((s + w1) * (s + w4)) ** 2
        return s**4 / (common * (s + w2) * (s + w3)) if kind == "A" else s**2 / common

    return raw(frequency) / np.abs(raw(min(1000.0, fs / 2 * 0.999)))


def butterworth(frequency, fs, order, low=None, high=None):
    """Butterworth response: high-pass with `low` only, band-pass with both."""
    s = _s(frequency, fs)
    s = np.where(np.abs(s) < 1e-9, 1e-9j, s)
    if high is None:
        p = _warp(low, fs) / s
    else:
        w1, w2 = _warp(low, fs), _warp(high, fs)
        p = (s * s + w1 * w2) / ((w2 - w1) * s)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    return 1 / np.prod([p - q for q in poles], axis=0)


def _size(n):
    return 1 << int(n - 1).bit_length()


def filtered(x, fs, response, settle_s, zero_phase=False):
    """Filter rows of x (last axis) from silence; `settle_s` sizes the zero padding."""
    n = x.shape[-1]
    size = _size(n + 2 * int(settle_s * fs) + 1)
    h = response(np.fft.rfftfreq(size, 1 / fs))
    h = np.abs(h) ** 2 if zero_phase else h
    # A copy, so that the padding is not kept with the rows.
    return np.fft.irfft(np.fft.rfft(x, size) * h, size)[..., :n].copy()


def weighted(x, fs, kind):
    """Causal A or C weighting; Z leaves the samples alone."""
    if kind == "Z":
        return x
    return filtered(x, fs, lambda f: weighting_response(f, fs, kind), 12 / (2 * np.pi * F1))


def high_passed(x, fs, cutoff=10.0):
    """Mean removed, then a zero-phase second-order high-pass over silence."""
    x = x - x.mean(axis=-1, keepdims=True)
    if x.shape[-1] < 32 or not 0 < cutoff < fs / 2:
        return x
    n = x.shape[-1]
    pad = int(np.ceil(5 * fs / (2 * np.pi * cutoff)))
    framed = np.zeros((*x.shape[:-1], n + 2 * pad))
    framed[..., pad:pad + n] = x
    return filtered(framed, fs, lambda f: butterworth(f, fs, 2, cutoff), 8 / (2 * np.pi * cutoff), True)[..., pad:pad + n].copy()


def high_pass_pole(fs, cutoff):
    """(pole, weight, direct) of a second-order Butterworth high-pass: y = direct x + 2 Re(weight w), w = x + pole w'.

    A cutoff the rate cannot hold gives the filter that lets everything pass.
    """
    if not 0 < cutoff < fs / 2:
        return 0.5 + 0j, 0j, 1.0
    s = np.tan(np.pi * cutoff / fs) * np.exp(0.75j * np.pi)
    pole = (1 + s) / (1 - s)
    gain = abs(1 + pole) ** 2 / 4
    return pole, gain * (1 - 1 / pole) ** 2 / (1 - pole.conjugate() / pole), gain / abs(pole) ** 2


def one_pole(x, pole, start):
    """w = x + pole w' along the last axis, in blocks that cannot overflow."""
    out = np.empty(x.shape, complex)
    carry = np.broadcast_to(np.asarray(start, complex), x.shape[:-1])
    block = max(1, int(-30 / np.log(abs(pole))))
    for i in range(0, x.shape[-1], block):
        part = x[..., i:i + block]
        gain = pole ** (np.arange(part.shape[-1]) + 1)
        out[..., i:i + block] = gain * (carry[..., None] + np.cumsum(part / gain, axis=-1))
        carry = out[..., i + part.shape[-1] - 1]
    return out


def answered(x, w, weight, direct):
    """Output of the filter whose state after each sample of x is w."""
    return direct * x + 2 * (weight * w).real


def returned(n, w, pole, weight):
    """State a backward run has after n samples of what the forward run still makes of the state w without input."""
    on = weight * pole * w
    return on * (1 - pole ** (2 * n)) / (1 - pole**2) + np.conj(on) * (1 - abs(pole) ** (2 * n)) / (1 - abs(pole) ** 2)


def detection_band(x, fs, low=50.0, high=8000.0):
    """Zero-phase band-pass to the band events are detected in."""
    high = min(high, fs / 2 * 0.95)
    if x.shape[-1] < 64 or high <= low:
        return x
    return filtered(x, fs, lambda f: butterworth(f, fs, 2, low, high), 8 / (2 * np.pi * low), True)


def envelope(x):
    """Magnitude of the analytic signal along the last axis."""
    n = x.shape[-1]
    if n < 4:
        return np.abs(x)
    spectrum = np.fft.fft(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1:(n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(spectrum * gain))


def exponential_average(x2, fs, tau, start=0.0):
    """y = a x + (1 - a) y' along the last axis, in blocks that cannot overflow."""
    a = 1 - np.exp(-1 / (fs * tau))
    out = np.empty(x2.shape)
    carry = np.broadcast_to(np.asarray(start, float), x2.shape[:-1])
    block = max(1, int(30 * fs * tau))
    for i in range(0, x2.shape[-1], block):
        part = x2[..., i:i + block]
        gain = np.exp(-(np.arange(part.shape[-1]) + 1) / (fs * tau))
        out[..., i:i + block] = gain * (carry[..., None] + np.cumsum(a * part / gain, axis=-1))
        carry = out[..., i + part.shape[-1] - 1]
    return out


def decaying_hold(x, fs, tau=HOLD_S, start=0.0):
    """y = max(x, d y') along the last axis."""
    out = np.empty(x.shape)
    carry = np.broadcast_to(np.asarray(start, float), x.shape[:-1])
    block = max(1, int(30 * fs * tau))
    for i in range(0, x.shape[-1], block):
        part = x[..., i:i + block]
        gain = np.exp(-(np.arange(part.shape[-1]) + 1) / (fs * tau))
        out[..., i:i + block] = gain * np.maximum(carry[..., None], np.maximum.accumulate(part / gain, axis=-1))
        carry = out[..., i + part.shape[-1] - 1]
    return out


def impulse_average(x2, fs):
    """35 ms average followed by the decaying hold."""
    return decaying_hold(exponential_average(x2, fs, IMPULSE_S), fs)


# Fixed list: nominal third-octave centres in Hz.
NOMINAL_BANDS = [20, 25, 31.5, 40, 50, 63, 80, 100, 125, 160, 200, 250, 315, 400, 500, 630, 800, 1000, 1250, 1600,
                 2000, 2500, 3150, 4000, 5000, 6300, 8000, 10000, 12500, 16000, 20000, 25000, 31500, 40000, 50000,
                 63000, 80000]


def band_table(fs, fraction=3.0, lowest=0.0, highest=1e9):
    """(nominal, low edge, high edge) of the bands a sample rate can carry."""
    g = 10 ** 0.3
    out = []
    for nominal in NOMINAL_BANDS:
        centre = 1000 * g ** (round(fraction * np.log(nominal / 1000) / np.log(g)) / fraction)
        low, high = centre * g ** (-0.5 / fraction), centre * g ** (0.5 / fraction)
        if lowest <= nominal <= highest and high < fs / 2 and centre <= 0.45 * fs:
            out.append((float(nominal), low, high))
    return out


def band_signals(x, fs, order=4, lowest=0.0, highest=1e9):
    """Yield (nominal, band-passed rows) one band at a time."""
    n = x.shape[-1]
    for nominal, low, high in band_table(fs, lowest=lowest, highest=highest):
        size = _size(n + int(8 * fs / (np.pi * (high - low))) + 1)
        h = butterworth(np.fft.rfftfreq(size, 1 / fs), fs, order, low, high)
        yield nominal, np.fft.irfft(np.fft.rfft(x, size) * h, size)[..., :n].copy()


def spectrum_window(name, n):
    """Periodic spectral window."""
    t = 2 * np.pi * np.arange(n) / n
    # Fixed cosine coefficients of each window.
    terms = {"rectangular": [1.0], "hann": [0.5, 0.5], "hamming": [0.54, 0.46], "blackman": [0.42, 0.5, 0.08],
             "flattop": [0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368]}[name]
    return sum((-1) ** k * c * np.cos(k * t) for k, c in enumerate(terms))


def stft_frames(x, fs, nperseg, noverlap, window="hann", scaling="rms"):
    """(times, frequencies, frames x bins) of one signal."""
    hop = nperseg - noverlap
    if len(x) < nperseg:
        x = np.pad(x, (0, nperseg - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, nperseg)[::hop]
    w = spectrum_window(window, nperseg)
    power = np.abs(np.fft.rfft(frames * w, axis=1)) ** 2
    power[:, 1:] *= 2
    if nperseg % 2 == 0:
        power[:, -1] /= 2
    value = np.sqrt(power) / w.sum() if scaling == "rms" else power / (fs * (w * w).sum())
    times = (np.arange(len(frames)) * hop + nperseg / 2) / fs
    return times, np.fft.rfftfreq(nperseg, 1 / fs), value


def energy_bounds(x, capture=0.99):
    """First and one-past-last sample of the span holding `capture` of each row's energy."""
    running = np.cumsum(x * x, axis=-1)
    total = running[:, -1:]
    share = running / np.where(total > 1e-30, total, 1.0)
    margin = (1 - capture) / 2
    start = (share < margin).sum(axis=-1)
    stop = np.minimum(x.shape[-1], np.maximum((share < 1 - margin).sum(axis=-1) + 1, start + 1))
    silent = total[:, 0] <= 1e-30
    return np.where(silent, 0, start), np.where(silent, x.shape[-1], stop)


def blast_bounds(env, fs, down_dB=20.0, guard_ms=1.0):
    """First and one-past-last sample within `down_dB` of the envelope peak, with a guard."""
    n, top = env.shape[-1], env.max(axis=-1, keepdims=True)
    near = (env >= top * 10 ** (-abs(down_dB) / 20)) | (top <= 1e-30)
    guard = np.where(top[:, 0] > 1e-30, int(guard_ms * fs / 1000), 0)
    first, last = near.argmax(axis=-1), n - 1 - near[:, ::-1].argmax(axis=-1)
    return np.maximum(0, first - guard), np.minimum(n, last + guard + 1)


def centroid(blast, fs):
    """Power-weighted mean frequency at and above 20 Hz under a symmetric Hann window."""
    n = len(blast)
    if n < 4:
        return 0.0
    power = np.abs(np.fft.rfft(blast * np.hanning(n))) ** 2
    f = np.fft.rfftfreq(n, 1 / fs)
    power, f = power[f >= 20], f[f >= 20]
    return float((power * f).sum() / power.sum()) if power.sum() >= 1e-30 else 0.0


def local_maxima(x):
    """Indices of maxima; a flat top counts once, at its middle."""
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    v = x[starts]
    up = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    return (starts[up] + starts[up + 1] - 1) // 2


def keep_apart(position, value, distance):
    """Mask of the entries a loudest-first selection keeps; later wins a tie. Positions rise.

    In rounds: what is the loudest within its distance stays and silences the rest of it.
    """
    rank = np.empty(len(position), np.int64)
    rank[np.lexsort((position, value))] = np.arange(len(position))
    keep, left = np.zeros(len(position), bool), np.arange(len(position))
    while len(left):
        p, loud = position[left], rank[left]
        beaten = np.zeros(len(left), bool)
        step, pairs = 1, []
        while step < len(left):
            near = np.flatnonzero(p[step:] - p[:-step] < distance)
            if not len(near):
                break
            pairs.append((near, near + step))
            first = loud[near] > loud[near + step]
            beaten[near[~first]] = True
            beaten[near[first] + step] = True
            step += 1
        won = ~beaten
        keep[left[won]] = True
        gone = won.copy()
        for a, b in pairs:
            gone[b[won[a]]] = True
            gone[a[won[b]]] = True
        left = left[~gone]
    return keep


def _lowest_before_higher(x, at):
    """For each place the lowest value back to the nearest higher one (or the start), its own included.

    Extremes of stretches of 1, 2, 4 ... values; all places go back together, longest stretches first.
    """
    high, low, width = [x], [x], 1
    while 2 * width <= len(x):
        high.append(np.maximum(high[-1][:-width], high[-1][width:]))
        low.append(np.minimum(low[-1][:-width], low[-1][width:]))
        width *= 2
    height, begin, least = x[at], at.copy(), x[at].copy()
    for k in range(len(high) - 1, -1, -1):
        back = begin - (1 << k)
        go = np.flatnonzero(back >= 0)
        go = go[high[k][back[go]] <= height[go]]
        least[go] = np.minimum(least[go], low[k][back[go]])
        begin[go] = back[go]
    return least


def prominences(x, peaks):
    """Height of each peak above the higher of the two lowest points that separate it from a higher one."""
    peaks = np.asarray(peaks, np.int64)
    left = _lowest_before_higher(x, peaks)
    right = _lowest_before_higher(x[::-1], len(x) - 1 - peaks)
    return x[peaks] - np.maximum(left, right)

"""NumPy kernels for a block of a recording: spectrogram, sliding correlation, sliding warping. Spark deals the blocks."""

from __future__ import annotations

import numpy as np


#: Frames that are transformed at once.
AT_ONCE = 1024


def frame_count(n_samples: int, wl: int, ovlp: float) -> int:
    """Frames start at multiples of the hop wl * (1 - ovlp / 100), while they fit."""
    return int((n_samples - wl) / (wl * (1 - ovlp / 100))) + 1 if n_samples >= wl else 0


def frame_starts(first: int, end: int, wl: int, ovlp: float) -> np.ndarray:
    """The samples at which the frames first to end - 1 (from 0) start: multiples of the hop, rounded down."""
    return np.floor(np.arange(first, end) * (wl * (1 - ovlp / 100))).astype(np.int64)


def amplitudes(samples: np.ndarray, starts: np.ndarray, wl: int) -> np.ndarray:
    """Amplitudes (frames by bins) of the frames that start there, under a Hann window."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(wl) / (wl - 1))
    out = np.zeros((len(starts), wl // 2))
    if len(starts):
        frames = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, float), wl)
        for at in range(0, len(starts), AT_ONCE):
            part = starts[at : at + AT_ONCE]
            out[at : at + len(part)] = np.abs(np.fft.rfft(frames[part] * window, axis=1))[:, : wl // 2] * 2 / window.sum()
    return out


def levels(amp: np.ndarray, top: float) -> np.ndarray:
    """Decibels below the amplitude `top`; silence stands at a floor."""
    return 20 * np.log10(np.maximum(amp, 1e-12) / max(top, 1e-12))


def spectrogram(samples: np.ndarray, rate: int, wl: int, ovlp: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times (s), frequencies (kHz) and amplitudes (frames by bins) of a whole series."""
    starts = frame_starts(0, frame_count(len(samples), wl, ovlp), wl, ovlp)
    return starts / rate, np.arange(wl // 2) * rate / wl / 1000, amplitudes(samples, starts, wl)


#: Templates of so many frames or more are correlated in the transform domain; measured, see the README.
FFT_FRAMES = 64


class Windows:
    """A block of frames by bins whose windows are correlated with templates.

    Sums and sums of squares of any window are four values of integral images, made once for all templates. The cross
    term of a short template is a sum over its frames; that of a long one is an overlap-save correlation along the
    frames: segments of the block are transformed once for a size, multiplied with the template's transform, summed over
    the bins and transformed back, so its cost doesn't grow with the template's frames.
    """

    def __init__(self, x: np.ndarray):
        self.mean = x.mean() if x.size else 0.0
        self.x = x - self.mean
        self.images: tuple[np.ndarray, np.ndarray] | None = None
        self.size, self.spectrum = (0, 0), np.zeros(0)

    def moments(self, sw: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The sums and sums of squares of the bins lo to hi - 1 of each window of sw frames."""
        if self.images is None:
            self.images = tuple(np.pad(v.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0))) for v in (self.x, self.x * self.x))
        s, ss = ((i[sw:, hi] - i[:-sw, hi]) - (i[sw:, lo] - i[:-sw, lo]) for i in self.images)
        return s, ss

    def cross(self, template: np.ndarray, lo: int, hi: int) -> np.ndarray:
        sw, w = len(template), len(self.x) - len(template) + 1
        if sw < FFT_FRAMES:
            out = np.zeros(w)
            for k in range(sw):
                out += self.x[k : k + w, lo:hi] @ template[k]
            return out
        most = 1 << (sw - 1).bit_length()  # templates up to one power of two share the segments
        n = max(512, 4 * most)
        step = n - most + 1
        if self.size != (n, step):
            count = max(1, -(-w // step))
            padded = np.zeros(((count - 1) * step + n, self.x.shape[1]))
            padded[: len(self.x)] = self.x[: len(padded)]
            self.spectrum = np.stack([np.fft.rfft(padded[i * step : i * step + n], axis=0) for i in range(count)])
            self.size = n, step
        t = np.conj(np.fft.rfft(template, n, axis=0))
        found = np.fft.irfft(np.einsum("skb,kb->sk", self.spectrum[:, :, lo:hi], t), n, axis=1)
        return found[:, :step].ravel()[:w]

    def pearson(self, template: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The correlation of the template with each complete window of the bins lo to hi - 1; NaN without variance."""
        hi, sw = self.x.shape[1] if hi is None else hi, len(template)
        if len(self.x) < sw:
            return np.zeros(0)
        own = template - template.mean()  # with the block's mean away too, sums stay small
        n, (sx, sxx), sxy = template.size, self.moments(sw, lo, hi), self.cross(own, lo, hi)
        vx, vy = n * sxx - sx * sx, n * (own * own).sum() - own.sum() ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (n * sxy - sx * own.sum()) / np.sqrt(vx * vy)
        scale = n * sxx + (n * self.mean) ** 2  # of the sums as they came
        return np.where((vx > 1e-12 * np.maximum(scale, 1e-300)) & (vy > 1e-12 * (n * (template * template).sum())), np.clip(r, -1, 1), np.nan)


def sliding_pearson(x: np.ndarray, template: np.ndarray) -> np.ndarray:
    """The correlation of the template (frames by bins) with each complete window of x; NaN without variance."""
    return Windows(x).pearson(template)


def warping_distances(x: np.ndarray, template: np.ndarray) -> np.ndarray:
    """The warping distance (L1 cost, steps of weight 1) of the template from each complete window of x."""
    sw = len(template)
    w = len(x) - sw + 1
    if w <= 0:
        return np.zeros(0)
    cost = np.stack([np.abs(x - row).sum(axis=1) for row in template], axis=1)
    above: list[np.ndarray] = []
    for i in range(sw):
        row: list[np.ndarray] = []
        for j in range(sw):
            here = cost[i : i + w, j]
            before = above[max(j - 1, 0) : j + 1] + row[-1:]
            row.append(here + np.minimum.reduce(before) if before else here)
        above = row
    return above[-1]


def block_scores(block: Windows, first: int, own_first: int, n_own: int, template: np.ndarray, lo: int, hi: int, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a block's own frames, and whether each has a window. The block has the frames from `first` on, others' too; lo to hi: the template's bins, from 1.

    The score of the window that begins at frame s stands at s + sw // 2 - 1. For dtw the distance, not yet scaled.
    """
    sw = len(template)
    found = block.pearson(template, lo - 1, hi) if method == "cor" else warping_distances(block.x[:, lo - 1 : hi] + block.mean, template)
    at = np.arange(own_first, own_first + n_own) - (sw // 2 - 1) - first
    window = (at >= 0) & (at < len(found))
    scores = np.full(n_own, np.nan)
    scores[window] = found[at[window]]
    return scores, window

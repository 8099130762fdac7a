"""Descriptors of windows of sound: spectrum, timbre, pitch classes, onsets and tempo.

A window is framed (SIZE samples at RATE, as long at other rates up to a power of two; a step of a quarter; half a frame of
silence at both ends), each frame is weighted and transformed, and everything else is a product with a matrix of filters
or a mean over frames:

* brightness, bandwidth, roll-off, contrast by octaves and flatness of the magnitudes; shares of energy in bands from 20 Hz;
* cepstral coefficients: the cosine transform of the levels in MELS bands on the mel scale;
* pitch classes: frames' energy by the nearest semitone, each frame's greatest being 1;
* onsets: the mean rise of the bands' levels from frame to frame, with peaks picked that stand out from their surroundings;
* tempo: the lag at which the onsets agree best with themselves, weighed by how near it is to START_BPM.

``describe`` runs on Arrow batches and yields a row a window; what a window fails at is its row's error. Defined
results: silence has 0 everywhere and no tempo; windows without samples, with samples that aren't finite or a
rate that isn't positive fail; null windows fail.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

SIZE, RATE, MELS, COEFFICIENTS, START_BPM = 2048, 22050, 128, 20, 120.0
# Names, and how many places each value has.
PLACES = {
    "est_bpm": 2, "brightness": 2, "energy_rms": 5, "percussiveness": 5, "duration_sec": 2, "spectral_bandwidth_hz": 2, "low_band_energy_ratio": 5,
    "mid_band_energy_ratio": 5, "high_band_energy_ratio": 5, "onset_density_per_sec": 5, "crest_factor": 5, "tempo_confidence": 5,
}
BANDS = {"low_band_energy_ratio": (20.0, 250.0), "mid_band_energy_ratio": (250.0, 4000.0), "high_band_energy_ratio": (4000.0, float("inf"))}
#: Octaves of the contrast, from this frequency; share of a band's values that are its peaks and valleys.
OCTAVES, LOWEST, EXTREMES = 6, 200.0, 0.02
#: Of the peaks: seconds before and after, seconds of the mean around, how far above it (of 1), seconds between two.
BEFORE, AROUND, ABOVE, BETWEEN = 0.03, 0.10, 0.07, 0.03


def mel(hz):
    """The mel scale: linear up to 1000 Hz, then 27 steps for each factor of 6.4."""
    import numpy as np

    hz = np.asarray(hz, float)
    return np.where(hz < 1000, 3 * hz / 200, 15 + 27 * np.log(np.maximum(hz, 1e-9) / 1000) / np.log(6.4))


def from_mel(m):
    import numpy as np

    m = np.asarray(m, float)
    return np.where(m < 15, 200 * m / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))


def frame_size(rate: float) -> int:
    import math

    return 1 << max(6, round(math.log2(SIZE * rate / RATE)))


@lru_cache(maxsize=16)
def filters(rate: float):
    """(frequencies, mel bands, pitch classes, cosine transform) of a rate, as matrices."""
    import numpy as np

    freq = np.fft.rfftfreq(frame_size(rate), 1 / rate)
    edges = from_mel(np.linspace(0, mel(rate / 2), MELS + 2))
    rise = (freq - edges[:-2, None]) / np.maximum(np.diff(edges)[:-1, None], 1e-9)
    fall = (edges[2:, None] - freq) / np.maximum(np.diff(edges)[1:, None], 1e-9)
    bands = np.maximum(0, np.minimum(rise, fall)) * (2 / np.maximum(edges[2:] - edges[:-2], 1e-9))[:, None]
    classes = np.zeros((12, len(freq)))
    heard = np.flatnonzero(freq >= 27.5)
    semitones = 12 * np.log2(freq[heard] / 440.0) + 9  # class 0 is C
    for shift in (-1, 0, 1):  # a bin counts for the semitones about it, the less the farther away
        at = np.round(semitones) + shift
        classes[(at % 12).astype(int), heard] += np.exp(-((semitones - at) ** 2) * 8)
    n = np.arange(MELS)
    cosines = np.cos(np.pi * np.arange(COEFFICIENTS)[:, None] * (2 * n + 1) / (2 * MELS)) * np.sqrt(2 / MELS)
    cosines[0] /= np.sqrt(2)
    return freq, bands, classes, cosines


def framed(x, size: int):
    """(frames, size)."""
    import numpy as np

    padded = np.concatenate([np.zeros(size // 2), x, np.zeros(size // 2)])
    return np.lib.stride_tricks.sliding_window_view(padded, size)[:: size // 4]


def levels(power):
    """Decibels below the greatest value, 80 at most."""
    import numpy as np

    db = 10 * np.log10(np.maximum(power, 1e-10))
    return np.maximum(db, db.max(initial=-100.0) - 80)


def onset_peaks(strength, frame_rate: float) -> list[int]:
    """Frames whose strength is the greatest about them and stands out from the mean around."""
    import numpy as np

    top = strength.max(initial=0)
    if top <= 0:
        return []
    s = strength / top
    near, around, between = (max(1, round(t * frame_rate)) for t in (BEFORE, AROUND, BETWEEN))
    out: list[int] = []
    for i in range(len(s)):
        about = s[max(0, i - near) : i + near + 1]
        if s[i] >= about.max() and s[i] >= s[max(0, i - around) : i + around + 1].mean() + ABOVE and (not out or i - out[-1] > between):
            out.append(i)
    return out


def tempo(strength, frame_rate: float) -> tuple[float, float]:
    """(beats a minute, confidence), both 0 without onsets."""
    import numpy as np

    s = np.maximum(strength, 0)
    n = len(s)
    if n < 3 or s.max() <= 0:
        return 0.0, 0.0
    spread = np.fft.rfft(s, 2 * n)
    same = np.fft.irfft(np.abs(spread) ** 2)[:n]
    lags = np.arange(1, n)
    bpm = 60 * frame_rate / lags
    fit = same[1:] / same[0] * np.exp(-0.5 * np.log2(bpm / START_BPM) ** 2) * ((bpm >= 30) & (bpm <= 300))
    best = int(fit.argmax())
    at = float(lags[best])
    if 0 < best < len(fit) - 1 and fit[best] > 0:  # between frames, by the parabola through the three values
        a, b, c = same[best], same[best + 1], same[best + 2]
        at += 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c < 0 else 0.0
    return 60 * frame_rate / at, float(np.clip(same[1:].max() / same[0], 0, 1))


def spectral_features(row: dict) -> tuple[dict, list[float]]:
    """(values by name, vector of 65) of one window {samples, rate}."""
    import numpy as np

    if row["samples"] is None or row["rate"] is None:
        raise ValueError("a window needs samples and a rate")
    x, rate = np.asarray(row["samples"], float), float(row["rate"])
    if not len(x) or not np.isfinite(x).all():
        raise ValueError("samples must be finite")
    if not rate > 0:
        raise ValueError("the rate must be positive")
    freq, bands, classes, cosines = filters(rate)
    long = frame_size(rate)
    frames, frame_rate = framed(x, long), rate / (long // 4)
    weight = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(long) / long)
    size = np.abs(np.fft.rfft(frames * weight, axis=1))
    power, total = size**2, np.maximum(size.sum(1), 1e-12)
    centroid = (size @ freq) / total
    bandwidth = np.sqrt(np.maximum((size @ freq**2) / total - centroid**2, 0))
    rolloff = freq[(np.cumsum(size, 1) >= 0.85 * size.sum(1, keepdims=True)).argmax(1)]
    flatness = np.exp(np.log(np.maximum(power, 1e-10)).mean(1)) / np.maximum(power, 1e-10).mean(1)
    contrast = []
    for o in range(OCTAVES + 1):
        low, high = (0.0 if o == 0 else LOWEST * 2 ** (o - 1)), (LOWEST * 2**o if o < OCTAVES else float("inf"))
        part = np.sort(size[:, (freq >= low) & (freq < high)], axis=1)
        few = max(1, round(EXTREMES * part.shape[1]))
        contrast.append(0.0 if not part.shape[1] else float((levels(part[:, -few:].mean(1) ** 2) - levels(part[:, :few].mean(1) ** 2)).mean()))
    mels = levels(power @ bands.T)
    cepstrum = mels @ cosines.T
    chroma = power @ classes.T
    chroma = chroma / np.maximum(chroma.max(1, keepdims=True), 1e-12)
    rms = np.sqrt((frames**2).mean(1))
    crossings = (np.signbit(frames[:, 1:]) != np.signbit(frames[:, :-1])).mean(1)
    strength = np.r_[0.0, np.maximum(np.diff(mels, axis=0), 0).mean(1)]
    bpm, confidence = tempo(strength, frame_rate)
    energy, seconds, level = power.sum(), len(x) / rate, float(np.sqrt((x * x).mean()))
    values = {
        "est_bpm": bpm,
        "brightness": float(centroid.mean()),
        "energy_rms": float(rms.mean()),
        "percussiveness": float(crossings.mean()),
        "duration_sec": seconds,
        "spectral_bandwidth_hz": float(bandwidth.mean()),
        "onset_density_per_sec": len(onset_peaks(strength, frame_rate)) / seconds,
        "crest_factor": float(np.abs(x).max() / level) if level > 0 else 0.0,
        "tempo_confidence": confidence,
    }
    for name, (low, high) in BANDS.items():
        values[name] = float(power[:, (freq >= low) & (freq < high)].sum() / energy) if energy > 0 else 0.0
    vector = [*cepstrum.mean(0), *cepstrum.std(0), *chroma.mean(0), centroid.mean(), bandwidth.mean(), rolloff.mean(), *contrast, flatness.mean(), rms.mean(), crossings.mean()]
    return {k: round(v, PLACES[k]) for k, v in values.items()}, [float(v) for v in vector]


def describe(windows: DataFrame, key: str) -> DataFrame:
    """(key, error, features map, embedding of 65) of windows (key, samples, rate)."""

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for name, samples, rate in zip(*(batch.column(c) for c in (key, "samples", "rate")), strict=True):
                try:
                    values, vector = spectral_features({"samples": None if not samples.is_valid else samples.values.to_numpy(zero_copy_only=False), "rate": rate.as_py()})
                    rows.append((name.as_py(), "", list(values.items()), vector))
                except ValueError as e:  # the window's own failure, kept as its result
                    rows.append((name.as_py(), str(e), [], None))
            kinds = [batch.schema.field(key).type, pa.string(), pa.map_(pa.string(), pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [key, "error", "features", "embedding"])

    kind = dict(windows.dtypes)[key]
    return windows.select(key, "samples", "rate").mapInArrow(of, f"{key} {kind}, error string, features map<string,double>, embedding array<double>")

"""Descriptors of signals whose values are known."""

import math

import numpy as np
import pytest

from tracklens.operators import evidence, spectral

RATE = 22050


def tone(hz, seconds=3.0, rate=RATE, level=0.5):
    return level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def clicks(bpm, seconds=12.0, rate=RATE):
    x = np.zeros(int(seconds * rate))
    for i in range(int(seconds * bpm / 60)):
        at = int(i * 60 / bpm * rate)
        x[at : at + 200] = np.random.default_rng(i).normal(0, 0.5, len(x[at : at + 200]))
    return x


def values(x, rate=RATE):
    return spectral.spectral_features({"samples": x, "rate": rate})


@pytest.mark.parametrize("hz, pitch", [(440.0, 9), (261.626, 0), (659.255, 4), (1864.66, 10)])
def test_pure_tones(hz, pitch):
    found, vector = values(tone(hz))
    assert len(vector) == 65 and int(np.argmax(vector[40:52])) == pitch and vector[40 + pitch] > 0.95
    assert abs(found["brightness"] - hz) < 0.08 * hz and found["mid_band_energy_ratio"] > 0.9
    assert abs(found["energy_rms"] - 0.5 / math.sqrt(2)) < 0.01 and abs(found["crest_factor"] - math.sqrt(2)) < 1e-3
    assert abs(found["percussiveness"] - 2 * hz / RATE) < 0.02 * hz / RATE + 0.001 and found["duration_sec"] == 3.0
    assert abs(vector[54] - hz) < 60  # the roll-off; the frames at the ends are cut


def test_bands_start_at_20_hz():
    low, _ = values(tone(100.0))
    assert low["low_band_energy_ratio"] > 0.99 and low["mid_band_energy_ratio"] < 0.01
    high, _ = values(tone(8000.0))
    assert high["high_band_energy_ratio"] > 0.99
    offset, _ = values(np.full(3 * RATE, 0.5))  # nothing but a constant
    assert offset["low_band_energy_ratio"] < 0.02
    mixed, _ = values(tone(100.0) + tone(1000.0))
    assert abs(mixed["low_band_energy_ratio"] - 0.5) < 0.01 and abs(mixed["mid_band_energy_ratio"] - 0.5) < 0.01
    x = np.concatenate([tone(100.0, 0.5, 8000), [0.0]])
    assert evidence.signal_features({"samples": x, "rate": 8000})["low"] > 0.98
    assert evidence.signal_features({"samples": np.ones(800), "rate": 8000})["low"] == 0.0


@pytest.mark.parametrize("bpm", [90.0, 120.0, 140.0])
def test_clicks_have_their_tempo_and_onsets(bpm):
    found, _ = values(clicks(bpm))
    assert abs(found["est_bpm"] - bpm) < 0.02 * bpm and found["tempo_confidence"] > 0.5
    assert abs(found["onset_density_per_sec"] - bpm / 60) < 0.15


def test_noise_is_flat_and_silence_is_nothing():
    _, noise = values(np.random.default_rng(1).normal(0, 0.3, 3 * RATE))
    _, pure = values(tone(440.0))
    assert noise[62] > 0.4 > 0.01 > pure[62]
    found, vector = values(np.zeros(RATE))
    assert {k: v for k, v in found.items() if v} == {"duration_sec": 1.0} and all(math.isfinite(v) for v in vector)


def test_cosine_transform_and_bands():
    freq, bands, classes, cosines = spectral.filters(float(RATE))
    assert np.allclose(cosines @ cosines.T, np.eye(20)) and bands.shape == (128, 1025) and (bands >= 0).all()
    assert np.allclose(spectral.from_mel(spectral.mel([0, 200, 999, 1000, 6400, 11025])), [0, 200, 999, 1000, 6400, 11025])
    assert math.isclose(float(spectral.mel(6400)), 42.0)


def test_windows_fail_alone(spark):
    rows = [("a", tone(440.0, 0.3).tolist(), RATE), ("b", [float("nan")], RATE), ("c", [], RATE), ("d", None, RATE), ("e", [0.5] * 10, 0), ("f", [0.1, -0.1], 8000), ("g", [0.1], None)]
    got = {r.track_id: r for r in spectral.describe(spark.createDataFrame(rows, "track_id string, samples array<double>, rate int"), "track_id").collect()}
    assert {k for k, r in got.items() if r.error} == {"b", "c", "d", "e", "g"}
    want, vector = values(tone(440.0, 0.3))
    assert got["a"].features == want and np.allclose(got["a"].embedding, vector)

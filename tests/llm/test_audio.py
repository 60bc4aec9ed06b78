"""Lossless storage, a direct resampler, spectra of known tones, and hysteresis."""

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import functions as F

from quire.llm import audio


def test_wave_is_standard_and_lossless():
    for raw in (b"", b"x", b"y" * 64, bytes(range(256)) * 5):
        payload = audio.padded(raw)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(raw) and not payload[len(raw) :].strip(b"\0")
        media = audio.to_wave(payload)
        assert audio.from_wave(media) == (audio.RATE, payload)
        with wave.open(io.BytesIO(media)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(1 << 20)) == (1, 1, audio.RATE, payload)


def test_resample_matches_direct_sum():
    x = np.random.default_rng(1).normal(size=500)
    for rate, target in ((16000, 12000), (8000, 12000), (22050, 16000)):
        g = int(np.gcd(rate, target))
        up, down = target // g, rate // g
        bank, y = audio.phases(up, down), audio.resample(x, rate, target)
        assert len(y) == -(-len(x) * up // down)
        for i in (0, 1, 2, 77, len(y) - 1):
            at, phase = divmod(i * down, up)
            want = sum(bank[phase][audio.TAPS - 1 - k] * x[j] for k in range(audio.TAPS) if 0 <= (j := at + k - (audio.TAPS - 1 - audio.TAPS // 2)) < len(x))
            assert abs(y[i] - want) < 1e-12


def test_tone_peaks_in_its_band():
    t = np.arange(audio.TARGET) / audio.TARGET
    for hz in (300, 1000, 3000):
        mels, energy = audio.log_mels(np.sin(2 * np.pi * hz * t))
        bank = audio.mel_bank(audio.TARGET)
        assert mels[10].argmax() == bank[:, round(hz * audio.FFT / audio.TARGET)].argmax()
        assert abs(energy[10] + 3.01) < 0.2


def test_hysteresis():
    e = np.array([-50, -33, -29, -33, -35, -37, -33, -20, -90.0])
    assert audio.segments(e) == [(2, 5), (7, 8)]
    assert audio.segments(np.array([-50.0])) == []


def test_operator(spark):
    texts = [None, "", "abc", "abc", "é" * 40_000, "abc" * 70]
    rows = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    found = {r.doc_id: r for r in audio.audio_features(audio.stored_media(rows)).collect()}
    assert found[0][1:] == found[1][1:] and found[2][1:] == found[3][1:]
    for i, t in enumerate(texts):
        payload = audio.padded((t or "").encode())
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(payload) + 44
        table = audio.from_stream(r.audio)
        assert sum(table["frames"].to_pylist()) == r.n_frames >= 1
        assert table["mels"].type.shape == [audio.FRAMES, audio.MELS]
        assert all(a < b for a, b in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist(), strict=True))
    assert audio.audio_features(audio.stored_media(rows.where(F.lit(False)))).count() == 0


def test_stretches_equal_one_pass(monkeypatch):
    media = audio.to_wave(audio.padded(np.random.default_rng(2).integers(0, 256, 50_000, dtype=np.uint8).tobytes()))
    whole = audio.features(media)
    monkeypatch.setattr(audio, "STRETCH", audio.HOP * 16)
    parts = audio.features(media)
    assert whole[0].shape == parts[0].shape and np.allclose(whole[0], parts[0], atol=1e-3) and whole[2] == parts[2]

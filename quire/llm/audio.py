"""Audio features of byte payloads.

A payload is kept as 8-bit mono PCM in a RIFF/WAVE container, which is lossless. What is read back is resampled by a
polyphase filter, cut into overlapping frames, turned into log-mel energies, and segmented by energy with hysteresis: a
segment opens above one level and closes below a lower one. Features are stored as fixed-shape tensors (Arrow's
fixed_shape_tensor, FRAMES x MELS each) with the time span of every tensor, as an Arrow stream in one column.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Bytes of a payload are padded to a positive multiple of this.
PAD = 64
RATE, TARGET = 16_000, 12_000
FRAME, HOP, FFT = 300, 120, 512
MELS, FRAMES = 32, 64
#: Taps of the low-pass filter for each phase.
TAPS = 16
#: Levels in decibels over the floor, at which a segment opens and closes.
OPEN_DB, CLOSE_DB = -30.0, -36.0
FLOOR = 1e-10
#: Samples of the target rate that are worked on at once; a multiple of HOP.
STRETCH = HOP * 4096


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % PAD if raw else PAD)


def to_wave(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM; payloads are even, so the chunk needs no filler."""
    header = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return header + b"data" + struct.pack("<I", len(payload)) + payload


def from_wave(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples, found by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if name == b"fmt ":
            rate = struct.unpack("<I", media[at + 12 : at + 16])[0]
        if name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def phases(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """A windowed-sinc low-pass filter as ``up`` phases of ``taps``; each phase sums to 1."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * np.hamming(n)
    h = h.reshape(taps, up).T
    return h / h.sum(axis=1, keepdims=True)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Polyphase resampling by target / rate: output i is phase (i * down) % up over the inputs up to (i * down) // up."""
    g = int(np.gcd(rate, target))
    up, down = target // g, rate // g
    if up == down:
        return x
    bank = phases(up, down)
    n = -(-len(x) * up // down)
    half = TAPS // 2
    line = np.concatenate((np.zeros(TAPS - 1 - half), x, np.zeros(half + 1 + down)))
    windows = np.lib.stride_tricks.sliding_window_view(line, TAPS)
    out = np.empty(n)
    for first in range(min(up, n)):  # outputs with one phase take equally spaced windows
        at = first * down
        rows = windows[at // up :: down][: len(out[first::up])]
        out[first::up] = rows @ bank[at % up][::-1]
    return out


def mel_bank(rate: int, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters, equally spaced in mel."""
    to_mel, to_hz = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = to_hz(np.linspace(to_mel(0.0), to_mel(rate / 2), mels + 2))
    f = np.arange(fft // 2 + 1) * rate / fft
    rise = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall))


_BANK = mel_bank(TARGET).T.copy()
_WINDOW = np.hanning(FRAME)


def log_mels(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x MELS, decibels) and the energy of each frame. The end is padded, so there is at least one frame."""
    count = max(1, 1 + -(-(len(y) - FRAME) // HOP))
    y = np.concatenate((y, np.zeros(FRAME + (count - 1) * HOP - len(y)))) if len(y) < FRAME + (count - 1) * HOP else y
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:count]
    mels, energy = np.empty((count, MELS), np.float32), np.empty(count)
    for at in range(0, count, 512):
        part = frames[at : at + 512]
        power = np.abs(np.fft.rfft(part * _WINDOW, FFT)) ** 2 / FFT
        mels[at : at + 512] = 10 * np.log10(np.maximum(power @ _BANK, FLOOR))
        energy[at : at + 512] = 10 * np.log10(np.maximum((part**2).mean(axis=1), FLOOR))
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames [first, last): opened at OPEN_DB over or at, held until below CLOSE_DB."""
    state = np.where(energy >= OPEN_DB, 1, np.where(energy < CLOSE_DB, 0, -1))
    told = np.where(state >= 0, np.arange(len(state)), -1)
    last = np.maximum.accumulate(told)
    on = np.where(last >= 0, state[np.maximum(last, 0)], 0) == 1
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(media: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], int]:
    """Log-mels, energies and segments of stored media, and the rate of frames' samples. Long media go in stretches."""
    rate, raw = from_wave(media)
    x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    y = resample(x, rate, TARGET)
    mels, energy = [], []
    for at in range(0, max(1, len(y)), STRETCH):
        stretch = y[at : at + STRETCH + FRAME - HOP]
        if at and len(stretch) <= FRAME - HOP:
            break
        m, e = log_mels(stretch)
        mels.append(m[: STRETCH // HOP])
        energy.append(e[: STRETCH // HOP])
    energy = np.concatenate(energy)
    return np.concatenate(mels), energy, segments(energy), TARGET


def tensors(mels: np.ndarray, rate: int) -> pa.RecordBatch:
    """start_s, end_s, frames and the tensor of each FRAMES frames; the last one is filled with the floor."""
    n = -(-len(mels) // FRAMES)
    filled = np.full((n * FRAMES, MELS), 10 * np.log10(FLOOR), np.float32)
    filled[: len(mels)] = mels
    used = np.minimum(FRAMES, len(mels) - np.arange(n) * FRAMES)
    start = np.arange(n) * FRAMES * HOP / rate
    kind = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
    storage = pa.FixedSizeListArray.from_arrays(pa.array(filled.ravel()), FRAMES * MELS)
    return pa.record_batch([pa.array(start), pa.array(start + ((used - 1) * HOP + FRAME) / rate), pa.array(used, pa.int32()), pa.ExtensionArray.from_storage(kind, storage)], names=["start_s", "end_s", "frames", "mels"])


def to_stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_stream(raw: bytes) -> pa.Table:
    """What an ``audio`` column holds: start_s, end_s, frames and mels, a tensor in each row."""
    return pa.ipc.open_stream(raw).read_all()


MEDIA = "doc_id long, n_bytes long, media binary"
AUDIO = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, segments array<struct<start_s: double, end_s: double>>, audio binary"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        for at in range(0, len(texts), 256):
            raw = [t.as_py() or b"" for t in texts.slice(at, 256)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array([len(r) for r in raw], pa.int64()), pa.array([to_wave(padded(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])


def _hear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for media in part.column(2):
                media = media.as_py()
                payload = from_wave(media)[1]
                mels, _, spans, rate = features(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), len(mels),
                             [{"start_s": a * HOP / rate, "end_s": ((b - 1) * HOP + FRAME) / rate} for a, b in spans], to_stream(tensors(mels, rate))))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(kind), pa.binary()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=[c.split()[0] for c in AUDIO.split(", ") if not c.startswith("end_s")])


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a wave file of the padded text) for each row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(_store, MEDIA)


def audio_features(media: DataFrame) -> DataFrame:
    """Features of stored media (doc_id, n_bytes, media): columns AUDIO.

    Null and empty texts are a payload of 64 zero bytes; every medium has at least one frame; equal texts give equal
    values, as each row is computed on its own in the same steps; an empty table gives no rows.
    """
    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_hear, AUDIO)


def op6_audio_features(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    heard = audio_features(stored_media(docs))
    feature = F.concat_ws("/", "n_frames", F.size("segments"), F.sha2(F.to_json("segments"), 256), F.sha2("audio", 256))
    return heard.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


QUERIES = {"op6_audio_features": op6_audio_features}
ORACLE: dict[str, str] = {}

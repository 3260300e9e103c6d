"""Operator 1: audio columns with polyphase resampling, log-mel tensors and segments.

A payload of bytes is stored losslessly as the samples of an 8-bit mono WAV file. The
features come from the stored file read back: the samples are resampled by a rational
factor through a polyphase windowed-sinc filter, framed with overlap, turned into
log-mel energies and grouped into tensors of fixed shape (``TENSOR_FRAMES`` x ``MELS``)
with the time span of each, kept as one Arrow stream per row. Speech-like segments are
spans where the frame energy rose over a high threshold and hasn't yet fallen under a
low one; both thresholds are quantiles of the row's own frames.

Defined results: null text is stored like empty text, as 64 zero bytes. Equal texts
have equal results. Frames are computed in blocks, so a long text needs no more
working memory than its own bytes a few times over. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATE = 16_000
UP, DOWN, TAPS = 2, 3, 32
FRAME, HOP, MELS = 256, 128, 24
TENSOR_FRAMES = 32
BLOCK_FRAMES = 4096
LOW_QUANTILE, HIGH_QUANTILE = 0.4, 0.7
PAD = 64


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of 64, and their number before."""
    data = (text or "").encode("utf-8")
    return data + b"\0" * (-len(data) % PAD if data else PAD), len(data)


def to_wav(data: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(data)
    return out.getvalue()


def from_wav(stored: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


@functools.lru_cache
def phases(up: int, down: int, taps: int) -> np.ndarray:
    """The filter's taps by phase: ``up`` rows of ``taps`` coefficients."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(n * cut) * cut * np.hamming(len(n)) * up
    return h.reshape(taps, up).T[:, ::-1].astype(np.float32).copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling by up/down; ceil(len(x) * up / down) samples."""
    h = phases(up, down, taps)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x.astype(np.float32), np.zeros(taps + down, np.float32)])
    out = np.zeros(n, np.float32)
    for first in range(up):  # outputs first, first + up, ... share a phase and a stride
        k = len(range(first, n, up))
        at, phase = divmod(first * down, up)
        own = np.zeros(k, np.float32)
        for j in range(taps):
            own += h[phase, j] * padded[at + j : at + j + (k - 1) * down + 1 : down]
        out[first::up] = own
    return out


@functools.lru_cache
def mel_filters(rate: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """(frame / 2 + 1) x mels triangular filters."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x mels) and the mean power of each frame."""
    frames = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros((frames - 1) * HOP + FRAME - len(x), np.float32)])
    window, filters = np.hanning(FRAME).astype(np.float32), mel_filters(rate)
    mel, power = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for at in range(0, frames, BLOCK_FRAMES):
        part = view[at : at + BLOCK_FRAMES]
        spectrum = np.fft.rfft(part * window)
        mel[at : at + len(part)] = np.log(spectrum.real**2 @ filters + spectrum.imag**2 @ filters + np.float32(1e-8))
        power[at : at + len(part)] = (part**2).mean(1)
    return mel, power


def hysteresis(energy: np.ndarray, low: float, high: float) -> list[tuple[int, int]]:
    """Half-open runs of frames that start above ``high`` and last until below ``low``."""
    if not len(energy):
        return []
    event = np.where(energy > high, 1, np.where(energy < low, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = np.concatenate([[0], ((last >= 0) & (event[last] == 1)).astype(np.int8), [0]])
    edge = np.diff(on)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def tensor_type() -> pa.FixedShapeTensorType:
    return pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))


def to_tensors(mel: np.ndarray, rate: int) -> pa.RecordBatch:
    """Tensors of fixed shape with their time spans in seconds; the last is padded."""
    n = -(-len(mel) // TENSOR_FRAMES)
    full = np.full((n * TENSOR_FRAMES, MELS), np.log(np.float32(1e-8)), np.float32)
    full[: len(mel)] = mel
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, TENSOR_FRAMES, MELS))
    step = TENSOR_FRAMES * HOP / rate
    start = np.arange(n) * step
    frames = np.minimum(TENSOR_FRAMES, len(mel) - np.arange(n) * TENSOR_FRAMES)
    end = start + ((frames - 1) * HOP + FRAME) / rate
    return pa.RecordBatch.from_arrays([tensors, pa.array(start), pa.array(end)], ["mel", "t_start", "t_end"])


def write_tensors(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as r:
        return r.read_next_batch()


def features(stored: bytes) -> tuple[np.ndarray, list[tuple[float, float]], int]:
    """Log-mel frames, segments in seconds and the rate of what was resampled."""
    data, rate = from_wav(stored)
    x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    rate = rate * UP // DOWN
    mel, power = log_mel(resample(x), rate)
    low, high = np.quantile(power, [LOW_QUANTILE, HIGH_QUANTILE])
    return mel, [(a * HOP / rate, (b * HOP + FRAME - HOP) / rate) for a, b in hysteresis(power, low, high)], rate


def store(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and the stored WAV file of each text."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([to_wav(payload(t)[0]) for t in part.column(1).to_pylist()], pa.binary())], [id_col, "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, media binary")


def extract(media: DataFrame, id_col: str = "doc_id", col: str = "media") -> DataFrame:
    """id, tensors (an Arrow stream, see ``read_tensors``) and segments; null media give nulls."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                tensors, segments = [], []
                for m in part.column(1).to_pylist():
                    if m is None:
                        tensors.append(None)
                        segments.append(None)
                        continue
                    mel, spans, rate = features(m)
                    tensors.append(write_tensors(to_tensors(mel, rate)))
                    segments.append([{"t_start": a, "t_end": z} for a, z in spans])
                kind = pa.list_(pa.struct([("t_start", pa.float64()), ("t_end", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tensors, pa.binary()), pa.array(segments, kind)], [id_col, "tensors", "segments"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, col).mapInArrow(run, f"`{id_col}` {kind}, tensors binary, segments array<struct<t_start:double,t_end:double>>")


def digest(text: str | None) -> tuple:
    """What one text's payload, stored form and features come to."""
    data, n = payload(text)
    stored = to_wav(data)
    back, _ = from_wav(stored)
    mel, spans, rate = features(stored)
    tensors = read_tensors(write_tensors(to_tensors(mel, rate)))
    coarse = np.round(tensors.column(0).to_numpy_ndarray() * 2).astype("<i2").tobytes()
    active = sum(b - a for a, b in spans)
    feature = f"frames={len(mel)};tensors={tensors.num_rows};segments={len(spans)};active_s={active:.3f};mel={hashlib.sha256(coarse).hexdigest()[:16]}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text, reads it back and returns digests, sizes and a feature summary."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            cols = list(zip(*[digest(t) for t in b.column(1).to_pylist()])) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )

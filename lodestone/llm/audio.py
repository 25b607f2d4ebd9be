"""Media columns: audio features.

Bytes become the samples of an 8-bit mono wave file. The samples are resampled
by a polyphase filter, turned into overlapped log-mel frames and segmented by
energy with hysteresis. The segments are kept as an Arrow stream with a
fixed-shape tensor column and the time span of each tensor.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

RATE, UP, DOWN, TAPS = 12000, 2, 3, 12
FFT, HOP, MELS, POOL = 256, 128, 20, 8
#: Output samples, and frames, that are worked on at a time, whatever the length of the text.
BLOCK, FRAMES = 1 << 18, 2048


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono PCM wave file."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def samples_of(media: bytes) -> bytes:
    """The bytes of a wave file's data chunk."""
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("the wave file has no data chunk")


@lru_cache(maxsize=1)
def _filters() -> list[np.ndarray]:
    """One low-pass filter for each phase of the resampler."""
    n = UP * TAPS
    t = (np.arange(n) - (n - 1) / 2) / DOWN
    h = np.sinc(t) * np.kaiser(n, 6.0)
    h *= UP / h.sum()
    return [h[p::UP][::-1].astype(np.float32) for p in range(UP)]


@lru_cache(maxsize=1)
def _mel() -> tuple[np.ndarray, np.ndarray]:
    """The window, and the weights of triangular filters spaced evenly on the mel scale."""
    top = 2595 * np.log10(1 + RATE * UP / DOWN / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * (RATE * UP / DOWN) / FFT
    up, down = (f[:, None] - hz[:-2]) / (hz[1:-1] - hz[:-2]), (hz[2:] - f[:, None]) / (hz[2:] - hz[1:-1])
    return np.hanning(FFT).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def resampled(payload: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP / DOWN, block by block."""
    n = -(-len(payload) * UP // DOWN)
    out = np.empty(n, np.float32)
    for first in range(0, n, BLOCK):  # BLOCK is a multiple of UP
        last = min(n, first + BLOCK)
        lo = first * DOWN // UP - TAPS + 1
        hi = (last - 1) * DOWN // UP + 1
        x = np.zeros(hi - lo, np.float32)
        a, b = max(lo, 0), min(hi, len(payload))
        x[a - lo : b - lo] = (payload[a:b].astype(np.float32) - 128) / 128
        for p in range(UP):
            k = np.arange(first + p, last, UP)
            if len(k):
                phase = k[0] * DOWN % UP
                at = k[0] * DOWN // UP - TAPS + 1 - lo
                windows = np.lib.stride_tricks.sliding_window_view(x, TAPS)[at::DOWN][: len(k)]
                out[first + p : last : UP] = windows @ _filters()[phase]
    return out


def log_mel(signal: np.ndarray) -> np.ndarray:
    """Frames x MELS; the last frames are padded with silence."""
    n = max(1, -(-max(0, len(signal) - FFT) // HOP) + 1)
    window, mel = _mel()
    out = np.empty((n, MELS), np.float32)
    for first in range(0, n, FRAMES):
        last = min(n, first + FRAMES)
        part = signal[first * HOP : (last - 1) * HOP + FFT]
        part = np.pad(part, (0, (last - 1 - first) * HOP + FFT - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, FFT)[::HOP] * window
        spectrum = np.fft.rfft(frames, axis=1)
        out[first:last] = np.log((spectrum.real**2 + spectrum.imag**2) @ mel + np.float32(1e-6))
    return out


def segments(frames: np.ndarray) -> np.ndarray:
    """Spans of frames, end exclusive: one opens at an energy over the higher threshold and closes under the lower one."""
    energy = frames.mean(axis=1)
    mid, dev = float(energy.mean()), float(energy.std())
    state = np.where(energy > mid + 0.5 * dev, 1, np.where(energy < mid - 0.5 * dev, 0, -1))
    at = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(at >= 0, state[np.maximum(at, 0)], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return edge.reshape(-1, 2)


def features(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in seconds (n x 2), tensors (n x POOL x MELS), and the mean frame."""
    frames = log_mel(resampled(np.frombuffer(payload, np.uint8)))
    spans = segments(frames)
    tensors = np.empty((len(spans), POOL, MELS), np.float32)
    if len(spans):
        size = spans[:, 1] - spans[:, 0]
        edges = spans[:, :1] + (np.arange(POOL + 1) * size[:, None]) // POOL
        sums = np.concatenate([np.zeros((1, MELS)), np.cumsum(frames, axis=0, dtype=np.float64)])
        lo, hi = edges[:, :-1], np.maximum(edges[:, 1:], edges[:, :-1] + 1)
        tensors[:] = (sums[hi] - sums[lo]) / (hi - lo)[:, :, None]
    return spans * (HOP * DOWN / (RATE * UP)), tensors, frames.mean(axis=0, dtype=np.float64)


def to_arrow(spans: np.ndarray, tensors: np.ndarray) -> bytes:
    """An Arrow stream of start_s, end_s and a fixed-shape tensor."""
    values = pa.array(tensors.reshape(-1), pa.float32())
    kind = pa.fixed_shape_tensor(pa.float32(), [POOL, MELS])
    tensor = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(values, POOL * MELS))
    batch = pa.record_batch([pa.array(spans[:, 0], pa.float64()), pa.array(spans[:, 1], pa.float64()), tensor], names=["start_s", "end_s", "tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_arrow(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


_OWN = (("n_bytes", T.LongType()), ("media", T.BinaryType()), ("payload", T.BinaryType()), ("tensors", T.BinaryType()), ("feature", T.StringType()))


def audio_features(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Store each whole text as a wave file, read it back and compute its features.

    Returns the columns ``keep``, and ``n_bytes`` (unpadded), ``media`` (the wave file), ``payload`` (its samples, read
    back), ``tensors`` (the Arrow stream of spans and tensors) and ``feature`` (a summary). A null or empty text is
    64 zero bytes. Values depend on the text alone. An empty table gives an empty table.
    """
    small = docs.select(*[f"`{c}`" for c in keep if c not in dict(_OWN)], docs[text_col].alias("_audio_text"))
    schema = T.StructType([*small.drop("_audio_text").schema, *[T.StructField(n, t, False) for n, t in _OWN]])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = batch.column(batch.num_columns - 1).cast(pa.binary())
                rows: list[list] = [[], [], [], [], []]
                for x in texts:
                    raw = x.as_py() or b""
                    padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
                    media = wav(padded)
                    payload = samples_of(media)
                    spans, tensors, mean = features(payload)
                    text = f"segments={len(spans)};seconds={len(payload) / RATE:.3f};voiced={float((spans[:, 1] - spans[:, 0]).sum()):.3f};mel=" + ",".join(f"{v:.2f}" for v in mean)
                    for row, v in zip(rows, (len(raw), media, payload, to_arrow(spans, tensors), text), strict=True):
                        row.append(v)
                own = [pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[*batch.schema.names[:-1], *[n for n, _ in _OWN]])

    return small.mapInArrow(run, schema)

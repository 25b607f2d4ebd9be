"""The audio features against plain loops: a direct form of the resampler, a discrete Fourier sum, filters one by one, and a walk over the frames."""

import cmath
import math
import random

import numpy as np
import pytest

from lodestone.llm import audio


def bessel(x):
    """The modified Bessel function of order zero, by its series."""
    total, term, k = 1.0, 1.0, 1
    while term > 1e-14 * total:
        term *= (x / (2 * k)) ** 2
        total, k = total + term, k + 1
    return total


def plain_resampled(payload):
    """Put UP - 1 zeros between samples, filter by a windowed sinc, take each DOWN-th: the direct form, without phases."""
    n = audio.UP * audio.TAPS
    taps = []
    for i in range(n):
        t = (i - (n - 1) / 2) / audio.DOWN
        sinc = 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
        taps.append(sinc * bessel(6.0 * math.sqrt(1 - (2 * i / (n - 1) - 1) ** 2)) / bessel(6.0))
    scale = audio.UP / sum(taps)
    x = [(b - 128) / 128 for b in payload]
    out = []
    for k in range(-(-len(x) * audio.UP // audio.DOWN)):
        at, total = k * audio.DOWN, 0.0
        for i, h in enumerate(taps):
            if (at - i) % audio.UP == 0 and 0 <= (at - i) // audio.UP < len(x):
                total += h * scale * x[(at - i) // audio.UP]
        out.append(total)
    return out


def mel(hz):
    return 2595 * math.log10(1 + hz / 700)


def plain_frames(signal):
    rate = audio.RATE * audio.UP / audio.DOWN
    edges = [700 * (10 ** (mel(rate / 2) * i / (audio.MELS + 1) / 2595) - 1) for i in range(audio.MELS + 2)]
    frames, start = [], 0
    while True:
        part = [signal[start + i] if start + i < len(signal) else 0.0 for i in range(audio.FFT)]
        part = [v * (0.5 - 0.5 * math.cos(2 * math.pi * i / (audio.FFT - 1))) for i, v in enumerate(part)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * f * i / audio.FFT) for i, v in enumerate(part))) ** 2 for f in range(audio.FFT // 2 + 1)]
        row = []
        for m in range(audio.MELS):
            total = 0.0
            for f, p in enumerate(power):
                hz = f * rate / audio.FFT
                if edges[m] < hz <= edges[m + 1]:
                    total += p * (hz - edges[m]) / (edges[m + 1] - edges[m])
                elif edges[m + 1] < hz < edges[m + 2]:
                    total += p * (edges[m + 2] - hz) / (edges[m + 2] - edges[m + 1])
            row.append(math.log(total + 1e-6))
        frames.append(row)
        if start + audio.FFT >= len(signal):
            return frames
        start += audio.HOP


def plain_segments(energy):
    """Open over the higher threshold, closed under the lower one, unchanged between them."""
    mid = sum(energy) / len(energy)
    dev = math.sqrt(sum((e - mid) ** 2 for e in energy) / len(energy))
    out, begun = [], None
    for i, e in enumerate(energy):
        if begun is None and e > mid + 0.5 * dev:
            begun = i
        elif begun is not None and e < mid - 0.5 * dev:
            out.append((begun, i))
            begun = None
    return out + ([(begun, len(energy))] if begun is not None else [])


def speech(seed, n):
    """Loud and quiet stretches."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        loud = rng.choice([3, 20, 90])
        out += [128 + int(loud * math.sin(i * rng.choice([0.2, 0.9])) + rng.randrange(-2, 3)) for i in range(rng.randrange(100, 500))]
    return bytes(min(255, max(0, v)) for v in out[:n])


@pytest.mark.parametrize("payload", [bytes(64), speech(1, 64), speech(2, 640), speech(3, 4096), "text that is heard, ünd more of it. ".encode() * 20])
def test_features_by_plain_loops(payload):
    signal = plain_resampled(payload)
    got = audio.resampled(np.frombuffer(payload, np.uint8))
    assert len(got) == len(signal) and np.allclose(got, signal, atol=2e-5)
    frames = plain_frames([float(v) for v in got])
    mine = audio.log_mel(got)
    assert mine.shape == (len(frames), audio.MELS) and np.allclose(np.exp(mine), np.exp(frames), rtol=2e-3, atol=2e-6)
    assert [tuple(s) for s in audio.segments(mine)] == plain_segments(mine.mean(axis=1, dtype=np.float64).tolist())
    spans, tensors, mean = audio.features(payload)
    places = plain_segments(mine.mean(axis=1, dtype=np.float64).tolist())
    assert len(places) == len(spans) == len(tensors) and np.allclose(mean, mine.mean(axis=0), atol=1e-4)
    for (a, b), (start, end), tensor in zip(places, spans, tensors, strict=True):
        assert math.isclose(start, a * audio.HOP * 1.5 / audio.RATE) and math.isclose(end, b * audio.HOP * 1.5 / audio.RATE)
        for row in range(audio.POOL):
            lo, hi = a + row * (b - a) // audio.POOL, a + (row + 1) * (b - a) // audio.POOL
            assert np.allclose(tensor[row], mine[lo : max(hi, lo + 1)].mean(axis=0), atol=1e-3)
    table = audio.from_arrow(audio.to_arrow(spans, tensors))
    assert np.allclose(np.array(table["start_s"]), spans[:, 0]) and table.num_rows == len(spans)


def test_hysteresis_opens_and_closes():
    energy = [0, 0, 9, 5, 9, 5, 0, 5, 5, 9, 9, 5]
    frames = np.repeat(np.array(energy, np.float32)[:, None], audio.MELS, axis=1)
    assert [tuple(s) for s in audio.segments(frames)] == plain_segments(energy) == [(2, 6), (9, 12)]
    assert len(audio.segments(np.zeros((5, audio.MELS), np.float32))) == 0

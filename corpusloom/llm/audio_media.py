"""Media columns: 8-bit audio containers, polyphase resampling, log-mel features, energy segments.

A payload is stored as the samples of a WAV file (unsigned 8-bit PCM, one channel). Features are
computed from the stored bytes in blocks of frames, so the memory for a sound is bounded by the
block and not by its length: rational polyphase resampling, overlapped log-mel filterbanks, and
segments of high energy with hysteresis. Filterbanks are cut into windows of a fixed number of
frames and stored as a fixed-shape Arrow tensor with a time span for each window.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

PAD_UNIT, PAD_BYTE = 576, 255


@dataclass(frozen=True)
class AudioConfig:
    """Rates in Hz, lengths in seconds; ``rise`` and ``fall`` are decibels above the quietest frame."""

    rate: int = 16_000
    up: int = 3
    down: int = 4
    taps: int = 12
    window_s: float = 0.025
    hop_s: float = 0.010
    fft: int = 512
    mels: int = 40
    tensor_frames: int = 64
    rise: float = 4.0
    fall: float = 2.0
    least_frames: int = 3
    block_frames: int = 4096

    @property
    def out_rate(self) -> int:
        return self.rate * self.up // self.down

    @property
    def window(self) -> int:
        return round(self.out_rate * self.window_s)

    @property
    def hop(self) -> int:
        return round(self.out_rate * self.hop_s)


def wav(samples: bytes, rate: int) -> bytes:
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    pad = b"\0" * (len(samples) % 2)
    data = struct.pack("<4sI", b"data", len(samples)) + samples + pad
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def wav_samples(media: bytes) -> tuple[bytes, int]:
    """Samples and rate; raises ValueError on other formats."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only one channel of 8-bit PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """The low-pass filter (windowed sinc) as one row of ``2 * taps`` weights for each phase."""
    wide = max(up, down)
    t = (np.arange(2 * taps * up) - taps * up) / up
    h = np.sinc(t * up / wide) * (up / wide) * np.hanning(len(t) + 1)[:-1]
    rows = np.empty((up, 2 * taps))
    for p in range(up):
        k = np.arange(2 * taps)
        rows[p] = h[(p + (2 * taps - 1 - k) * up) % len(h)]
    return (rows / rows.sum(axis=1, keepdims=True)).astype(np.float32)


def resampled_length(n: int, up: int, down: int) -> int:
    return n * up // down


def resample(x: np.ndarray, up: int, down: int, taps: int, start: int, stop: int) -> np.ndarray:
    """Outputs ``start`` to ``stop`` of the signal resampled by ``up / down``; outside it is silence.

    Output n is a weighted sum of the ``2 * taps`` inputs around n * down / up, with the weights of
    phase n * down mod up; outputs of one phase are one product of strided windows and weights.
    """
    weights = _phases(up, down, taps)
    first = start - start % up
    count = -(-(stop - first) // up)
    base = first // up * down
    low, high = base - taps, base + count * down + down + taps
    part = np.zeros(high - low, dtype=np.float32)
    a, b = max(low, 0), min(high, len(x))
    if b > a:
        part[a - low : b - low] = (x[a:b].astype(np.float32) - 128.0) / 128.0
    windows = np.lib.stride_tricks.sliding_window_view(part, 2 * taps)
    out = np.empty((count, up), dtype=np.float32)
    for r in range(up):
        shift, phase = r * down // up, r * down % up
        out[:, r] = windows[shift + 1 : shift + 1 + count * down : down][:count] @ weights[phase]
    return out.reshape(-1)[start - first : stop - first]


@lru_cache(maxsize=8)
def _mel_weights(rate: int, fft: int, mels: int) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(fft, 1 / rate)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32).T


def frame_blocks(samples: bytes, c: AudioConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Log-mel frames and their energies in decibels, block by block."""
    x = np.frombuffer(samples, dtype=np.uint8)
    total = resampled_length(len(x), c.up, c.down)
    frames = max(1, 1 + (total - c.window) // c.hop)
    shape, mel = np.hanning(c.window).astype(np.float32), _mel_weights(c.out_rate, c.fft, c.mels)
    for f0 in range(0, frames, c.block_frames):
        f1 = min(frames, f0 + c.block_frames)
        y = resample(x, c.up, c.down, c.taps, f0 * c.hop, (f1 - 1) * c.hop + c.window)
        w = np.lib.stride_tricks.sliding_window_view(y, c.window)[:: c.hop] * shape
        power = np.abs(np.fft.rfft(w, c.fft)) ** 2
        yield np.log(power.astype(np.float32) @ mel + 1e-6), 10 * np.log10((w * w).mean(axis=1) + 1e-6)


def hysteresis(energy: np.ndarray, c: AudioConfig) -> list[tuple[int, int]]:
    """Segments of frames: one starts where the energy reaches ``rise`` and goes on until it is below ``fall``."""
    floor = float(energy.min())
    level = np.where(energy >= floor + c.rise, 1, np.where(energy < floor + c.fall, -1, 0))
    known = np.where(level != 0, np.arange(len(level)), -1)
    last = np.maximum.accumulate(known)
    on = np.where(last >= 0, level[np.maximum(last, 0)], -1) > 0
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if b - a >= c.least_frames]


def tensor_stream(blocks: list[np.ndarray], c: AudioConfig) -> tuple[bytes, int]:
    """An Arrow IPC stream of ``start_s, end_s, log_mel fixed_shape_tensor[frames, mels]``, and the number of windows.

    The last window is filled up with the value of silence; its end is that of its last frame.
    """
    frames = np.concatenate(blocks)
    n = -(-len(frames) // c.tensor_frames)
    padded = np.full((n * c.tensor_frames, c.mels), np.float32(np.log(1e-6)), dtype=np.float32)
    padded[: len(frames)] = frames
    kind = pa.fixed_shape_tensor(pa.float32(), [c.tensor_frames, c.mels])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(padded.reshape(-1)), c.tensor_frames * c.mels)
    first = np.arange(n) * c.tensor_frames
    last = np.minimum(first + c.tensor_frames, len(frames)) - 1
    table = pa.table({
        "start_s": first * c.hop / c.out_rate,
        "end_s": (last * c.hop + c.window) / c.out_rate,
        "log_mel": pa.ExtensionArray.from_storage(kind, flat),
    })
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue(), n


def encode_media(df: DataFrame, config: AudioConfig = AudioConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes long, media binary``: each text's bytes, filled up with 255 to a positive multiple of 576, as WAV.

    A null text is empty. Repeated rows and null ids are kept; other columns are not read.
    """

    def make():
        def work(key, text):
            payload = (text or "").encode()
            short = -len(payload) % PAD_UNIT or (0 if payload else PAD_UNIT)
            return ((key, len(payload), wav(payload + bytes([PAD_BYTE]) * short, config.rate)),)

        return work

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(source, "doc_id long, n_bytes long, media binary", make)


def audio_features(media: DataFrame, config: AudioConfig = AudioConfig()) -> DataFrame:
    """The rows of :func:`encode_media` (or any with ``media``) with what is read back and its features.

    Adds ``payload binary, n_frames long, n_windows long, features binary`` (see :func:`tensor_stream`)
    and ``segments array<struct<start_s double, end_s double>>``. Media that is null or not in the
    format gives nulls in all of them. Equal media have equal features.
    """
    fields = [f for f in media.schema.fields if f.name.lower() not in ("payload", "n_frames", "n_windows", "features", "segments")]
    own = media.select(*[F.col(f"`{f.name}`") for f in fields])
    at = [f.name for f in fields].index("media")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def make():
        def work(*row):
            try:
                samples, _ = wav_samples(row[at] or b"")
            except (ValueError, struct.error):
                return ((*row, None, None, None, None, None),)
            mels, energies = zip(*frame_blocks(samples, config), strict=True)
            energy = np.concatenate(energies)
            features, windows = tensor_stream(list(mels), config)
            spans = [
                {"start_s": a * config.hop / config.out_rate, "end_s": ((b - 1) * config.hop + config.window) / config.out_rate}
                for a, b in hysteresis(energy, config)
            ]
            return ((*row, samples, len(energy), windows, features, spans),)

        return work

    return map_rows(
        own,
        f"{kept}, payload binary, n_frames long, n_windows long, features binary, segments array<struct<start_s: double, end_s: double>>",
        make,
    )

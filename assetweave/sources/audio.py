"""Sounds: samples and metadata from bytes, with NumPy."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

from ..functions.numbers import decibels_of, round_up_of

EXTENSIONS = ("wav", "ogg", "oga", "mp3", "flac", "opus", "m4a", "aiff", "aif")
#: Rate and window of the audio models, in samples a second and seconds.
RATE, WINDOW_SECONDS = 48_000, 10
_FORMATS = {"oga": "ogg", "aif": "aiff"}


def _integers(raw: bytes, bits: int, big: bool) -> np.ndarray:
    order = ">" if big else "<"
    if bits == 8:
        return np.frombuffer(raw, "i1").astype(np.float32) / 128 if big else (np.frombuffer(raw, "u1").astype(np.float32) - 128) / 128
    if bits == 24:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        b = b[:, ::-1] if big else b
        return (((b[:, 2] << 24) | (b[:, 1] << 16) | (b[:, 0] << 8)) >> 8).astype(np.float32) / (1 << 23)
    size = bits // 8
    return np.frombuffer(raw[: len(raw) // size * size], f"{order}i{size}").astype(np.float32) / float(1 << (bits - 1))


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(channels x frames, rate) of PCM and float WAV files."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("Not a WAV file")
    at, form, body = 12, None, b""
    while at + 8 <= len(data):
        kind, size = struct.unpack("<4sI", data[at : at + 8])
        if kind == b"fmt ":
            form = data[at + 8 : at + 8 + size]
        elif kind == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None:
        raise ValueError("WAV without a format")
    code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
    if code == 0xFFFE and len(form) >= 26:
        code = struct.unpack("<H", form[24:26])[0]
    if code == 3:
        samples = np.frombuffer(body[: len(body) // (bits // 8) * (bits // 8)], f"<f{bits // 8}").astype(np.float32)
    elif code == 1:
        samples = _integers(body, bits, False)
    else:
        raise ValueError(f"WAV codec {code} is not supported")
    return samples[: len(samples) // channels * channels].reshape(-1, channels).T, rate


def decode_aiff(data: bytes) -> tuple[np.ndarray, int]:
    if data[:4] != b"FORM" or data[8:12] != b"AIFF":
        raise ValueError("Not an uncompressed AIFF file")
    at, channels, bits, rate, body = 12, 0, 0, 0, b""
    while at + 8 <= len(data):
        kind, size = struct.unpack(">4sI", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"COMM":
            channels, _, bits = struct.unpack(">hIh", chunk[:8])
            exponent, mantissa = struct.unpack(">HQ", chunk[8:18])
            rate = round(mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63))
        elif kind == b"SSND":
            body = chunk[8 + struct.unpack(">I", chunk[:4])[0] :]
        at += 8 + size + size % 2
    samples = _integers(body, bits, True)
    return samples[: len(samples) // channels * channels].reshape(-1, channels).T, rate


#: Decoders by extension; others can be added where a codec library is installed.
DECODERS: dict[str, Callable[[bytes], tuple[np.ndarray, int]]] = {"wav": decode_wav, "aiff": decode_aiff, "aif": decode_aiff}


def downmix(channels: np.ndarray) -> np.ndarray:
    """The mean of all channels."""
    return channels.mean(axis=0, dtype=np.float64).astype(np.float32) if len(channels) else np.zeros(0, np.float32)


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Straight lines between samples where the rate rises, box means where it falls."""
    if rate == to or not len(samples):
        return samples
    ratio = rate / to
    n = max(1, int(len(samples) / ratio + 0.5))
    at = np.arange(n) * ratio
    first = np.floor(at).astype(int)
    if ratio > 1:
        last = np.minimum(len(samples), np.maximum(first + 1, np.floor((np.arange(n) + 1) * ratio).astype(int)))
        sums = np.r_[0.0, np.cumsum(samples, dtype=np.float64)]
        return ((sums[last] - sums[first]) / (last - first)).astype(np.float32)
    a = samples[np.minimum(first, len(samples) - 1)]
    b = samples[np.minimum(first + 1, len(samples) - 1)]
    return (a + (b - a) * (at - first)).astype(np.float32)


def levels(samples: np.ndarray) -> tuple[float | None, float | None]:
    """Peak and RMS in dBFS, none for silence."""
    if not len(samples):
        return None, None
    x = samples.astype(np.float64)
    return decibels_of(float(np.abs(x).max())), decibels_of(float(np.sqrt(np.mean(x * x))))


def windows(samples: np.ndarray, rate: int = RATE) -> list[np.ndarray]:
    """Whole up to ten seconds; else start and end, and from thirty seconds the middle too."""
    size = WINDOW_SECONDS * rate
    last = len(samples) - size
    if last <= 0:
        return [samples]
    starts = [0, last // 2, last] if len(samples) >= 3 * size else [0, last]
    return [samples[s : s + size] for s in starts]


def waveform(samples: np.ndarray, columns: int) -> np.ndarray:
    """Least and greatest sample of each pixel column."""
    if not len(samples):
        return np.zeros((columns, 2), np.float32)
    starts = np.arange(columns) * len(samples) // columns
    parts = np.array_split(samples, starts[1:]) if columns > 1 else [samples]
    return np.array([(p.min(), p.max()) if len(p) else (0, 0) for p in parts], np.float32)


def describe(extension: str, data: bytes) -> tuple[dict, np.ndarray, int]:
    """(metadata, mono samples, rate)."""
    if extension not in DECODERS:
        raise ValueError(f"No decoder for {extension} is installed")
    channels, rate = DECODERS[extension](data)
    if not len(channels) or not channels.shape[1] or not rate:
        raise ValueError("No audio samples decoded")
    seconds = channels.shape[1] / rate
    mono = downmix(channels)
    peak, rms = levels(mono)
    metadata = {
        "durationSeconds": round_up_of(seconds, 3),
        "channels": len(channels),
        "sampleRate": rate,
        "format": _FORMATS.get(extension, extension),
        "bitrateKbps": int(len(data) * 8 / seconds / 1000 + 0.5),
        "peakDb": peak,
        "rmsDb": rms,
    }
    return metadata, mono, rate

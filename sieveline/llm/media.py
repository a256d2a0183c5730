"""Media columns: texts' bytes as WAV audio, its spectra, and fingerprints of pairs of spectral peaks.

Audio is 8-bit mono PCM, written and read by the wave module, so each byte of a payload is one sample. Spectra are
short-time Fourier transforms with a Hann window, worked through in blocks of frames; silence fills the last frame. A frame's peak in a band is its
strongest bin there if no weaker than in the frames beside it; each peak pairs with the next few of the peaks in time,
and the two frequencies and the time between them make a code. Codes are stored with the frame at which they start.

Defined cases: a null text counts as empty; an empty text gives a payload of 192 spaces; very long texts are taken
whole; equal texts give equal values; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

RATE = 8000
WINDOW, HOP, BLOCK = 256, 192, 4096
#: First bin of each band of a spectrum, and the end of the last.
BANDS = (2, 16, 32, 64, 129)
FAN_OUT, MAX_GAP = 3, 32
PAD = 192


def payload(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 with spaces up to a positive multiple of 192 bytes, and its length before."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % PAD or (0 if raw else PAD)), len(raw)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    """The samples of an 8-bit mono WAV file."""
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono PCM is asked for")
        return w.readframes(w.getnframes())


def band_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each frame and band the strongest bin and its magnitude."""
    x = np.frombuffer(samples, np.uint8)
    rest = WINDOW - len(x) if len(x) < WINDOW else -(len(x) - WINDOW) % HOP
    x = np.concatenate([x, np.full(rest, 128, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    hann = np.hanning(WINDOW).astype(np.float32)
    bins = np.empty((len(frames), len(BANDS) - 1), np.int16)
    size = np.empty(bins.shape, np.float32)
    for at in range(0, len(frames), BLOCK):
        spectrum = np.fft.rfft((frames[at : at + BLOCK].astype(np.float32) - 128) * hann, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        for k, (low, high) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            part = power[:, low:high]
            top = part.argmax(axis=1)
            bins[at : at + BLOCK, k] = top + low
            size[at : at + BLOCK, k] = part[np.arange(len(part)), top]
    return bins, size


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start frames and codes of the pairs of peaks, in time order."""
    bins, size = band_peaks(samples)
    edge = np.zeros((1, size.shape[1]), np.float32)
    peak = (size > 0) & (size >= np.concatenate([edge, size[:-1]])) & (size >= np.concatenate([size[1:], edge]))
    at, band = np.nonzero(peak)
    freq = bins[at, band].astype(np.int64)
    times, codes = [], []
    for k in range(1, FAN_OUT + 1):
        gap = at[k:] - at[:-k]
        good = gap <= MAX_GAP
        times.append(at[:-k][good])
        codes.append((freq[:-k] << 16 | freq[k:] << 8 | gap)[good])
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


def media(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Rows of ``id_col``, sizes and hashes of payload and WAV, ``times`` and ``codes``; with ``keep`` also the WAV as ``media``."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(text_col).to_pylist():
            raw, n = payload(text)
            stored = to_wav(raw)
            back = from_wav(stored)
            times, codes = fingerprint(back)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), times, codes, stored if keep else None))
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "times", "codes", "media")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
        columns = {id_col: batch.column(id_col)} | {name: pa.array([r[k] for r in rows], t) for k, (name, t) in enumerate(zip(names, kinds, strict=True)) if keep or name != "media"}
        return pa.RecordBatch.from_pydict(columns)

    schema = f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, times array<int>, codes array<int>"
    return map_slices(df.select(id_col, text_col), text_col, schema + (", media binary" if keep else ""), work)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as audio; ``feature`` is the number of its pairs of peaks and a digest of their times and codes."""
    made = media(table(spark, sf_dir, "documents"))
    digest = F.hex(F.xxhash64("times", "codes"))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(":", F.size("codes"), digest).alias("feature"))

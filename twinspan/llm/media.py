"""Media columns: payloads kept as WAV files in a binary column, read by the wave module, and fingerprinted by
pairs of spectral peaks.

A payload of bytes becomes a mono file of 8-bit samples (one byte a sample, lossless). Its short-time Fourier
transform has frames of FRAME samples every HOP; a frame's peaks are its PEAKS strongest local maxima over
frequency that stand out from the frame's mean; each peak is paired with the next FAN peaks of the following
REACH frames. A pair (f1, f2, dt) makes a hash, kept with the time of its first peak.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, slices, table

UNIT = 576
PAD = 255
RATE = 8000
FRAME, HOP = 256, 192
PEAKS, FAN, REACH = 2, 2, 3
BLOCK = 4096  # frames transformed at once
_WINDOW = np.hanning(FRAME + 2)[1:-1].astype(np.float32)  # no sample weighs nothing


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """data and bytes 255 up to a positive multiple of unit."""
    return data + bytes([PAD]) * (max(1, -(-len(data) // unit)) * unit - len(data))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("mono files of 8-bit samples are read")
        return w.readframes(w.getnframes())


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, frequency bin) of all peaks, by frame and then from strong to weak; at least one frame. Silence
    behind the samples fills the last frame, so that every sample lies in one."""
    x = np.zeros(FRAME + -(-max(len(samples) - FRAME, 0) // HOP) * HOP, np.float32)
    x[: len(samples)] = samples.astype(np.float32) - 128
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    times, bins = [], []
    for at in range(0, len(frames), BLOCK):
        power = np.abs(np.fft.rfft(frames[at : at + BLOCK] * _WINDOW, axis=1)).astype(np.float32)
        power[:, 0] = 0
        inner = power[:, 1:-1]
        strength = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 2 * power.mean(axis=1, keepdims=True)), inner, 0)
        best = np.argpartition(strength, -PEAKS, axis=1)[:, -PEAKS:]
        order = np.argsort(-np.take_along_axis(strength, best, 1), axis=1, kind="stable")
        best = np.take_along_axis(best, order, 1)
        frame, k = np.nonzero(np.take_along_axis(strength, best, 1) > 0)
        times.append(frame + at)
        bins.append(best[frame, k] + 1)
    return np.concatenate(times), np.concatenate(bins)


def peak_pairs(samples: np.ndarray) -> np.ndarray:
    """Codes time << 32 | f1 << 16 | f2 << 4 | dt, ascending: the fingerprint as one time-coded array."""
    t, f = spectral_peaks(samples)
    codes = []
    for step in range(1, FAN * PEAKS + 1):
        if step >= len(t):
            break
        dt = t[step:] - t[:-step]
        ok = (dt > 0) & (dt <= REACH)
        codes.append((t[:-step][ok] << 32) | (f[:-step][ok] << 16) | (f[step:][ok] << 4) | dt[ok])
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (binary, a WAV file) of every row: the text's UTF-8 bytes, padded. Narrow.

    A null or empty text is one unit of padding, a null id is carried along. Repeated rows each get their row, other
    columns are not read whatever their names, an empty table gives an empty result."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data = [b or b"" for b in part.column(1).to_pylist()]
            yield batch_of(schema, part.column(0), [len(b) for b in data], [to_wav(padded(b)) for b in data])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("data")).mapInArrow(
        store, "doc_id long, n_bytes long, media binary"
    )


def fingerprints(media: DataFrame) -> DataFrame:
    """Reads the media column of with_media() back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256 and pairs (array<long>, the time-coded peak pairs; empty where no peak has a partner). A row
    without media isn't made by with_media(), and fails here."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
         ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("pairs", pa.list_(pa.int64()))]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            pairs = []
            for m in part.column("media").to_pylist():
                payload = from_wav(m)
                pairs.append(peak_pairs(np.frombuffer(payload, np.uint8)))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest()))
            ends = np.cumsum([0, *map(len, pairs)], dtype=np.int32)
            yield batch_of(schema, part.column("doc_id"), part.column("n_bytes"), *zip(*rows), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pairs).astype(np.int64))))

    return media.mapInArrow(
        read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pairs array<long>"
    )


def digest(found: DataFrame) -> DataFrame:
    """fingerprints() with the pairs as one short text: how many they are and a hash of all."""
    feature = F.concat_ws(":", F.size("pairs").cast("string"), F.sha2(F.array_join("pairs", ","), 256))
    return found.withColumn("feature", feature).drop("pairs")


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    """Nulls: a null text is an empty payload, which is one unit of padding. Very long texts are transformed in
    blocks of frames. Equal texts have equal values in every column. Repeated rows each get their row, other
    columns are not read, an empty table gives an empty result."""
    return digest(fingerprints(with_media(table(spark, sf_dir, "documents"))))

"""Operator 1: media columns (WAV, short-time Fourier transform, peak pairs).

``to_wav`` stores bytes losslessly as the 8-bit samples of a mono WAV file in a
binary column. ``wav_fingerprints`` reads such a column with the ``wave``
module, takes a Hann-windowed short-time Fourier transform block by block, keeps
spectral peaks and stores pairs of nearby peaks as time-coded arrays: entry i
says that at frame ``fp_time[i]`` a peak at bin f1 is followed ``dt`` frames
later by one at f2, with ``fp_hash[i] = f1 << 14 | f2 << 7 | dt``.

Defined results: null bytes count as empty; an empty payload becomes 64 zero
samples, which have no peaks (empty arrays); a document of any length is
handled in blocks of ``BLOCK`` frames; equal bytes give equal values. A media
value that is no such WAV file raises, as does a null one. Other columns pass
through unchanged; a column that has the name of a new one is replaced.
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
from pyspark.sql import types as T

from .staging import Stage, documents, importable

RATE, FRAME, HOP, PAD = 8000, 256, 128, 64
#: Frames transformed at once: about 8 MB of spectra.
BLOCK = 4096
#: Frequency bands, each with one peak a frame at most; bin 0 is left out.
BANDS = ((1, 9), (9, 25), (25, 57), (57, 129))
#: Later peaks paired with each peak, and the furthest in frames.
FAN_OUT, FURTHEST = 3, 63
#: Output rows an Arrow batch.
ROWS = 256

_WINDOW = np.hanning(FRAME).astype(np.float32)


def wav_bytes(payload: bytes) -> bytes:
    """A mono 8-bit WAV file of which the samples are the payload."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def wav_payload(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getnchannels() != 1 or w.getsampwidth() != 1:
            raise ValueError("expected mono samples of 8 bits")
        return w.readframes(w.getnframes())


def padded(data: bytes, unit: int = PAD) -> bytes:
    """data with zero bytes up to a positive multiple of unit."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(frame, bin) of the peaks in time order, and the number of frames.

    In each band the strongest bin of a frame is a peak when it has power and
    is stronger than the band's strongest of the frame before, and no weaker
    than that of the frame after.
    """
    n = len(samples)
    frames = max(1, -(-(n - FRAME) // HOP) + 1)
    x = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    x[:n] = samples
    x[:n] -= 128
    x[n:] = 0
    windows = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    where = np.empty((len(BANDS), frames), np.int32)
    power = np.empty((len(BANDS), frames), np.float32)
    for at in range(0, frames, BLOCK):
        spectrum = np.fft.rfft(windows[at : at + BLOCK] * _WINDOW, axis=1)
        energy = spectrum.real**2 + spectrum.imag**2
        for b, (low, high) in enumerate(BANDS):
            best = energy[:, low:high].argmax(1)
            where[b, at : at + BLOCK] = best + low
            power[b, at : at + BLOCK] = energy[np.arange(len(best)), best + low]
    floor = np.float32(1e-3)
    keep = power > floor
    keep[:, 1:] &= power[:, 1:] > power[:, :-1]
    keep[:, :-1] &= power[:, :-1] >= power[:, 1:]
    t, b = np.nonzero(keep.T)
    return t.astype(np.int32), where[b, t], frames


def pairs(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded pair hashes, by time of the first peak."""
    times, hashes, order = [], [], []
    for step in range(1, FAN_OUT + 1):
        dt = t[step:] - t[:-step]
        ok = np.flatnonzero(dt <= FURTHEST)
        times.append(t[ok])
        hashes.append(f[ok] << 14 | f[ok + step] << 7 | dt[ok])
        order.append(ok * FAN_OUT + step)
    by = np.argsort(np.concatenate(order), kind="stable")
    return np.concatenate(times)[by].astype(np.int32), np.concatenate(hashes)[by].astype(np.int32)


def _map(df: DataFrame, column: str, new: list[T.StructField], row) -> DataFrame:
    """df with the columns new, which row(bytes) gives for each value of column."""
    importable(df.sparkSession)
    names = {x.name for x in new}
    held = [x for x in df.schema.fields if x.name not in names]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(x.dataType) for x in new]
    keep = [x.name for x in held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = [row(x.as_py()) for x in part.column(column)]
                arrays = [part.column(n) for n in keep] + [pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=keep + [x.name for x in new])

    return df.mapInArrow(run, T.StructType(held + new))


def to_wav(df: DataFrame, column: str, media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """Adds the WAV form of a string or binary column and its unpadded length."""

    def row(value) -> tuple:
        data = b"" if value is None else value.encode() if isinstance(value, str) else bytes(value)
        return len(data), wav_bytes(padded(data))

    return _map(df, column, [T.StructField(n_bytes, T.LongType()), T.StructField(media, T.BinaryType())], row)


def wav_fingerprints(df: DataFrame, media: str = "media", arrays: bool = True) -> DataFrame:
    """Adds what is read from a WAV column.

    payload_bytes, payload_sha256, tail_crc32 (of the last 64 samples),
    media_bytes, media_sha256, n_frames, n_peaks, n_pairs, fp_sha256 (of the
    arrays as little-endian int32, times first) and, if arrays, fp_time and
    fp_hash.
    """
    text, number = T.StringType(), T.LongType()
    new = [
        T.StructField(n, k)
        for n, k in (("payload_bytes", number), ("payload_sha256", text), ("tail_crc32", number), ("media_bytes", number), ("media_sha256", text), ("n_frames", number), ("n_peaks", number), ("n_pairs", number), ("fp_sha256", text))
    ]
    if arrays:
        new += [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("fp_time", "fp_hash")]

    def row(value) -> tuple:
        payload = wav_payload(value)
        t, f, frames = peaks(np.frombuffer(payload, np.uint8))
        time, code = pairs(t, f)
        out = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(value), hashlib.sha256(value).hexdigest(), frames, len(t), len(time), hashlib.sha256(time.astype("<i4").tobytes() + code.astype("<i4").tobytes()).hexdigest())
        return out + ((time, code) if arrays else ())

    return _map(df, media, new, row)


def op1_media_wav(spark, sf_dir: str) -> DataFrame:
    """Contract query: every whole text as WAV in a stored table, read back from it and
    fingerprinted; the time-coded arrays stand in the result."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    stored = Stage(spark, "media").save(to_wav(docs, "text").drop("text"), "wav")
    read = wav_fingerprints(stored)
    feature = F.concat_ws(":", F.col("n_frames"), F.col("n_peaks"), F.col("n_pairs"), F.col("fp_sha256"))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "n_frames", "n_pairs", "fp_time", "fp_hash")

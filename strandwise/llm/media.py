"""Media columns: payloads stored as WAV, and spectral-peak pair fingerprints of what is read back.

A payload is a text's UTF-8 bytes, padded by spaces to a positive multiple of ``BLOCK``; each byte is one 8-bit sample.
The spectrum comes from a short-time Fourier transform over blocks of samples that lie half a block apart. A frame's
strongest bin is a peak if no neighbouring frame has a stronger one; each peak is paired with the next few. A pair is
kept as one time-coded number: frame << 20 | bin << 13 | next bin << 6 | frames between.
"""

from __future__ import annotations

import io
import wave
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

BLOCK, HOP, RATE = 192, 96, 8000
FAN, REACH = 3, 63
FRAMES = 8192
WINDOW = np.hanning(BLOCK).astype(np.float32)


def payload_of(raw: bytes) -> bytes:
    """Bytes padded by spaces to a positive multiple of BLOCK."""
    return raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b" ")


def to_wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples in a WAV file."""
    with io.BytesIO() as file:
        with wave.open(file, "wb") as out:
            out.setnchannels(1)
            out.setsampwidth(1)
            out.setframerate(RATE)
            out.writeframes(payload)
        return file.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file of one channel of 8-bit samples."""
    with wave.open(io.BytesIO(media), "rb") as got:
        if (got.getnchannels(), got.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return got.readframes(got.getnframes())


def strongest(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each frame's strongest bin (the constant part left out) and its magnitude; spectra of FRAMES frames at a time."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    frames = np.lib.stride_tricks.sliding_window_view(x, BLOCK)[::HOP]
    bins, power = np.empty(len(frames), np.int64), np.empty(len(frames), np.float32)
    for at in range(0, len(frames), FRAMES):
        spectrum = np.abs(np.fft.rfft(frames[at : at + FRAMES] * WINDOW, axis=1))[:, 2:]
        best = spectrum.argmax(axis=1)
        bins[at : at + FRAMES] = best + 2
        power[at : at + FRAMES] = spectrum[np.arange(len(best)), best]
    return bins, power


def landmarks(samples: bytes) -> tuple[int, np.ndarray]:
    """Number of peaks, and the time-coded pairs in order of time."""
    bins, power = strongest(samples)
    wall = np.concatenate([[-1], power, [-1]])
    peaks = np.flatnonzero((power > 0) & (power >= wall[:-2]) & (power >= wall[2:]))
    codes = []
    for step in range(1, FAN + 1):
        a, b = peaks[:-step], peaks[step:]
        near = b - a <= REACH
        a, b = a[near], b[near]
        codes.append(a << 20 | bins[a] << 13 | bins[b] << 6 | b - a)
    return len(peaks), np.sort(np.concatenate(codes)) if codes else np.empty(0, np.int64)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for each row: its text as WAV. A null text counts as empty and gives one block.

    Repeated rows come as often as they came, equal texts give equal media, other columns are ignored, an empty table gives
    an empty table. A very long text is stored whole, in memory of its task.
    """

    def run(batches):
        for batch in batches:
            raw = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            media = pa.array([to_wav(payload_of(x)) for x in raw], pa.binary())
            sizes = pa.array(list(map(len, raw)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, media], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


FEATURES = (
    "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, "
    "feature string, landmarks array<bigint>"
)


def features(media: DataFrame) -> DataFrame:
    """Reads ``media`` back and adds digests of it and of its samples, the landmarks and a digest of these.

    ``feature`` is the number of peaks, of pairs, and the pairs' 128-bit hash. A null medium gives nulls, an empty table an
    empty table; a very long medium is read whole.
    """

    def row(data: bytes | None):
        if data is None:
            return (None,) * 7
        payload = from_wav(data)
        peaks, codes = landmarks(payload)
        feature = f"{peaks}:{len(codes)}:{xxhash.xxh3_128_hexdigest(codes.astype('<i8').tobytes())}"
        digests = len(payload), sha256(payload).hexdigest(), crc32(payload[-16:]), len(data), sha256(data).hexdigest()
        return *digests, feature, codes

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]

    def run(batches):
        for batch in batches:
            rows = [row(x.as_py()) for x in batch.column("media")]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            kept = [n for n in batch.schema.names if n != "media"]
            names = kept + [x.split()[0] for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + made, names)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != "media"]
    return media.mapInArrow(run, ", ".join([*kept, FEATURES]))

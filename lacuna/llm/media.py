"""Media columns: text bytes kept as 8-bit audio, and features computed from the stored audio."""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576  #: payloads are a positive multiple of this
RATE, UP, DOWN, TAPS = 8000, 3, 4, 16
FRAME, HOP, MELS, BINS = 256, 144, 16, 4
HIGH_DB, LOW_DB = 1.0, 0.25

_MEDIA = "doc_id long, n_bytes long, media binary"
_FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, n_frames long, segments binary, feature string"
)


def store(data: bytes) -> bytes:
    """The bytes, padded with 255, as the samples of an 8-bit mono WAV file."""
    n = max(1, -(-len(data) // UNIT)) * UNIT
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + (n & 1), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)
    return head + data + b"\xff" * (n - len(data)) + b"\0" * (n & 1)


def load(media: bytes) -> bytes:
    """The samples of a stored file."""
    with wave.open(io.BytesIO(media)) as f:
        if (f.getnchannels(), f.getsampwidth(), f.getframerate()) != (1, 1, RATE):
            raise ValueError("not an 8-bit mono file of the stored rate")
        return f.readframes(f.getnframes())


@lru_cache
def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low-pass taps of each phase, mel weights, and the window."""
    t = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(len(t))
    phases = np.stack([h[r::UP] / h[r::UP].sum() for r in range(UP)])
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(40), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    low, mid, high = points[:-2, None], points[1:-1, None], points[2:, None]
    weights = np.clip(np.minimum((f - low) / (mid - low), (high - f) / (high - mid)), 0, None)
    return phases[:, ::-1].copy(), weights.T.copy(), np.hanning(FRAME)


def resample(x: np.ndarray) -> np.ndarray:
    """By UP / DOWN: each output sample is one phase of the low-pass filter at its place in the input."""
    phases, _, _ = _filters()
    n = len(x) * UP // DOWN
    padded = np.concatenate((np.zeros(TAPS - 1), x, np.zeros(DOWN)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n)
    for r in range(UP):
        k = len(range(r, n, UP))
        out[r::UP] = rows[r * DOWN // UP :: DOWN][:k] @ phases[r]
    return out


def log_mel(x: np.ndarray) -> np.ndarray:
    """Overlapped frames by mel bands, in dB rounded to hundredths."""
    _, weights, window = _filters()
    x = np.concatenate((x, np.zeros(max(0, FRAME - len(x)))))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * window
    return np.round(10 * np.log10((np.abs(np.fft.rfft(frames)) ** 2) @ weights + 1e-8), 2)


def segments(energy: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> list[tuple[int, int]]:
    """Hysteresis: runs of frames that stay above the median by `low` and reach `high` somewhere."""
    over = energy - np.median(energy)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (over >= low).view(np.int8), [0]))))
    strong = np.concatenate(([0], np.cumsum(over >= high)))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if strong[b] > strong[a]]


def features(payload: bytes) -> tuple[int, list[tuple[float, float, np.ndarray]]]:
    """Number of frames; per segment its span in seconds and a BINS x MELS tensor of pooled log-mel frames."""
    mel = log_mel(resample((np.frombuffer(payload, np.uint8).astype(float) - 128) / 128))
    rate, found = RATE * UP / DOWN, []
    sums = np.concatenate((np.zeros((1, MELS)), np.cumsum(mel, axis=0)))
    for a, b in segments(mel.mean(axis=1)):
        cuts = a + (np.arange(BINS + 1) * (b - a)) // BINS
        lo, hi = cuts[:-1], np.maximum(cuts[1:], cuts[:-1] + 1)
        pooled = np.round((sums[hi] - sums[lo]) / (hi - lo)[:, None], 2).astype(np.float32)
        found.append((round(a * HOP / rate, 4), round(((b - 1) * HOP + FRAME) / rate, 4), pooled))
    return len(mel), found


def tensor_array(values: list[np.ndarray]) -> pa.ExtensionArray:
    """Segment tensors as an Arrow array of fixed shape."""
    kind = pa.fixed_shape_tensor(pa.float32(), (BINS, MELS), dim_names=("time", "mel"))
    flat = np.concatenate([np.ravel(v) for v in values]) if values else np.zeros(0, np.float32)
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float32()), BINS * MELS))


def store_segments(found: list[tuple[float, float, np.ndarray]]) -> bytes:
    """Spans and tensors of the segments of a file, as an Arrow stream."""
    columns = [pa.array([x[k] for x in found], pa.float64()) for k in (0, 1)]
    batch = pa.record_batch([*columns, tensor_array([x[2] for x in found])], ["start_s", "end_s", "tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as f:
        f.write_batch(batch)
    return sink.getvalue().to_pybytes()


def load_segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and tensors (segments x BINS x MELS) of a stored stream."""
    table = pa.ipc.open_stream(data).read_all()
    tensors = table["tensor"].combine_chunks() if table.num_rows else tensor_array([])
    tensors = tensors.chunk(0) if isinstance(tensors, pa.ChunkedArray) else tensors
    flat = tensors.to_numpy_ndarray() if len(tensors) else np.zeros((0, BINS, MELS), np.float32)
    return table["start_s"].to_numpy(), table["end_s"].to_numpy(), flat


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One stored file per row: doc_id, n_bytes, media.

    A null or empty text is one unit of padding. Null ids and repeated rows are kept as they are; other columns are
    left out, whatever their names. An empty table gives an empty table.
    """

    def run(batches):
        for b in batches:
            data = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, data), pa.int64()), pa.array(map(store, data), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("data")).mapInArrow(run, _MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    """Features of the files of `to_media`, from their stored bytes alone. Equal files give equal features.

    segments is an Arrow stream of spans (start_s, end_s) and fixed-shape tensors; feature sums up what is read back from it.
    """

    def row(n: int, m: bytes) -> tuple:
        payload = load(m)
        frames, found = features(payload)
        segs = store_segments(found)
        starts, ends, tensors = load_segments(segs)
        spans = ",".join(f"{a:.4f}-{b:.4f}" for a, b in zip(starts, ends, strict=True))
        crc = zlib.crc32(tensors.tobytes())
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), frames, segs, f"frames={frames};segments={len(starts)};tensors={crc:08x};spans={spans}"

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    kinds += [pa.binary(), pa.string()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "segments", "feature"]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                rows = [row(n.as_py(), m.as_py()) for n, m in zip(b.column(1), b.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return media.mapInArrow(run, _FEATURES)


def op4_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media_features(to_media(docs))

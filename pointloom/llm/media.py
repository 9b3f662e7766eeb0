"""Media columns: audio containers, resampling, log-mel features, segments, Arrow tensors."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import pieces
from .common import as_bytes

#: Samples a block: the features of a long recording are computed block by block.
BLOCK = 1 << 17


def store_wav(payload: bytes, rate: int) -> bytes:
    """A mono WAV file of unsigned 8-bit samples; the payload is its sample data."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1), file.setsampwidth(1), file.setframerate(rate)
        file.writeframes(payload)
    return out.getvalue()


def load_wav(data: bytes) -> tuple[int, bytes]:
    with wave.open(io.BytesIO(data), "rb") as file:
        return file.getframerate(), file.readframes(file.getnframes())


def low_pass(up: int, down: int, half: int = 8) -> np.ndarray:
    """A windowed-sinc filter for the change of rate up/down; its gain is up."""
    cut = 1 / max(up, down)
    n = np.arange(-half * max(up, down), half * max(up, down) + 1)
    return np.sinc(n * cut) * cut * up * np.kaiser(len(n), 6.0)


class Polyphase:
    """Resampling by up/down: each output sample uses the one phase of the filter that meets input samples."""

    def __init__(self, rate: int, to: int):
        common = gcd(rate, to)
        self.up, self.down = to // common, rate // common
        taps = low_pass(self.up, self.down)
        self.centre = len(taps) // 2
        self.width = -(-len(taps) // self.up)
        padded = np.zeros(self.width * self.up)
        padded[: len(taps)] = taps
        self.phases = padded.reshape(self.width, self.up).T[:, ::-1].copy().astype(np.float32)  # one row a phase

    def count(self, n: int) -> int:
        """Output samples for n input samples."""
        return -(-n * self.up // self.down)

    def __call__(self, x: np.ndarray, first: int = 0, end: int | None = None) -> np.ndarray:
        """Output samples first to end of the whole input x (8-bit, 128 is silence); only what they need of x is read."""
        end = self.count(len(x)) if end is None else end
        at = np.arange(first, end) * self.down + self.centre
        newest, phase = at // self.up, at % self.up
        if not len(at):
            return np.zeros(0, np.float32)
        base, stop = int(newest[0]) - self.width + 1, int(newest[-1]) + 1
        lo, hi = min(max(base, 0), len(x)), min(stop, len(x))
        source = np.zeros(stop - base, np.float32)
        source[lo - base : lo - base + max(hi - lo, 0)] = (x[lo:hi].astype(np.float32) - 128) / 128
        views = np.lib.stride_tricks.sliding_window_view(source, self.width)
        oldest = newest - self.width + 1 - base
        out = np.empty(len(at), np.float32)
        for p in np.unique(phase):
            rows = phase == p
            out[rows] = views[oldest[rows]] @ self.phases[p]
        return out


def mel_filters(bins: int, rate: int, mels: int) -> np.ndarray:
    """Triangles, evenly spaced on the mel scale, over the bins of a real spectrum."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hertz = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    at = np.linspace(0, rate / 2, bins)
    rise = (at[None] - hertz[:-2, None]) / np.maximum(hertz[1:-1, None] - hertz[:-2, None], 1e-9)
    fall = (hertz[2:, None] - at[None]) / np.maximum(hertz[2:, None] - hertz[1:-1, None], 1e-9)
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def hysteresis(energy: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Runs of frames at or above low that hold a frame at or above high: (first, end)."""
    edge = np.diff(np.concatenate(([0], (energy >= low).astype(np.int8), [0])))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    strong = np.concatenate(([0], np.cumsum(energy >= high)))
    return [(int(a), int(b)) for a, b in zip(first, end) if strong[b] > strong[a]]


class AudioFeatures:
    """Resample, cut into overlapped frames, log-mel, segments; all parameters are fixed by the caller."""

    def __init__(self, rate=16000, to=8000, frame=256, hop=128, mels=16, tensor_frames=64, high_db=-6.0, low_db=-12.0):
        self.rate, self.to, self.frame, self.hop, self.mels, self.tensor_frames = rate, to, frame, hop, mels, tensor_frames
        self.high_db, self.low_db = high_db, low_db
        self.resample = Polyphase(rate, to)
        self.window = np.hanning(frame).astype(np.float32)
        self.filters = mel_filters(frame // 2 + 1, to, mels)

    def log_mel(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Frames x mels in dB, and the energy of each frame in dB. Blocks bound the scratch space."""
        total = self.resample.count(len(samples))
        wave_ = np.concatenate([self.resample(samples, i, min(i + BLOCK, total)) for i in range(0, total, BLOCK)])
        short = max(0, self.frame - len(wave_))
        if short:
            wave_ = np.pad(wave_, (0, short))
        tail = -(len(wave_) - self.frame) % self.hop
        frames = np.lib.stride_tricks.sliding_window_view(np.pad(wave_, (0, tail)), self.frame)[:: self.hop]
        mel, energy = [], []
        for i in range(0, len(frames), 1024):
            power = np.abs(np.fft.rfft(frames[i : i + 1024] * self.window, axis=1).astype(np.complex64)) ** 2
            mel.append(10 * np.log10(power @ self.filters.T + 1e-6))
            energy.append(10 * np.log10(power.mean(axis=1) + 1e-6))
        return np.concatenate(mel).astype(np.float32), np.concatenate(energy).astype(np.float32)

    def tensors(self, mel: np.ndarray) -> pa.Array:
        """Fixed-shape Arrow tensors of tensor_frames x mels; the last one is padded with its lowest value."""
        short = -len(mel) % self.tensor_frames
        if short:
            mel = np.pad(mel, ((0, short), (0, 0)), constant_values=float(mel.min()))
        return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(mel.reshape(-1, self.tensor_frames, self.mels)))

    def spans(self, energy: np.ndarray) -> list[tuple[float, float]]:
        """Time spans in seconds of the segments whose energy stands out of the recording's mean."""
        mean = float(energy.mean())
        spread = max(float(energy.std()), 1e-3)
        found = hysteresis((energy - mean) / spread * 6, self.high_db + 12, self.low_db + 12)
        return [(a * self.hop / self.to, ((b - 1) * self.hop + self.frame) / self.to) for a, b in found]

    def ipc(self, mel: np.ndarray) -> bytes:
        """The tensors, the time span of each and how many of its frames are no padding, as one Arrow stream."""
        rows = self.tensors(mel)
        step = self.tensor_frames * self.hop / self.to
        start = np.arange(len(rows)) * step
        end = np.minimum(start + step, ((len(mel) - 1) * self.hop + self.frame) / self.to)
        frames = np.minimum(len(mel) - np.arange(len(rows)) * self.tensor_frames, self.tensor_frames)
        batch = pa.RecordBatch.from_arrays([rows, pa.array(start), pa.array(end), pa.array(frames)], ["tensor", "start_s", "end_s", "frames"])
        out = io.BytesIO()
        with pa.ipc.new_stream(out, batch.schema) as stream:
            stream.write_batch(batch)
        return out.getvalue()


def read_tensors(data: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The log-mel frames of an Arrow stream of ipc, without padding, and the time span of each tensor."""
    with pa.ipc.open_stream(data) as stream:
        batch = stream.read_next_batch()
    tensors = batch.column(0).to_numpy_ndarray()
    frames = batch.column(3).to_numpy()
    return tensors.reshape(-1, tensors.shape[-1])[: int(frames.sum())], list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))


def pad_payload(data: bytes, unit: int) -> bytes:
    """data, then bytes 255 up to a positive multiple of unit."""
    return data + b"\xff" * (unit - len(data) % unit if len(data) % unit or not data else 0)


def feature_text(audio: AudioFeatures, tensors: bytes, spans: list[tuple[float, float]]) -> str:
    """A summary of stored tensors and of the segments: counts, seconds, mean and deviation of each mel band."""
    mel, times = read_tensors(tensors)
    bands = np.round(np.stack((mel.mean(axis=0, dtype=np.float64), mel.std(axis=0, dtype=np.float64)), axis=1), 2).ravel()
    head = f"frames={len(mel)};mels={audio.mels};tensors={len(times)};end_s={times[-1][1]:.3f};segments={len(spans)};voiced_s={sum(b - a for a, b in spans):.3f};"
    return head + "mel=" + ",".join(f"{x:.2f}" for x in bands)


_SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def audio_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 576, **settings) -> DataFrame:
    """Store every whole text as 8-bit audio, read it back and compute features from what was read.

    A row per input row: the id, n_bytes (of the text), media (the WAV file), payload_bytes,
    payload_sha256 and tail_crc32 (of the samples read back from it), tensors (an Arrow
    stream of fixed-shape log-mel tensors with their time spans), spans (the segments in
    seconds) and feature (feature_text of the tensors read back). Null text is the empty
    text, whose payload is one unit of 255. Null ids and repeated rows pass through; equal
    texts give equal values. Other columns are ignored. No shuffle; a worker holds a slice
    of a batch, and a long recording is resampled and transformed block by block.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "tensors", "spans", "feature"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.binary(), _SPANS, pa.string()]
    schema = f"`{id_col}` {kind}, n_bytes bigint, media binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, tensors binary, spans array<struct<start_s double, end_s double>>, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audio = AudioFeatures(**settings)
        for batch in batches:
            raw = as_bytes(batch.column(1))
            for part in pieces(raw):
                rows = []
                for text in raw[part]:
                    media = store_wav(pad_payload(text, unit), audio.rate)
                    payload = load_wav(media)[1]
                    mel, energy = audio.log_mel(np.frombuffer(payload, np.uint8))
                    tensors, spans = audio.ipc(mel), audio.spans(energy)
                    rows.append((len(text), media, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), tensors, [{"start_s": a, "end_s": b} for a, b in spans], feature_text(audio, tensors, spans)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [id_col, *names])

    return docs.select(id_col, docs[text_col].cast("string").alias("text_")).mapInArrow(run, schema)


def audio_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Digests of audio_columns: the stored forms as sizes and sha256, the segments and the feature."""
    return audio_columns(docs, id_col, text_col, **settings).select(
        id_col,
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.length("tensors").cast("long").alias("tensor_bytes"),
        F.sha2("tensors", 256).alias("tensors_sha256"),
        "spans",
    )

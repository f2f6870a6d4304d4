"""Media columns, audio: texts' bytes as 8-bit PCM, resampled, turned into log-mel frames and cut into active spans.

A payload is stored as a RIFF/WAVE clip of one channel of unsigned 8-bit samples, so the bytes are kept exactly. Tasks write the
clips to compressed Arrow files in the shared folder, and read them again; features are computed from what was read:
  * polyphase resampling by 1/2 with a windowed-sinc low-pass filter: only the kept phases of the filter are computed;
  * overlapped frames of 256 samples every 128, Hann window, power spectrum, 16 triangular mel bands, log;
  * hysteresis energy segmentation: a span opens above the high threshold and lasts while the energy stays above the low one.
Frames are stored in groups of FRAMES x MELS as a fixed-shape Arrow tensor column, each with its time span in milliseconds, in
files beside the clips; the rows' frames, spans and digests are those read from these. A file holds at most CLIPS clips, and is
written under a name of its attempt and then renamed, so a repeated task replaces its own files.

Defined results: null is the empty text, and its payload is 64 zero bytes; a clip shorter than a frame is padded with silence
to one frame; equal texts give equal rows, whatever stands beside them, as each clip is computed on its own; repeated rows keep
their multiplicity; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import work_dir

RATE, UP, DOWN, TAPS = 8000, 1, 2, 32
FRAME, HOP, MELS, FRAMES = 256, 128, 16, 64
HIGH, LOW = 3.0, 1.0  # decibels above the clip's median frame energy
ALIGN = 64
CLIPS, CHUNK = 2048, 16 << 20  # clips and bytes of a file, by which a task's memory is bounded too
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * (max(ALIGN, -(-len(raw) // ALIGN) * ALIGN) - len(raw))


def write_clip(samples: bytes, rate: int = RATE) -> bytes:
    """A WAVE file: one channel, 8 bits unsigned."""
    n = len(samples)
    return _HEADER.pack(b"RIFF", 36 + n + (n & 1), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + samples + b"\0" * (n & 1)


def read_clip(clip: bytes) -> tuple[int, bytes]:
    """Rate and samples of a WAVE file as written above; the chunks are walked, and other forms are refused."""
    if clip[:4] != b"RIFF" or clip[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(clip):
        name, size = struct.unpack_from("<4sI", clip, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", clip, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only one channel of 8-bit PCM is supported")
        elif name == b"data":
            return rate, clip[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@cache
def _lowpass() -> np.ndarray:
    """Kaiser-windowed sinc at the lower of the two Nyquist rates, of unit gain."""
    n = TAPS * max(UP, DOWN) // 2 * 2 + 1
    t = np.arange(n) - n // 2
    h = np.sinc(t / max(UP, DOWN)) * np.kaiser(n, 6.0)
    return (h / h.sum() * UP).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase decimation by DOWN: each branch filters every DOWN-th sample with every DOWN-th tap, and the branches add up."""
    h, n = _lowpass(), -(-len(x) // DOWN)
    half = len(h) // 2
    padded = np.zeros(n * DOWN + 2 * half + DOWN, np.float32)
    padded[half : half + len(x)] = x
    out = np.zeros(n, np.float32)
    for p in range(DOWN):
        taps = h[p::DOWN]
        out += np.convolve(padded[p::DOWN][: n + len(taps) - 1], taps[::-1], "valid")[:n]
    return out


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, FRAME // 2 + 1)
    low, mid, high = (points[i : i + MELS, None] for i in range(3))
    bank = np.clip(np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid)), 0, None)
    return np.hanning(FRAME + 1)[:-1].astype(np.float32), bank.T.astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """frames x MELS, natural logarithm of the band powers; in blocks of frames, so that memory is bounded."""
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    window, bank = _tables()
    views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((len(views), MELS), np.float32)
    for i in range(0, len(views), 4096):
        power = np.abs(np.fft.rfft(views[i : i + 4096] * window, axis=1).astype(np.complex64)) ** 2
        out[i : i + 4096] = np.log(power @ bank + np.float32(1e-6))
    return out


def segments(energy_db: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans [from, to) that rise above median + HIGH and last while above median + LOW."""
    base = np.median(energy_db)
    alive = np.concatenate(([False], energy_db > base + LOW, [False]))
    edges = np.flatnonzero(alive[1:] != alive[:-1]).reshape(-1, 2)
    loud = np.concatenate(([0], np.cumsum(energy_db > base + HIGH)))
    return [(int(a), int(b)) for a, b in edges if loud[b] > loud[a]]


def clip_features(clip: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """log-mel frames and active spans in milliseconds."""
    _, samples = read_clip(clip)
    x = resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128)
    mel = log_mel(x)
    energy = 10 / np.log(10) * np.log(np.exp(mel).sum(axis=1))
    ms = 1000 * HOP * DOWN / (RATE * UP)
    return mel, [(round(a * ms), round((b - 1) * ms + 1000 * FRAME * DOWN / (RATE * UP))) for a, b in segments(energy)]


def tensor_column(mel: list[np.ndarray]) -> pa.Array:
    """Frame groups of FRAMES x MELS, the last one padded with the log of silence, as fixed-shape tensors."""
    floor = np.log(np.float32(1e-6))
    groups = [np.concatenate((m, np.full((-len(m) % FRAMES, MELS), floor, np.float32))).reshape(-1, FRAMES, MELS) for m in mel]
    flat = np.concatenate(groups) if groups else np.empty((0, FRAMES, MELS), np.float32)
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
    storage = pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), FRAMES * MELS)
    return pa.ExtensionArray.from_storage(kind, storage)


def _stored(folder: str, name: str, attempt: str, write) -> pa.Table:
    """Lets `write` fill a file of the shared folder, and reads it from there."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/_{name}.{attempt}") as sink:
        write(sink)
    files.move(f"{path}/_{name}.{attempt}", f"{path}/{name}")
    with files.open_input_file(f"{path}/{name}") as source:
        return pa.ipc.open_file(source).read_all()


def write_clips(clips: list[bytes], sink) -> None:
    """An Arrow IPC file of clips."""
    table = pa.table({"media": pa.array(clips, pa.binary())})
    with pa.ipc.new_file(sink, table.schema, options=_ZSTD) as out:
        out.write_table(table)


def read_tensors(table: pa.Table, n: int) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """Frames and active spans of n clips, from the frame groups of write_tensors()."""
    clip, end = table.column("clip").to_numpy(), table.column("to_ms").to_numpy()
    flat = table.column("mel").combine_chunks().storage.flatten().to_numpy().reshape(-1, MELS)
    first, out = np.searchsorted(clip, np.arange(n + 1)), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        frames = (int(end[b - 1]) - FRAME * DOWN * 1000 // (RATE * UP)) // (HOP * DOWN * 1000 // (RATE * UP)) + 1
        active = table.column("active")[a].as_py()
        out.append((flat[a * FRAMES : a * FRAMES + frames], [(s["from_ms"], s["to_ms"]) for s in active]))
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    """doc_ids and texts of up to CLIPS rows and some CHUNK bytes."""
    docs, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            docs.append(doc)
            texts.append(text)
            size += len(text or "") + ALIGN
            if len(docs) == CLIPS or size >= CHUNK:
                yield docs, texts
                docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def audio_features(docs: DataFrame, keep: bool = True, folder: str | None = None) -> DataFrame:
    """A row a document: n_bytes, media (the clip), mel (frames x MELS, row-major), n_frames, spans, and digests of what was read back.

    Files of clips and of frame groups stay below `folder`. Without `keep` the two large columns, media and mel, stay out of the result."""
    folder = folder or work_dir(docs.sparkSession, "audio")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        for chunk, (ids, texts) in enumerate(_chunks(batches)):
            name, attempt = f"{context.partitionId():06d}-{chunk:06d}.arrow", f"{context.taskAttemptId()}"
            clips = [write_clip(payload(t)) for t in texts]
            stored = _stored(folder, f"clips-{name}", attempt, lambda sink: write_clips(clips, sink)).column("media")  # noqa: B023
            mels, active = zip(*(clip_features(c.as_py()) for c in stored), strict=True)
            tensors = _stored(folder, f"tensors-{name}", attempt, lambda sink: write_tensors(list(mels), list(active), sink))  # noqa: B023
            rows = []
            for doc, text, clip, (mel, spans) in zip(ids, texts, stored, read_tensors(tensors, len(ids)), strict=True):
                clip = clip.as_py()
                back = read_clip(clip)[1]
                h = hashlib.sha256(np.rint(mel * 100).astype("<i4").tobytes())
                h.update(repr(spans).encode())
                row = {"doc_id": doc, "n_bytes": len((text or "").encode()), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-ALIGN:]), "media_bytes": len(clip), "media_sha256": hashlib.sha256(clip).hexdigest()}
                mean = ",".join(f"{v:.2f}" for v in mel.mean(axis=0, dtype=np.float64))
                row |= {"feature": f"{len(mel)}x{MELS}:{len(spans)}:{mean}:{h.hexdigest()[:16]}", "n_frames": len(mel), "n_spans": len(spans)}
                row |= {"spans": [{"from_ms": a, "to_ms": b} for a, b in spans]}
                if keep:
                    row |= {"media": clip, "mel": mel.reshape(-1)}
                rows.append(row)
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    plain = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_spans long, spans array<struct<from_ms:long,to_ms:long>>"
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("from_ms", pa.int64()), ("to_ms", pa.int64())])))]
    fields += [("media", pa.binary()), ("mel", pa.list_(pa.float32()))] * keep
    arrow = pa.schema(fields)
    return docs.select("doc_id", "text").mapInArrow(task, plain + ", media binary, mel array<float>" * keep)


def write_tensors(mel: list[np.ndarray], spans: list[list[tuple[int, int]]], sink) -> None:
    """An Arrow IPC file of frame groups: the clip's number, the group's time span and its fixed-shape tensor."""
    tensors = tensor_column(mel)
    ms = HOP * DOWN * 1000 // (RATE * UP)
    clip, begin, end = [], [], []
    for i, m in enumerate(mel):
        for g in range(0, len(m), FRAMES):
            clip.append(i)
            begin.append(g * ms)
            end.append((min(g + FRAMES, len(m)) - 1) * ms + FRAME * DOWN * 1000 // (RATE * UP))
    active = [[{"from_ms": a, "to_ms": b} for a, b in s] for s in spans]
    table = pa.table({"clip": pa.array(clip, pa.int64()), "from_ms": pa.array(begin, pa.int64()), "to_ms": pa.array(end, pa.int64()), "mel": tensors, "active": pa.array([active[i] for i in clip], pa.list_(pa.struct([("from_ms", pa.int64()), ("to_ms", pa.int64())])))})
    with pa.ipc.new_file(sink, table.schema, options=_ZSTD) as out:
        out.write_table(table)

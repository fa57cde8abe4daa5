"""Lengths of media files from their headers, and WAV audio as samples."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# MPEG audio tables by version (3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5).
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
KBPS_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBPS_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATE = 16_000


def _wav_chunks(raw: bytes):
    """(name, begin, declared size) of each chunk; chunks begin at even places."""
    at = 12
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        yield name, at + 8, size
        at += 8 + size + (size & 1)


def _is_wav(raw: bytes) -> bool:
    return raw[:4] in (b"RIFF", b"RF64") and raw[8:12] == b"WAVE"


def probe_wav(raw: bytes):
    if not _is_wav(raw):
        return None
    byte_rate = rate = channels = bits = data = 0
    long_size = None
    for name, at, size in _wav_chunks(raw):
        if name == b"ds64" and at + 16 <= len(raw):
            long_size = struct.unpack("<Q", raw[at + 8 : at + 16])[0]
        elif name == b"fmt " and at + 16 <= len(raw):
            _, channels, rate, byte_rate, _, bits = struct.unpack("<HHIIHH", raw[at : at + 16])
        elif name == b"data":
            data = size if size != 0xFFFFFFFF else long_size if long_size is not None else len(raw) - at
            break
    per_second = byte_rate or rate * channels * bits // 8
    return (data / per_second, True) if rate and per_second else (0.0, False)


def probe_flac(raw: bytes):
    if raw[:4] != b"fLaC" or len(raw) < 26:
        return None
    packed = int.from_bytes(raw[18:26], "big")
    rate, samples = packed >> 44, packed & ((1 << 36) - 1)
    return (samples / rate, True) if rate else (0.0, False)


def probe_ogg(raw: bytes):
    if raw[:4] != b"OggS":
        return None
    head, tail = raw[: 8 << 10], raw[-(64 << 10) :]
    granule, at = 0, tail.find(b"OggS")
    while at >= 0:
        if at + 14 <= len(tail):
            g = struct.unpack("<q", tail[at + 6 : at + 14])[0]
            granule = max(granule, g)
        at = tail.find(b"OggS", at + 4)
    at = head.find(b"OpusHead")
    if at >= 0 and at + 12 <= len(head):
        skip = struct.unpack("<H", head[at + 10 : at + 12])[0]
        return max(0, granule - skip) / 48_000, True
    at = head.find(b"\x01vorbis")
    if at >= 0 and at + 16 <= len(head):
        rate = struct.unpack("<I", head[at + 12 : at + 16])[0]
        return (granule / rate, True) if rate else (0.0, True)
    return 0.0, False


def _vint(raw: bytes, at: int, keep_marker: bool):
    """(value, bytes) of an EBML number; value None for an unknown size."""
    if at >= len(raw) or not raw[at]:
        return None, 0
    n = 9 - raw[at].bit_length()
    if at + n > len(raw):
        return None, 0
    value = int.from_bytes(raw[at : at + n], "big")
    if not keep_marker:
        value &= (1 << 7 * n) - 1
        if value == (1 << 7 * n) - 1:
            return None, n
    return value, n


def probe_matroska(raw: bytes):
    if raw[:4] != b"\x1a\x45\xdf\xa3":
        return None
    raw = raw[: 256 << 10]
    # Element names of the format.
    segment, info, scale_id, duration_id, tracks, entry, kind, cluster = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE, 0x83, 0x1F43B675
    scale, duration, audio, at = 1_000_000, None, False, 0
    while at < len(raw):
        name, n = _vint(raw, at, True)
        size, m = _vint(raw, at + n, False) if n else (None, 0)
        if not n or not m:
            at += 1  # not an element: the next byte may begin one
            continue
        if name == cluster:
            break
        body = at + n + m
        if name in (segment, info, tracks, entry):
            at = body  # what stands inside comes next
            continue
        data = raw[body : body + (size or 0)]
        if name == scale_id:
            scale = int.from_bytes(data, "big") or scale
        elif name == duration_id and len(data) in (4, 8):
            duration = struct.unpack(">f" if len(data) == 4 else ">d", data)[0]
        elif name == kind and int.from_bytes(data, "big") == 2:
            audio = True
        if size is None:
            break
        at = body + size
    return (duration * scale / 1e9 if duration else 0.0), audio


def _boxes(raw: bytes, at: int, end: int):
    while at + 8 <= end:
        size, name = struct.unpack(">I4s", raw[at : at + 8])
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack(">Q", raw[at + 8 : at + 16])[0], 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        yield name, at + head, min(at + size, end)
        at += size


def _clock(raw: bytes, at: int, end: int) -> float:
    """Seconds of an mvhd or mdhd box."""
    long_ = raw[at : at + 1] == b"\x01"
    need = 32 if long_ else 20
    if at + need > end:
        return 0.0
    scale, n = struct.unpack(">IQ" if long_ else ">II", raw[at + (20 if long_ else 12) : at + need])
    return n / scale if scale else 0.0


def probe_mp4(raw: bytes):
    if raw[4:8] not in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip"):
        return None
    movie, audio = 0.0, []

    def walk(at: int, end: int, depth: int, track: dict | None) -> None:
        nonlocal movie
        for name, a, b in _boxes(raw, at, end):
            if name == b"trak" and depth < 12:
                own = {"sound": False, "seconds": 0.0}
                walk(a, b, depth + 1, own)
                if own["sound"]:
                    audio.append(own["seconds"])
            elif name in (b"moov", b"mdia") and depth < 12:
                walk(a, b, depth + 1, track)
            elif name == b"mvhd":
                movie = _clock(raw, a, b)
            elif name == b"mdhd" and track is not None:
                track["seconds"] = _clock(raw, a, b)
            elif name == b"hdlr" and track is not None:
                track["sound"] |= raw[a + 8 : a + 12] == b"soun"

    walk(0, len(raw), 0, None)
    return (max(audio) if audio and max(audio) > 0 else movie), bool(audio)


def probe_mpeg(raw: bytes):
    at = 0
    if raw[:3] == b"ID3" and len(raw) >= 10:
        at = 10 + ((raw[6] & 127) << 21 | (raw[7] & 127) << 14 | (raw[8] & 127) << 7 | raw[9] & 127)
    scan = raw[at : at + 8192]
    for i in range(max(0, len(scan) - 4)):
        if scan[i] != 0xFF or scan[i + 1] & 0xE0 != 0xE0:
            continue
        version, layer = scan[i + 1] >> 3 & 3, scan[i + 1] >> 1 & 3
        if layer == 0 and version >= 2:
            return 0.0, True  # AAC: no length in its frames
        rate_bits, kbps_bits = scan[i + 2] >> 2 & 3, scan[i + 2] >> 4
        if layer != 1 or version == 1 or kbps_bits in (0, 15) or rate_bits == 3:
            continue
        rate, mono = RATES[version][rate_bits], scan[i + 3] >> 6 == 3
        kbps = (KBPS_1 if version == 3 else KBPS_2)[kbps_bits]
        tag = i + 4 + ((17 if mono else 32) if version == 3 else (9 if mono else 17))
        if scan[tag : tag + 4] in (b"Xing", b"Info") and tag + 12 <= len(scan) and scan[tag + 7] & 1:
            frames = int.from_bytes(scan[tag + 8 : tag + 12], "big")
            return frames * (1152 if version == 3 else 576) / rate, True
        return (len(raw) - at - i) * 8 / (kbps * 1000), True
    return None


def probe(raw: bytes | None) -> tuple[float, bool]:
    """(seconds, rounded to tenths, and whether there is sound); (0, False) for what isn't known."""
    for f in (probe_wav, probe_flac, probe_ogg, probe_matroska, probe_mp4, probe_mpeg):
        found = f(raw or b"")
        if found is not None and (found[0] > 0 or f is not probe_mpeg):
            return float(np.floor(max(0.0, found[0]) * 10 + 0.5) / 10) if np.isfinite(found[0]) else 0.0, bool(found[1])
    return 0.0, False


def probe_files(files: DataFrame) -> DataFrame:
    """(path, content) to (path, duration_sec, has_audio)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [probe(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.bool_())], ["path", "duration_sec", "has_audio"])

    return files.select("path", "content").mapInArrow(run, "path string, duration_sec double, has_audio boolean")


def decode_wav(raw: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and their rate."""
    if not _is_wav(raw):
        raise ValueError("not a WAV file")
    kind = channels = rate = bits = 0
    data = b""
    for name, at, size in _wav_chunks(raw):
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[at : at + 16])
            if kind == 0xFFFE and size >= 26:  # the kind proper follows
                kind = struct.unpack("<H", raw[at + 24 : at + 26])[0]
        elif name == b"data":
            data = raw[at:] if size == 0xFFFFFFFF else raw[at : at + size]
            break
    if not channels or not rate:
        raise ValueError("no audio format in this WAV file")
    step = bits // 8 * channels
    data = data[: len(data) // step * step] if step else b""
    if kind == 3 and bits in (32, 64):
        x = np.frombuffer(data, f"<f{bits // 8}").astype(np.float32)
    elif kind == 1 and bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif kind == 1 and bits == 16:
        x = np.frombuffer(data, "<i2").astype(np.float32) / 32768
    elif kind == 1 and bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    elif kind == 1 and bits == 32:
        x = (np.frombuffer(data, "<i4").astype(np.float64) / (1 << 31)).astype(np.float32)
    else:
        raise ValueError(f"WAV encoding {kind} with {bits} bits isn't read")
    return x.reshape(-1, channels).mean(1, dtype=np.float32), rate


def resample(x: np.ndarray, source: int, to: int = RATE) -> np.ndarray:
    """Another rate: three taps from 48 to 16 kHz, a triangular window downwards, linear interpolation upwards."""
    x = np.asarray(x, np.float32)
    if not len(x) or not source or not to:
        return np.zeros(0, np.float32)
    if source == to:
        return x
    if (source, to) == (48_000, 16_000) and len(x) >= 3:
        t = x[: len(x) // 3 * 3].reshape(-1, 3)
        return (t @ np.array([0.25, 0.5, 0.25], np.float32)).astype(np.float32)
    ratio, last = source / to, len(x) - 1
    n = int(np.floor(len(x) / ratio + 0.5))
    i = np.arange(n)
    if ratio <= 1:
        place = i * ratio
        low = np.minimum(np.floor(place).astype(np.int64), last)
        part = (place - low).astype(np.float32)
        return x[low] * (1 - part) + x[np.minimum(low + 1, last)] * part
    half = max(0.5, 0.5 * ratio)
    center = (i + 0.5) * ratio - 0.5
    left = np.maximum(np.floor(center - half), 0).astype(np.int64)
    right = np.minimum(np.ceil(center + half), last).astype(np.int64)
    total, weight = np.zeros(n, np.float32), np.zeros(n, np.float32)
    for k in range(int((right - left).max()) + 1 if n else 0):
        j = left + k
        w = np.where(j <= right, np.maximum(1 - np.abs(j - center) / half, 0.05), 0).astype(np.float32)
        total += x[np.minimum(j, last)] * w
        weight += w
    nearest = x[np.minimum(np.floor(center + 0.5).astype(np.int64).clip(0), last)]
    return np.where(left >= right, nearest, total / np.maximum(weight, 1e-12)).astype(np.float32)


def pad(x: np.ndarray, least: int = RATE) -> np.ndarray:
    return np.concatenate([x, np.zeros(least - len(x), np.float32)]) if 0 < len(x) < least else x


def encode_pcm16(x: np.ndarray, rate: int = RATE) -> bytes:
    """A mono WAV file; what isn't a number is silence."""
    v = np.clip(np.nan_to_num(np.asarray(x, np.float64), nan=0.0), -1, 1) * 32767
    body = (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(body)) + body


def decode_files(files: DataFrame) -> DataFrame:
    """(path, content) of WAV files to (path, samples, error): mono at 16 kHz, a second long at least."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                try:
                    x, rate = decode_wav(raw)
                    out.append((pad(resample(x, rate)).tolist(), None))
                except (ValueError, struct.error) as e:
                    out.append((None, f"decode_error: {e}"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.list_(pa.float32())), pa.array([x[1] for x in out], pa.string())], ["path", "samples", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, samples array<float>, error string")


def has_signal(samples):
    return F.exists(samples, lambda v: F.abs(v) > 0)

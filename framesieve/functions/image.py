"""Pixel kernels in NumPy, and the Arrow function that turns frames into a few numbers before anything is shuffled."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Limits of a usable frame (8-bit grey levels), and the size frames are hashed at.
BRIGHT, DARK, FLAT, BLURRED = 245.0, 8.0, 80.0, 50.0
HASH_WIDTH, HASH_HEIGHT = 256, 144


def grey(bgr: np.ndarray) -> np.ndarray:
    """Luma of an 8-bit BGR image, rounded to 8 bits."""
    weighted = bgr.astype(np.float64) @ np.array([0.114, 0.587, 0.299])
    return np.clip(np.rint(weighted), 0, 255).astype(np.uint8)


@lru_cache(maxsize=64)
def _shares(source: int, target: int) -> np.ndarray:
    """How much of each source pixel lies in each target pixel, as rows that sum to one."""
    edges = np.linspace(0, source, target + 1)
    left = np.maximum(edges[:-1, None], np.arange(source)[None, :])
    right = np.minimum(edges[1:, None], np.arange(1, source + 1)[None, :])
    overlap = np.clip(right - left, 0, None)
    return overlap / overlap.sum(axis=1, keepdims=True)


def shrink(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean of the covered area for each target pixel, in 8 bits."""
    rows, columns = _shares(image.shape[0], height), _shares(image.shape[1], width)
    out = np.einsum("yh,hw...,xw->yx...", rows, image.astype(np.float64), columns, optimize=True)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """A PNG of an 8-bit BGR or grey image, without filters."""
    height, width, channels = image.shape
    rows = image[:, :, ::-1] if channels == 3 else image
    raw = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(rows).reshape(height, -1)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def laplacian(image: np.ndarray) -> np.ndarray:
    p = np.pad(image.astype(np.float64), 1, mode="reflect") if min(image.shape) > 1 else np.pad(image.astype(np.float64), 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


@lru_cache(maxsize=4)
def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    basis = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    basis[0] /= np.sqrt(2)
    return basis


def perceptual_hash(image: np.ndarray) -> int:
    """64 bits, as a signed integer: the low 8 x 8 cosine coefficients of the 32 x 32 image against their median (the first left out of it)."""
    basis = _cosines(32)
    low = (basis @ shrink(image, 32, 32).astype(np.float64) @ basis.T)[:8, :8].ravel()
    bits = low > np.median(low[1:])
    return int(np.packbits(bits).view(">i8")[0])


def measure(data: bytes, height: int, width: int, channels: int) -> tuple[float, float, float, int]:
    """Mean, variance and Laplacian variance of the full grey frame, and the hash of the small one."""
    frame = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    full = grey(frame) if channels == 3 else frame[:, :, 0]
    small = shrink(frame, HASH_WIDTH, HASH_HEIGHT)
    return float(full.mean()), float(full.var()), float(laplacian(full).var()), perceptual_hash(grey(small) if channels == 3 else small[:, :, 0])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for height, width, channels, data in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
            try:
                rows.append(measure(data, height, width, channels))
            except (TypeError, ValueError):  # no data, or not of the stated size
                rows.append((None, None, None, None))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(columns, (pa.float64(), pa.float64(), pa.float64(), pa.int64()), strict=True))], names=["video_id", "frame_idx", "mean", "var", "lap_var", "hash"])


def measured_frames(frames: DataFrame) -> DataFrame:
    """(video_id, frame_idx, mean, var, lap_var, hash) of frames with (height, width, n_channels, data). Pixels stay in the scan's task; a frame that can't be read has nulls."""
    return frames.select("video_id", "frame_idx", "height", "width", "n_channels", "data").mapInArrow(_measure, "video_id string, frame_idx bigint, mean double, var double, lap_var double, hash bigint")

"""Arrays of numbers as compressed bytes."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(x: np.ndarray) -> bytes:
    """The array by planes of bytes, compressed: the high bytes of small numbers take no room."""
    return zstandard.compress(np.ascontiguousarray(x.view("u1").reshape(-1, x.dtype.itemsize).T).tobytes(), 1)


def unpack(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(data), "u1").reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_up(x: np.ndarray) -> bytes:
    """An ascending array of numbers, as its gaps."""
    return pack(np.diff(x.astype("<u8"), prepend=np.uint64(0)))


def unpack_up(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)

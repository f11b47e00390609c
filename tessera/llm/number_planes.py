"""Numbers on their way between tasks: differences or small values as byte planes, each compressed by itself."""

from __future__ import annotations

import numpy as np
import zstandard

#: From this many numbers on, each byte plane is compressed by itself.
PLANES_FROM = 512


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed; a first byte says whether together or each by itself."""
    packer = zstandard.ZstdCompressor(level=1)
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)
    if numbers.itemsize == 1 or len(numbers) < PLANES_FROM:
        return b"\0" + packer.compress(planes.tobytes())
    each = [packer.compress(p.tobytes()) for p in planes]
    return b"\1" + np.array([len(p) for p in each], "<u4").tobytes() + b"".join(each)


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    unpacker, size = zstandard.ZstdDecompressor(), np.dtype(kind).itemsize
    if raw[0] == 0:
        planes = np.frombuffer(unpacker.decompress(raw[1:]), np.uint8).reshape(size, -1)
    else:
        stops = 1 + 4 * size + np.cumsum(np.concatenate([[0], np.frombuffer(raw, "<u4", size, 1)]))
        planes = np.stack([np.frombuffer(unpacker.decompress(raw[a:b]), np.uint8) for a, b in zip(stops.tolist(), stops[1:].tolist())])
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys: their differences as byte planes, compressed."""
    return _pack(np.diff(keys.astype("<u8"), prepend=np.zeros(1, "<u8")))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, "<u8"), dtype=np.uint64)


def pack_small(values: np.ndarray, kind: str) -> bytes:
    """Small numbers as byte planes, compressed; ``kind`` is their numpy type."""
    return _pack(values.astype(kind))


def unpack_small(raw: bytes, kind: str) -> np.ndarray:
    return _unpack(raw, kind)

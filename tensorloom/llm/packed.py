"""Arrays of numbers as compressed bytes, for rows that carry a whole block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ZSTD, _TEXT = pa.Codec("zstd", compression_level=1), pa.Codec("zstd", compression_level=3)


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Bytes of the same place together, then zstd; of rising values the steps.  The type and the length stand in front."""
    if rising and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()
    return f"{values.dtype.str}{len(values)}".encode().ljust(16) + (_ZSTD.compress(planes, asbytes=True) if planes else b"")


def unpack(data: bytes, rising: bool = False) -> np.ndarray:
    head = data[:16].decode().strip()
    kind, n = np.dtype(head[:3]), int(head[3:])
    if not n:
        return np.zeros(0, kind)
    planes = _ZSTD.decompress(data[16:], decompressed_size=n * kind.itemsize, asbytes=True)
    values = np.zeros((n, kind.itemsize), np.uint8)
    for place, plane in enumerate(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n)):
        if plane.any():  # of small numbers most are empty
            values[:, place] = plane
    values = values.view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def pack_words(words: pa.Array) -> bytes:
    """Words have no space, so spaces part them; as text they take half the bytes of their keys."""
    # A space after each, so their bytes on end are the text.
    spaced = pc.binary_join_element_wise(words.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    size = pc.sum(pc.binary_length(spaced)).as_py() or 0
    joined = spaced.buffers()[2][: size - 1].to_pybytes() if size else b""
    return len(joined).to_bytes(8, "little") + (_TEXT.compress(joined, asbytes=True) if joined else b"")


def unpack_words(data: bytes) -> list[str]:
    size = int.from_bytes(data[:8], "little")
    return _TEXT.decompress(data[8:], decompressed_size=size, asbytes=True).decode().split(" ") if size else []

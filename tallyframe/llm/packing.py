"""Numpy arrays as compressed bytes: what is shuffled in bulk."""

from __future__ import annotations

import numpy as np


def pack(*arrays: np.ndarray) -> bytes:
    """Each array as planes of its bytes, which compress better than its values."""
    import zstandard

    c, out = zstandard.ZstdCompressor(level=1), []
    for a in arrays:
        kind = a.dtype.str.encode().ljust(4)
        body = c.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
        out += [kind, len(a).to_bytes(4, "little"), len(body).to_bytes(4, "little"), body]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    d, out, at = zstandard.ZstdDecompressor(), [], 0
    while at < len(blob):
        kind, n, size = np.dtype(blob[at : at + 4].decode().strip()), int.from_bytes(blob[at + 4 : at + 8], "little"), int.from_bytes(blob[at + 8 : at + 12], "little")
        at += 12
        raw = d.decompress(blob[at : at + size]) if n else b""
        out.append(np.frombuffer(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).tobytes(), kind) if n else np.zeros(0, kind))
        at += size
    return out

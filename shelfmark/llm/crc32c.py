"""CRC-32C (Castagnoli) of many byte strings at once, with numpy.

The register's step is linear over GF(2): strings are cut into chunks of 64 bytes, padded with
zeros in front (which leave a zero register as it is), all chunks advance together by table
look-ups, and each chunk's register is moved on by the zeros that follow it, then xor-ed.
"""

from __future__ import annotations

import numpy as np

_CHUNK, _LOG = 64, 6


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


_T = [_byte_table()]
for _ in range(3):
    _T.append((_T[-1] >> 8) ^ _T[0][_T[-1] & 255])


def _apply(tables: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _shifts(n: int) -> list[list[np.ndarray]]:
    """Tables of the maps that move a register on by 1, 2, 4, ... zero bytes."""
    b = np.arange(256, dtype=np.uint32)
    step = [(x >> 8) ^ _T[0][x & 255] for x in (b, b << 8, b << 16, b << 24)]
    out = [step]
    for _ in range(n - 1):
        out.append([_apply(out[-1], t) for t in out[-1]])
    return out


_SHIFT = _shifts(40)


def _moved(x: np.ndarray, zeros: np.ndarray, first: int = 0) -> np.ndarray:
    """Registers x moved on by ``zeros`` times 2**first zero bytes each."""
    x, bit, rest = x.copy(), first, zeros.copy()
    while rest.any():
        on = (rest & 1).astype(bool)
        x[on] = _apply(_SHIFT[bit], x[on])
        rest >>= 1
        bit += 1
    return x


def crc32c(parts: list[bytes]) -> np.ndarray:
    """Unsigned CRC-32C of each byte string."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    chunks = np.maximum(1, -(-lengths // _CHUNK))
    front = chunks * _CHUNK - lengths
    zeros = bytes(_CHUNK)
    joined = b"".join([x for n, p in zip(front.tolist(), parts, strict=True) for x in (zeros[:n], p)])
    words = np.frombuffer(joined, "<u4").reshape(-1, _CHUNK // 4)
    state = np.zeros(len(words), np.uint32)
    for j in range(_CHUNK // 4):
        x = state ^ words[:, j]
        state = _T[3][x & 255] ^ _T[2][(x >> 8) & 255] ^ _T[1][(x >> 16) & 255] ^ _T[0][x >> 24]
    ends = np.cumsum(chunks)
    after = np.repeat(ends, chunks) - 1 - np.arange(len(words))
    lin = np.bitwise_xor.reduceat(_moved(state, after, _LOG), ends - chunks) if len(parts) else state
    start = _moved(np.full(len(parts), 0xFFFFFFFF, np.uint32), lengths)
    return lin ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The rotated and offset form that record files store."""
    return ((crc >> 15) | (crc << 17)) + np.uint32(0xA282EAD8)

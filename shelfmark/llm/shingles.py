"""Words, word shingles and their XXH64 values over many texts at once, with numpy.

Texts are laid out in one byte buffer; white space is found and squeezed by array operations, and
XXH64 runs over all shingles of one length together. No Python loop runs over words.
"""

from __future__ import annotations

import numpy as np

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[start:start+length] for each pair; ``buf`` is uint8."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    u64 = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    u32 = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    order = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    seed = np.uint64(seed)
    with np.errstate(over="ignore"):
        for size, a, b in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            rows = order[a:b]
            at = starts[rows]
            left = size
            if size >= 32:
                acc = [np.full(len(rows), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
                while left >= 32:
                    for k in range(4):
                        acc[k] = _round(acc[k], u64[at + 8 * k])
                    at = at + 32
                    left -= 32
                h = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
                for x in acc:
                    h = (h ^ _round(np.zeros(len(rows), np.uint64), x)) * _P1 + _P4
            else:
                h = np.full(len(rows), seed + _P5, np.uint64)
            h = h + np.uint64(size)
            while left >= 8:
                h = _rot(h ^ _round(np.zeros(len(rows), np.uint64), u64[at]), 27) * _P1 + _P4
                at = at + 8
                left -= 8
            if left >= 4:
                h = _rot(h ^ (u32[at].astype(np.uint64) * _P1), 23) * _P2 + _P3
                at = at + 4
                left -= 4
            while left:
                h = _rot(h ^ (padded[at].astype(np.uint64) * _P5), 11) * _P1
                at = at + 1
                left -= 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of many texts, A-Z in lower case, single spaces between.

    ``buf`` holds all texts; word i is buf[starts[i]:ends[i]]; text d has words first[d]:first[d + 1].
    """

    def __init__(self, texts: list[bytes], lower: bool = True):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        begins = ~space
        begins[1:] &= space[:-1]
        keep = ~space  # and the one space before each word
        keep[:-1] |= begins[1:]
        to = np.cumsum(keep)
        self.buf = raw[keep]
        if lower:
            self.buf = np.where((self.buf >= 65) & (self.buf <= 90), self.buf | 32, self.buf)
        self.buf[space[keep]] = 32
        at = np.flatnonzero(begins)
        closes = np.flatnonzero(np.concatenate([(~space[:-1]) & space[1:], [False]]))
        self.starts, self.ends = to[at] - 1, to[closes]
        self.first = np.concatenate([[0], np.searchsorted(at, ends)])

    def __len__(self) -> int:
        return len(self.first) - 1

    def shingles(self, width: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start byte, byte length, first word) of every shingle and each text's first shingle (one more entry than texts).

        A text of fewer words is one shingle if ``whole_if_short``; one without words has none.
        """
        words = np.diff(self.first)
        short = (words > 0) & (words < width) if whole_if_short else np.zeros(len(words), bool)
        n = np.where(short, 1, np.maximum(words - width + 1, 0))
        bounds = np.concatenate([[0], np.cumsum(n)])
        word = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(self.first[:-1], n)
        last = word + np.where(np.repeat(short, n), np.repeat(words, n), width) - 1
        begin = self.starts[word] if len(word) else np.zeros(0, np.int64)
        return begin, (self.ends[last] if len(word) else begin) - begin, word, bounds


def text_groups(texts: list, size: int = 4 << 20):
    """Consecutive index ranges of texts of about ``size`` characters in all."""
    a = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(texts):
        yield a, len(texts)

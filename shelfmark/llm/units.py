"""Byte-level BPE over white-space units.

The pre-tokenizer of the GPT-2 family never joins characters across the start of a space that
follows a non-space character, so a text is the concatenation of units that encode on their own:
an optional space with a run of non-space, or white space as the pre-tokenizer groups it; letters
part from signs after them. Most units recur, so their ids are kept by unit and only new units
reach the tokenizer library, many words in one text. Added tokens of a vocabulary, such as an end
mark, are units of their own wherever a text holds their string, as in the library; none may hold
white space.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

# White space as Unicode defines it (fixed values of the White_Space property).
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"  # letters only
_SIGNS = re.escape('!"#$%&()*+,-./:;<=>?@[]^_`{|}~') + "\\\\"  # ASCII signs but the apostrophe, which can join
_WORD = f" ?[{_LATIN}]++(?=[{_SIGNS}{WS}]|\\Z)"  # letters never join with a sign after them
UNIT = re.compile(f"{_WORD}| ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
_IS_WORD = re.compile(f" ?[{_LATIN}]+").fullmatch
_CUT = re.compile(f"(?<=[^{WS}]) (?=[^{WS}])")
BLOCK_CHARS = 1 << 20
CACHE_UNITS = 1_000_000


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """Parts of a text of about ``size`` characters, cut only where units part."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class UnitEncoder:
    """Ids of units, as little-endian bytes, by the ``tokenizers`` library with a bounded memory of units."""

    def __init__(self, path: str, width: int = 2, cache_units: int = CACHE_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # the library takes these out of a text first, and encodes what lies between by itself
        self.added = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.tokenizer.encode_special_tokens = True  # units hold none of them; words side by side must not make one
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        self.cache_units, self.old = cache_units, {}
        self.fixed = {t: np.asarray([i], self.dtype).tobytes() for t, i in added.items()}
        self.known = dict(self.fixed)

    def learn(self, units: list[str]) -> None:
        """Put the ids of all these units into ``known``; the units unused for longest go first."""
        known, old = self.known, self.old
        new = [u for u in set(units) if u not in known]
        if len(known) + len(new) > self.cache_units // 2:
            self.old, self.known = known, dict(self.fixed)
            known, old = self.known, self.old
            new = list(set(units))
        rest = []
        for u in new:
            if (ids := old.get(u)) is None:
                rest.append(u)
            else:
                known[u] = ids
        spaced, bare, others = [], [], []
        for u in rest:
            (others if not _IS_WORD(u) else spaced if u[0] == " " else bare).append(u)
        self._learn_words(spaced, "", 1)
        self._learn_words(bare, "\n", 2)
        for i in range(0, len(others), 4096):
            some = others[i : i + 4096]
            for u, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[u] = np.asarray(e.ids, self.dtype).tobytes()

    def _learn_words(self, words: list[str], between: str, step: int) -> None:
        """Many words in one text: each is one pre-token, at every ``step``-th place."""
        width = self.dtype.itemsize
        for i in range(0, len(words), 256):
            some = words[i : i + 256]
            e = self.tokenizer.encode(between.join(some), add_special_tokens=False)
            at = np.searchsorted(np.array(e.word_ids), np.arange(len(some) * step - (step - 1)))
            at = [*(at * width).tolist(), len(e.ids) * width]
            raw = np.asarray(e.ids, self.dtype).tobytes()
            for k, u in enumerate(some):
                self.known[u] = raw[at[k * step] : at[k * step + 1]]

    def units(self, part: str) -> list[str]:
        """The units of a text, added tokens among them."""
        if not self.added or not (found := list(self.added.finditer(part))):
            return UNIT.findall(part)
        out, at = [], 0
        for m in found:
            out += [*UNIT.findall(part[at : m.start()]), m[0]]
            at = m.end()
        return out + UNIT.findall(part[at:])

    def encode(self, text: str) -> bytes:
        """All ids of a text, as bytes of ``dtype``."""
        out = []
        for part in blocks(text):
            units = self.units(part)
            self.learn(units)
            known = self.known
            out.append(b"".join([known[u] for u in units]))
        return b"".join(out)

    def counts(self, units: list[str]) -> np.ndarray:
        self.learn(units)
        known, w = self.known, self.dtype.itemsize
        return np.fromiter((len(known[u]) // w for u in units), np.int64, len(units))


@lru_cache(2)
def encoder(path: str, width: int = 2) -> UnitEncoder:
    """A worker's encoder, kept from task to task."""
    return UnitEncoder(path, width)

"""SentencePiece BPE models as a lattice whose paths score over the (max, +) semiring.

Two neighbouring pieces s, t can stand in an encoding exactly if encoding s + t gives s, t again:
merges on either side of a border don't depend on what lies beyond the two pieces. So an edge from
s to t weighs 0 if they can and minus infinity if not, and the one path of weight 0 over a text is
its encoding. A border's state is the piece that covers the character before it; a chunk's transfer
matrix holds the best weight from every state at its left border to every state at its right one.

Where a blank follows another character no piece reaches across, so all paths meet. Between such
points, chunks and whole short texts go unit by unit to the ``sentencepiece`` library, which a
bounded memory of units spares most of the work.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

BLANK = "▁"
UNIT = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
CACHE_UNITS = 240_000
NONE = -np.inf


def normal(text: str) -> str:
    """The text as the model sees it: blanks made visible, one more in front (an empty text stays empty)."""
    return BLANK + text.replace(" ", BLANK) if text else ""


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(sp.get_piece_size())]
        self.ids = {sp.id_to_piece(i): i for i, x in enumerate(special) if not x}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.meets = not any(BLANK in p.lstrip(BLANK) for p in self.ids)  # no piece holds a blank after another character
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(BLANK, " ").encode() for i in range(sp.get_piece_size())]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bpe, self.follows = lru_cache(1 << 15)(self._bpe), lru_cache(1 << 18)(self._follows)

    def _bpe(self, text: str) -> tuple[str, ...]:
        """Pieces of a short text: the best-scored pair merges first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((s, -k) for k in range(len(parts) - 1) if (s := self.scores.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return tuple(parts)
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _follows(self, s: str, t: str) -> bool:
        return self.bpe(s + t) == (s, t)

    def at(self, text: str, p: int) -> list[str]:
        """Pieces that begin at a place (a character that is none counts as one)."""
        return [t for n in range(1, min(self.longest, len(text) - p) + 1) if (n == 1 or (t := text[p : p + n]) in self.ids) and (t := text[p : p + n]) and self.bpe(t) == (t,)]

    def ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte[b] for b in piece.encode()]

    def states(self, text: str, border: int) -> list[tuple[int, int]]:
        """All (begin, end) of pieces that cover the character before a border."""
        return [(a, a + len(t)) for a in range(max(0, border - self.longest), border) for t in self.at(text, a) if a + len(t) >= border]

    def learn(self, units: list[str]) -> None:
        new = [u for u in set(units) if u not in self.known]
        if len(self.known) + len(new) > CACHE_UNITS // 2:
            self.old, self.known = self.known, {}
            new = list(set(units))
        rest = []
        for u in new:
            if (ids := self.old.get(u)) is not None:
                self.known[u] = ids
            elif u[0] == BLANK and u.strip(BLANK):
                rest.append(u)
            else:  # blanks only, which the library would count as no text, or a part without one in front
                self.known[u] = np.array([i for p in self._bpe(u) for i in self.ids_of(p)], "<i4").tobytes()
        if rest:
            for u, ids in zip(rest, self.sp.encode([u[1:].replace(BLANK, " ") for u in rest], num_threads=1), strict=True):
                self.known[u] = np.array(ids, "<i4").tobytes()

    def encode_units(self, text: str) -> bytes:
        """Ids (int32 bytes) of a normal text that begins at a meeting point."""
        if not self.meets:
            return np.array(self.sp.encode(text[1:].replace(BLANK, " ")), "<i4").tobytes() if text else b""
        units = UNIT.findall(text)
        self.learn(units)
        known = self.known
        return b"".join([known[u] for u in units])

    def decode_raw(self, ids: np.ndarray) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()])

    def meetings(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """First and last meeting point in [begin, end)."""
        if not self.meets:
            return None
        first = next((m.start() for m in re.compile(f"(?<=[^{BLANK}]){BLANK}").finditer(text, begin, end)), None)
        if first is None:
            return None
        p = end
        while True:
            p = text.rfind(BLANK, first, p)
            if p == first or text[p - 1] != BLANK:
                return first, p

    def forward(self, text: str, seeds: dict[int, dict[str | None, np.ndarray]], stop: int) -> dict[int, dict[str | None, np.ndarray]]:
        """Best weights from seeds to every (place, piece that ends there), for pieces that begin before ``stop``."""
        best = {p: dict(x) for p, x in seeds.items()}
        for p in range(min(seeds, default=stop), stop):
            for s, weight in best.get(p, {}).items():
                for t in self.at(text, p):
                    if s is None or self.follows(s, t):
                        here = best.setdefault(p + len(t), {})
                        here[t] = np.maximum(here[t], weight) if t in here else weight
        return best

    def matrix(self, text: str, begin: int, end: int, first: bool, last: bool) -> np.ndarray:
        """Transfer matrix of text[begin:end]; ``text`` reaches one longest piece beyond on both sides."""
        left = [(begin, begin)] if first else self.states(text, begin)
        right = [(end, end)] if last else self.states(text, end)
        out = np.full((len(left), len(right)), NONE)
        seeds: dict[int, dict] = {}
        for k, (a, b) in enumerate(left):
            one = np.full(len(left), NONE)
            one[k] = 0
            here = seeds.setdefault(b, {})
            piece = None if first else text[a:b]
            here[piece] = np.maximum(here[piece], one) if piece in here else one
        meet = self.meetings(text, begin + 1 if first else begin, end)
        if meet:
            best = self.forward(text, seeds, meet[0])
            arrived = np.max([NONE + np.zeros(len(left)), *best.get(meet[0], {}).values()], axis=0)
            best = self.forward(text, {meet[1]: {None: arrived}}, end)
        else:
            best = self.forward(text, seeds, end)
        for k, (a, b) in enumerate(right):
            for t, weight in best.get(b, {}).items():
                if last or (t is not None and b - len(t) == a):
                    out[:, k] = np.maximum(out[:, k], weight)
        return out

    def trace(self, text: str, start: int, piece: str | None, stop: int, goal: tuple[int, int]) -> list[str]:
        """Pieces of the path from ``start``, after ``piece``, to the one with place ``goal`` (or that ends at goal[1] if both are equal)."""
        back: dict[tuple[int, str | None], tuple[int, str | None] | None] = {(start, piece): None}
        at: dict[int, list[str | None]] = {start: [piece]}
        for p in range(start, stop):
            for s in at.get(p, []):
                for t in self.at(text, p):
                    if (s is None or self.follows(s, t)) and (node := (p + len(t), t)) not in back:
                        back[node] = (p, s)
                        at.setdefault(p + len(t), []).append(t)
        ends = [(goal[1], t) for t in at.get(goal[1], []) if goal[0] == goal[1] or (t is not None and goal[1] - len(t) == goal[0])]
        node, out = ends[0], []
        while back[node] is not None:
            out.append(node[1])
            node = back[node]
        return out[::-1]

    def chunk_ids(self, text: str, begin: int, end: int, first: bool, last: bool, enter: int, leave: int) -> bytes:
        """Ids of the pieces that begin in text[begin:end], given the states at both borders."""
        a, b = (begin, begin) if first else self.states(text, begin)[enter]
        goal = (end, end) if last else self.states(text, end)[leave]
        if b >= end and not first and goal == (a, b):
            return b""  # one piece covers the whole chunk
        piece = None if first else text[a:b]
        meet = self.meetings(text, begin + 1 if first else begin, end)
        flat = lambda pieces: np.array([i for p in pieces for i in self.ids_of(p)], "<i4").tobytes()
        if not meet:
            return flat(self.trace(text, b, piece, end, goal))
        head = self.trace(text, b, piece, meet[0], (meet[0], meet[0]))
        tail = self.trace(text, meet[1], None, end, goal)
        return flat(head) + self.encode_units(text[meet[0] : meet[1]]) + flat(tail)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """A worker's model, kept from task to task."""
    return Pieces(path)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product over (max, +); associative."""
    out = np.full((a.shape[0], b.shape[1]), NONE)
    for k in range(a.shape[1]):
        out = np.maximum(out, a[:, k, None] + b[None, k, :])
    return out

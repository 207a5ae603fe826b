"""Token ids of Arrow string columns through ``tokenizers``, each distinct piece once per worker.

Byte-level BPE never merges across the pieces that its pre-tokenizer makes, so
a text's ids are its pieces' ids end to end.  Pieces are found with numpy on
code points (letters, digits, blanks and the rest of Latin text), hashed, and
only pieces not met before go to the library.  A text with any code point
from ``_LIMIT`` on is encoded by the library as a whole.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa

from .kernel import _BASE, _powers, splitmix

_U = np.uint64
#: Code points below this are Latin letters, digits, blanks and signs, whose classes are the same in every Unicode version.
_LIMIT = 0x250
_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
_BLANKS = (*range(9, 14), 32, 0x85, 0xA0)
_CLASS = np.array([_SPACE if c in _BLANKS else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(_LIMIT)], dtype=np.uint8)
#: Code points handled at once (a longer text is a slice of its own); the temporary arrays of a slice take about 100 bytes for each.
_SLICE = 1 << 19
_POW = _powers(_BASE, _SLICE + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), _SLICE + 1)
_HASH = splitmix(np.arange(_LIMIT, dtype=_U))


def _byte_alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary: itself if printable, else 256 on."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_ALPHABET = _byte_alphabet()
#: Contractions that are pieces of their own.
_TAILS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Cached pieces per worker; the cache starts anew beyond it (about 100 MB).
MAX_PIECES = 2_000_000


def piece_starts(cp: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Start positions of pieces in code points; ``edge`` marks the first code point of each text."""
    n = len(cp)
    if not n:
        return np.zeros(0, dtype=np.int64)
    cls = _CLASS[cp]
    space = cls == _SPACE
    start = edge[:n].copy()
    last = np.ones(n, dtype=bool)
    last[:-1] = edge[1:n]
    change = np.zeros(n, dtype=bool)
    change[1:] = cls[1:] != cls[:-1]
    after_space = np.zeros(n, dtype=bool)
    after_space[1:] = space[:-1]
    joined = np.zeros(n, dtype=bool)
    joined[1:] = cp[:-1] == 32
    joined &= ~edge[:n]
    before_text = np.zeros(n, dtype=bool)
    before_text[:-1] = ~space[1:]
    before_text &= ~last
    start |= ~space & change & ~(after_space & joined)
    start |= space & ((~after_space) | before_text)
    quotes = np.flatnonzero((cp == 39) & start)
    if len(quotes):
        for q in quotes.tolist():
            for tail in _TAILS:
                end = q + 1 + len(tail)
                if end <= n and not edge[q + 1 : end].any() and all(cp[q + 1 + i] == ord(c) for i, c in enumerate(tail)):
                    start[q + 1 : end] = False
                    if end < n:
                        # what follows the contraction begins anew, but a blank run keeps its own rules
                        start[end] |= not space[end]
                    break
    return np.flatnonzero(start)


class PieceEncoder:
    """Encodes string columns with a ``tokenizers`` file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self._quick = self._by_rank(path)
        self._clear()

    @staticmethod
    def _by_rank(path: str):
        """An encoder of single pieces from the same file's vocabulary, or None.

        Where every merge of the file makes a token of a higher id than the
        merge before it, merging by id is merging by the file's list, and a
        rank-based encoder gives the library's ids in a fraction of the time.
        """
        try:
            import tiktoken
        except ImportError:
            return None
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        back = {c: b for b, c in _ALPHABET.items()}
        singles = [t for t in model["vocab"] if len(t) == 1 and t in back]
        if len(singles) < 256 or any(x >= y for x, y in zip(made, made[1:])) or (made and min(made) <= max(model["vocab"][t] for t in singles)):
            return None
        ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
        kept = {model["vocab"][t] for t in singles} | set(made)
        ranks = {t: i for t, i in ranks.items() if i in kept}
        return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.lens = np.zeros(1 << 16, dtype=np.int64)
        self.offs = np.zeros(1 << 16, dtype=np.int64)
        self.flat = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def _piece(self, text: str) -> list[int]:
        """Ids of one piece: the model itself, without the offsets that a full encoding carries."""
        return [t.id for t in self.model.model.tokenize(text.encode().decode("latin-1").translate(_ALPHABET))]

    def _learn(self, hashes: list[int], texts: list[str]) -> None:
        piece = self._quick or self._piece
        found = [piece(t) for t in texts]
        base = len(self.index)
        need = base + len(found)
        if need > len(self.lens):
            self.lens = np.resize(self.lens, 2 * need)
            self.offs = np.resize(self.offs, 2 * need)
        lens = np.array([len(x) for x in found], dtype=np.int64)
        ids = np.array([i for x in found for i in x], dtype=np.uint32)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.lens[base:need] = lens
        self.offs[base:need] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.index.update(zip(hashes, range(base, need), strict=True))

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        odd = set((np.searchsorted(begins, np.flatnonzero(cp >= _LIMIT), "right") - 1).tolist())
        if odd:
            plain = iter(self._slice([t for k, t in enumerate(texts) if k not in odd]))
            whole = lambda t: np.array(self.model.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
            return [whole(t) if k in odd else next(plain) for k, t in enumerate(texts)]
        edge = np.zeros(len(cp) + 1, dtype=bool)
        edge[begins] = True
        starts = piece_starts(cp, edge)
        if not len(starts):
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        ends = np.append(starts[1:], len(cp))
        powers, inverse = (_POW, _INV) if len(cp) <= _SLICE else (_powers(_BASE, len(cp) + 1), _powers(pow(_BASE, -1, 1 << 64), len(cp) + 1))
        sums = np.zeros(len(cp) + 1, dtype=_U)
        with np.errstate(over="ignore"):
            np.cumsum(_HASH[cp] * powers[: len(cp)], out=sums[1:])
            hashes = splitmix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.index) > MAX_PIECES:
            self._clear()
        keys = unique.tolist()
        get = self.index.get
        at = np.array([get(h, -1) for h in keys], dtype=np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            s, e = starts[first[new]].tolist(), ends[first[new]].tolist()
            self._learn([keys[i] for i in new.tolist()], [joined[a:b] for a, b in zip(s, e, strict=True)])
            at[new] = np.array([self.index[keys[i]] for i in new.tolist()], dtype=np.int64)
        piece = at[back]
        lens = self.lens[piece]
        before = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.repeat(self.offs[piece] - before[:-1], lens) + np.arange(before[-1])]
        bounds = before[np.searchsorted(starts, begins)]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode(self, column: pa.Array):
        """Yields the ids (uint32) of each text; a null one has none."""
        texts, room = [], 0
        for value in column:
            text = value.as_py() or ""
            if texts and room + len(text) > _SLICE:
                yield from self._slice(texts)
                texts, room = [], 0
            texts.append(text)
            room += len(text)
        if texts:
            yield from self._slice(texts)

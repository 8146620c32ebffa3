"""Pre-tokenisation of many texts at once, in numpy over code points, equal to that of the public tokenizer files.

Two rules are known: ``pieces`` (a space joins the piece that follows it; the byte-level file) and ``words`` (NFC, white
space is dropped, digits stand alone, letters are lower-cased; the word-end file). A text is left to the library only if
it holds a special token's string, a code point that this Python's Unicode data don't have, or, under ``words``, one
whose lower case is longer.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
from tokenizers import Tokenizer

from kumiki.llm.kernel import U, _B, powers, splitmix

OTHER, LETTER, DIGIT, SPACE, GAP, UNKNOWN = range(6)
#: Code points beyond these are unassigned or for private use.
PLANES = (*range(0x40000), *range(0xE0000, 0xE1000))
#: Characters of one piece of work.
CHUNK_CHARS = 1 << 18
#: Pieces of which a worker remembers the ids; beyond that it begins anew.
CACHE_PIECES = 600_000
FRONT_BITS = 20


@cache
def classes() -> np.ndarray:
    """The class of each code point, by its general category."""
    table = np.full(0x110000, UNKNOWN, np.uint8)
    kinds = {"L": LETTER, "N": DIGIT, "Z": SPACE}
    for cp in PLANES:
        kind = unicodedata.category(chr(cp))
        if kind not in ("Cn", "Cs"):
            table[cp] = kinds.get(kind[0], OTHER)
    table[9:14] = SPACE
    table[0x85] = SPACE
    return table


@cache
def lower_case() -> np.ndarray:
    """The lower case of each code point by itself, and 0x110000 where that is longer than one."""
    table = np.arange(0x110000, dtype=np.uint32)
    for cp in PLANES:
        if not 0xD800 <= cp < 0xE000 and (low := chr(cp).lower()) != chr(cp):
            table[cp] = ord(low) if len(low) == 1 else 0x110000
    return table


def classify(text: str, rule: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The text as its pieces are cut from it, its code points, and their classes."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if rule == "pieces" or text.isascii():
        text = text if rule == "pieces" else text.lower()
        cps = cps if rule == "pieces" else np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return text, cps, classes()[cps]
    low = lower_case()[cps]
    long = low == 0x110000
    cps = np.where(long, cps, low)
    cls = classes()[cps]
    cls[long] = UNKNOWN
    return cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), cps, cls


def spans(cps: np.ndarray, cls: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every piece; a GAP ends a text."""
    n = len(cps)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    quote = np.flatnonzero((cps[: n - 1] == 39) & start[: n - 1] & (cls[1:] == LETTER))
    if rule == "pieces":
        after = np.flatnonzero(start[1:] & (cls[:-1] == SPACE) & (cls[1:] != GAP)) + 1
        joined = after[cps[after - 1] == 32]
        start[after - 1] = True
        start[joined] = False
        quote = quote[(quote == 0) | (cps[quote - 1] != 32)]
    else:
        start |= cls == DIGIT
    if len(quote):
        a, b = cps[quote + 1], cps[np.minimum(quote + 2, n - 1)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = np.isin(a * 65536 + b, [ord(x) * 65536 + ord(y) for x, y in ("re", "ve", "ll")])
        taken = np.where(one, 1, np.where(two, 2, 0))
        quote, taken = quote[taken > 0], taken[taken > 0]
        start[quote + 1] = False
        rest = quote + 1 + taken
        start[rest[rest < n]] = True
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    kept = cls[begin] != GAP if rule == "pieces" else cls[begin] < SPACE
    return begin[kept], end[kept]


def span_hashes(cps: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(cps)
    up, down = powers(_B, n + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, U)
        sums[0] = 0
        np.cumsum(splitmix(cps.astype(U) + U(0x1234567)) * up[:n], out=sums[1:])
        return splitmix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U) * U(0xC2B2AE3D27D4EB4F))


def marks(cps: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length, first and last code point of each piece as one number: pieces of equal hashes are told apart by it."""
    return ((end - begin).astype(U) << U(42)) ^ (cps[begin].astype(U) << U(21)) ^ cps[end - 1].astype(U)


class Encoder:
    """Ids of whole texts, the same as the library's, by pieces: each distinct piece is encoded once.

    lexicon, if given, has lookup(list of pieces) -> list of id tuples or None; what it lacks is merged by the library.
    """

    def __init__(self, path: str, rule: str, lexicon=None):
        self.tok, self.rule, self.lexicon = Tokenizer.from_file(path), rule, lexicon
        self.tok.no_padding()
        self.tok.no_truncation()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        # A direct-mapped front of the slots, looked up for all pieces at once; the latest piece of a place wins.
        self.front_key, self.front_slot = np.zeros(1 << FRONT_BITS, U), np.zeros(1 << FRONT_BITS, np.int32)
        self.first, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.mark = np.zeros(1024, U)
        self.used = 0

    def merge(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces that the lexicon lacks, by the library's exact merges, as many at a time."""
        out: list[list[int]] = [[] for _ in pieces]
        e = self.tok.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        for i, k in zip(e.word_ids, e.ids, strict=True):
            out[i].append(k)
        return out

    def _learn(self, hashes: list[int], pieces: list[str], mark: np.ndarray) -> None:
        found = self.lexicon.lookup(pieces) if self.lexicon else [None] * len(pieces)
        unseen = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(unseen, self.merge([pieces[i] for i in unseen]) if unseen else [], strict=True):
            found[i] = ids
        at, n = len(self.slots), len(pieces)
        sizes = np.fromiter(map(len, found), np.int64, n)
        total = int(sizes.sum())
        while at + n > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
            self.mark = np.resize(self.mark, 2 * len(self.mark))
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.first[at : at + n] = self.used + np.cumsum(sizes) - sizes
        self.size[at : at + n] = sizes
        self.mark[at : at + n] = mark
        self.ids[self.used : self.used + total] = np.fromiter((k for x in found for k in x), np.uint32, total)
        self.used += total
        self.slots.update(zip(hashes, range(at, at + n), strict=True))

    def _slots(self, joined: str, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, mark: np.ndarray) -> np.ndarray:
        if len(self.slots) > CACHE_PIECES:
            self.clear()
        place = (hashes >> U(64 - FRONT_BITS)).astype(np.int64)
        slot = self.front_slot[place].astype(np.int64)
        miss = np.flatnonzero(self.front_key[place] != hashes)
        if not len(miss):
            return slot
        distinct, where, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
        keys = distinct.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.slots]
        if new:
            at = miss[where[new]]
            b, e = begin[at].tolist(), end[at].tolist()
            self._learn([keys[i] for i in new], [joined[x:y] for x, y in zip(b, e, strict=True)], mark[at])
        found = np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))
        slot[miss] = found[back]
        front = place[miss[where]]
        self.front_key[front], self.front_slot[front] = distinct, found
        return slot

    def _fast(self, texts: list[str]) -> list[np.ndarray]:
        joined, cps, cls = classify("\0".join(texts), self.rule)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        strange = np.flatnonzero(cls == UNKNOWN)
        if len(strange):
            own = np.zeros(len(texts), bool)
            own[np.searchsorted(np.cumsum(sizes), strange, side="right")] = True
            plain = iter(self._fast([t for t, o in zip(texts, own, strict=True) if not o]) if not own.all() else ())
            return [None if o else next(plain) for o in own]
        gaps = np.cumsum(sizes)[:-1] - 1
        if len(gaps):
            cls = cls.copy()
            cls[gaps] = GAP
        if not len(cps):
            return [np.zeros(0, np.uint32) for _ in texts]
        begin, end = spans(cps, cls, self.rule)
        mark = marks(cps, begin, end)
        slot = self._slots(joined, begin, end, span_hashes(cps, begin, end), mark)
        if (self.mark[slot] != mark).any():  # two pieces of one hash: the library takes these texts
            return [None] * len(texts)
        first, size = self.first[slot], self.size[slot]
        ends = np.cumsum(size)
        ids = self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)]
        cut = np.searchsorted(begin, np.append(0, np.cumsum(sizes)))
        edges = np.append(0, ends)[cut]
        return [ids[edges[i] : edges[i + 1]] for i in range(len(texts))]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        group: list[str] = []
        at: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal group, at, held
            for i, ids in zip(at, self._fast(group), strict=True):
                out[i] = self.whole(texts[i]) if ids is None else ids
            group, at, held = [], [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self.special):
                out[i] = self.whole(text)
                continue
            if group and held + len(text) > CHUNK_CHARS:
                flush()
            group.append(text if self.rule == "pieces" or text.isascii() else unicodedata.normalize("NFC", text))
            at.append(i)
            held += len(text)
        if group:
            flush()
        return out

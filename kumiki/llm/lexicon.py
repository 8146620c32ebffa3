"""A minimal acyclic transducer from frequent words to their token ids, in one flat file that is memory-mapped.

Words are added in byte order, and states with the same future are shared, so common suffixes are stored once. Each arc
carries the number of words that its siblings of smaller bytes lead to; the sum along a path is the word's rank, and the
rank leads to its ids. Lookup walks many words at once, a byte of each at a time.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

MAGIC = 0x4B4D4C58


def build(words: dict[str, list[int]]) -> bytes:
    """The file for words and their ids."""
    keyed = sorted((w.encode(), ids) for w, ids in words.items() if w)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # parent, byte, child of the last word

    def settle(keep: int) -> None:
        while len(path) > keep:
            parent, byte, child = path.pop()
            key = (final[child], tuple(arcs[child].items()))
            same = register.setdefault(key, child)
            if same != child:
                arcs[parent][byte] = same

    last = b""
    for word, _ in keyed:
        common = len(os.path.commonprefix([last, word]))
        settle(common)
        state = path[-1][2] if path else 0
        for byte in word[common:]:
            arcs.append({})
            final.append(False)
            child = len(arcs) - 1
            arcs[state][byte] = child
            path.append((state, byte, child))
            state = child
        final[state] = True
        last = word
    settle(0)

    order: dict[int, int] = {0: 0}
    stack, post = [0], []
    while stack:
        s = stack.pop()
        post.append(s)
        for t in arcs[s].values():
            if t not in order:
                order[t] = len(order)
                stack.append(t)
    ways: dict[int, int] = {}
    work = [0]
    while work:
        s = work[-1]
        todo = [t for t in arcs[s].values() if t not in ways]
        if todo:
            work.extend(todo)
        else:
            ways[s] = final[s] + sum(ways[t] for t in arcs[s].values())
            work.pop()
    used = sorted({b for s in order for b in arcs[s]})
    code = np.zeros(256, np.int64)
    code[used] = np.arange(1, len(used) + 1)
    wide = len(used) + 1
    nxt, out = np.full((len(order), wide), -1, np.int32), np.zeros((len(order), wide), np.int32)
    done = np.zeros(len(order), np.int64)
    for s, i in order.items():
        done[i] = final[s]
        rank = int(final[s])
        for b, t in sorted(arcs[s].items()):
            nxt[i, code[b]], out[i, code[b]] = order[t], rank
            rank += ways[t]
    sizes = np.array([len(ids) for _, ids in keyed], np.int64)
    offs = np.append(0, np.cumsum(sizes)).astype(np.int64)
    flat = np.fromiter((k for _, ids in keyed for k in ids), np.int64, int(offs[-1]))
    longest = max((len(w) for w, _ in keyed), default=0)
    head = np.array([MAGIC, len(order), wide, len(keyed), len(flat), longest], np.int64)
    return b"".join(x.tobytes() for x in (head, code, done, offs, flat, nxt, out))


class Lexicon:
    """Reads the file by a memory map."""

    def __init__(self, path: str):
        self.map = np.memmap(path, np.uint8, "r")
        head = self.map[:48].view(np.int64)
        if head[0] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        _, self.states, self.wide, self.n_words, n_ids, self.longest = map(int, head)
        at = 48

        def take(n: int, kind) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            at += size
            return self.map[at - size : at].view(kind)

        self.code, self.final = take(256, np.int64), take(self.states, np.int64)
        self.offs, self.ids = take(self.n_words + 1, np.int64), take(n_ids, np.int64)
        self.nxt, self.out = take(self.states * self.wide, np.int32), take(self.states * self.wide, np.int32)

    @classmethod
    def of(cls, blob: bytes) -> Lexicon:
        """Maps a blob through a file of this machine's own that needs no clearing away."""
        with tempfile.NamedTemporaryFile(prefix="lexicon-") as f:
            f.write(blob)
            f.flush()
            return cls(f.name)

    def rank(self, pieces: list[str]) -> np.ndarray:
        """Rank of each piece, -1 where the lexicon lacks it."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        first = np.cumsum(size) - size
        data = self.code[np.frombuffer(b"".join(raw) + b"\0", np.uint8)]
        state, rank = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        alive = np.flatnonzero((size <= self.longest) & (size > 0))
        ended = np.full(len(raw), -1, np.int64)
        for j in range(self.longest):
            if not len(alive):
                break
            arc = state[alive] * self.wide + data[first[alive] + j]
            to = self.nxt[arc]
            alive, arc, to = alive[to >= 0], arc[to >= 0], to[to >= 0]
            state[alive] = to
            rank[alive] += self.out[arc]
            over = size[alive] == j + 1
            at = alive[over]
            good = at[self.final[state[at]] > 0]
            ended[good] = rank[good]
            alive = alive[~over]
        return ended

    def lookup(self, pieces: list[str]) -> list[list[int] | None]:
        ids, offs = self.ids, self.offs
        return [None if r < 0 else ids[offs[r] : offs[r + 1]].tolist() for r in self.rank(pieces).tolist()]

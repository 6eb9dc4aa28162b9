"""Byte-level BPE in arrays: pre-tokens by a scan over transition functions, merges by rank.

The pattern that splits a text is `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`. Here it is a small
automaton over classes of code points. A character is a function from state to state; functions compose associatively, and
the few different compositions are numbered, so that a block's function is found with table look-ups for all blocks at once.
A prefix scan over the blocks gives the state in which each one starts, and a second pass the places where pieces begin.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json

import numpy as np

END, LETTER, STMD, R, V, E, L, NUMBER, OTHER, QUOTE, SPACE, BLANK = range(12)
#: What was read last: nothing, letters, numbers, others, a quote that starts a piece, 'r 'v 'l of such a quote, a whole contraction, one space, one other blank, blanks ending in a space, blanks ending in another.
START, LET, NUM, OTH, QUO, Q_R, Q_V, Q_L, SHORT, SP, BL, SPS, BLS = range(13)
#: A piece begins here; one begins at the character before; none begins at the character before.
HERE, BEFORE, NOT_BEFORE = 1, 2, 4
#: The characters of `\\s` (fixed values: Unicode's White_Space).
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 64


def _step(state: int, kind: int) -> tuple[int, int]:
    """The next state and what is known then about beginnings."""
    if kind == END:
        return START, HERE
    if kind in (SPACE, BLANK):
        run = state in (SP, BL, SPS, BLS)
        return ((SPS if run else SP) if kind == SPACE else (BLS if run else BL)), 0 if run else HERE
    after = {SP: 0, BL: HERE, SPS: BEFORE, BLS: BEFORE | HERE}.get(state)
    if kind == NUMBER:
        return NUM, after if after is not None else HERE * (state != NUM)
    if kind in (OTHER, QUOTE):
        if state in (OTH, QUO):
            return OTH, 0
        starts = kind == QUOTE and state not in (SP, SPS)
        return (QUO if starts else OTH), after if after is not None else HERE
    if state == QUO and kind == STMD:
        return SHORT, 0
    if state == QUO and kind in (R, V, L):
        return {R: Q_R, V: Q_V, L: Q_L}[kind], HERE
    if (state, kind) in ((Q_R, E), (Q_V, E), (Q_L, L)):
        return SHORT, NOT_BEFORE
    return LET, after if after is not None else HERE * (state not in (LET, Q_R, Q_V, Q_L))


@functools.cache
def _tables() -> tuple[np.ndarray, ...]:
    """next state and marks by state * 12 + class; the function after one more character; compositions; what a function makes of START."""
    steps = [[_step(s, k) for k in range(12)] for s in range(13)]
    ways = [tuple(steps[s][k][0] for s in range(13)) for k in range(12)]
    number = {tuple(range(13)): 0}
    todo = [tuple(range(13))]
    for f in todo:
        for w in ways:
            g = tuple(w[x] for x in f)
            if g not in number:
                number[g] = len(number)
                todo.append(g)
    n = len(todo)
    one_more = np.array([[number[tuple(w[x] for x in f)] for w in ways] for f in todo], np.int64)
    both = np.array([[number[tuple(g[x] for x in f)] for g in todo] for f in todo], np.int64)
    return (
        np.array([[a for a, _ in row] for row in steps], np.int64).ravel() * 12, np.array([[b for _, b in row] for row in steps], np.uint8).ravel(),
        one_more.ravel() * 12, both.ravel() * 1, np.array([f[START] for f in todo], np.int64), np.int64(n),
    )


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    import tiktoken  # for its Unicode tables, so that what is a letter or number is what the libraries take for one

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        found = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        out[np.frombuffer(found.decode(found.encode_ordinary(every)).encode("utf-32-le"), np.uint32)] = kind
    out[WHITE] = BLANK
    for letters, kind in (("stmd", STMD), ("r", R), ("v", V), ("e", E), ("l", L), ("'", QUOTE), (" ", SPACE)):
        out[[ord(x) for x in letters]] = kind
    return out


def beginnings(kinds: np.ndarray) -> np.ndarray:
    """Where pieces begin, by the classes of the characters; each END is a piece of its own."""
    step, mark, one_more, both, from_start, n = _tables()
    size = len(kinds)
    rows = -(-size // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)
    grid[:size] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    acc = np.zeros(rows, np.int64)
    for line in grid:  # each block's function
        acc = one_more[acc + line]
    acc //= 12
    reach = 1
    while reach < rows:  # of each block with all before it
        acc[reach:] = both[acc[:-reach] * n + acc[reach:]]
        reach *= 2
    state = np.empty(rows, np.int64)
    state[:1] = START
    state[1:] = from_start[acc[:-1]] * 12
    marks = np.empty((BLOCK, rows), np.uint8)
    for j, line in enumerate(grid):
        at = state + line
        marks[j] = mark[at]
        state = step[at]
    marks = marks.T.ravel()[:size]
    here = (marks & HERE).astype(bool)
    here[:-1] |= (marks[1:] & BEFORE).astype(bool)
    here[:-1] &= (marks[1:] & NOT_BEFORE) == 0
    return here


def pieces(texts: list[str]) -> list[list[str]]:
    """The pre-tokens of each text."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds = classes()[points]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kinds[ends] = END
    at = np.flatnonzero(beginnings(kinds))
    last = np.searchsorted(at, ends).tolist()
    at = at.tolist()
    cut = [joined[a:b] for a, b in zip(at, at[1:])]
    out, first = [], 0
    for k in last:
        out.append(cut[first:k])
        first = k + 1
    return out


class Merges:
    """Merges by rank: of all neighbours of a sequence, those of the lowest rank become one, the leftmost first, until none is left."""

    BIG = np.int32(2**31 - 1)
    #: Longer sequences are merged one by one with a heap: n log n, not n * n.
    LONG = 256

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], byte_ids: list[int], vocabulary: dict[int, bytes]):
        """pairs: (left, right) to (rank, merged id); byte_ids: by byte."""
        self.pairs, self.byte_ids, self.vocabulary = pairs, np.array(byte_ids, np.int32), vocabulary
        bits = max(4, int(len(pairs) * 6).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        left, right = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        self.key = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, self.BIG, np.int32)
        self.became = np.full(max((r for r, _ in pairs.values()), default=0) + 1, -1, np.int32)
        keys = left << 20 | right
        ranks, ids = (np.array([v[i] for v in pairs.values()], np.int32) for i in (0, 1))
        self.became[ranks] = ids
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):  # the first of those that want a free slot gets it
            free = self.key[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.key[slot[won]], self.rank[slot[won]] = keys[todo[won]], ranks[todo[won]]
            stay = np.ones(len(todo), bool)
            stay[won] = False
            todo, slot = todo[stay], (slot[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        slot = self._slot(keys)
        there = self.key[slot]
        out = np.where(there == keys, self.rank[slot], self.BIG)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):  # the slot is taken by another pair: look at the next one
            slot[todo] = (slot[todo] + 1) & self.mask
            there = self.key[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.rank[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in their order, and how many each has."""
        n = len(words)
        length = np.array([len(w) for w in words], np.int64)
        counts = np.zeros(n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, lengths, symbols
        for k in np.flatnonzero(length > self.LONG).tolist():
            ids = self.one(words[k])
            done.append((np.array([k]), np.array([len(ids)]), np.array(ids, np.int32)))
        row = np.flatnonzero((length > 0) & (length <= self.LONG))
        lens = length[row]
        sym = self.byte_ids[np.frombuffer(b"".join([words[k] for k in row.tolist()]), np.uint8)]
        starts = np.cumsum(lens) - lens
        rank = np.full(len(sym), self.BIG, np.int32)
        if len(sym):
            inner = np.ones(len(sym), bool)
            inner[starts + lens - 1] = False
            at = np.flatnonzero(inner)
            rank[at] = self.ranks(sym[at], sym[at + 1])
        while len(row):
            low = np.minimum.reduceat(rank, starts)
            live = low < self.BIG
            if not live.all():
                each = np.repeat(live, lens)
                done.append((row[~live], lens[~live], sym[~each]))
                sym, rank, row, lens, low = sym[each], rank[each], row[live], lens[live], low[live]
                starts = np.cumsum(lens) - lens
                if not len(row):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, lens))
            of = np.searchsorted(starts, hit, "right")
            pos = hit[np.r_[True, of[1:] != of[:-1]]]  # the leftmost of each sequence
            sym[pos] = self.became[low]
            stay = np.ones(len(sym), bool)
            stay[pos + 1] = False
            sym, rank = sym[stay], rank[stay]
            shift = np.arange(len(row))
            pos, starts, lens = pos - shift, starts - shift, lens - 1
            rank[pos] = self.BIG
            right = pos[pos < starts + lens - 1]
            left = pos[pos > starts] - 1
            at = np.concatenate([right, left])
            rank[at] = self.ranks(sym[at], sym[at + 1])
        if not done:
            return np.zeros(0, np.int32), counts
        rows, sizes, symbols = (np.concatenate([d[i] for d in done]) for i in range(3))
        counts[rows] = sizes
        order = np.argsort(rows, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        take = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(symbols))
        return symbols[take], counts

    def one(self, word: bytes) -> list[int]:
        """A long sequence."""
        ids: list[int | None] = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(self.pairs[p][0], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else -1
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.pairs[a, b][1], None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if p := self.pairs.get((ids[i], ids[k])):
                    heapq.heappush(heap, (p[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (p := self.pairs.get((ids[h], ids[i]))):
                heapq.heappush(heap, (p[0], h, ids[h], ids[i]))
        return [x for x in ids if x is not None]


@functools.cache
def from_ranks(path: str) -> Merges:
    """A rank file: two neighbours merge if their bytes together have a rank, which is also the id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pairs = {(ranks[t[:i]], ranks[t[i:]]): (r, r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
    return Merges(pairs, [ranks[bytes([b])] for b in range(256)], {r: t for t, r in ranks.items()})


@functools.cache
def from_merges(path: str) -> tuple[Merges, list[str]]:
    """A tokenizers file of a byte-level BPE: its list of merges gives the ranks. Also its special tokens."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    ids = said["model"]["vocab"]
    # printable stand-ins of bytes: those that print stand for themselves, the rest follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    stands = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    back = {c: b for b, c in stands.items()}
    pairs: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, m in enumerate(said["model"]["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        pairs.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
    words = {i: bytes(back[c] for c in t) for t, i in ids.items() if all(c in back for c in t)}
    return Merges(pairs, [ids[stands[b]] for b in range(256)], words), [t["content"] for t in said["added_tokens"]]

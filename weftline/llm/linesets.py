"""Lines of texts as sets of words, in arrays: what :mod:`weftline.llm.lines` computes inside its tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SIMILAR = (4, 5)  # 0.8, as a fraction
#: bits of a word's hash
WORD_BITS = 52
#: lines whose words are sorted at once; their number within the slice takes the bits above the hash
SLICE_BITS = 64 - WORD_BITS
#: counts of lines by words; any order of words is right, that by these counts is fast
BUCKET_BITS = 21
#: sets of so many words have a sketch of 128 bits, others of 64
WIDE = 72
#: bytes of texts that are cut into words at once (a longer line is cut alone)
SLICE_BYTES = 1 << 20

_FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_WORD = np.uint64((1 << WORD_BITS) - 1)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def prefix_of(n: np.ndarray) -> np.ndarray:
    """Words of a set of ``n`` of which a similar set has one at least."""
    up, down = SIMILAR
    return n - -(-n * up // down) + 1


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of ``raw``, which ends in white space; A-Z count as a-z."""
    space = (raw == 32) | ((raw - np.uint8(9)) < 5)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, size = edge[::2], edge[1::2] - edge[::2]
    padded = np.zeros(len(raw) + 8, np.uint8)
    np.add(raw, ((raw - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5), out=padded[: len(raw)])
    eight = np.ndarray((len(raw) + 1,), "<u8", buffer=padded, strides=(1,))  # the eight bytes from each on
    h = mix((eight[start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more, at = np.flatnonzero(size > 8), 8
    while len(more):
        h[more] = mix(h[more] * np.uint64(5) + (eight[start[more] + at] & _FIRST[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    return start, h


@dataclass
class Sets:
    """Lines with a word: place of the text in its batch, number in the text, words (sorted hashes) from ``start`` on."""

    text: np.ndarray
    line: np.ndarray
    start: np.ndarray
    n: np.ndarray
    words: np.ndarray

    def ids(self, half: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes that together name a set; of the first one ``half`` bits are used."""
        one, two = (np.add.reduceat(mix(self.words, salt), self.start) if len(self.n) else np.zeros(0, np.uint64) for salt in (1, 2))
        return (one >> np.uint64(64 - half)).view(np.int64), two.view(np.int64)

    def sketches(self) -> tuple[np.ndarray, np.ndarray]:
        """Parities of the words in 64 cells, and of those in the first 64 of 128 cells (0 for sets below ``WIDE``)."""
        if not len(self.n):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cell = mix(self.words, 3)
        bit = np.uint64(1) << (cell & np.uint64(63))
        half = np.bitwise_xor.reduceat(bit * (cell >> np.uint64(6) & np.uint64(1)), self.start)
        return np.bitwise_xor.reduceat(bit, self.start).view(np.int64), np.where(self.n >= WIDE, half, np.uint64(0)).view(np.int64)

    def only(self, keep: np.ndarray) -> Sets:
        inside = np.repeat(keep, self.n)
        n = self.n[keep]
        return Sets(self.text[keep], self.line[keep], np.cumsum(n) - n, n, self.words[inside])


def _pieces(texts: list[bytes | None]):
    """Slices of (text, number of its first line, bytes): whole texts, or parts of one that end at a line break."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if t is None:
            continue
        at = line = 0
        while len(t) - at > SLICE_BYTES:
            cut = t.rfind(b"\n", at, at + SLICE_BYTES)
            cut = t.find(b"\n", at + SLICE_BYTES) if cut < 0 else cut
            if cut < 0:
                break
            if held:
                yield held
                held, size = [], 0
            part = t[at:cut]
            yield [(i, line, part)]
            line += part.count(b"\n") + 1
            at = cut + 1
        held.append((i, line, t[at:] if at else t))
        size += len(t) - at
        if size >= SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _joined(piece) -> np.ndarray:
    return np.frombuffer(b"".join(x for _, _, t in piece for x in (t, b"\n")), np.uint8)


def words_of(texts: list[bytes | None]):
    """The hashes of all words, repeats included, in slices."""
    for piece in _pieces(texts):
        yield _words(_joined(piece))[1] & _WORD


def sets_of(texts: list[bytes | None], floor: int = 1):
    """:class:`Sets` of the lines with ``floor`` different words, in slices."""
    for piece in _pieces(texts):
        raw = _joined(piece)
        start, h = _words(raw)
        breaks = np.flatnonzero(raw == 10)
        lines = np.searchsorted(breaks, np.cumsum([len(t) + 1 for _, _, t in piece]))  # lines up to the end of each text
        first = np.concatenate([[0], lines[:-1]])
        of = np.repeat(np.arange(len(piece)), lines - first)
        number = np.arange(len(breaks)) - first[of] + np.array([line for _, line, _ in piece])[of]
        ahead = np.searchsorted(start, breaks)  # words up to each break
        at = np.repeat(np.arange(len(breaks)), np.diff(ahead, prepend=0))
        keys = (at.astype(np.uint64) << np.uint64(WORD_BITS)) | (h & _WORD)
        block = at >> SLICE_BITS
        edges = np.searchsorted(block, np.arange(len(breaks) // (1 << SLICE_BITS) + 2))
        for a, b in zip(edges[:-1], edges[1:]):
            keys[a:b].sort()
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (block[1:] != block[:-1])
        at, keys = at[new], keys[new] & _WORD
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        n = np.diff(np.append(begin, len(at)))
        line = at[begin]
        out = Sets(np.array([i for i, _, _ in piece])[of[line]], number[line], begin, n, keys)
        yield out.only(n >= floor) if floor > 1 else out


#: odd numbers by which the words of a shingle are told apart
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(texts: list[bytes | None], k: int):
    """:class:`Sets` of whole texts: their different runs of ``k`` words (8 at most), of all words where there are fewer.  Texts
    without words are left out."""
    held, size = [], 0
    for i, t in enumerate([*texts, None]):
        if t:
            held.append((i, 0, t))
            size += len(t)
        if not held or i < len(texts) and size < SLICE_BYTES and len(held) < 1 << SLICE_BITS:
            continue
        start, h = _words(_joined(held))
        at = np.searchsorted(np.cumsum([len(t) + 1 for _, _, t in held]), start, side="right")
        count = np.bincount(at, minlength=len(held))
        first = np.cumsum(count) - count
        whole = np.flatnonzero((count > 0) & (count < k))
        runs = max(0, len(h) - k + 1)
        total = np.zeros(runs, np.uint64)
        for j in range(k):
            total += h[j : j + runs] * _PLACES[j]
        inside = at[:runs] == at[k - 1 :] if runs else np.zeros(0, bool)
        few = np.array([(h[first[x] : first[x] + count[x]] * _PLACES[: count[x]]).sum(dtype=np.uint64) + np.uint64(count[x]) for x in whole], np.uint64)
        of = np.concatenate([at[:runs][inside], whole])
        keys = (of.astype(np.uint64) << np.uint64(WORD_BITS)) | (mix(np.concatenate([total[inside], few])) & _WORD)
        keys = np.unique(keys)
        of = (keys >> np.uint64(WORD_BITS)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        yield Sets(np.array([i for i, _, _ in held])[of[begin]], np.zeros(len(begin), np.int64), begin, np.diff(np.append(begin, len(of))), keys & _WORD)
        held, size = [], 0


def bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(WORD_BITS - BUCKET_BITS)).astype(np.int64)


def ranks(counts: np.ndarray) -> np.ndarray:
    """How common, in a byte: 0 for one line at most, else eight steps for each doubling."""
    return np.where(counts > 1, np.minimum(1 + np.floor(8 * np.log2(np.maximum(counts, 1))), 255), 0).astype(np.uint8)


def rank_of(count: int) -> int:
    return int(ranks(np.array([count]))[0])


def most(rank: np.ndarray) -> np.ndarray:
    """An upper bound of the lines of a rank."""
    return np.exp2(rank / 8)


#: a word's place in the order: its rank, then this many bits of its hash
TOKEN = 32


def prefixes(sets: Sets, rank: np.ndarray, more: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The rarest words of each set as (number of them, rank << TOKEN | hash): its prefix and ``more``.

    Words that share rank and hash are one to the join, twice in a set where both are in it, which hides no match."""
    seen = rank[bucket(sets.words)].astype(np.uint64)
    token = (seen << np.uint64(TOKEN)) | (sets.words >> np.uint64(WORD_BITS - TOKEN))
    of = np.repeat(np.arange(len(sets.n)), sets.n)
    for a in range(0, len(sets.n), 1 << SLICE_BITS):
        b = min(len(sets.n), a + (1 << SLICE_BITS))
        part = slice(sets.start[a], sets.start[b - 1] + sets.n[b - 1])
        keyed = ((of[part] - a).astype(np.uint64) << np.uint64(WORD_BITS)) | token[part]
        keyed.sort()
        token[part] = keyed & _WORD
    take = np.minimum(prefix_of(sets.n) + more, sets.n)
    inside = np.arange(len(of)) - sets.start[of] < take[of]
    return take, token[inside]


def packed(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def binaries(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Arrow's binary values of ``sizes`` bytes each, one after the other in ``raw``."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])


def unpacked(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.view("<u8").reshape(-1)


def lookups(n: np.ndarray, size: np.ndarray, token: np.ndarray, common: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, place of the key's first word, upper bound of its lines) by which sets meet; ``size`` tokens of each of them.

    A word of more than ``common`` lines is not looked up by itself: if it is the first that two sets share, their second is
    within prefixes one word longer, so it goes in pairs.  Sets of ``long`` words go by single words, whatever their count,
    and meet among themselves; those of fewer than 5/4 of it go as all others too."""
    of = np.repeat(np.arange(len(n)), size)
    pos = np.arange(len(token)) - (np.cumsum(size) - size)[of]
    seen = token >> np.uint64(TOKEN)
    short = prefix_of(n)
    inside, usual = pos < short[of], (n * 4 <= long * 5)[of]
    rare = seen <= np.uint64(rank_of(common))
    alone, far = inside & usual & rare & (seen > 0), inside & (n >= long)[of] & (seen > 0)
    out = [(of[alone], mix(token[alone], 4), pos[alone], seen[alone]), (of[far], mix(token[far], 5), pos[far], seen[far])]
    at, step = np.flatnonzero(inside & usual & ~rare), 1
    while len(at):
        at = at[(pos[at] + step <= short[of[at]]) & (pos[at] + step < size[of[at]])]
        out.append((of[at], mix(token[at], 6) + mix(token[at + step], 7), pos[at], seen[at]))
        step += 1
    of, key, pos, seen = (np.concatenate(x) for x in zip(*out))
    return of, key, pos, most(seen.astype(np.int64))


@dataclass
class Postings:
    """Sets under a key, in order of key and size: number, words, place, sketches; ``part``: the key has further parts."""

    key: np.ndarray
    num: np.ndarray
    n: np.ndarray
    pos: np.ndarray
    part: np.ndarray
    one: np.ndarray
    two: np.ndarray
    ask: np.ndarray | None = None

    def __post_init__(self):
        up, down = SIMILAR
        self._room = ((down + up) * (self.n - self.pos)).astype(np.int32)  # both sides of the positional filter, times nine
        self._share = (up * self.n).astype(np.int32)

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that pass the positional filter and the sketch; words that differ at least."""
        ok = np.minimum(self._room[i], self._room[j]) >= self._share[i] + self._share[j]
        i, j = i[ok], j[ok]
        up, down = SIMILAR
        both = self.n[i] + self.n[j]
        a, b = self.one[i] ^ self.one[j], self.two[i] ^ self.two[j]
        wide = np.minimum(self.n[i], self.n[j]) >= WIDE
        apart = np.where(wide, np.bitwise_count(b).astype(np.int16) + np.bitwise_count(a ^ b), np.bitwise_count(a)).astype(np.int16)
        good = (apart <= both - 2 * -(-both * up // (up + down))) & (self.num[i] != self.num[j])
        return i[good], j[good], apart[good]


#: bits of a set's size in the order of postings (larger sets count as that), pairs that are looked at at once
_SIZE, _PAIRS = 24, 1 << 18


def place(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By key (of 40 bits), then by size: sets of like size lie side by side."""
    return (key << np.uint64(_SIZE)) | np.minimum(n, (1 << _SIZE) - 1).astype(np.uint64)


def _meeting(p: Postings):
    """Pairs of places that share a key and are of like size (the length filter), in blocks: of any two, or with ``ask`` (one that
    does not ask, one that does)."""
    up, down = SIMILAR
    at = place(p.key, p.n)
    if p.ask is None:
        row = np.arange(len(at))
        low = row + 1
    else:
        row = np.flatnonzero(p.ask)
        low = np.searchsorted(at, place(p.key[row], -(-p.n[row] * up // down)))
    room = np.searchsorted(at, place(p.key[row], p.n[row] * down // up), side="right") - low
    use = room > 0
    row, low, room = row[use], low[use], room[use]
    total = np.cumsum(room)
    start = 0
    while start < len(row):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _PAIRS, side="right")))
        r, k = row[start:stop], room[start:stop]
        j = np.repeat(r, k)
        i = np.arange(len(j)) + np.repeat(low[start:stop] - (np.cumsum(k) - k), k)
        start = stop
        if p.ask is not None:
            use = ~p.ask[i]
            i, j = i[use], j[use]
        yield i, j


def matches(p: Postings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, earlier line, distance, whether it may have others) by number, from postings in the order of :func:`place`.

    Each line names the nearest that it may be similar to.  One that names none may still have some in other parts of its
    key: it names -1.  With ``ask``, all pairs of a line that asks with one that does not."""
    found = []
    for i, j in _meeting(p):
        i, j, apart = p.near(i, j)
        late = p.num[i] < p.num[j]
        if p.ask is None:
            i, j = np.where(late, i, j), np.where(late, j, i)
        else:
            i, j, apart = i[late], j[late], apart[late]
        found.append((j, i, apart))
    j, i, apart = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16))
    if p.ask is not None:
        return p.num[j], p.num[i], apart, np.zeros(len(j), bool)
    # of each j the nearest, of those the earliest: by minima, for a sort of all pairs costs more than finding them
    near = np.full(len(p.num), np.iinfo(np.int16).max, np.int16)
    np.minimum.at(near, j, apart)
    nearest = apart == near[j]
    low = np.full(len(p.num), np.iinfo(np.int64).max)
    np.minimum.at(low, j[nearest], p.num[i[nearest]])
    count = np.bincount(j, minlength=len(p.num))
    at = np.flatnonzero(count)
    alone = p.part.copy()
    alone[at] = False
    alone = np.flatnonzero(alone)
    more = np.concatenate([(count[at] > 1) | p.part[at], np.ones(len(alone), bool)])
    return np.concatenate([p.num[at], p.num[alone]]), np.concatenate([low[at], np.full(len(alone), -1)]), np.concatenate([near[at], np.full(len(alone), 1 << 14, np.int16)]), more


def similar(pair_a: list[bytes], pair_b: list[bytes], width: int) -> np.ndarray:
    """Whether the sets, packed words of ``width`` bytes each, are of Jaccard similarity ``SIMILAR`` or more."""
    out = np.zeros(len(pair_a), bool)
    up, down = SIMILAR
    for s in range(0, len(pair_a), 1 << SLICE_BITS):
        a, b = pair_a[s : s + (1 << SLICE_BITS)], pair_b[s : s + (1 << SLICE_BITS)]
        na, nb = (np.array([len(x) // width for x in c]) for c in (a, b))
        keys = [(np.repeat(np.arange(len(c)), n).astype(np.uint64) << np.uint64(WORD_BITS)) | unpacked(np.frombuffer(b"".join(c), np.uint8), width) for c, n in ((a, na), (b, nb))]
        both = np.concatenate(keys)
        both.sort()
        twice = both[1:][both[1:] == both[:-1]] >> np.uint64(WORD_BITS)
        shared = np.bincount(twice.astype(np.int64), minlength=len(a))
        out[s : s + len(a)] = shared * down >= (na + nb - shared) * up
    return out

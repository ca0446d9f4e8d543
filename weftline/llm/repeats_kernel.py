"""Anchors, contexts and the common-prefix interval tree, for one text or one group of contexts."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

LENGTH = 400
GRAM = 32
_PLACE = 20  # bits of a place within a chunk
_CHUNK = (1 << _PLACE) - LENGTH
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(_CHUNK + LENGTH, _BASE, np.uint64), np.full(_CHUNK + LENGTH, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` bytes that depends on those bytes alone."""
    up, down = _powers()
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
    h = (total[gram:] - total[:-gram]) * down[: len(b) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, left, right) of the anchors of ``raw``.

    Every string of ``length`` bytes has one anchor: its ``gram`` with the smallest hash, the first of equals.  An anchor owns a
    run of neighbouring strings; they lie in [place - left, place + right).  Equal strings own equal anchors at equal places."""
    out = [np.zeros((4, 0), np.int64)]
    for at in range(0, max(0, len(raw) - length + 1), _CHUNK):
        b = np.frombuffer(raw, np.uint8, min(_CHUNK + length - 1, len(raw) - at), at)
        h = _gram_hashes(b, gram)
        place = (_sliding_min(h >> np.uint64(_PLACE) << np.uint64(_PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        p = place[first]
        out.append(np.stack([h[p].view(np.int64), p + at, p - first, last + length - p]))
    return tuple(np.concatenate(out, axis=1))


def _common(a: bytes, b: bytes) -> int:
    return len(os.path.commonprefix((a, b)))


def repeat_groups(rights: list[bytes], lefts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, list[int]]]:
    """(left, right, members) of the maximal repeats around one anchor: strings of ``length`` bytes or more, ``left`` of them before the
    anchor, that all members share and no longer string does.

    ``rights`` are the bytes from the anchor on, ``lefts`` those before it, reversed; all contexts differ and share the anchor.
    The sorted ``rights`` are the suffix array; a stack runs over the lengths of common prefixes of neighbours and yields the
    intervals of the prefix tree, each with its children.  The members of an interval are then scanned in the order of their left sides,
    by a stack again: a run that shares enough to the left, and parts there (left-extension diversity, as it is an interval of
    left sides), is a group if it takes members of two children, so that it parts to the right, too."""
    n = len(rights)
    order = sorted(range(n), key=rights.__getitem__)
    by_left = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for i, x in enumerate(by_left):
        rank[x] = i
    beside = [_common(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:])]
    found: list[tuple[int, int, list[int]]] = []

    def close(children: list[list[int]], common: int) -> None:
        need = max(0, length - common)
        child = {m: k for k, members in enumerate(children) for m in members}
        at = sorted((rank[m], m) for m in child)
        stack: list[tuple[int, list[int]]] = []
        for k, (r, m) in enumerate(at):
            here = [m]
            shared = -1 if k + 1 == len(at) else beside[r] if at[k + 1][0] == r + 1 else min(beside[r : at[k + 1][0]])
            while stack and stack[-1][0] > shared:
                depth, members = stack.pop()
                here = members + here
                if depth >= need and len({child[x] for x in here}) > 1:
                    found.append((depth, common, list(here)))
            if stack and stack[-1][0] == shared:
                stack[-1][1].extend(here)
            elif shared >= 0:
                stack.append((shared, here))

    stack: list[tuple[int, list[list[int]]]] = []  # (common prefix, children so far)
    for k in range(n):
        here = [order[k]]
        common = _common(rights[order[k]], rights[order[k + 1]]) if k + 1 < n else -1
        while stack and stack[-1][0] > common:
            depth, children = stack.pop()
            children.append(here)
            close(children, depth)
            here = [m for c in children for m in c]
        if stack and stack[-1][0] == common:
            stack[-1][1].append(here)
        elif common >= 0:
            stack.append((common, [here]))
    return found


def covers(rights: list[bytes], lefts: list[bytes], length: int = LENGTH) -> list[tuple[int, int]]:
    """(left, right) for each context: the bytes before and after its anchor that lie in a repeated string, those of all its groups of
    :func:`repeat_groups` together (each holds the anchor, so they are one run); (0, 0) if none."""
    left, right = [0] * len(rights), [0] * len(rights)
    for a, b, members in repeat_groups(rights, lefts, length):
        for m in members:
            left[m], right[m] = max(left[m], a), max(right[m], b)
    return list(zip(left, right))

"""Deep-shallow sorting of suffixes, all groups of a buffer at once.

Shallow: multikey quicksort over characters of eight bytes, to a depth of ``shallow`` bytes; suffixes that are alone
with their prefix by then are done. Deep: what still shares its prefix is ordered by blind tries. A trie is built along
the path of one suffix of the group, its pivot: each other suffix leaves that path at its first differing byte, so that
depth and byte are all a node holds, and suffixes leaving at the same node with the same byte form the next group.
"""

from __future__ import annotations

import numpy as np

STEP = 8
ROWS = 1 << 16  #: suffixes compared with their pivots at once


def _ranked(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order by group, then key."""
    return np.lexsort((key, group))


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """Numbers that rise where any of the sorted keys changes."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _tied(number: np.ndarray) -> np.ndarray:
    """Of sorted numbers, those that stand there more than once."""
    same = number[1:] == number[:-1]
    out = np.zeros(len(number), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def suffix_order(buf: np.ndarray, start: np.ndarray, group: np.ndarray, length: int, shallow: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(order, number): the suffixes at ``start``, cut at ``length`` bytes, sorted within their groups, and for each
    place of the order a number that two places share if group and all ``length`` bytes are equal."""
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(group, kind="stable")
    number = _numbered(group[order])
    shallow = min(shallow, length // STEP * STEP)
    view = np.lib.stride_tricks.sliding_window_view(buf, length)
    for depth in range(0, shallow, STEP):
        at = np.flatnonzero(_tied(number))
        if not len(at):
            break
        char = np.ascontiguousarray(view[start[order[at]], depth : depth + STEP]).view(">u8").ravel().astype(np.uint64)
        by = _ranked(number[at], char)
        order[at] = order[at[by]]
        number = _split(number, at, char[by])
    done = np.zeros(n, bool)
    while True:
        at = np.flatnonzero(_tied(number) & ~done)
        if not len(at):
            break
        mine = number[at]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        pivot = at[first][np.cumsum(np.concatenate([[0], (mine[1:] != mine[:-1]).astype(np.int64)]))]
        node = _leaves(view, start[order[at]], start[order[pivot]], shallow, length)
        by = _ranked(mine, node)
        order[at] = order[at[by]]
        done[at] = node[by] == _MIDDLE
        number = _split(number, at, node[by])
    return order, number


_MIDDLE = np.int64(1) << 40


def _leaves(view: np.ndarray, start: np.ndarray, pivot: np.ndarray, from_: int, length: int) -> np.ndarray:
    """Where each suffix leaves its pivot's path, as a key that sorts like the suffixes: below the pivot, the sooner the
    smaller; above it, the sooner the larger; ``_MIDDLE``: equal."""
    out = np.empty(len(start), np.int64)
    for i in range(0, len(start), ROWS):
        a, b = view[start[i : i + ROWS], from_:length], view[pivot[i : i + ROWS], from_:length]
        differs = a != b
        depth = np.argmax(differs, axis=1)
        row = np.arange(len(a))
        x, y = a[row, depth].astype(np.int64), b[row, depth].astype(np.int64)
        out[i : i + ROWS] = np.where(~differs[row, depth], _MIDDLE, np.where(x < y, depth * 256 + x, 2 * _MIDDLE - (depth + 1) * 256 + x))
    return out


def _split(number: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The numbers anew where the groups at ``at`` (whole groups, sorted) now differ by ``key``."""
    new = np.zeros(len(number), np.int64)
    new[1:] = number[1:] != number[:-1]
    inner = np.zeros(len(at), bool)
    inner[1:] = (number[at][1:] == number[at][:-1]) & (key[1:] != key[:-1])
    new[at] |= inner
    return np.cumsum(new)

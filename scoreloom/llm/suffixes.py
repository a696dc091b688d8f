"""Deep-shallow sorting of suffixes that start at given places of a byte buffer."""

from __future__ import annotations

import numpy as np

#: Bytes sorted by multikey quicksort, a machine word at a time, before tries take over.
SHALLOW = 16


class BlindTrie:
    """A trie that keeps only the depths at which its strings branch.

    A new string first walks down by the bytes at those depths alone; the one
    leaf it ends at tells the true common prefix, and with it the place to
    branch. Equal strings share a leaf.
    """

    def __init__(self):
        self.root = None

    def add(self, s: bytes, tag: int) -> None:
        if self.root is None:
            self.root = (s, [tag])
            return
        node = self.root
        while type(node) is list:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if s == other:
            node[1].append(tag)
            return
        depth = next(i for i in range(len(s)) if s[i] != other[i])
        above, node = None, self.root
        while type(node) is list and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        leaf = (s, [tag])
        if type(node) is list and node[0] == depth:
            node[1][s[depth]] = leaf
            return
        branch = [depth, {s[depth]: leaf, other[depth]: node}]
        if above is None:
            self.root = branch
        else:
            above[1][s[above[0]]] = branch

    def in_order(self) -> list[list[int]]:
        """The tags of equal strings, by the strings' order."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            elif node is not None:
                out.append(node[1])
        return out


def _partitioned(order: np.ndarray, fresh: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort each group of an order by one more machine word: three-way quicksort of all groups at a time.

    ``fresh`` marks where groups begin. In each round every group that is not
    of one word is parted about the word in its middle; what is equal to it is
    settled for this word and waits for the next one.
    """
    order, fresh, left = order.copy(), fresh.copy(), np.arange(len(order))
    while len(left):
        own, begin = order[left], np.flatnonzero(fresh[left])
        size = np.diff(np.append(begin, len(left)))
        group = np.repeat(np.arange(len(begin)), size)
        word = key[own]
        pivot = word[begin + size // 2][group]
        side = (word >= pivot).astype(np.int8) + (word > pivot)
        place = begin[group]
        starts = [begin]
        for s in range(3):
            mine = side == s
            upto = np.append(0, np.cumsum(mine))
            n = upto[begin + size] - upto[begin]
            here = starts[-1]
            place[mine] = (here[group] + upto[:-1] - upto[begin][group])[mine]
            starts.append(here + n)
        parted = np.empty_like(own)
        parted[place] = own
        order[left] = parted
        sides = np.empty_like(side)
        sides[place] = side
        for first, end in zip(starts[:-1], starts[1:], strict=True):
            fresh[left[first[end > first]]] = True
        left = left[sides != 1]
        # a group of one is settled
        alone = fresh[left] & np.append(fresh[left][1:], True) if len(left) else fresh[left]
        left = left[~alone]
    return order, fresh


def equal_runs(buf: np.ndarray, start: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the strings of ``length`` bytes at ``start`` by (first, bytes); the order, and where a new string begins.

    The first SHALLOW bytes are sorted by multikey quicksort, a machine word at
    a time: groups that are equal in one word are parted by the next. Groups
    that share the whole shallow prefix are ordered by blind tries.
    """
    order = np.argsort(first, kind="stable")
    f = first[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = f[1:] != f[:-1]
    for depth in range(0, SHALLOW, 8):
        alone = fresh & np.append(fresh[1:], True)
        if alone.all():
            return order, fresh
        more = np.flatnonzero(~alone)
        word = np.zeros(len(start), np.uint64)
        word[order[more]] = buf[start[order[more], None] + np.arange(depth, depth + 8)].view(">u8").ravel()
        order[more], fresh[more] = _partitioned(order[more], fresh[more], word)
    begin = np.flatnonzero(fresh)
    for lo, hi in zip(begin, np.append(begin[1:], len(order)), strict=True):
        if hi - lo == 1:
            continue
        trie = BlindTrie()
        for i in order[lo:hi].tolist():
            at = int(start[i])
            trie.add(buf[at : at + length].tobytes(), i)
        place = lo
        for tags in trie.in_order():
            order[place : place + len(tags)] = tags
            fresh[place] = True
            place += len(tags)
    return order, fresh

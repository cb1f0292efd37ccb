"""Double-array tries of byte strings, built and walked in numpy."""

from __future__ import annotations

import io

import numpy as np

_DEAD = 256  # slots before the first run, so that no sum of base and code points before the array


class Trie:
    """A state is a slot. From state s the byte with code c leads to slot base[s] + c if check holds s there.

    accept[s] is the number of the key that ends in s, or -1. Code 0 stands for bytes that no key has.
    """

    def __init__(self, base: np.ndarray, check: np.ndarray, accept: np.ndarray, codes: np.ndarray, ids: np.ndarray) -> None:
        self.base, self.check, self.accept, self.codes, self.ids = base, check, accept, codes, ids

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, base=self.base, check=self.check, accept=self.accept, codes=self.codes, ids=self.ids)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Trie:
        return cls(**np.load(io.BytesIO(data)))

    def step(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, which of them exist) after a byte each."""
        codes = self.codes[data]
        found = self.base[states] + codes
        return found, (self.check[found] == states) & (codes > 0)

    def walk(self, key: bytes) -> int:
        """The state after the key's bytes from the root, or -1."""
        state = np.zeros(1, np.int32)
        for b in key:
            state, there = self.step(state, np.array([b], np.uint8))
            if not there[0]:
                return -1
        return int(state[0])


def build(keys: list[bytes], ids: np.ndarray) -> Trie:
    """The trie of distinct, non-empty keys; ids[i] belongs to keys[i].

    Keys are sorted and read one byte deeper at a time, all keys at once: a key opens a node where it differs from the key
    before it. A node with several children takes a run of slots of its own, as wide as their codes; single children then
    fill the slots that these runs leave free.
    """
    order = sorted(range(len(keys)), key=keys.__getitem__)
    data = np.frombuffer(b"".join(keys[i] for i in order), np.uint8)
    ids = np.asarray(ids, np.int64)[order]
    lengths = np.array([len(keys[i]) for i in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)

    parents, letters, n_nodes, depth = [np.zeros(1, np.int64)], [np.zeros(1, np.uint8)], 1, 0
    node, same = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
    same[:1] = False
    ends, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
    while len(alive := alive[lengths[alive] > depth]):
        letter, before = data[starts[alive] + depth], np.maximum(alive - 1, 0)
        there = lengths[before] > depth
        same[alive] &= there & (letter == data[np.where(there, starts[before] + depth, 0)])
        new = ~same[alive]
        parents.append(node[alive[new]])
        letters.append(letter[new])
        node[alive] = n_nodes + np.cumsum(new) - 1
        n_nodes += int(new.sum())
        depth += 1
        ended = alive[lengths[alive] == depth]
        ends[ended] = node[ended]
    parent, letter = np.concatenate(parents)[1:], np.concatenate(letters)[1:]

    # Frequent bytes take the lowest codes, so that runs are short.
    often = np.bincount(letter, minlength=256)
    codes = np.zeros(256, np.int32)
    ranked = np.argsort(-often, kind="stable")
    codes[ranked] = np.where(often[ranked] > 0, np.arange(1, 257), 0)
    code = codes[letter].astype(np.int64)

    # Children of a node stand together; `first` is the place of its first child.
    heads = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(parent) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([heads, [len(parent)]]))
    low = np.minimum.reduceat(code, heads) if len(heads) else heads
    high = np.maximum.reduceat(code, heads) if len(heads) else heads
    branching = counts > 1
    width = (high - low + 1)[branching]
    run = _DEAD + np.concatenate([[0], np.cumsum(width)])
    base_of = np.zeros(n_nodes, np.int64)
    base_of[parent[heads[branching]]] = run[:-1] - low[branching]
    many = np.repeat(branching, counts)
    slot = np.zeros(n_nodes, np.int64)  # the root has slot 0
    kids = np.arange(1, n_nodes)
    slot[kids[many]] = base_of[parent[many]] + code[many]
    single = int((~many).sum())
    used = np.zeros(run[-1] + single, bool)
    used[:_DEAD] = True
    used[slot[kids[many]]] = True
    free = np.flatnonzero(~used)[:single]
    slot[kids[~many]] = free
    base_of[parent[~many]] = free - code[~many]

    size = len(used) + 257
    base, check, accept = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    base[slot] = base_of
    check[slot[1:]] = slot[parent]
    accept[slot[ends]] = np.arange(len(keys))
    return Trie(base, check, accept, codes, ids)

"""Burrows-Wheeler transforms of shards of short strings, merged by interleave refinement.

Rotations of the strings are compared by their first DEPTH bytes, two bytes a round. A merge starts from
the shards' rotations one shard after the other. A round sorts the interleave, stably, by the two bytes
that stand before each rotation, which the shards' transforms hold in their own order; after DEPTH / 2
rounds it is in order to DEPTH bytes, and no suffix has been sorted again. Where neighbours came apart in
a round their common prefix ends there; neighbours that never did share DEPTH bytes.
"""

from __future__ import annotations

import numpy as np


class ShardTransform:
    """Rotations of a shard's strings in order of their first depth bytes (order), and the two bytes before each (symbols)."""

    def __init__(self, strings: list[bytes], depth: int):
        text = np.frombuffer(b"".join(strings), np.uint8)
        lens = np.fromiter(map(len, strings), np.int64, len(strings))
        starts = np.cumsum(lens) - lens
        back = np.arange(len(text)) - 1  # the place before each place, around each string
        back[starts] += lens
        two_back = back[back]
        pairs = text[two_back].astype(np.uint16) << 8 | text[back]
        order = np.arange(len(text))
        for _ in range(depth // 2):
            order = two_back[order[np.argsort(pairs[order], kind="stable")]]
        self.order, self.symbols, self.strings = order, pairs[order], len(strings)


def merge(shards: list[ShardTransform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, block) in merged order. Rotations count through the shards' texts; rotations of one block share depth bytes."""
    sizes = [len(s.order) for s in shards]
    symbols = np.concatenate([s.symbols for s in shards])
    shard = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16), sizes)
    block = np.zeros(len(shard), np.int32)
    for _ in range(depth // 2):
        before = np.empty_like(symbols)
        before[np.argsort(shard, kind="stable")] = symbols
        move = np.argsort(before, kind="stable")
        shard, before, block = shard[move], before[move], block[move]
        apart = np.empty(len(block), bool)
        apart[:1] = False
        apart[1:] = (before[1:] != before[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(apart, dtype=np.int32)
    offsets = np.cumsum(sizes) - sizes
    rotation = np.empty(len(shard), np.int64)
    rotation[np.argsort(shard, kind="stable")] = np.concatenate([s.order + o for s, o in zip(shards, offsets)])
    return rotation, block


def repeated_windows(shards: list[list[bytes]], owners: np.ndarray, width: int) -> np.ndarray:
    """For each place of the shards' concatenated strings: does the string of width bytes that starts there also start in a string of a smaller owner?

    owners: one for each string, in the shards' order. Places with fewer than width bytes left are False.
    """
    strings = [x for s in shards for x in s]
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    rotation, block = merge([ShardTransform(s, width) for s in shards if s], width)
    ends = np.repeat(np.cumsum(lens), lens)
    valid = ends[rotation] - rotation >= width
    rotation, block = rotation[valid], block[valid]
    found = np.zeros(int(lens.sum()), bool)
    if len(rotation):
        owner = np.repeat(owners, lens)[rotation]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        least = np.repeat(np.minimum.reduceat(owner, starts), np.diff(np.r_[starts, len(block)]))
        found[rotation] = owner > least
    return found

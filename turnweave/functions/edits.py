"""Edit distances of many pairs of lists at once, by bit-parallel columns of the edit table (Myers 1999, Hyyrö 2003)."""

from __future__ import annotations

import numpy as np

Lists = tuple[np.ndarray, np.ndarray]  # codes of all members, and where each list's begin (one more at the end)
ONE = np.uint64(1)


def distances(a: Lists, b: Lists) -> np.ndarray:
    """The edit distance of the k-th list of ``a`` and the k-th of ``b``.

    A column of the edit table is held as two bit sets: where it rises and where it falls.  The
    shorter list of a pair lies along the bits.  Up to 64 members it is one machine word, and
    all such pairs take each step side by side; longer ones are whole numbers of as many bits.
    """
    (x, p), (y, q) = a, b
    n, m = np.diff(p), np.diff(q)
    out = np.maximum(n, m).astype(np.int64)
    both = (n > 0) & (m > 0)
    swap = n > m
    short, long = np.minimum(n, m), np.maximum(n, m)
    # one array for both sides; a pair's shorter list begins at s, its longer one at t
    codes = np.concatenate([x, y])
    s, t = np.where(swap, q[:-1] + len(x), p[:-1]), np.where(swap, p[:-1], q[:-1] + len(x))
    few = np.flatnonzero(both & (short <= 64))
    if len(few):
        out[few] = side_by_side(codes, s[few], short[few], t[few], long[few])
    for k in np.flatnonzero(both & (short > 64)):
        out[k] = one_pair(codes[s[k] : s[k] + short[k]].tolist(), codes[t[k] : t[k] + long[k]].tolist())
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, step, place) of all members of lists that begin at ``starts``."""
    pair = np.repeat(np.arange(len(starts)), lengths)
    step = np.arange(len(pair)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return pair, step, starts[pair] + step


def side_by_side(codes: np.ndarray, s: np.ndarray, short: np.ndarray, t: np.ndarray, long: np.ndarray) -> np.ndarray:
    order = np.argsort(-long, kind="stable")  # those that go on longest first
    s, short, t, long = s[order], short[order], t[order], long[order]
    width = int(codes.max()) + 1
    pair, step, place = spread(s, short)
    keys, at = np.unique(pair * width + codes[place], return_inverse=True)
    masks = np.zeros(len(keys) + 1, np.uint64)  # the last one: a member that the shorter list lacks
    np.bitwise_or.at(masks, at, ONE << step.astype(np.uint64))
    pair, step, place = spread(t, long)
    wanted = pair * width + codes[place]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    equal = masks[np.where(keys[at] == wanted, at, len(keys))]
    # by step, and within a step by pair: so the pairs that are left are the first ones
    equal = equal[np.lexsort((pair, step))]
    active = np.bincount(step)
    rise, fall = np.full(len(s), ~np.uint64(0)), np.zeros(len(s), np.uint64)
    score, shift = short.astype(np.int64), (short - 1).astype(np.uint64)
    begin = 0
    for k in active.tolist():
        eq, up, down = equal[begin : begin + k], rise[:k], fall[:k]
        begin += k
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(zero | up), up & zero
        score[:k] += ((plus >> shift[:k]) & ONE).astype(np.int64) - ((minus >> shift[:k]) & ONE).astype(np.int64)
        plus, minus = (plus << ONE) | ONE, minus << ONE
        rise[:k], fall[:k] = minus | ~(zero | plus), plus & zero
    out = np.empty(len(s), np.int64)
    out[order] = score
    return out


def one_pair(short: list[int], long: list[int]) -> int:
    masks: dict[int, int] = {}
    for i, w in enumerate(short):
        masks[w] = masks.get(w, 0) | 1 << i
    every, last, score = (1 << len(short)) - 1, len(short) - 1, len(short)
    rise, fall = every, 0
    for w in long:
        eq = masks.get(w, 0)
        zero = ((((eq & rise) + rise) ^ rise) | eq | fall) & every
        plus, minus = fall | ~(zero | rise) & every, rise & zero
        score += (plus >> last & 1) - (minus >> last & 1)
        plus, minus = (plus << 1 | 1) & every, minus << 1 & every
        rise, fall = minus | ~(zero | plus) & every, plus & zero
    return score

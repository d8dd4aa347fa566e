"""Longest common subsequences of many pairs of texts at once: Hyyro's bit-vector recurrence over numpy lanes.

A pair's row of the dynamic programme is one bit a character of its first text, in 64-bit words. All pairs of a batch
take one character of their second text a step, so a step costs a few array operations whatever the number of pairs.
Where one text meets many, these stand in Columns, one place of all in a row, and no step gathers from far apart.
"""

from __future__ import annotations

import numpy as np

#: Words of rows and masks that are held at once.
HELD = 1 << 21
#: Texts of Columns that take a step together, so that their rows stay in a core's cache.
ABREAST = 4096
#: Bits of a row's word in Columns; the last one holds what is carried on.
BITS, FULL = 63, np.uint64((1 << 63) - 1)


class Texts:
    """Texts as code points, one after the other."""

    def __init__(self, texts: list[str]) -> None:
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)

    def __len__(self) -> int:
        return len(self.lengths)

    def bags(self, classes: int) -> np.ndarray:
        """Counts of the texts' code points by remainder."""
        text = np.repeat(np.arange(len(self)), self.lengths)
        return np.bincount(text * classes + self.codes % classes, minlength=len(self) * classes).reshape(-1, classes).astype(np.int32)


def lcs_lengths(left: Texts, right: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of left[a[i]] and right[b[i]] for every i."""
    out = np.zeros(len(a), np.int64)
    if not len(a):
        return out
    seen = np.zeros(int(max(left.codes.max(initial=0), right.codes.max(initial=0))) + 1, bool)
    seen[left.codes] = seen[right.codes] = True
    number = np.cumsum(seen) - 1
    left_ids, right_ids, n_codes = number[left.codes], number[right.codes], int(number[-1]) + 1
    words = (left.lengths[a] + 63) >> 6
    # Pairs of as many words together; of those, pairs of the same first text, whose masks are shared.
    order = np.lexsort((a, words))
    begun = 0
    while begun < len(order):
        w = int(words[order[begun]])
        stop = begun + int(np.searchsorted(words[order[begun:]], w, "right"))
        if w:
            # Never more first texts at once than their masks may take.
            texts = max(1, HELD // (w * n_codes))
            new = np.cumsum(np.concatenate([[0], np.diff(a[order[begun:stop]]) != 0]))
            stop = begun + int(np.searchsorted(new, texts, "left"))
            stop = min(stop, begun + max(1, HELD // w))
            some = order[begun:stop]
            out[some] = _batch(left, left_ids, right, right_ids, a[some], b[some], w, n_codes)
        begun = stop
    return out


def _batch(left: Texts, left_ids: np.ndarray, right: Texts, right_ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: int, n_codes: int) -> np.ndarray:
    distinct, which = np.unique(a, return_inverse=True)
    masks = np.zeros((len(distinct), n_codes, w), np.uint64)
    for i, t in enumerate(distinct.tolist()):
        at = np.arange(left.lengths[t])
        np.bitwise_or.at(masks[i], (left_ids[left.starts[t] : left.starts[t + 1]], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    # Longest second texts first: those still running are a prefix.
    order = np.argsort(-right.lengths[b], kind="stable")
    which, starts, lengths = which[order], right.starts[b[order]], right.lengths[b[order]]
    live = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")
    row = np.full((w, len(order)), np.iinfo(np.uint64).max, np.uint64)
    flat = masks.reshape(-1, w)
    for step, m in enumerate(live.tolist()):
        held = flat[which[:m] * n_codes + right_ids[starts[:m] + step]]
        carry = np.zeros(m, np.uint64)
        for k in range(w):
            r = row[k, :m]
            u = r & held[:, k]
            total = r + u
            over = total < r
            if w > 1:
                total = total + carry
                carry = (over | (total < carry)).astype(np.uint64)
            row[k, :m] = total | (r & ~u)
    # A bit that has gone is a character of the subsequence; bits beyond the text were never in a mask, so they stay.
    found = np.empty(len(order), np.int64)
    found[order] = w * 64 - np.bitwise_count(row).sum(axis=0, dtype=np.int64)
    return found


class Columns:
    """Texts in the order of their lengths, one place of all in a row: each can be compared with a text at once."""

    def __init__(self, texts: Texts) -> None:
        self.lengths = texts.lengths
        seen = np.zeros(int(texts.codes.max(initial=0)) + 1, bool)
        seen[texts.codes] = True
        number = np.cumsum(seen)  # from 1; 0 is none of them
        self.number, self.n_codes = np.where(seen, number, 0), int(number[-1]) + 1
        kind = np.uint8 if self.n_codes < 1 << 8 else np.uint16 if self.n_codes < 1 << 16 else np.uint32
        self.rows = np.zeros((int(self.lengths.max(initial=0)), len(texts)), kind)
        of = np.repeat(np.arange(len(texts)), self.lengths)
        self.rows[np.arange(len(of)) - texts.starts[of], of] = number[texts.codes]

    def masks(self, codes: np.ndarray) -> np.ndarray:
        found = np.zeros((max(1, -(-len(codes) // BITS)), self.n_codes), np.uint64)
        at = np.arange(len(codes))
        ids = np.where(codes < len(self.number), self.number[np.minimum(codes, len(self.number) - 1)], 0)
        np.bitwise_or.at(found, (at // BITS, ids), np.uint64(1) << (at % BITS).astype(np.uint64))
        found[:, 0] = 0
        return found

    def lcs(self, codes: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of the text of these code points and each text of some, in ascending order."""
        masks = self.masks(codes)
        return np.concatenate([self._lcs(masks, some[i : i + ABREAST]) for i in range(0, len(some), ABREAST)] or [np.zeros(0, np.int64)])

    def _lcs(self, masks: np.ndarray, some: np.ndarray) -> np.ndarray:
        lengths, w = self.lengths[some], len(masks)
        row = np.full((w, len(some)), FULL)
        held, total, carry = (np.zeros(len(some), np.uint64) for _ in range(3))
        # The shortest come first, so those still running are the last ones.
        for step, ended in enumerate(np.searchsorted(lengths, np.arange(int(lengths[-1])), "right").tolist()):
            at = self.rows[step].take(some[ended:]).astype(np.intp)
            u, t, c = held[ended:], total[ended:], carry[ended:]
            for k in range(w):
                r = row[k, ended:]
                masks[k].take(at, out=u, mode="clip")
                np.bitwise_and(u, r, out=u)
                np.add(r, u, out=t)
                if k:
                    np.add(t, c, out=t)
                np.bitwise_xor(r, u, out=r)
                np.bitwise_or(r, t, out=r)
                if k + 1 < w:
                    np.right_shift(t, BITS, out=c)
                    np.bitwise_and(r, FULL, out=r)
        return w * BITS - np.bitwise_count(row & FULL).sum(axis=0, dtype=np.int64)

"""Word differences of two versions: a shortest edit script, one Arrow-batched pass a text.

A row of the table of common subsequences is one long integer with a bit a token (Hyyro's recurrence), so a token of the old
version costs a few operations on integers. Only some rows are kept; the way back computes the ones between again.

Long versions are first tried by Myers' greedy O(ND) method, which is faster where few tokens differ: each step widens the band
of diagonals by one and moves all of them at once over numpy arrays. Only every STRIDE-th band is kept; the way back computes the
ones between again, so a script of D edits needs about D * sqrt(D) numbers. Both ways give the same script.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bands between two that are kept.
STRIDE = 128
#: Pairs of tokens from which versions are long.
LONG = 1 << 24
#: A word with the white space after it, or white space at the beginning.
TOKENS = re.compile(r"\s+|\S+\s*")


#: The place on a diagonal that no path has reached within the texts.
NOWHERE = -(1 << 40)


def _slide(a: np.ndarray, b: np.ndarray, x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Furthest x of each diagonal k along equal tokens."""
    live = np.flatnonzero(x >= 0)
    while len(live):
        at = x[live]
        live = live[(at < len(a)) & (at - k[live] < len(b))]
        live = live[a[x[live]] == b[x[live] - k[live]]]
        x[live] += 1
    return x


def _sources(band: np.ndarray, d: int, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Where an added and a removed token lead from the band of d - 1 edits, on the diagonals -d, -d + 2, ..., d."""
    added = np.append(band, NOWHERE)
    removed = np.insert(band, 0, NOWHERE) + 1
    k = np.arange(-d, d + 1, 2)
    return np.where((added < 0) | (added - k > m), NOWHERE, added), np.where((removed < 0) | (removed > n), NOWHERE, removed)


def _widened(a: np.ndarray, b: np.ndarray, band: np.ndarray, d: int) -> np.ndarray:
    """The furthest x on the diagonals -d, -d + 2, ..., d after d edits, from that of d - 1."""
    return _slide(a, b, np.maximum(*_sources(band, d, len(a), len(b))), np.arange(-d, d + 1, 2))


def edits(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of a are removed and which of b are added by a shortest edit script: of equally short ones, from the end
    on, what is added first, then what is removed, then what both have."""
    n, m = len(a), len(b)
    # Bands cost the square of the edits, rows a bit a pair of tokens.
    few = _edits_in_bands(a, b, math.isqrt(n * m) // 8) if n * m > LONG else None
    return few or _edits_in_rows(a, b)


def _rows(a: list[int], at: dict[int, int], full: int, row: int) -> Iterator[int]:
    """The rows behind each token of a: bit j is 0 where the first j + 1 tokens of b have one more in common with a than the first j."""
    for w in a:
        held = row & at.get(w, 0)
        row = ((row + held) | (row - held)) & full
        yield row


def _edits_in_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, m = len(a), len(b)
    gone, new = np.zeros(n, bool), np.zeros(m, bool)
    left, full, size = a.tolist(), (1 << m) - 1, (m + 7) // 8
    at = _places(b)
    stride = math.isqrt(n) + 1
    kept, row = [full], full
    for x, row in enumerate(_rows(left, at, full, full), 1):
        if x % stride == 0:
            kept.append(row)
    x, y, low, rows = n, m, n + 1, []
    while x or y:
        if x and x - 1 < low:
            low = (x - 1) // stride * stride
            rows = [r.to_bytes(size, "little") for r in (kept[low // stride], *_rows(left[low:x], at, full, kept[low // stride]))]
        if not x:
            new[:y] = True
            break
        place, bit = (y - 1) >> 3, 1 << ((y - 1) & 7)
        if y and rows[x - low][place] & bit:
            y -= 1
            new[y] = True
        elif not y or not rows[x - 1 - low][place] & bit:
            x -= 1
            gone[x] = True
        else:
            x, y = x - 1, y - 1
    return gone, new


def _places(b: np.ndarray) -> dict[int, int]:
    """The places of each token of b, as bits."""
    if len(b) <= 4096:  # short integers are quicker one by one
        out: dict[int, int] = {}
        for place, w in enumerate(b.tolist()):
            out[w] = out.get(w, 0) | 1 << place
        return out
    order = np.argsort(b, kind="stable")
    ends = np.flatnonzero(np.diff(b[order])) + 1
    out = {}
    for places in np.split(order, ends) if len(b) else []:
        bits = np.zeros((int(places[-1]) >> 3) + 1, np.uint8)
        np.bitwise_or.at(bits, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))
        out[int(b[places[0]])] = int.from_bytes(bits.tobytes(), "little")
    return out


def _edits_in_bands(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """edits() if they are `most` or fewer."""
    n, m = len(a), len(b)
    gone, new = np.zeros(n, bool), np.zeros(m, bool)
    band, d = _slide(a, b, np.zeros(1, np.int64), np.zeros(1, np.int64)), 0
    kept = {0: band}
    while not (abs(n - m) <= d and (n - m + d) % 2 == 0 and band[(n - m + d) // 2] == n):
        d += 1
        if d > most:
            return None
        band = _widened(a, b, band, d)
        if d % STRIDE == 0:
            kept[d] = band
    k, bands = n - m, {}
    for step in range(d, 0, -1):
        if step - 1 not in bands:
            low = (step - 1) // STRIDE * STRIDE
            bands = {low: kept[low]}
            for i in range(low + 1, step):
                bands[i] = _widened(a, b, bands[i - 1], i)
        added, removed = (x[(k + step) // 2] for x in _sources(bands[step - 1], step, n, m))
        if added >= removed:
            k += 1
            new[added - k] = True
        else:
            k -= 1
            gone[removed - 1] = True
    return gone, new


def differences(old: str, new: str) -> list[dict]:
    """Runs of words, with the white space after them, that both have, or that are removed or added; of a change, what is
    removed comes first."""
    left, right = TOKENS.findall(old), TOKENS.findall(new)
    head = 0
    while head < min(len(left), len(right)) and left[head] == right[head]:
        head += 1
    tail = 0
    while tail < min(len(left), len(right)) - head and left[-1 - tail] == right[-1 - tail]:
        tail += 1
    number: dict[str, int] = {}
    a, b = left[head : len(left) - tail], right[head : len(right) - tail]
    gone, come = edits(*(np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in (a, b)))
    marks, x, y = [("same", w) for w in left[:head]], 0, 0
    while x < len(a) or y < len(b):
        if x < len(a) and gone[x]:
            marks.append(("removed", a[x]))
            x += 1
        elif y < len(b) and come[y]:
            marks.append(("added", b[y]))
            y += 1
        else:
            marks.append(("same", a[x]))
            x, y = x + 1, y + 1
    return joined(marks + [("same", w) for w in left[len(left) - tail :]])


def joined(marks: list[tuple[str, str]]) -> list[dict]:
    """Runs of marked words; between two kept ones what is removed, then what is added."""
    out: list[dict] = []
    held: dict[str, list[str]] = {}

    def flush(kinds: tuple[str, ...]) -> None:
        out.extend({"kind": k, "text": "".join(held[k]), "words": len(held.pop(k))} for k in kinds if k in held)

    for kind, text in marks:
        flush(("removed", "added") if kind == "same" else ("same",))
        held.setdefault(kind, []).append(text)
    flush(("same", "removed", "added"))
    return out


RUN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("words", T.LongType())])


@F.pandas_udf(T.ArrayType(RUN))
def word_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([differences(a or "", b or "") for a, b in zip(old, new, strict=True)])

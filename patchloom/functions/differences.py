"""Shortest differences of two token lists by divide and conquer in linear space (Myers, 1986).

Common ends go first; of what is left a shorter side that lies whole in the longer is matched there at its first place; else
the furthest reaching paths from both ends are extended in turn, and where they meet the
problem is cut in two. So the cuts among equally short scripts are fixed. At last one deletion and one insertion stand
between two equal runs, deletion first, and a lone edit that repeats the whole equal run beside it swallows it.
The same meeting point is found in three ways: step by step where few edits or short lists are left; from the distances of
all points to both ends, by rows of bits, for lists of up to :data:`TABLE` pairs of tokens; else all diagonals of a step at
once, with memory linear in the lists and time their length times the number of edits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

DELETE, EQUAL, INSERT = -1, 0, 1
_OUT = -(1 << 40)
#: Steps from both ends that are tried one diagonal at a time; pairs of tokens up to which it stays at that, and up to which a
#: table of distances is made.
FEW, SHORT, TABLE = 2, 200, 1 << 20


def _step(far: np.ndarray, zero: int, d: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Extends the furthest points ``far`` (by diagonal, offset ``zero``) to ``d`` edits; returns the diagonals reached."""
    n, m = len(a), len(b)
    low, high = max(-d, -m - ((d - m) & 1)), min(d, n + ((d - n) & 1))
    k = np.arange(low, high + 1, 2)
    left, right = far[zero + k - 1], far[zero + k + 1]
    x = np.maximum(np.where((left >= 0) & (left < n), left + 1, _OUT), np.where((right >= 0) & (right - k <= m), right, _OUT))
    live = np.flatnonzero(x >= 0)
    while len(live):
        live = live[(x[live] < n) & (x[live] - k[live] < m)]
        live = live[a[x[live]] == b[x[live] - k[live]]]
        x[live] += 1
    far[zero + k] = x
    return k


def _stepwise(a: str, b: str, most: int) -> tuple[int, int] | None:
    """The point where the furthest paths from both ends meet within ``most`` steps each."""
    n, m = len(a), len(b)
    delta, zero = n - m, most + abs(n - m) + 2
    odd = delta & 1
    ahead, back = [_OUT] * (2 * zero + 1), [_OUT] * (2 * zero + 1)
    ahead[zero + 1] = back[zero + 1] = 0
    from_end, from_end_b = a[::-1], b[::-1]
    for d in range(most + 1):
        ks = range(max(-d, -m - ((d - m) & 1)), min(d, n + ((d - n) & 1)) + 1, 2)
        for k in ks:
            x, right = ahead[zero + k - 1] + 1, ahead[zero + k + 1]
            if x > n:
                x = _OUT
            if right >= x and right - k <= m:
                x = right
            if x >= 0:
                y = x - k
                while x < n and y < m and a[x] == b[y]:
                    x += 1
                    y += 1
                if odd and -d < delta - k < d and x + back[zero + delta - k] >= n:
                    return x, y
            ahead[zero + k] = x
        for k in ks:
            x, right = back[zero + k - 1] + 1, back[zero + k + 1]
            if x > n:
                x = _OUT
            if right >= x and right - k <= m:
                x = right
            if x >= 0:
                y = x - k
                while x < n and y < m and from_end[x] == from_end_b[y]:
                    x += 1
                    y += 1
                if not odd and -d <= delta - k <= d and x + (at := ahead[zero + delta - k]) >= n:
                    return at, at - delta + k
            back[zero + k] = x
    return None


def _places(a: str, b: str) -> list[int]:
    """For each token of ``b`` its places in ``a`` as bits."""
    places = dict.fromkeys(b, 0)
    for i, x in enumerate(a):
        if x in places:
            places[x] |= 1 << i
    return [places[y] for y in b]


def _common(a: str, b: str) -> np.ndarray:
    """Lengths of the longest common subsequences of all starts of ``b`` (rows) and of ``a`` (columns): a row is one number,
    whose bits that are 0 tell where the length grows (Hyyro, 2004)."""
    n, every, width = len(a), (1 << len(a)) - 1, (len(a) + 7) // 8
    row, rows, at = every, [every.to_bytes(width, "little")], [0]
    for place in _places(a, b):
        if same := row & place:
            row = ((row + same) | (row - same)) & every
            rows.append(row.to_bytes(width, "little"))
        at.append(len(rows) - 1)
    bits = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), width), axis=1, count=n, bitorder="little")
    out = np.zeros((len(rows), n + 1), np.int32)
    np.cumsum(bits == 0, axis=1, out=out[:, 1:])
    return out[at]


def _from_table(a: str, b: str) -> tuple[int, int] | None:
    """The same point from the distances: on a shortest path, with half the edits before it, on the outermost diagonal (the
    lowest for an odd number of edits, else the highest) and there the furthest. None if the lists share nothing."""
    start = _common(a, b)
    if not (kept := int(start[-1, -1])):
        return None
    end = _common(a[::-1], b[::-1])[::-1, ::-1]
    edits = len(a) + len(b) - 2 * kept
    y, x = np.nonzero(start + end == kept)
    k = x - y
    half = x + y - 2 * start[y, x] == (edits + 1) // 2
    x, k = x[half], k[half]
    outer = k.min() if edits & 1 else k.max()
    far = int(x[k == outer].max())
    return far, far - int(outer)


def _meeting(a: str, b: str) -> tuple[int, int] | None:
    """A point on a shortest path where the paths from both ends meet; None if the lists share nothing."""
    size, half = len(a) * len(b), (len(a) + len(b) + 1) // 2
    met = _stepwise(a, b, half if size <= SHORT else min(FEW, half))
    if met or size <= SHORT:
        return met
    if size <= TABLE:
        return _from_table(a, b)
    code = lambda t: np.array([ord(c) for c in t], np.int64)
    return _stepwise_wide(code(a), code(b))


def _stepwise_wide(a: np.ndarray, b: np.ndarray) -> tuple[int, int] | None:
    """The same point with all diagonals of a step at once."""
    n, m = len(a), len(b)
    odd, half, delta = (n - m) & 1, (n + m + 1) // 2, n - m
    zero = n + m + 2
    ahead, back = np.full(2 * zero + 1, _OUT), np.full(2 * zero + 1, _OUT)
    ahead[zero + 1] = back[zero + 1] = 0
    from_end, from_end_b = a[::-1], b[::-1]
    for d in range(half + 1):
        k = _step(ahead, zero, d, a, b)
        if odd:
            x, other = ahead[zero + k], back[np.clip(zero + delta - k, 0, 2 * zero)]
            met = np.flatnonzero((x >= 0) & (other >= 0) & (np.abs(delta - k) < d) & (x + other >= n))
            if len(met):
                return int(x[met[0]]), int(x[met[0]] - k[met[0]])
        k = _step(back, zero, d, from_end, from_end_b)
        if not odd:
            x, other = back[zero + k], ahead[np.clip(zero + delta - k, 0, 2 * zero)]
            met = np.flatnonzero((x >= 0) & (other >= 0) & (np.abs(delta - k) <= d) & (x + other >= n))
            if len(met):
                at = int(other[met[0]])
                return at, at - int(delta - k[met[0]])
    return None


def _equal_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _kept(a: str, b: str) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the equal runs of a shortest script, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        x, y = a[i:j], b[k:m]
        if head := _equal_start(x, y):
            out.append((i, k, head))
            i, k, x, y = i + head, k + head, x[head:], y[head:]
        if tail := _equal_start(x[::-1], y[::-1]):
            out.append((j - tail, m - tail, tail))
            j, m, x, y = j - tail, m - tail, x[:-tail], y[:-tail]
        if not x or not y:
            continue
        long, short = (x, y) if len(x) > len(y) else (y, x)
        if (at := long.find(short)) >= 0:
            out.append((i + at, k, len(short)) if long is x else (i, k + at, len(short)))
            continue
        if len(short) == 1:
            continue
        met = _meeting(x, y)
        if met and met not in ((0, 0), (len(x), len(y))):
            todo += [(i, i + met[0], k, k + met[1]), (i + met[0], j, k + met[1], m)]
    return sorted(out)


def _slid(before: list, edit: list, after: list, op: int) -> list[tuple[int, list]] | None:
    """The three pieces as two, where the edit repeats the whole equal run before or after it."""
    rest = len(edit) - len(before)
    if rest >= 0 and edit[rest:] == before:
        return [(op, before + edit[:rest]), (EQUAL, before + after)]
    if edit[: len(after)] == after:
        return [(EQUAL, before + after), (op, edit[len(after) :] + after)]
    return None


def _tidy(pieces: list[tuple[int, list]]) -> list[tuple[int, list]]:
    """Lone edits slid over the whole of an equal run that they repeat, from the left; equal runs and edits then join."""
    at = 1
    while at < len(pieces) - 1:
        (p, before), (op, edit), (q, after) = pieces[at - 1 : at + 2]
        fewer = _slid(before, edit, after, op) if p == q == EQUAL != op else None
        if fewer:
            begin = max(at - 4, 0)
            pieces[begin : at + 4] = _joined([*pieces[begin : at - 1], *fewer, *pieces[at + 2 : at + 4]])
            at = max(begin, 1)
        else:
            at += 1
    return pieces


def _joined(pieces: list[tuple[int, list]]) -> list[tuple[int, list]]:
    """Between equal runs one deletion, then one insertion; no empty pieces."""
    out, gone, new = [], [], []

    def flush():
        out.extend((op, x) for op, x in ((DELETE, gone), (INSERT, new)) if x)

    for op, tokens in pieces:
        if op == EQUAL and tokens:
            flush()
            gone, new = [], []
            if out and out[-1][0] == EQUAL:
                out[-1] = (EQUAL, out[-1][1] + tokens)
            else:
                out.append((EQUAL, list(tokens)))
        elif op == DELETE:
            gone = gone + list(tokens)
        elif op == INSERT:
            new = new + list(tokens)
    flush()
    return out


def script(a: Sequence, b: Sequence) -> list[tuple[int, list]]:
    """Pieces (-1 deleted, 0 kept, 1 inserted; tokens) of a shortest script from ``a`` to ``b``."""
    codes: dict = {}
    coded = ["".join(chr(codes.setdefault(t, len(codes))) for t in side) for side in (a, b)]
    pieces, i, k = [], 0, 0
    for p, q, n in [*_kept(*coded), (len(a), len(b), 0)]:
        pieces += [(DELETE, list(a[i:p])), (INSERT, list(b[k:q])), (EQUAL, list(a[p : p + n]))]
        i, k = p + n, q + n
    return _tidy(_joined(pieces))


def counts(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    """Tokens that a shortest script deletes, keeps and inserts, without the script: the length of a longest common
    subsequence, by rows of bits. Common ends go first."""
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    end = 0
    while end < high - low and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[low : len(a) - end], b[low : len(b) - end]
    every = row = (1 << len(x)) - 1
    for place in _places(x, y):
        if same := row & place:
            row = ((row + same) | (row - same)) & every
    kept = low + end + len(x) - row.bit_count()
    return len(a) - kept, kept, len(b) - kept


def blank_tokens(text: str) -> list[str]:
    """Words with the blank that follows each; a last word has none, so it differs from the same word before a blank."""
    parts = text.split(" ")
    return [p + " " for p in parts[:-1]] + [parts[-1]] * bool(parts[-1])

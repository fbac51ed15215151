"""Alignment scores of many pairs at once, wave by wave.

The cells (i, j) with i + j = d of all pairs of a block make up a wave; they depend on the two waves before only, so a wave is a few
array operations over (places, pairs), whatever the letters.  Pairs are put into blocks by length; shorter ones are filled up with letters
that match nothing, which changes no cell of their own.  Numbers are as narrow as the costs and lengths of a block allow.

A block of few pairs, each of a short text and a very long one, has many waves of few cells; such pairs go one by one, row by row, where the
dependence along a row, which only gaps cause, is a running maximum.  With a gap g <= 0 a Needleman-Wunsch row is t[j] = max(diagonal + match, up + g), then row[j] = max over i <= j of
t[i] + g * (j - i).  A Smith-Waterman row opens horizontal gaps from t only, as opening from a gap never pays.
Which way a block goes is decided by an estimate of both; the scores are the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

MATCH, MISMATCH, GAP, EXTEND = 10, -5, -5, -2

#: Seconds that decide between waves and rows: of a wave or row, and of a cell in it.
PER_WAVE, PER_WAVE_CELL, PER_ROW, PER_ROW_CELL = 16e-6, 0.8e-9, 14e-6, 3e-9

#: Cells of a wave, over all pairs of a block: a few arrays of that size fit into a core's cache.
CELLS = 1 << 16
LANES = 512


def _blocks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of pairs whose longer texts, and whose shorter ones, differ by about a quarter at most; LANES pairs, or so many that a wave
    has CELLS cells, but one at least."""
    like = np.floor(np.log(lengths[:, 1] + 16) / np.log(1.25))
    order = np.lexsort((lengths[:, 0], like))
    at = 0
    while at < len(order):
        first, end = order[at], at + 1
        while end < min(at + LANES, len(order)):
            m = lengths[order[end], 0]
            if like[order[end]] != like[first] or m > 1.25 * lengths[first, 0] + 16 or (m + 1) * (end + 1 - at) > CELLS:
                break
            end += 1
        yield order[at:end]
        at = end


def _letters(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all letters, where each text begins)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def _filled(codes: np.ndarray, starts: np.ndarray, rows: np.ndarray, size: int, fill: int, dtype, backwards: bool) -> np.ndarray:
    """(size, pairs): the letters of texts ``rows`` downwards, or upwards from the last row."""
    out = np.full((len(rows), size), fill, dtype)
    for k, r in enumerate(rows):
        text = codes[starts[r] : starts[r + 1]]
        if backwards:
            out[k, size - len(text) :] = text[::-1]
        else:
            out[k, : len(text)] = text
    return np.ascontiguousarray(out.T)


def _width(n: int, *costs: int):
    most = (n + 4) * max(map(abs, costs))
    return np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64


def _substitution(x: np.ndarray, y: np.ndarray, match: int, mismatch: int, table: np.ndarray | None, dtype):
    """Function of (rows of x, rows of y): scores of their letters, in an array of its own."""
    if table is None:
        differ = dtype(match - mismatch)

        def plain(rows: slice, others: slice, out: np.ndarray) -> np.ndarray:
            np.bitwise_xor(x[rows], y[others], out=out)
            np.minimum(out, dtype(1), out=out)
            np.multiply(out, -differ, out=out)
            return np.add(out, dtype(match), out=out)

        return plain
    flat, n = table.astype(dtype).ravel(), len(table)
    first = x.astype(np.int32) * n

    def looked_up(rows: slice, others: slice, out: np.ndarray) -> np.ndarray:
        return np.take(flat, first[rows] + y[others], out=out)

    return looked_up


def _global(m: int, n: int, ends: np.ndarray, similar, gap: int, dtype) -> np.ndarray:
    lanes = len(ends)
    out, by_wave = np.zeros(lanes, np.int64), {}
    for lane, (i, j) in enumerate(ends):
        if i and j:
            by_wave.setdefault(int(i + j), []).append(lane)
        else:
            out[lane] = gap * (i + j)
    two, one, new = (np.zeros((m + 1, lanes), dtype) for _ in range(3))
    one[:2] = gap
    scores, step = np.empty((m + 1, lanes), dtype), dtype(gap)
    for d in range(2, m + n + 1):
        lo, hi = max(1, d - n), min(m, d - 1)
        now = new[lo : hi + 1]
        np.maximum(one[lo - 1 : hi], one[lo : hi + 1], out=now)
        np.add(now, step, out=now)
        s = similar(slice(lo - 1, hi), slice(n - d + lo, n - d + hi + 1), scores[: hi - lo + 1])
        np.add(s, two[lo - 1 : hi], out=s)
        np.maximum(now, s, out=now)
        if d <= n:
            new[0] = gap * d
        if d <= m:
            new[d] = gap * d
        for lane in by_wave.get(d, ()):
            out[lane] = new[ends[lane, 0], lane]
        two, one, new = one, new, two
    return out


def _local(m: int, n: int, lanes: int, similar, gap: int, extend: int, dtype) -> np.ndarray:
    """Values are never below 0, so a gap's value beyond the borders may be ``gap`` instead of minus infinity."""
    two, one, new, best, scores, opened = (np.zeros((m + 1, lanes), dtype) for _ in range(6))
    across, down, below = (np.full((m + 1, lanes), gap, dtype) for _ in range(3))
    g, e, zero = dtype(gap), dtype(extend), dtype(0)
    for d in range(2, m + n + 1):
        lo, hi = max(1, d - n), min(m, d - 1)
        now, held = slice(lo, hi + 1), slice(lo - 1, hi)
        np.add(one[lo - 1 : hi + 1], g, out=opened[lo - 1 : hi + 1])
        np.maximum(across[now], opened[now], out=across[now])
        np.add(across[now], e, out=across[now])
        np.maximum(down[held], opened[held], out=below[now])
        np.add(below[now], e, out=below[now])
        s = similar(held, slice(n - d + lo, n - d + hi + 1), scores[: hi - lo + 1])
        np.add(s, two[held], out=s)
        np.maximum(s, across[now], out=s)
        np.maximum(s, below[now], out=s)
        np.maximum(s, zero, out=new[now])
        np.maximum(best[now], new[now], out=best[now])
        two, one, new = one, new, two
        down, below = below, down
    return best.max(axis=0).astype(np.int64)


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pairing(y: np.ndarray, match: int, mismatch: int, table: np.ndarray | None):
    """Function of a letter's code: its scores with all letters of ``y``."""
    if table is None:
        return lambda c: np.where(y == c, match, mismatch)
    at = np.minimum(y, 128)
    return lambda c: table[min(c, 128)][at]


def global_score(a: str, b: str, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP, table: np.ndarray | None = None) -> int:
    x, y = sorted((_codes(a), _codes(b)), key=len)
    lead = gap * np.arange(len(y) + 1, dtype=np.int64)
    row, scores = lead.copy(), _pairing(y, match, mismatch, table)
    for i, c in enumerate(x, 1):
        t = np.empty(len(y) + 1, np.int64)
        t[0] = gap * i
        t[1:] = np.maximum(row[:-1] + scores(c), row[1:] + gap)
        row = np.maximum.accumulate(t - lead) + lead
    return int(row[-1])


def local_score(a: str, b: str, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP, extend: int = EXTEND, table: np.ndarray | None = None) -> int:
    x, y = sorted((_codes(a), _codes(b)), key=len)
    n, best, scores = len(y), 0, _pairing(y, match, mismatch, table)
    v, f = np.zeros(n + 1, np.int64), np.full(n + 1, -(1 << 40), np.int64)
    slope = extend * np.arange(n + 1, dtype=np.int64)
    for c in x:
        f = np.maximum(f, v + gap) + extend
        t = np.zeros(n + 1, np.int64)
        t[1:] = np.maximum(np.maximum(v[:-1] + scores(c), f[1:]), 0)
        reach = np.maximum.accumulate(t - slope) + gap
        v = t
        v[1:] = np.maximum(t[1:], reach[:-1] + slope[1:])
        best = max(best, int(v.max()))
    return best


def scores(a: Sequence[str], b: Sequence[str], local: bool, match: int, mismatch: int, gap: int, extend: int = 0, table: np.ndarray | None = None) -> np.ndarray:
    """Alignment scores of the pairs (a[k], b[k]): Smith-Waterman with affine gaps if ``local``, else Needleman-Wunsch with linear ones.
    ``table`` has scores by letter codes, its last row and column standing for all other letters."""
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b)]
    lengths = np.array([(len(x), len(y)) for x, y in zip(short, long)], np.int64).reshape(len(short), 2)
    whole = table
    codes, starts = zip(_letters(short), _letters(long))
    if table is None:  # letters by number, from 2: 0 and 1 fill up
        known = np.unique(np.concatenate(codes))
        codes = [np.searchsorted(known, c) + 2 for c in codes]
        fills, most = (0, 1), len(known) + 2
    else:
        codes = [np.minimum(c, len(table) - 1) for c in codes]
        low = min(mismatch, int(table.min()))
        table = np.pad(table, (0, 1), constant_values=low)
        fills, most = (len(table) - 1, len(table) - 1), len(table)
    out = np.zeros(len(short), np.int64)
    for block in _blocks(lengths):
        m, n = lengths[block].max(axis=0)
        by_waves = (m + n) * PER_WAVE + m * n * len(block) * PER_WAVE_CELL
        by_rows = lengths[block, 0].sum() * PER_ROW + (lengths[block, 0] * lengths[block, 1]).sum() * PER_ROW_CELL
        if by_rows < by_waves:
            costs = {"match": match, "mismatch": mismatch, "gap": gap, "table": whole} | ({"extend": extend} if local else {})
            out[block] = [(local_score if local else global_score)(short[r], long[r], **costs) for r in block]
            continue
        dtype = _width(int(m + n) + most // int(m + n + 4), match, mismatch, gap, gap + extend, *([] if table is None else [int(np.abs(table).max())]))
        x = _filled(codes[0], starts[0], block, m, fills[0], dtype, False)
        y = _filled(codes[1], starts[1], block, n, fills[1], dtype, True)
        similar = _substitution(x, y, match, mismatch, table, dtype)
        out[block] = _local(m, n, len(block), similar, gap, extend, dtype) if local else _global(m, n, lengths[block], similar, gap, dtype)
    return out

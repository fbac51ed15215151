"""K-mers and codons of blocks of sequences at once, as numpy arrays over the letters of many rows.

Rows are taken in blocks of about LETTERS letters, so a task's memory depends on that and on its longest sequence.  Sequences with characters beyond
ASCII or line ends, which the column functions treat by their own rules, are taken one by one by those rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.alphabet import CODONS, GENETIC_CODE, NUCLEOTIDES, RESIDUES

LETTERS = 1 << 20
#: Entries of a table of counts that a task holds before it hands them on.
HELD = 1 << 21
_ANY = r"[^\n\r\x85\u2028\u2029]"  # what a dot stands for in the column functions


def _residue(c: str) -> int | None:
    at = RESIDUES.find(c.upper())
    return at if at >= 0 and len(c.upper()) == 1 else None


def _class(c: str) -> int | None:
    return ord(c.upper()[0]) - 65


#: The number of a letter, None where a k-mer with it counts for nothing: residues, and class letters.
NUMBERS = {"residue": _residue, "class": _class}


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, by the letters of their last column."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.columns[-1]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS, "right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, their bounds by row) of strings; nulls are empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def _odd(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows with a character beyond ASCII or a line end."""
    at = np.flatnonzero((data > 127) | (data == 10) | (data == 13))
    return np.unique(np.searchsorted(bounds, at, "right") - 1) if len(at) else at


def _one(seq: str, k: int, stride: int, drop_last: bool, base: int, number) -> list[int | None]:
    """Hashes of the k-mers of any text, in order, None for those that count for nothing."""
    found = re.findall(f"{_ANY}{{{k}}}", seq) if stride == k else re.findall(f"(?=({_ANY}{{{k}}}))", seq)[::stride]
    if drop_last and found and (len(seq) - k) % stride == 0:
        found.pop()
    values = [[number(c) for c in x] for x in found]
    return [None if None in v else sum(x * base**i for i, x in enumerate(v)) for v in values]


def hashes(col: pa.Array, k: int, stride: int, drop_last: bool, base: int, letters: str = "residue") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, whether it counts) of each k-mer of the strings, by row and in order."""
    number = NUMBERS[letters]
    values = [number(chr(c)) for c in range(128)] + [None] * 128
    of, counts = np.array([v or 0 for v in values], np.int64), np.array([v is not None for v in values])
    data, bounds = flat(col)
    n = max(len(data) - k + 1, 0)
    code, known = of[data], counts[data]
    h, good = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        h += code[i : i + n] * base**i
        good &= known[i : i + n]
    row = np.repeat(np.arange(len(col)), np.diff(bounds))[:n]
    left = bounds[row + 1] - np.arange(n) - k  # letters after the k-mer
    begins = left >= (1 if drop_last else 0)
    if stride > 1:
        begins &= (np.arange(n) - bounds[row]) % stride == 0
    odd = _odd(data, bounds)
    if len(odd):
        begins &= ~np.isin(row, odd)
    row, h, good = row[begins], h[begins], good[begins]
    if len(odd):
        more = [(r, x) for r in odd.tolist() for x in _one(col[r].as_py(), k, stride, drop_last, base, number)]
        row, h = np.append(row, [r for r, _ in more]).astype(np.int64), np.append(h, [x or 0 for _, x in more]).astype(np.int64)
        good = np.append(good, [x is not None for _, x in more]).astype(bool)
        order = np.argsort(row, kind="stable")
        row, h, good = row[order], h[order], good[order]
    return row, h, good


#: Multiplier of the hash of any characters, modulo 2^64.
_ODD = 0x9E3779B97F4A7C15


def any_hashes(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each k-mer of any characters at every offset of the strings; different k-mers may share a hash, but hardly do."""
    data, bounds = flat(col)
    if (data > 127).any():
        data = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        bounds = np.append(0, np.cumsum(pc.utf8_length(pc.fill_null(col, "")).to_numpy(zero_copy_only=False)))
    n, code = max(len(data) - k + 1, 0), data.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h += code[i : i + n] * np.uint64(pow(_ODD, i, 1 << 64))
    row = np.repeat(np.arange(len(col)), np.diff(bounds))[:n]
    inside = np.arange(n) + k <= bounds[row + 1]
    return row[inside], h[inside].view(np.int64)


def counted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, h, n), distinct, in order."""
    if not len(h):
        return row, h, h
    low, span, rows = int(h.min()), int(h.max()) - int(h.min()) + 1, int(row.max()) + 1
    if span * rows >= 1 << 62:
        names, of = np.unique(h, return_inverse=True)
        row, of, n = counted(row, of)
        return row, names[of], n
    key = row * span + (h - low)
    if rows * span <= 4 * len(h):
        n = np.bincount(key)
        key = np.flatnonzero(n)
        n = n[key]
    else:
        key, n = np.unique(key, return_counts=True)
    return key // span, key % span + low, n.astype(np.int64)


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(h, n), distinct, of several tables of counts."""
    h, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    return (h[starts], np.add.reduceat(n, starts)) if len(h) else (h, n)


def added(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, h, n), distinct, of several tables of counts by row."""
    row, h, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*held) if held else ((), (), ())))
    order = np.lexsort((h, row))
    row, h, n = row[order], h[order], n[order]
    starts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)])
    return (row[starts], h[starts], np.add.reduceat(n, starts)) if len(h) else (row, h, n)


def lists(row: np.ndarray, h: np.ndarray, n: int) -> pa.ListArray:
    """The hashes ``h`` of rows ``row``, in order, as one list for each of ``n`` rows."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=n))), pa.int32()), pa.array(h, pa.int64()))


def _strings(data: np.ndarray, sizes: np.ndarray, null: np.ndarray) -> pa.Array:
    bounds = np.append(0, np.cumsum(sizes)).astype(np.int32)
    a = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
    return pc.if_else(pa.array(np.ascontiguousarray(null)), pa.scalar(None, pa.string()), a) if null.any() else a


_PLACE = np.full(256, 4, np.int64)
_PLACE[[ord(c) for c in NUCLEOTIDES]] = range(4)
_CODON = np.full(125, ord("X"), np.uint8)
_CODON[[25 * (i // 16) + 5 * (i // 4 % 4) + i % 4 for i in range(64)]] = np.frombuffer(GENETIC_CODE.encode(), np.uint8)
_OTHER = np.zeros(256, np.uint8)
_OTHER[[ord(c) for c in "ACGTacgt"]] = [ord(c) for c in "TGCATGCA"]


def _translated(data: np.ndarray, bounds: np.ndarray, drop_last: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(residues, their number by row) of three frames."""
    n = max(len(data) - 2, 0)
    code = _PLACE[data]
    residue = _CODON[25 * code[:n] + 5 * code[1 : n + 1] + code[2 : n + 2]]
    place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))[:n]
    length = np.diff(bounds) - int(drop_last)
    room = np.repeat(length, np.diff(bounds))[:n] - place
    for frame in range(3):
        yield residue[(place % 3 == frame) & (room >= 3)], np.maximum((length - frame) // 3, 0)


def _frames_of_one(seq: str, drop_last: bool) -> list[str]:
    back = "".join(chr(_OTHER[ord(c)]) for c in reversed(seq) if c in "ACGTacgt")
    return ["".join(CODONS.get(c, "X") for c in re.findall(f"{_ANY}{{3}}", s[f : max(len(s) - int(drop_last), f)])) for s in (seq, back) for f in range(3)]


def six_frames(col: pa.Array, drop_last: bool) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(frame, rows, translations) of the strings; nulls stay."""
    null = pc.is_null(col).to_numpy(zero_copy_only=False)
    data, bounds = flat(col)
    odd = _odd(data, bounds)
    if len(odd):
        rows = np.setdiff1d(np.arange(len(col)), odd)
        for frame, at, seqs in six_frames(col.take(pa.array(rows)), drop_last):
            yield frame, rows[at], seqs
        for frame, seqs in enumerate(zip(*(_frames_of_one(col[r].as_py(), drop_last) for r in odd.tolist()))):
            yield frame, odd, pa.array(seqs, pa.string())
        return
    rows = np.arange(len(col))
    for frame, (found, sizes) in enumerate(_translated(data, bounds, drop_last)):
        yield frame, rows, _strings(found, sizes, null)
    kept = _OTHER[data]
    ends = np.append(0, np.cumsum(kept > 0))[bounds]
    back, rows = kept[kept > 0][::-1], rows[::-1]  # rows come in reverse too
    for frame, (found, sizes) in enumerate(_translated(back, np.append(0, np.cumsum(np.diff(ends)[::-1])), drop_last)):
        yield 3 + frame, rows, _strings(found, sizes, null[::-1])

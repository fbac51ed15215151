"""Exact n-gram Jaccard self-join over a tree of count vectors.

A document is the set of its distinct ``width``-word shingles; two link when their Jaccard similarity
is at least ``num``/``den``.  Shingles are hashed to 64 bits and these into groups; a document is the
point of its group counts.  Linked documents of n and m shingles share at least
num/(num+den) * (n + m) of them, and the sum of coordinate minima of two points bounds what they share.

* Copies: documents with equal sets are one point (their class), whatever their number.
* Top of the tree: half-spaces "count of fine group g is at least 1" of the space of fine groups (2^32 or more of them,
  growing with the input).  A point lies in those of its first n - ceil(n * num/den) + 1 fine groups by level
  of their document frequency, then by hash, as any two linked points must meet in one of these.  Frequencies are exact
  counts over all documents, so passages that many documents share come last in the order and hardly ever serve as
  entries.  Boxes alone would not do: at this dimension every box of unrelated points covers all others.
* Half-spaces of at most ``RARE`` points are leaves and give pairs directly, dropped where the sum of minima is too small.
* The points of larger ones, which only families of near copies have, are linked to a pivot each; what is then still
  in different components is packed into an R-tree: by the largest half-space and size class of a point, then in the order
  of a code of its counts into leaves of about ``LEAF`` points, and ``FAN`` nodes to a parent.  Leaves are joined with
  themselves first.  Then the tree is joined with itself from the roots whose half-spaces share a point downward; node
  pairs go when the sum of minima of their bounding boxes is too small or when they hold one and the same component.
* Surviving pairs are verified on their sets, whole hashes against whole hashes of 64 bits.  Pairs already in one component need no test, as only
  the components are returned.  Classes are named by 64 bits of a hash of their set.

Every step is a shuffle by a hashed key; groups that may be large are handled by aggregates and joins
that adaptive execution can split.  What is broadcast has a bound: one level byte for each of at most 2^28 slots, as many as
the frequent groups need (colliding groups share the larger level, which changes the order, not the result),
and one bit for each of at most 2^31 slots that marks documents in pairs.

Defined results: null, empty and blank texts have 0 shingles and are their own component; fewer than
``width`` words make one shingle; repeated rows are copies; null ids never become a component's name
unless all its ids are null; an empty table gives no rows; columns of other names are not read.
"""

import ctypes
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, scratch, settled

WIDTH, NUM, DEN = 5, 75, 100
RARE = 32
COARSE = 64
LEAF, FAN = 64, 16
#: Slots of the broadcast tables: as many as the data need between these bounds.
SLOTS = (1 << 18, 1 << 28)
MARKS = (1 << 20, 1 << 31)
#: Edges that one task joins to components (64 MB); more are contracted in rounds over all tasks.
EDGES = 1 << 22
_WORDS: dict[bytes, int] = {}
_CACHE = 1 << 16  # words whose hashes a task remembers
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SIZE_STEP = math.log(1.05)


def _trim() -> None:
    """Give freed memory back to the system: a worker is reused by later tasks of other stages."""
    _WORDS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    import xxhash

    get, fresh = _WORDS, xxhash.xxh3_64_intdigest
    if len(get) > _CACHE:
        get.clear()
    lengths, codes = [], []
    for t in texts:
        words = t.encode("utf-8", "surrogatepass").translate(_LOWER).split() if t else ()
        lengths.append(len(words))
        for w in words:
            c = get.get(w)
            if c is None:
                c = get[w] = fresh(w)
            codes.append(c)
    # one linear form of all texts at once; what reaches into the next text isn't used
    v = np.zeros(len(codes) + width, np.uint64)
    v[:len(codes)] = np.array(codes, dtype=np.uint64)
    k = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(width)]
    full = sum((v[i:i + len(codes)] * k[i] for i in range(width)), np.zeros(len(codes), np.uint64))
    full = _mix(full + np.uint64(width))
    out, at = [], 0
    for n in lengths:
        if n >= width:
            out.append(np.unique(full[at:at + n - width + 1]))
        elif n:
            whole = sum((v[at + i:at + i + 1] * k[i] for i in range(n)), np.zeros(1, np.uint64))
            out.append(_mix(whole + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _signature(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _fine(s: np.ndarray, bits: int) -> np.ndarray:
    return s >> np.uint64(64 - bits)


def _point(s: np.ndarray) -> bytes:
    """Counts over the lowest bits of the hashes: COARSE groups or more, up to 4 hashes to a group, so that chance
    overlaps stay small beside the bound whatever the size.  The first byte states the bytes of a count."""
    groups = COARSE
    while groups * 4 < len(s):
        groups *= 2
    c = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    wide = 1 if c.max(initial=0) < 256 else 4
    return bytes([wide]) + c.astype("<u1" if wide == 1 else "<u4").tobytes()


def _counts_of(point: bytes, groups: int | None = None) -> np.ndarray:
    """The counts of a point, folded to fewer groups if asked."""
    c = np.frombuffer(point, "<u1" if point[0] == 1 else "<u4", offset=1).astype(np.int64)
    return c if groups is None else c.reshape(-1, groups).sum(0)


def _most(p: bytes, q: bytes) -> int:
    """Sum of the coordinate minima of two points."""
    a, b = _counts_of(p), _counts_of(q)
    g = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, g).sum(0), b.reshape(-1, g).sum(0)).sum())


def _pack(v: np.ndarray) -> bytes:
    """Sorted values as gaps of as many bytes as the largest needs."""
    gaps = np.diff(v, prepend=np.uint64(0)).astype("<u8")
    wide = max(1, (int(gaps[1:].max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + v[:1].astype("<u8").tobytes() + np.ascontiguousarray(gaps[1:].view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    if len(b) == 1:
        return np.zeros(0, np.uint64)
    part = np.frombuffer(b, np.uint8, offset=9).reshape(-1, b[0])
    gaps = np.zeros((len(part) + 1, 8), np.uint8)
    gaps[0] = np.frombuffer(b, np.uint8, 8, 1)
    gaps[1:, :b[0]] = part
    return np.cumsum(gaps.view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def _by_bucket(v: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Edges of the buckets in sorted values of so many bits."""
    bounds = [(k << bits) // buckets for k in range(buckets)]
    return np.append(np.searchsorted(v, np.array(bounds, np.uint64)), len(v))


def _shape(docs: DataFrame) -> tuple[int, int]:
    """Buckets, one for about 8 MB of input as the optimizer knows it, and bits of a fine group, so that there are a hundred
    times more groups than shingles.  Only the split of the work hangs on them."""
    size = float(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1e18:  # not known
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(min(max(size / (8 << 20), 64), 1 << 20)), min(max(math.ceil(math.log2(size + 1)) + 5, 32), 56)


def _points(docs: DataFrame, buckets: int, bits: int, width: int) -> DataFrame:
    """Rows of kind 0, one per document (key = id, n, sig, point, hash of the text), and of kind 1, fine-group counts of a task by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def flush():
            nonlocal held, size
            if not held:
                return None
            v, c = np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
            edges = _by_bucket(v, buckets, bits)
            rows = [(b, _pack(v[a:z]), _pack(many) if len(many := v[a:z][c[a:z] > 1]) else None, c[a:z][c[a:z] > 1].astype("<u4").tobytes() or None)
                    for b, (a, z) in enumerate(zip(edges, edges[1:])) if z > a]
            b, x, y, w = zip(*rows)
            k = len(rows)
            return pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.array(b, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary()), pa.array(w, pa.binary()), pa.nulls(k, pa.int64())], names=names)

        names = ["kind", "key", "n", "sig", "blob", "more", "times", "text_hash"]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column(1).to_pylist(), width)
                sigs = [_signature(s) if len(s) else None for s in sets]
                for s, g in zip(sets, sigs):
                    if g is not None and g not in seen:
                        seen.add(g)
                        held.append(np.unique(_fine(s, bits)))
                        size += len(held[-1])
                k = len(sets)
                yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.int64()), pa.array([_point(s) for s in sets], pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), part.column(2)], names=names)
                if size > 2_000_000:
                    yield flush()
        if held:
            yield flush()
        _trim()

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(work, "kind int, key bigint, n bigint, sig bigint, blob binary, more binary, times binary, text_hash bigint")


def _table(rows: DataFrame, slots: int, kind: type) -> bytes:
    """``rows`` (slot, level) as one array of so many slots, folded by the tasks; the largest level of a slot counts."""
    chunk = 1 << 14

    def fold(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        out = np.zeros(chunk, np.uint8)
        np.maximum.at(out, batch["slot"].to_numpy() % chunk, batch["level"].to_numpy().astype(np.uint8))
        return pa.table({"at": [key[0].as_py()], "bytes": pa.array([(np.packbits(out) if kind is bool else out).tobytes()], pa.binary())})

    per = 8 if kind is bool else 1
    table, size = bytearray(slots // per), chunk // per
    for r in rows.groupBy(F.expr(f"slot div {chunk}").alias("at")).applyInArrow(fold, "at bigint, bytes binary").toLocalIterator():  # slots / per bytes at most
        table[r["at"] * size:(r["at"] + 1) * size] = r["bytes"]
    return bytes(table)


def _slots(n: int, bounds: tuple[int, int]) -> int:
    return min(max(1 << (8 * n).bit_length(), bounds[0]), bounds[1])


def _levels(points: DataFrame) -> bytes:
    """Level of each slot: 0 for document frequencies up to RARE, else the binary logarithm."""

    def count(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        v = np.concatenate([_unpack(b) for b in batch["blob"].to_pylist()])
        w = [(_unpack(m), np.frombuffer(t, "<u4")) for m, t in zip(batch["more"].to_pylist(), batch["times"].to_pylist()) if m]
        v, c = np.unique(v, return_counts=True)
        c = c.astype(np.int64)
        for m, t in w:
            c[np.searchsorted(v, m)] += t.astype(np.int64) - 1
        v, c = v[c > RARE], c[c > RARE]
        del w
        _trim()
        return pa.table({"fine": v.astype(np.int64), "level": np.log2(c).astype(np.int64)})

    common = cut(points.filter("kind = 1").select("key", "blob", "more", "times").groupBy("key").applyInArrow(count, "fine bigint, level bigint"), "frequent")
    slots = _slots(common.count(), SLOTS)
    return _table(common.select(F.pmod("fine", F.lit(slots)).alias("slot"), "level"), slots, int)


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-n * num // den) + 1


def _entries(docs: DataFrame, levels, buckets: int, bits: int, width: int, num: int, den: int) -> DataFrame:
    """(a, b, entry): pairs of classes that meet in a rare entry (entry null), and points of frequent entries (b null)."""
    names = ["bucket", "cells", "sigs", "sizes", "frequent"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        seen: set[int] = set()
        cells, sigs, sizes, hot, n = [], [], [], [], 0

        def flush():
            nonlocal cells, sigs, sizes, hot, n
            c, s, z, h = (np.concatenate(x) for x in (cells, sigs, sizes, hot))
            cells, sigs, sizes, hot, n = [], [], [], [], 0
            rows = []
            for frequent in (False, True):
                of = h == frequent
                c1, s1, z1 = c[of], s[of], z[of]
                order = np.argsort(c1, kind="stable")
                c1, s1, z1 = c1[order], s1[order], z1[order]
                if frequent:  # these only pass through: deal them out evenly
                    rows += [(b, c1[b::buckets], s1[b::buckets], z1[b::buckets], True) for b in range(min(buckets, len(c1)))]
                else:
                    e = _by_bucket(c1, buckets, bits)
                    rows += [(b, c1[i:j], s1[i:j], z1[i:j], False) for b, (i, j) in enumerate(zip(e, e[1:])) if j > i]
            if rows:
                b, x, y, w, f = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([_pack(v) for v in x], pa.binary()), pa.array([v.tobytes() for v in y], pa.binary()),
                                                  pa.array([v.tobytes() for v in w], pa.binary()), pa.array(f, pa.bool_())], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for s in shingle_sets(batch.column(0).slice(at, 500).to_pylist(), width):
                    if not len(s) or (g := _signature(s)) in seen:
                        continue
                    seen.add(g)
                    fine = _fine(s, bits)
                    deep = level[fine & np.uint64(len(level) - 1)]
                    k = prefix_length(len(s), num, den)
                    first = np.lexsort((s, deep))[:k]
                    # equal fine groups of one document are one entry
                    c, i = np.unique(fine[first], return_index=True)
                    cells.append(c)
                    hot.append(deep[first][i] > 0)
                    sigs.append(np.full(len(c), g, np.int64))
                    sizes.append(np.full(len(c), min(255, int(math.log(len(s)) / _SIZE_STEP)), np.uint8))
                    n += len(c)
                if n > 1_000_000:
                    yield from flush()
        if n:
            yield from flush()
        _trim()

    reach = math.ceil(math.log(den / num) / _SIZE_STEP) + 1

    def pairs(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        got = [(_unpack(c), np.frombuffer(s, np.int64), np.frombuffer(z, np.uint8), f) for c, s, z, f in zip(*(batch[x].to_pylist() for x in names[1:]))]
        out_a, out_b, out_e = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        hot = [(c, s) for c, s, _, f in got if f]
        rare = [x for x in got if not x[3]]
        if rare:
            c, s, z = (np.concatenate([x[k] for x in rare]) for k in range(3))
            order = np.lexsort((s, z, c))
            c, s, z = c[order], s[order], z[order].astype(np.int16)
            keep = np.ones(len(c), bool)
            keep[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
            c, s, z = c[keep], s[keep], z[keep]
            k, left = 1, np.arange(len(c))
            while len(left):
                left = left[left + k < len(c)]
                left = left[(c[left] == c[left + k]) & (z[left + k] - z[left] <= reach)]
                out_a.append(np.minimum(s[left], s[left + k]))
                out_b.append(np.maximum(s[left], s[left + k]))
                k += 1
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        if len(a):
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            keep = np.ones(len(a), bool)
            keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b = a[keep], b[keep]
        n = len(a)
        m = sum(len(c) for c, _ in hot)
        del got, rare, out_a, out_b
        _trim()
        ea = np.concatenate([s for _, s in hot]) if hot else np.zeros(0, np.int64)
        ee = np.concatenate([c for c, _ in hot]).astype(np.int64) if hot else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.concatenate([a, ea]), pa.int64()), "b": pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(m, pa.int64())]), "entry": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(ee, pa.int64())])})

    blobs = docs.select("text").mapInArrow(work, "bucket int, cells binary, sigs binary, sizes binary, frequent boolean")
    return blobs.groupBy("bucket").applyInArrow(pairs, "a bigint, b bigint, entry bigint")


def _packed_set(s: np.ndarray) -> bytes:
    return np.ascontiguousarray(s.astype("<u8")).tobytes()


def _unpacked_set(b) -> np.ndarray:
    return np.frombuffer(b, "<u8")


def _sets(docs: DataFrame, marks, slots: int, width: int) -> DataFrame:
    """(sig, shingles) of the documents whose ids are marked, and of a few that share their slots."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(marks.value, np.uint8), set()
        for batch in batches:
            slot = batch.column(0).to_numpy()
            wanted = np.flatnonzero(bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
            for at in range(0, len(wanted), 500):
                part = batch.column(1).take(pa.array(wanted[at:at + 500])).to_pylist()
                sets = {g: s for s in shingle_sets(part, width) if len(s) and (g := _signature(s)) not in seen}
                seen.update(sets)
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([_packed_set(s) for s in sets.values()], pa.binary())], names=["sig", "shingles"])
        _trim()

    return docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(slots)).alias("slot"), "text").mapInArrow(work, "sig bigint, shingles binary")


def _bounded(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, most): pairs whose summed coordinate minima reach the least overlap of a link; most is the similarity they allow."""
    side = lambda x: classes.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("point").alias(f"p_{x}"))

    @F.arrow_udf("double")
    def allowed(n_a: pa.Array, n_b: pa.Array, p_a: pa.Array, p_b: pa.Array) -> pa.Array:
        most = np.array([_most(p, q) for p, q in zip(p_a.to_pylist(), p_b.to_pylist())], np.int64)
        both = n_a.to_numpy() + n_b.to_numpy()
        return pa.array(np.where(most * (num + den) >= num * both, most / np.maximum(both - most, 1), -1.0), pa.float64())

    allowed = allowed.asNondeterministic()  # else the filter makes the plan evaluate it twice, in two workers a task
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    return j.select("a", "b", allowed("n_a", "n_b", "p_a", "p_b").alias("most")).filter("most >= 0")


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that link, tested on their sets."""

    @F.arrow_udf("boolean")
    def links(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(x, y):
            out.append(_similar(_unpacked_set(a.as_buffer()), _unpacked_set(b.as_buffer()), num, den))
        return pa.array(out, pa.bool_())

    first = pairs.join(sets, pairs.a == sets.sig).select("a", "b", F.col("shingles").alias("x"))
    return first.join(sets, first.b == sets.sig).filter(links("x", "shingles")).select("a", "b")


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, c): the smallest member of the component of every node of the edges (u, v)."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got:
        return
    u, v = (np.concatenate(x) for x in zip(*got))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[:len(u)], at[len(u):]
    up = np.arange(len(nodes))
    while True:  # hooks every root to the least neighbouring one, then points all nodes to their roots
        a, b = up[u], up[v]
        if not len(open_ := np.flatnonzero(a != b)):
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, up[up]):
            up = up[up]
    for k in range(0, len(nodes), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k:k + 10_000]), pa.array(nodes[up[k:k + 10_000]])], names=["v", "c"])


def connected(edges: DataFrame, max_rounds: int = 60, in_one: int = EDGES) -> DataFrame:
    """(v, c): the smallest member c of the component of every v in ``edges`` (a, b).

    At most ``in_one`` distinct edges, which are counted, are joined by one task.  More take alternating
    large-star and small-star steps, each written out, until the edges are stars.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    if e.count() <= in_one:
        return cut(e.repartition(1).mapInArrow(_union, "v bigint, c bigint"), "components")
    state = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        down = e.join(least, "u")
        e = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        seen = Observation()
        e = cut(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "stars")
        now = seen.get
        if now == state or not now["n"]:
            break
        state = now
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("v"), F.col("v").alias("c")).union(e.select("v", F.col("v").alias("c")).distinct())


def _named(points: DataFrame, comp: DataFrame) -> DataFrame:
    """``points`` with the component c of a, which is a itself where nothing links to it."""
    return points.drop("c").join(comp.withColumnRenamed("v", "a"), "a", "left").withColumn("c", F.coalesce("c", "a"))


def _by_entry(points: DataFrame, entries: DataFrame, shares: int = 16) -> DataFrame:
    """``points`` with what ``entries`` says of their entry; an entry's points are dealt out to ``shares`` tasks."""
    some = entries.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return points.withColumn("_s", F.pmod(F.xxhash64("a"), F.lit(shares)).cast("int")).join(some, ["entry", "_s"]).drop("_s")


def _packed(frequent: DataFrame, comp: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points of half-spaces that hold several components: (a, c, n, point, p, home, z, k, leaf), leaf being the number of the
    leaf among the k leaves of the root (home, z); and (entry, home), the half-spaces that the points of each home lie in."""
    named = _named(frequent, comp)
    size = named.groupBy("entry").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("held")).filter("x <> y").select("entry", "held")
    named = cut(_by_entry(named, size), "open-entries")
    points = named.groupBy("a").agg(F.max_by("entry", F.struct("held", "entry")).alias("home"), F.first("c").alias("c"))
    points = points.join(classes, F.col("a") == F.col("sig")).select("a", "c", "home", "n", "point", _coarse("point").alias("p"), F.floor(F.log("n") / _SIZE_STEP).alias("z"))
    bit = f"transform(sequence(0, {COARSE // 2 - 1}), i -> if(p[2 * i] > p[2 * i + 1], 1L, 0L))"
    points = cut(points.withColumn("code", F.expr(f"aggregate({bit}, 0L, (s, x) -> 2 * s + x)")), "open-points")
    share = points.groupBy("home", "z").agg(F.ceil(F.count("*") / LEAF).alias("k"), F.percentile_approx("code", [i / 256 for i in range(1, 256)], 10_000).alias("q"))
    j = points.join(share, ["home", "z"])
    low = F.size(F.filter("q", lambda x: x < F.col("code")))
    fine = F.ceil(F.col("k") / 256)
    j = j.withColumn("leaf", F.when(fine <= 1, F.floor(low * F.col("k") / 256)).otherwise(low * fine + F.pmod(F.xxhash64("a"), fine)))
    under = named.select("entry", "a").join(points.select("a", "home"), "a").select("entry", "home").distinct()
    return cut(j.drop("q", "code"), "leaf-points"), cut(under, "homes")


def _node(level: int):
    """Name of a point's node ``level`` levels above its leaf."""
    return F.xxhash64("home", "z", F.lit(level), F.expr(f"leaf div {FAN ** level}L"))


def _near(points: DataFrame, under: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y): pairs of different leaves that may hold links between components, by a join of the tree with itself."""
    top = points.agg(F.max("leaf")).first()[0] or 0
    levels = 0
    while FAN ** levels <= top:
        levels += 1
    box = [F.max(F.get("p", F.lit(k))) for k in range(COARSE)]
    reach = math.ceil(math.log(den / num) / _SIZE_STEP) + 1

    def boxes(level: int, *more: str) -> DataFrame:
        return points.groupBy(_node(level).alias("node"), *more).agg(F.struct(F.min("n").alias("n"), F.min("z").alias("z"), F.min("c").alias("c"), F.max("c").alias("cc"), F.array(*box).alias("p")).alias("b"))

    def kept(pairs: DataFrame, level: int) -> DataFrame:
        b = boxes(level)
        j = pairs.join(b.toDF("x", "bx"), "x").join(b.toDF("y", "by"), "y")
        most = F.aggregate(F.zip_with("bx.p", "by.p", lambda i, j: F.least(i, j)), F.lit(0).cast("long"), lambda s, v: s + v)
        apart = (F.least("bx.c", "by.c") != F.greatest("bx.cc", "by.cc")) & (F.abs(F.col("bx.z") - F.col("by.z")) <= reach)
        return j.filter(apart & (most * (num + den) >= num * (F.col("bx.n") + F.col("by.n")))).select("x", "y")

    one = lambda d: d.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    meet = under.join(under.withColumnRenamed("home", "other"), "entry").filter("home <= other").select("home", "other").distinct()
    roots = points.select("home", _node(levels).alias("x")).distinct()
    pairs = kept(one(meet.join(roots, "home").join(roots.toDF("other", "y"), "other")), levels)
    for level in range(levels - 1, -1, -1):
        below = points.select(_node(level + 1).alias("x"), _node(level).alias("kid")).distinct()
        pairs = kept(one(pairs.join(below, "x").withColumnRenamed("kid", "kx").join(below.toDF("y", "ky"), "y").select(F.col("kx").alias("x"), F.col("ky").alias("y"))), level)
    return pairs.filter("x <> y")


def _leaf_links(key: tuple[pa.Scalar, ...], batch: pa.Table, num: int, den: int) -> pa.Table:
    """Links of two leaves, or within one, that join components this call has not joined yet."""
    up: dict[int, int] = {}

    def find(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c]
        return c

    rows = list(zip(*(batch[x].to_pylist() for x in ("a", "c", "n", "point", "second"))))
    wide = [_unpacked_set(b.as_buffer()) for b in batch["shingles"].combine_chunks()]
    flat = np.array(batch["p"].to_pylist(), np.int64).reshape(len(rows), COARSE)
    n = np.array([r[2] for r in rows], np.int64)
    second = np.array([r[4] for r in rows], bool)
    left = np.flatnonzero(~second)
    right = np.flatnonzero(second) if second.any() else left
    out = []
    for i in left.tolist():
        most = np.minimum(flat[i], flat[right]).sum(1)
        able = right[(most * (num + den) >= num * (n[i] + n[right])) & (den * np.minimum(n[i], n[right]) >= num * np.maximum(n[i], n[right]))]
        for j in able.tolist():
            if (right is not left or j > i) and find(rows[i][1]) != find(rows[j][1]) and _most(rows[i][3], rows[j][3]) * (num + den) >= num * (n[i] + n[j]) and _similar(wide[i], wide[j], num, den):
                up[find(rows[i][1])] = find(rows[j][1])
                out.append((rows[i][0], rows[j][0]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _within(points: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links between components within each leaf."""
    mixed = points.groupBy(_node(0).alias("pair")).agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("pair")
    held = points.withColumn("pair", _node(0)).join(mixed, "pair", "left_semi").join(sets, F.col("a") == F.col("sig"))
    held = held.select("pair", F.lit(False).alias("second"), "a", "c", "n", "point", "p", "shingles")
    return held.groupBy("pair").applyInArrow(lambda k, b: _leaf_links(k, b, num, den), "a bigint, b bigint")


def _across(near: DataFrame, points: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links between components of each pair of leaves."""
    near = near.withColumn("pair", F.xxhash64("x", "y"))
    held = points.select(_node(0).alias("node"), "a", "c", "n", "point", "p").join(sets, F.col("a") == F.col("sig")).drop("sig")
    side = near.select("pair", F.explode(F.array(F.struct(F.col("x").alias("node"), F.lit(False).alias("second")), F.struct(F.col("y").alias("node"), F.lit(True).alias("second")))).alias("s")).select("pair", "s.*")
    return side.join(held, "node").drop("node").groupBy("pair").applyInArrow(lambda k, b: _leaf_links(k, b, num, den), "a bigint, b bigint")


def _coarse(point: str):
    """A point as an array of COARSE counts."""

    @F.arrow_udf("array<bigint>")
    def counts(p: pa.Array) -> pa.Array:
        return pa.array([_counts_of(x, COARSE) for x in p.to_pylist()], pa.list_(pa.int64()))

    return counts(point)


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends aren't in one component yet."""
    c = lambda x: comp.select(F.col("v").alias(x), F.col("c").alias(f"c_{x}"))
    j = pairs.join(c("a"), "a", "left").join(c("b"), "b", "left")
    return j.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def _extended(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    return connected(comp.select(F.col("v").alias("a"), F.col("c").alias("b")).union(links))


def _by_class(sets: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """``sets`` as a table in buckets of its key in the shared folder, so that the joins of every round move the pairs but not the sets; and its name."""
    spark, name = sets.sparkSession, f"seqloom_sets_{uuid.uuid4().hex}"
    buckets = min(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), 100_000)
    sets.repartition(buckets, "sig").write.format("parquet").bucketBy(buckets, "sig").sortBy("sig").option("path", scratch(spark, "sets")).saveAsTable(name)
    return spark.table(name), name


@contextmanager
def _small_batches(spark):
    """Arrow batches of few rows while the steps of the join run: a batch of 10,000 long texts or sets is too much for a task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "500")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def near_duplicates(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of ``docs`` (doc_id, text)."""
    with _small_batches(docs.sparkSession):
        return settled(docs.sparkSession, "near-duplicates", lambda: _near_duplicates(docs, width, num, den).select("doc_id", "n_shingles", "component_id"))


def _near_duplicates(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """near_duplicates() with text_hash and ``stays``: whether a row has the id and text that its component keeps."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets, bits = _shape(docs)
    made = cut(_points(docs, buckets, bits, width), "points")
    rows = made.filter("kind = 0").select(F.col("key").alias("doc_id"), "n", "sig", "text_hash")
    classes = cut(made.filter("kind = 0 and sig is not null").groupBy("sig").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("blob").alias("point"), F.min(F.struct(F.isnull("key").alias("no_id"), "key", "text_hash")).alias("top")), "classes")
    levels = spark.sparkContext.broadcast(_levels(made))
    entries = cut(_entries(docs, levels, buckets, bits, width, num, den), "entries")
    levels.destroy()
    frequent = entries.filter("b is null").select("entry", "a").distinct()
    pivots = frequent.groupBy("entry").agg(F.min("a").alias("pivot"))  # a hash, and so the same random point in many entries
    star = _by_entry(frequent, pivots).filter("a <> pivot").select(F.col("pivot").alias("a"), F.col("a").alias("b"))
    of = lambda p: p.select("a").union(p.select("b")).union(frequent.select("a")).distinct()
    pairs = cut(entries.filter("b is not null").select("a", "b").union(star).distinct(), "pairs")
    used = cut(classes.join(of(pairs), F.col("sig") == F.col("a"), "left_semi"), "used")
    pairs = cut(_bounded(pairs, used, num, den), "bounded")
    used = cut(used.join(of(pairs), F.col("sig") == F.col("a"), "left_semi"), "used")
    slots = _slots(used.count(), MARKS)
    marks = spark.sparkContext.broadcast(_table(used.select(F.pmod(F.xxhash64("rep"), F.lit(slots)).alias("slot"), F.lit(1).alias("level")), slots, bool))
    sets, name = _by_class(_sets(docs, marks, slots, width), buckets)
    try:
        marks.destroy()
        comp = _links(pairs, frequent, used, sets, num, den)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # all that follows is written out
    named = classes.join(comp, classes.sig == comp.v, "left").select("sig", "rep", "top", F.coalesce("c", "sig").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"), F.min("top").alias("top"))
    final = named.select("sig", "c").join(least, "c").select(F.col("sig").alias("s"), "component_id", "top")
    out = rows.join(final, rows.sig == final.s, "left")
    stays = F.isnull("sig") | F.col("top.key").eqNullSafe(F.col("doc_id")) & (F.col("top.text_hash") == F.col("text_hash"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", stays.alias("stays"), F.isnull("sig").alias("blank"))


def _links(pairs: DataFrame, frequent: DataFrame, used: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(v, c): components of the classes by all links."""
    #: every point's most promising pair first: most others then lie within one component and need no test
    best = cut(pairs.groupBy("b").agg(F.max_by("a", F.struct("most", "a")).alias("a")).select("a", "b"), "best")
    comp = connected(_verified(best, sets, num, den))
    rest = _apart(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), comp)
    comp = _extended(comp, _verified(rest, sets, num, den))
    points, under = _packed(frequent, comp, used)
    if points.isEmpty():
        return comp
    comp = _extended(comp, _within(points, sets, num, den))
    points = cut(_named(points, comp), "leaf-points")
    return _extended(comp, _across(cut(_near(points, under, num, den), "near"), points, sets, num, den))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near copies: one with the smallest id, null ids last; rows without a word all stay.

    Id and text name a row.  Of rows that agree in both, which are counted, an arbitrary one stays."""
    o = {"width": WIDTH, "num": NUM, "den": DEN} | options
    with _small_batches(docs.sparkSession):
        found = settled(docs.sparkSession, "found", lambda: _near_duplicates(docs, **o).select("doc_id", "text_hash", "stays", "blank"))
    gone = found.filter("not stays").select("doc_id", "text_hash").distinct()
    several = cut(found.filter("stays and not blank").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_hash"), "several")
    same = lambda x, k: x["_h"].eqNullSafe(k["_text_hash"]) & x["_i"].eqNullSafe(k["_doc_id"])
    d = docs.withColumn("_h", F.xxhash64("text")).withColumn("_i", F.col("doc_id").cast("long"))
    keys = lambda k: k.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"))
    if several.isEmpty():
        k = keys(gone)
        return d.join(k, same(d, k), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    k, again = keys(gone.union(several)), keys(several)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    one = d.join(again, same(d, again), "left_semi").groupBy("_i", "_h").agg(F.first(whole).alias("_row")).select("_row.*")
    return d.join(k, same(d, k), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).union(one)

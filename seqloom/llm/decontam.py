"""Benchmark decontamination by suffix arrays over the training text.

Tasks cut their documents into shards of at most ``SHARD`` words.  A shard's suffix array holds the
word positions that can begin a match at all: those followed by enough words of the benchmark's
vocabulary.  Suffixes are compared by as many words as a window has, which is all that a hit takes; every test suffix is
found by binary search, which gives all its locations.  Longer matches are overlapping windows on one diagonal, merged into
longest verbatim matches.

A window is ``width`` consecutive words of an item; an item with fewer words, but not none, is one
window.  Words are the maximal runs of ASCII letters and digits and of characters beyond ASCII, with
A-Z lower-cased.

The benchmark is read a partition at a time in blocks of at most ``BLOCK_WORDS`` words (or one item).  One block is
broadcast and scanned for in a single pass over the documents.  Of several, only one is held at a time: its
matches are written out by a hash of the text, its broadcast is released, and the matches are joined to the documents at last.

Defined results: null or empty texts have no words, hits or items; repeated rows and repeated item
ids are each handled by themselves (an id counts once per document); an empty benchmark hits nothing;
an empty table gives no rows; of texts beyond a shard's size, each is a shard of its own; equal matches are one;
input columns named as an output column are replaced, but remove_contaminated() gives all columns back as they were.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, without

WIDTH = 10
SHARD = 2_000_000
BLOCK_WORDS = 1_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class TestBlock:
    """Vocabulary and test windows of some items."""

    __test__ = False

    def __init__(self, items: list[tuple[object, list[bytes]]], width: int = WIDTH):
        self.width = width
        self.ids = [None if i is None else str(i) for i, _ in items]
        names = sorted({w for _, ws in items for w in ws})
        self.vocabulary = {w: k + 1 for k, w in enumerate(names)}
        keys, owner, at, length = [], [], [], []
        for k, (_, ws) in enumerate(items):
            n = len(ws)
            if not n:
                continue
            v = np.array([self.vocabulary[w] for w in ws], dtype=">u4")
            m = min(n, width)
            for j in range(n - m + 1):
                keys.append(v[j:j + m].tobytes())
                owner.append(k)
                at.append(j)
                length.append(m)
        self.keys, self.owner, self.at, self.length = keys, np.array(owner, np.int64), np.array(at, np.int64), np.array(length, np.int64)
        self.shortest = int(self.length.min()) if keys else 0
        self.lengths = sorted(set(length))


def _occurrences(ids: np.ndarray, doc: np.ndarray, block: TestBlock):
    """(position in the shard, test window) of every occurrence.  ids: word ids, 0 = not in the vocabulary;
    doc: document number of each word."""
    n = len(ids)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not n or not block.keys:
        return none
    #: words from each position to the next one outside the vocabulary, or the document's end
    stop = np.ones(n + 1, bool)
    stop[:-1] = ids == 0
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, n)
    stops = np.unique(np.append(np.flatnonzero(stop), ends))
    room = stops[np.searchsorted(stops, np.arange(n), "left")] - np.arange(n)
    starts = np.zeros(n, bool)
    starts[np.append(0, ends[:-1])] = True
    room = np.where((room == 0) & starts & (ids > 0), stops[np.minimum(np.searchsorted(stops, np.arange(n), "right"), len(stops) - 1)] - np.arange(n), room)
    pos = np.flatnonzero(room >= block.shortest)
    if not len(pos):
        return none
    w = block.width
    padded = np.zeros(n + w, np.uint32)
    padded[:n] = ids
    keys = padded[pos[:, None] + np.arange(w)[None, :]]
    keys[np.arange(w)[None, :] >= room[pos][:, None]] = 0
    keys = np.ascontiguousarray(keys.astype(">u4")).view(f"S{4 * w}").ravel()
    order = np.argsort(keys, kind="stable")  # the suffix array, to the depth of a window
    pos, keys = pos[order], keys[order]
    lo = np.searchsorted(keys, np.array(block.keys, dtype=f"S{4 * w}"), "left")
    hi = np.searchsorted(keys, np.array([k + b"\xff" * (4 * w - len(k)) for k in block.keys], dtype=f"S{4 * w}"), "right")
    found = hi - lo
    which = np.repeat(np.arange(len(lo)), found)
    into = np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found) + np.repeat(lo, found)
    return pos[into], which


def _scan(texts, block: TestBlock):
    """For each text, its number of words and its longest matches (item number, start, item start, words)."""
    words = [split_words(t) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    get = block.vocabulary.get
    ids = np.fromiter((get(x, 0) for w in words for x in w), np.uint32, int(counts.sum()))
    doc = np.repeat(np.arange(len(words)), counts)
    first = np.cumsum(counts) - counts
    p, t = _occurrences(ids, doc, block)
    matches: list[list[tuple]] = [[] for _ in words]
    if len(p):
        item, diagonal = block.owner[t], p - block.at[t]
        order = np.lexsort((p, diagonal, item, doc[p]))
        p, t, item, diagonal = p[order], t[order], item[order], diagonal[order]
        d = doc[p]
        new = np.ones(len(p), bool)
        new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (d[1:] != d[:-1]) | (p[1:] > p[:-1] + block.width)
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(p)) - 1
        size = p[z] + block.length[t[z]] - p[a]
        for k, i, s, j, m in zip(d[a].tolist(), item[a].tolist(), (p[a] - first[d[a]]).tolist(), block.at[t[a]].tolist(), size.tolist()):
            matches[k].append((block.ids[i], s, j, m))
    return counts.tolist(), matches


def blocks_of(benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS):
    """Test blocks of at most ``block_words`` words (or one item), read a partition at a time."""
    items, n = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        ws = split_words(r.text)
        if items and n + len(ws) > block_words:
            yield TestBlock(items, width)
            items, n = [], 0
        items.append((r.item_id, ws))
        n += len(ws)
    yield TestBlock(items, width)


def _spans(matches) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((int(m["start"]), int(m["start"]) + int(m["words"])) for m in matches):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


MATCHES = "array<struct<item_id: string, start: bigint, item_start: bigint, words: bigint>>"
DIGEST = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _match_table(docs: DataFrame, block: TestBlock) -> DataFrame:
    """(key, item_id, start, item_start, words), written out: the matches of the distinct texts of ``docs`` (text), key naming the text."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _shards(batch, 0):
                _, found = _scan(part.column(0).to_pylist(), shared.value)
                rows = [(key, *m) for key, ms in zip(part.column(1).to_pylist(), found) for m in ms]
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["key", "item_id", "start", "item_start", "words"])

    out = cut(docs.select("text", F.sha1("text").alias("key")).mapInArrow(work, "key string, item_id string, start bigint, item_start bigint, words bigint").distinct(), "matches")
    shared.destroy()
    return out


def find_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default: all) with n_words, matches (word offsets), n_hit, n_items, items_sha256 and contaminated."""
    added = ["matches", *DIGEST]
    spark: SparkSession = docs.sparkSession
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    out = without(docs, added).select(*[F.col(f"`{c}`") for c in carry], *([] if "text" in carry else ["text"]))
    blocks = blocks_of(benchmark, width, block_words)
    block, second, known = next(blocks), next(blocks, None), "_matches" if "_matches" not in out.columns else "_matches_"
    if second is None:
        out = out.withColumn(known, F.array().cast(MATCHES))
    else:
        tables = [_match_table(out, block), _match_table(out, second), *(_match_table(out, b) for b in blocks)]
        block, second = TestBlock([], width), None
        every = reduce(DataFrame.union, tables).groupBy("key").agg(F.collect_list(F.struct("item_id", "start", "item_start", "words")).cast(MATCHES).alias(known))  # as many as one text has
        out = out.withColumn("_key", F.sha1("text")).join(every.withColumnRenamed("key", "_k"), F.col("_key") == F.col("_k"), "left").drop("_key", "_k")
        out = out.withColumn(known, F.coalesce(known, F.array().cast(MATCHES)))
    shared = spark.sparkContext.broadcast(block)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.select(*[F.col(f"`{c}`") for c in carry]).schema.fields]
    schema = ", ".join([*fields, f"n_words bigint, matches {MATCHES}, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"])

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            at, old = (batch.schema.get_field_index(c) for c in ("text", known))
            for part in _shards(batch, at):
                n, found = _scan(part.column(at).to_pylist(), shared.value)
                rows = [[*ms, *(dict(zip(("item_id", "start", "item_start", "words"), m)) for m in new)] for ms, new in zip(part.column(old).to_pylist(), found)]
                ids = [sorted({m["item_id"] for m in ms if m["item_id"] is not None}) for ms in rows]
                hit = [sum(e - s for s, e in _spans(ms)) if ms else 0 for ms in rows]
                new = {"n_words": pa.array(n, pa.int64()), "matches": pa.array(rows, pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())]))),
                       "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([len(x) for x in ids], pa.int64()),
                       "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], pa.string()),
                       "contaminated": pa.array([x > 0 for x in hit], pa.bool_())}
                yield pa.RecordBatch.from_arrays([*(part.column(batch.schema.get_field_index(c)) for c in carry), *new.values()], names=[*carry, *new])

    return out.mapInArrow(work, schema)


def _shards(batch, at: int):
    """Slices of an Arrow batch of at most SHARD words, by the number of bytes (a word has two at least)."""
    sizes = np.array([2 + len(x.as_buffer()) if x.is_valid else 2 for x in batch.column(at)]) if batch.num_rows else np.zeros(0)
    cut = np.cumsum(sizes) // (2 * SHARD)
    edges = [0, *(np.flatnonzero(cut[1:] != cut[:-1]) + 1).tolist(), batch.num_rows]
    for a, z in zip(edges, edges[1:]):
        if z > a:
            yield batch.slice(a, z - a)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Only the documents without a hit, with the columns of ``docs``."""
    clash = [c for c in docs.columns if c.lower() in {"matches", *DIGEST}]
    aside = {c: f"_own_{c}" for c in clash}
    marked = find_matches(docs.withColumnsRenamed(aside), benchmark, **options)
    return marked.filter(~F.col("contaminated")).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])

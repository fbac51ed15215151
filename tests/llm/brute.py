"""Brute-force versions of the operators' digests, in plain Python."""

import base64
import collections
import hashlib
import re

WS = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in WS.split(t or "") if w]


def ascii_lower(t):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), t)


def quality(t):
    t = t or ""
    w = words(t)
    seen, hit = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def jaccard(rows, num=75, den=100):
    sets = {}
    for i, t in rows:
        w = words(ascii_lower(t or ""))
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def targets(sizes, weights=(5, 2, 1)):
    """source -> target by resharing the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, list(names)
    while free:
        share = {s: total * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            total -= out[s]
            free.remove(s)
    return out


def warc(rows):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    keeper = {}
    for i, h in rows:
        keeper[h or ""] = max(i, keeper.get(h or "", i))
    return {i: (len((h or "").encode()), digest(h), "response" if keeper[h or ""] == i else "revisit", None if keeper[h or ""] == i else keeper[h or ""]) for i, h in rows}


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def pii(t):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PII.items()) for m in re.finditer(p, t or "") if _valid(kind, m.group())]
    return sorted(found)


def pii_digest(t):
    found = pii(t)
    return *(sum(x[3] == k for x in found) for k in PII), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in found).encode()).hexdigest()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def decontam(docs, items, width=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall(ascii_lower(t or ""))
        m = min(width, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k:k + m])].add(i)
    lengths = sorted({len(x) for x in windows})
    out = []
    for i, t in docs:
        w, hit, ids = WORD.findall(ascii_lower(t or "")), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if (x := windows.get(tuple(w[k:k + m]))):
                    hit |= set(range(k, k + m))
                    ids |= x
        ids = sorted(map(str, ids))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out

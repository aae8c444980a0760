"""Plain versions of the operators, for small tables held in memory."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

from sigloom.llm import quality_rules as qr


def repeated_bytes(texts, length):
    """Per text: what is left, number of removed bytes, number of removed runs."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((kept, len(b) - len(kept), len(re.findall(b"\1+", bytes(gone)))))
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def component_ids(rows, size, percent):
    """rows: (doc_id, text); the least doc_id reachable by links, per row."""
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    return [min(least[find(i)]) for i in range(len(rows))]


def quality(rows, prior):
    """rows: (lang, source, text); (features, base_failed, kept) per row."""
    measured = [dict(zip(qr.FEATURES, qr.measure(t))) for *_, t in rows]
    values = [
        {s: (1000 * f[a] // f[b] if f[b] else 0) for s, (a, b, _) in qr.SIGNALS.items()}
        for f in measured
    ]
    base = [f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"] for f in measured]

    def fence(signal, *group):
        """group: nothing, lang, or lang and source."""
        v = sorted(
            x[signal] for x, r, b in zip(values, rows, base) if not b and r[: len(group)] == group
        )
        q1, q3 = v[(len(v) + 3) // 4 - 1], v[(3 * len(v) + 3) // 4 - 1]
        own = q3 + qr.SPREAD * max(q3 - q1, qr.SIGNALS[signal][2])
        if not group:
            return own
        above = fence(signal, *group[:-1])
        return (len(v) * min(own, qr.LIFT * above) + prior * above) // (len(v) + prior)

    return [
        (f, b, not b and all(v[s] <= fence(s, lang, source) for s in qr.SIGNALS))
        for (lang, source, _), f, v, b in zip(rows, measured, values, base)
    ]


def item_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contaminated(text, items, size=10):
    """(words, hit words, ids of items that occur) of a text; items: (item_id, text)."""
    words = item_words(text)
    hit, found = set(), set()
    for item_id, item in items:
        w = item_words(item)
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[s : s + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item_id))
    return len(words), len(hit), sorted(found)


def periodic_runs(words, least):
    """(start, length, period) of all runs: each period's stretches of equal words, one by one."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def planted_words(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def hard_negatives(rows, every, positives, negatives):
    """rows: (vec_id, vector, label); the report as tuples."""
    unique = set()
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        unique.add((vec_id, label, tuple(math.floor(256 * x) for x in vector)))
    out = []
    for anchor in unique:
        if anchor[0] % every:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(anchor[2], v)), i, label)
            for i, label, v in unique
            if i != anchor[0] and len(v) == len(anchor[2])
        )
        for p, i, label in [x for x in scored if x[2] == anchor[1]][:positives]:
            fit = [x for x in scored if x[2] != anchor[1] and -30 * p <= -100 * x[0] <= -90 * p]
            out += [(anchor[0], i, r, x[1], -p, -x[0]) for r, x in enumerate(fit[:negatives], 1)]
    return sorted(out)


def shard(key, tree):
    """The shard of a key by a descent, level by level."""
    for level in (1, 2, 3):
        draws = {}
        for path in {s[:level] for s in tree if s.weight}:
            weight = sum(s.weight for s in tree if s[:level] == path)
            name = "/".join(map(str, path)).encode()
            seed = 42 if key is None else xxhash.xxh64_intdigest(str(key).encode(), 42)
            bits = xxhash.xxh64_intdigest(name, seed) >> 11
            draws[path] = math.log((bits + 0.5) / 2**53) / weight
        best = max(draws, key=draws.get)
        tree = [s for s in tree if s[:level] == best]
    return best[2]

"""Plain versions of the operators, for small inputs: (doc_id, text) lists in, counters of rows out."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def windows(items, size):
    return [tuple(items[i : i + size]) for i in range(len(items) - size + 1)]


def covered_by_repeats(items, size, counts):
    gone = set()
    for i, w in enumerate(windows(items, size)):
        if counts[w] > 1:
            gone.update(range(i, i + size))
    return gone


def without_passages(docs, size):
    split = [(i, words(t)) for i, t in docs]
    counts = Counter(w for _, x in split for w in windows(x, size))
    out = Counter()
    for i, x in split:
        gone = covered_by_repeats(x, size, counts)
        out[i, len(x), len(gone), sha(" ".join(w for k, w in enumerate(x) if k not in gone))] += 1
    return out


def without_strings(docs, size):
    split = [(i, (t or "").encode()) for i, t in docs]
    counts = Counter(b[k : k + size] for _, b in split for k in range(len(b) - size + 1))
    out = Counter()
    for i, b in split:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if counts[b[k : k + size]] > 1:
                gone[k : k + size] = b"\x01" * size
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))] += 1
    return out


def quality(text, window=8):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    inside = lambda m: len(covered_by_repeats(w, m, Counter(windows(w, m))))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), inside(window), inside


def shingles(text, size=5):
    w = words((text or "").translate(ASCII_LOWER))
    return frozenset(windows(w, size) if len(w) >= size else [tuple(w)] if w else [])


def near_groups(docs, percent=75):
    sets = [shingles(t) for _, t in docs]
    having, parent = defaultdict(list), list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for j, n in Counter(j for t in s for j in having[t]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(k)] = root(j)
        for t in s:
            having[t].append(k)
    low = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return Counter((i, len(s), low.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(docs, sets, strict=True)))


def base_secrets(text):
    text, names = text or "", ("password", "passwd", "secret", "token", "api_?key")
    either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in names)
    spans = [
        (m.start(), 0, m.end())
        for m in re.finditer(rf"""(?:{either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
        if len(m[1]) >= 12
    ]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def listed(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{s}:{e}" for s, k, e in spans)


def top_k(vectors, k, scale=1024):
    """vectors: (id, list) rows; None or non-finite components leave a vector out."""
    import math

    fit = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in fit:
        if q is not None and q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i is None, i or 0, i) for i, b in fit if i != q)
            out |= {(q, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(found[:k])}
    return out


def water_levels(sizes, weights=(5, 2, 1), most=3):
    """Targets by handing the excess on until none is above its limit; sizes in the sources' order."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    total, full = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        share = sum(weight[i] for i in range(len(sizes)) if i not in full)
        target = [most * sizes[i] if i in full else left * weight[i] / share for i in range(len(sizes))]
        above = {i for i in range(len(sizes)) if i not in full and target[i] > most * sizes[i]}
        if not above:
            return target
        full |= above


def texts_with_repeats(seed, n=120):
    """Documents that share passages, copies, near copies and stretches of no pattern, with odd ones among them."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 8))) for _ in range(900)]
    some = lambda a, b: [rnd.choice(vocabulary) for _ in range(rnd.randint(a, b))]
    passages = [some(30, 70) for _ in range(6)]
    docs = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.3 and docs:
            w = words(rnd.choice(docs)[1])
            for _ in range(rnd.randint(0, 2)):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        else:
            w = some(0, 60)
            for _ in range(rnd.randint(0, 2)):
                p = rnd.choice(passages)
                a = rnd.randrange(len(p))
                w += p[a : a + rnd.randint(5, 70)] + some(0, 10)
        docs.append((i, rnd.choice(["", " "]) + rnd.choice([" ", "\n", "  "]).join(w)))
    odd = [(None, None), (None, "x y"), (n, ""), (n + 1, " \t\n"), (n + 2, "a"), (n + 3, "no " * 300), (n + 4, "z" * 900), (n + 4, "z" * 900)]
    return docs + odd + [docs[0], docs[1]] + [(n + 9, " ".join(some(4000, 4000)))]

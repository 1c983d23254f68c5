"""Plain Python versions of operators that SQL can't express, for small inputs."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring_dedup(rows, size=13):
    """{position: (n_words, n_removed, kept text)} of rows (id, text)."""
    least = {}
    words = [WORD.findall(t or "") for _, t in rows]
    big = float("inf")
    for (i, _), w in zip(rows, words, strict=True):
        for a in range(len(w) - size + 1):
            k = tuple(w[a : a + size])
            least[k] = min(least.get(k, big), big if i is None else i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for a in range(len(w) - size + 1):
            if least[tuple(w[a : a + size])] < (big if i is None else i):
                gone.update(range(a, a + size))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return out


def shingles(text, words=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lowered)
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def jaccard_components(rows, words=3, num=90, den=100):
    """[(id, n_shingles, component)] of rows (id, text) with distinct ids."""
    sets = {i: shingles(t, words) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {p for h in holders.values() for p in combinations(sorted(h), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if den * both >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()

"""Plain-Python versions of the operators, for small tables."""

import hashlib
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k, lower=True):
    words = WORDS.findall((text or "").translate(LOW) if lower else text or "")
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def near_components(docs, k, percent):
    """{doc_id: (n_shingles, component)} of [(doc_id, text)] with distinct ids."""
    sets = {d: shingles(t, k) for d, t in docs}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def window_removal(docs, window=50):
    """{doc_id: (n_words, n_removed, sha256 of the kept words)}."""
    words = {d: WORDS.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                keep[i : i + window] = [False] * window
        left = [x for x, k in zip(w, keep) if k]
        out[d] = len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()
    return out


def words_of(line):
    return frozenset(WORDS.findall(line.lower()))


def line_removal(docs):
    """{doc_id: kept text} of [(doc_id, text)]."""
    lines = [(d, i, x) for d, t in sorted(docs) if t is not None for i, x in enumerate(t.split("\n"))]
    seen, kept = [], {d: [] for d, _ in docs}
    for d, i, x in lines:
        p = words_of(x)
        hit = p and any(p == q or 10 * len(p & q) >= 8 * len(p | q) for q in seen)
        if p:
            seen.append(p)
        if not hit:
            kept[d].append(x)
    return {d: None if t is None else "\n".join(kept[d]) for d, t in docs}

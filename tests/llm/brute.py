"""Plain versions of the operators, for comparison."""

import hashlib
import re

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split((text or "").encode()) if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def substring_dedup(rows, window=50):
    """rows: (doc_id, text) -> {doc_id: (n_words, n_removed, kept_sha256)}"""
    split = {d: words(t) for d, t in rows}
    first = {}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, n=4):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def near_duplicates(rows, percent=85):
    """rows: (doc_id, text) -> {doc_id: (n_shingles, component_id)}"""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posting, groups = {}, {}
    for d, s in sets.items():
        groups.setdefault(s, []).append(d)
    for s, members in groups.items():
        if s:
            for m in members[1:]:
                parent[max(find(m), find(members[0]))] = min(find(m), find(members[0]))
            for x in s:
                posting.setdefault(x, []).append(members[0])
    pairs = {}
    for ds in posting.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    for (a, b), n in pairs.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}

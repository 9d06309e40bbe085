"""Brute-force versions that several test files share."""

from __future__ import annotations

import re


def word_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent=80):
    """(id -> set size, id -> component) comparing every pair of rows with ids."""
    sets = {i: word_set(t, k) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and root(i) != root(j):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: len(s) for i, s in sets.items()}, {i: root(i) for i in sets}

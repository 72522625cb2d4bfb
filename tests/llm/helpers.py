"""Plain versions of definitions, for small inputs."""

import re


def words(text, lower=True):
    b = (text or "").encode()
    if lower:
        b = b.lower()  # bytes: A-Z only
    return re.findall(rb"[^\x20\x09-\x0D]+", b)


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, percent=80):
    """rows: (doc_id, text). Smallest doc_id reachable, by row."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None:
                n = len(a & b)
                if 100 * n >= percent * (len(a) + len(b) - n):
                    parent[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[root(i)] = min(best.get(root(i), d), d)
    return [None if d is None else best[root(i)] for i, (d, _) in enumerate(rows)], [len(s) for s in sets]

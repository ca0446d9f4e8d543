"""The clusterer written again, plainly and slowly, from its description: dictionaries and loops."""

import math

W = {}


def cos(a, b):
    n = sum(x * x for x in a) * sum(x * x for x in b)
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(n) if n > 0 else 0.0


def gauss(hours):
    return math.exp(-((hours / 24) ** 2) / 18)


def stamp(c):
    mean = c["sum"] / c["n"]
    return mean + 1.282 * math.sqrt(max(c["sq"] / c["n"] - mean * mean, 0))


def size_bin(n):
    return next((round(0.1428 * (i + 1), 4) for i, b in enumerate((3, 10, 20, 30, 40, 50)) if n <= b), 1.0)


def doc_features(d, c):
    return [1 + cos(c["main"], d["main"]), gauss(d["h"] - c["new"]), gauss(d["h"] - c["old"]), gauss(d["h"] - stamp(c)), 0, 1 + cos(c["par"], d["par"]), 1 + cos(c["tp"], d["tp"]), 1 + cos(c["main"], d["par"]), 1 + cos(c["main"], d["tp"]), 0, 0, 0]


def pair_features(s, t):
    return [1 + cos(s["main"], t["main"]), gauss(s["new"] - t["new"]), gauss(s["old"] - t["old"]), gauss(stamp(s) - stamp(t)), 0, 1 + cos(s["par"], t["par"]), 1 + cos(s["tp"], t["tp"]), 1 + cos(s["main"], t["par"]), 1 + cos(s["main"], t["tp"]), 0, 0, 0]


def add(c, d):
    for k in ("main", "par", "tp"):
        c[k] = [x + y for x, y in zip(c[k], d[k])]
    c["n"] += 1
    c["sum"] += d["h"]
    c["sq"] += d["h"] ** 2
    c["new"], c["old"] = max(c["new"], d["h"]), min(c["old"], d["h"])
    c["docs"].append(d["id"])


def cluster(docs, rank, merge, join):
    """Final clusters, as sets of document ids."""
    pool = []
    for k, d in enumerate(docs):
        empty = {"main": [0.0] * len(d["main"]), "par": [0.0] * len(d["main"]), "tp": [0.0] * len(d["main"]), "n": 0, "sum": 0.0, "sq": 0.0, "new": -math.inf, "old": math.inf, "docs": []}
        if k < 4:
            add(empty, d)
            pool.append(empty)
            continue
        scored = [(rank.score(doc_features(d, c)), c) for c in pool]
        best = max(scored, key=lambda x: x[0])[1]
        if merge.score(doc_features(d, best)) > 0:
            add(best, d)
        else:
            add(empty, d)
            pool.append(empty)
        found = [(merge.score(pair_features(best, c)), i, pair_features(best, c), c) for i, c in enumerate(pool) if c is not best]
        for _, _, x, c in sorted(found, key=lambda r: (-r[0], r[1])):
            x = [*x[:9], size_bin(best["n"]), 0, size_bin(c["n"])]
            if join.score(x) > 0:
                for v in ("main", "par", "tp"):
                    best[v] = [a + b for a, b in zip(best[v], c[v])]
                for v in ("n", "sum", "sq"):
                    best[v] += c[v]
                best["new"], best["old"] = max(best["new"], c["new"]), min(best["old"], c["old"])
                best["docs"] += c["docs"]
                pool = [p for p in pool if p is not c]
    return {frozenset(c["docs"]) for c in pool}

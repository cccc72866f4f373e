"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def ngram_components(rows, n=5):
    """{id: (set size, smallest reachable id)} of (id, text) rows, by comparing all pairs."""
    sets = []
    for i, text in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        grams = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets.append((i, frozenset(grams)))
    low = {i: i for i, _ in sets}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if both and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = sorted((top(i), top(j)))
                low[y] = x
    return {i: (len(s), top(i)) for i, s in sets}


def cut_windows(rows, window):
    """{id: (words, removed, sha of what stays)} of (id, text) rows with distinct ids."""
    first = {}
    texts = {i: words(t) for i, t in rows}
    for i in sorted(texts):
        for j in range(len(texts[i]) - window + 1):
            first.setdefault(tuple(texts[i][j : j + window]), i)
    out = {}
    for i, w in texts.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target}: share by weight, stop at the limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, live, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while live:
        total = sum(w[s] for s in live)
        over = [s for s in live if left * w[s] / total > most * sizes[s]]
        if not over:
            out.update({s: left * w[s] / total for s in live})
            break
        for s in over:
            out[s] = float(most * sizes[s])
            live.discard(s)
            left -= out[s]
    return out


def secrets(text):
    found = []
    kinds = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
             ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16)]
    for rank, (kind, pattern, good) in enumerate(kinds):
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "", flags) if good(m)]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (i % 2 + 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)]
    found = []
    for kind, pattern, good in kinds:
        found += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if good(m)]
    return ",".join(found)


"""Plain versions of the contracts, for comparison on small tables."""

from __future__ import annotations

import re


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if len(w) >= width:
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    return {tuple(w)} if w else set()


def components(texts: dict, percent: int):
    """Smallest key reachable from each key by links of enough similarity."""
    sets = {k: shingles(t) for k, t in texts.items()}
    keys, up = sorted(sets), {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = root(a), root(b)
                    up[max(p, q)] = min(p, q)
    return {k: root(k) for k in keys}, {k: len(s) for k, s in sets.items()}


def contamination(texts: dict, items: list):
    """(words, hits, items) of each document."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows: dict = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9)):
            if w and item is not None:
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    out = {}
    for key, text in texts.items():
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out[key] = (len(w), len(hit), sorted(found))
    return out


def url_templates(paths: dict):
    """(template, purity) of each (host, path), from paths: (host, path) to (n, bad, good). Plain recursion over the tree."""
    out = {}

    def wildcard(seg):
        if seg == "":
            return ""
        end = re.search(r"(\.[A-Za-z]{2,5})$", seg)
        stem = seg[: end.start()] if end else seg
        kind = "{num}" if re.fullmatch(r"\d+", stem) else "{hex}" if re.fullmatch(r"[0-9a-fA-F-]{8,}", stem) else "{str}"
        return kind + (end[0] if end else "")

    def visit(rows, template, purity, labels):
        """rows: ((host, path), remaining segments, n, bad, good)"""
        if len(rows) == 1:
            out[rows[0][0]] = (template + "".join("/" + x for x in rows[0][1]), purity)
            return
        children = {}
        for r in rows:
            if r[1]:
                children.setdefault(r[1][0], []).append(r)
            else:
                out[r[0]] = (template, purity)
        total = lambda group, i: sum(r[i] for r in group)
        under = [r for g in children.values() for r in g]
        nn, nb, ng = (total(under, i) for i in (2, 3, 4))
        branches = {}
        for seg, group in children.items():
            cn, cb, cg = (total(group, i) for i in (2, 3, 4))
            part = seg
            if not (len(children) <= max(8, nn**0.5) or (cn >= 20 and cn >= 0.05 * nn)):
                part = wildcard(seg)
            elif 5 <= cb + cg < nb + ng:
                share = nb / (nb + ng)
                if abs(cb / (cb + cg) - share) <= 1.96 * (max(share * (1 - share), 1e-9) / (cb + cg)) ** 0.5:
                    part = "{alike}"
            branches.setdefault(part, []).extend((r[0], r[1][1:], *r[2:]) for r in group)
        for part, group in branches.items():
            b, n = total(group, 3), total(group, 3) + total(group, 4)
            visit(group, template + "/" + part, purity if n in (0, labels) else (b + 2 * purity) / (n + 2), n)

    bad, all_ = sum(x[1] for x in paths.values()), sum(x[1] + x[2] for x in paths.values())
    prior = min(0.5, bad / all_) if all_ else 0.0
    for host in {h for h, _ in paths}:
        rows = [(k, k[1][1:].split("/"), *x) for k, x in paths.items() if k[0] == host]
        b, n = sum(r[3] for r in rows), sum(r[3] + r[4] for r in rows)
        visit(rows, "", (b + 2 * prior) / (n + 2) if n else prior, n)
    return out


def marginals(score, transitions, start):
    """Marginals of each token's states by going through every path."""
    from itertools import product

    import numpy as np

    n, k = score.shape
    out = np.zeros((n, k))
    for path in product(range(k), repeat=n):
        total = start[path[0]] + sum(score[i, s] for i, s in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:]))
        for i, s in enumerate(path):
            out[i, s] += np.exp(total)
    return out / out.sum(1, keepdims=True)


def best_path(observed, start, move, emit):
    """The most probable states, the least ones on ties, by going through every path."""
    from itertools import product

    score = lambda p: start[p[0]] + sum(emit[s, o] for s, o in zip(p, observed)) + sum(move[a, b] for a, b in zip(p, p[1:]))
    return max(product(range(len(start)), repeat=len(observed)), key=lambda p: (round(score(p), 9), [-s for s in p[::-1]]))


def lz78(text):
    """Phrases of a text: each the shortest string that is not a phrase before it."""
    known, i = [], 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in known:
            j += 1
        if j > len(text):
            break
        known.append(text[i:j])
        i = j
    return known

"""Plain Python forms of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host):]).group()


def url_rule(host, path, rules):
    fits = [(len(r), r, v) for v, r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def statistics(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def phrases(text, wanted):
    w = ALNUM.findall((text or "").translate(LOWER))
    found = [(i, label) for label, p in wanted for s in [p.split()] for i in range(len(w) - len(s) + 1) if w[i : i + len(s)] == s]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def similar(texts, k, percent):
    """doc_id: (set size, component, links)."""
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), links[i]) for i in ids}


def stripped(rows, least):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of each (doc_id, text); null ids last, as one id."""
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        b = (t or "").encode()
        for s in range(len(b) - least + 1):
            first.setdefault(b[s : s + least], key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - least + 1):
            if first[b[s : s + least]] < key(i):
                gone[s : s + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def winnowed(grams, w):
    """Positions that windows of w hashes choose: the smallest, rightmost on ties."""
    if not grams:
        return []
    out = []
    for s in range(max(1, len(grams) - w + 1)):
        window = grams[s : s + w]
        m = min(window)
        p = s + len(window) - 1 - window[::-1].index(m)
        if p not in out:
            out.append(p)
    return out


def mix_targets(sizes, weights, most):
    """source: target, by sharing the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if most * sizes[s] <= w[s] * level}
        if not over:
            return out | {s: w[s] * level for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def by_key(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(tuple(r[1:]))
    return {k: sorted(v) for k, v in out.items()}

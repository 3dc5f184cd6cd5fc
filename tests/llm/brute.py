"""Plain versions of the operators, quadratic or in memory."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


class Forest(dict):
    def root(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def near(rows, size, percent=80):
    """rows of (key, id, text), key unique: key to (n, component id)."""
    sets = {}
    for key, _, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        sets[key] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    ids, f, keys = {k: i for k, i, _ in rows}, Forest(), [k for k, i, _ in rows if i is not None]
    for a in range(len(keys)):
        f.root(keys[a])
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                f.join(keys[a], keys[b])
    least = defaultdict(lambda: 1 << 62)
    for k in keys:
        least[f.root(k)] = min(least[f.root(k)], ids[k])
    return {k: (len(sets[k]), least[f.root(k)] if ids[k] is not None else None) for k, _, _ in rows}


def substring(rows, window=13):
    """rows of (id, text) to (id, n, removed, sha) of each."""
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def suffix(rows, length=200):
    count = Counter()
    for _, text in rows:
        b = (text or "").encode()
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def vectors(rows, threshold=0.95):
    """rows of (id, vector) to (id, n_links, component, kept) of each."""
    f, good = Forest(), []
    for k, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append(k)
    links = Counter()
    for a in range(len(good)):
        for b in range(a):
            x, y = np.array(rows[good[a]][1], float), np.array(rows[good[b]][1], float)
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                f.join(good[a], good[b])
                links[good[a]] += 1
                links[good[b]] += 1
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[f.root(k)] = min(least.get(f.root(k), i), i)
    return [(i, links[k], least.get(f.root(k)), i == least.get(f.root(k)) if least.get(f.root(k)) is not None else True) for k, (i, _) in enumerate(rows)]


def quality(rows, always=50, line_docs=5, share=0.05, most=0.5):
    """rows of (id, text, source) to (id, n_words, chars, symbols, dup lines, repeats, failed, kept) of each."""
    norm = lambda line: " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(line))
    docs, held = Counter(source for *_, source in rows), defaultdict(set)
    for k, (_, text, source) in enumerate(rows):
        for line in (text or "").split("\n"):
            if words(line):
                held[source, norm(line)].add(k)
    out = []
    for i, text, source in rows:
        w = words(text)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        c = Counter(grams)
        cover = {k + j for k, g in enumerate(grams) if c[g] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        often = [x for x in lines if (n := len(held[source, norm(x)])) > line_docs and (n > always or n > share * docs[source])]
        size = lambda xs: sum(len(x.encode()) for x in xs)
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), failed, not failed and size(often) <= most * size(lines)))
    return out

"""Plain Python versions of the operators' contracts, for small fixtures."""

import hashlib
import math
import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile("[^\x20\x09-\x0D]+")


def words(text, kind=SPACED, lower=True):
    t = text or ""
    return kind.findall(t.translate(LOW) if lower else t)


def contamination(text, items, n=10):
    """items: [(id, text)] -> (n_words, n_hit, n_items, digest)"""
    w = words(text, ALNUM)
    hit, ids = set(), set()
    for item, it in items:
        iw = words(it, ALNUM)
        size = min(n, len(iw))
        if not size:
            continue
        wins = {tuple(iw[i:i + size]) for i in range(len(iw) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i:i + size]) in wins:
                hit.update(range(i, i + size))
                if item is not None:
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def phrases(text, table):
    w = words(text, ALNUM)
    return sorted((i, label) for p, label in table.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())


def measures(text):
    t = text or ""
    w = words(t, lower=False)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def shingles(text, k=4):
    w = words(text)
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(rows, percent=85):
    """rows: [(id, text)] -> {id: least linked id}; all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


class Ppm:
    """Prediction by partial matching over word bytes, with escapes d / (T + d) and exclusion."""

    def __init__(self, learned, order):
        self.order = order
        self.words = Counter(w for t in learned for w in words(t))
        self.texts = len(learned)
        self.n = [defaultdict(Counter) for _ in range(order + 1)]
        for w, c in self.words.items():
            for ctx, s in self.keys(w.encode()):
                self.add(ctx, s, c)
        if self.texts:
            self.add(b"\0" * (order - 1) + b" ", 255, self.texts)

    def add(self, ctx, s, c):
        for j in range(self.order + 1):
            self.n[j][ctx[self.order - j:]][s] += c

    def keys(self, w):
        a = b"\0" * (self.order - 1) + b" " + w + b" "
        return [(a[i - self.order:i], a[i]) for i in range(self.order, len(a))]

    def lp(self, ctx, s):
        excluded, p = set(), 0.0
        for j in range(self.order, -1, -1):
            children = self.n[j].get(ctx[self.order - j:])
            if children is None:
                excluded = set()
                continue
            left = {x: c for x, c in children.items() if x not in excluded}
            total = sum(left.values()) + len(left)
            if s in left:
                return p + math.log10(left[s] / total)
            if total:
                p += math.log10(len(left) / total)
            excluded = set(children)
        return p - math.log10(256 - len(self.n[0].get(b"", ())))

    def score(self, text):
        return sum(self.lp(*k) for w in words(text) for k in self.keys(w.encode())) + self.lp(b"\0" * (self.order - 1) + b" ", 255)

    def base(self, text):
        n, v = sum(self.words.values()) + self.texts, len(self.words) + (self.texts > 0)
        return sum(math.log10((c + 1) / (n + v + 1)) for c in [*(self.words[w] for w in words(text)), self.texts])

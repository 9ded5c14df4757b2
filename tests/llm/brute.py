"""Plain Python versions of the operators, for small inputs."""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def lower(text):
    return (text or "").translate(UPPER)


def shingles(text, width):
    w = WORD.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def near_groups(rows, width, percent):
    """rows: (id, text); returns (id, set size, component id) of each, in order."""
    sets = [shingles(t, width) for _, t in rows]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    edges = []
    for i, s in enumerate(sets):
        both = Counter(j for g in s for j in by[g] if j < i)
        edges += [(i, j) for j, n in both.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
    root = roots(len(rows), edges)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, len(s), least.get(r)) for (i, _), s, r in zip(rows, sets, root)]


def distance_in(item, text):
    """The smallest edit distance of ``item`` to any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def leaks(docs, items, rate):
    """docs, items: (id, normalised text); {doc id: {(item id, distance)}}: dynamic programming over all texts at once."""
    gap = 1 + max(int(len(t) * rate) for _, t in items)  # marks between texts: crossing costs more than any budget
    codes, start = [], []
    for _, t in docs:
        start.append(sum(map(len, codes)))
        codes.append(np.array([*map(ord, t), *[-1] * gap], dtype=np.int32))
    text = np.concatenate(codes)
    place = np.arange(len(text) + 1, dtype=np.int32)
    out = {i: set() for i, _ in docs}
    for item_id, item in items:
        row = np.zeros(len(text) + 1, dtype=np.int32)
        for c in item:
            new = row + 1
            np.minimum(new[1:], row[:-1] + (text != ord(c)), out=new[1:])
            row = np.minimum.accumulate(new - place) + place
        least = np.minimum.reduceat(row[1:], start)
        most = min(int(len(item) * rate), len(item) - 1)
        for (i, _), d in zip(docs, least.tolist()):
            if d <= most:
                out[i].add((item_id, d))
    return out


MASK = (1 << 64) - 1


def _mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & MASK
    return x ^ x >> 31


def _hash(span):
    power, total = 1, 0
    for c in span:
        power = power * 0x9E3779B97F4A7C55 & MASK
        total += (c + 1) * power
    return _mixed(total + len(span) & MASK)


def toxicity(text, weights, cuts, slots):
    """p_toxic, p_severe, severity, grade of one text, word by word."""
    found = set()
    for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", lower(text).encode()):
        found.add(_hash(word) % slots)
        for k in (4, 5, 6):
            if len(word) > k:
                found.add(_mixed(_hash(word[:k]) + k & MASK) % slots)
    eta = sum(float(weights[s]) for s in found)
    over = [1 - 1 / (1 + math.exp(min(max(eta - c, -40), 40))) for c in cuts]
    share = [1 - over[0], over[0] - over[1], over[1]]
    return over[0], over[1], sum(over), share.index(max(share))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def span_digest(spans, kinds):
    spans = sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))
    return sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))


def secrets(text):
    text = text or ""
    out = [("assign", *m.span()) for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A)
        if len(m[2]) >= 6 and m[1].isascii()]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]


def luhn(number):
    d = [int(c) for c in number][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 9 <= len(digits(m[0])) <= 15]


class ContextTree:
    """Context-tree weighting by recursion over explicit counts."""

    def __init__(self, texts, depth):
        self.depth, self.count = depth, defaultdict(lambda: [0, 0])
        self.kids = defaultdict(set)
        for t in texts:
            for ctx, bits, bit in self.steps(t):
                for d in range(depth + 1):
                    own = ctx[depth - d:]
                    self.count[own, bits][bit] += 1
                    if d:
                        self.kids[own[1:], bits].add(own)
        self.memo = {}

    def steps(self, text):
        data = b"\xff" * self.depth + lower(text).encode() + b"\xff"
        for i in range(self.depth, len(data)):
            for k in range(8):
                yield data[i - self.depth:i], (k, data[i] >> (8 - k)), data[i] >> (7 - k) & 1

    def log_pe(self, node):
        a, b = self.count[node] if node in self.count else (0, 0)
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_pw(self, ctx, bits):
        if (ctx, bits) not in self.memo:
            pe = self.log_pe((ctx, bits))
            if len(ctx) < self.depth:
                below = sum(self.log_pw(c, bits) for c in self.kids[ctx, bits])
                high = max(pe, below)
                pe = high + math.log(math.exp(pe - high) + math.exp(below - high)) - math.log(2)
            self.memo[ctx, bits] = pe
        return self.memo[ctx, bits]

    def one(self, ctx, bits, d=0):
        own = ctx[self.depth - d:]
        a, b = self.count[own, bits] if (own, bits) in self.count else (0, 0)
        kt = (b + .5) / (a + b + 1)
        if d == self.depth:
            return kt
        alpha = math.exp(self.log_pe((own, bits)) - math.log(2) - self.log_pw(own, bits))
        return alpha * kt + (1 - alpha) * self.one(ctx, bits, d + 1)

    def score(self, text):
        return sum(math.log10(p if bit else 1 - p) for ctx, bits, bit in self.steps(text) for p in [self.one(ctx, bits)])

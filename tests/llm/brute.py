"""Plain versions of the operators, over lists of (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(i, n):
    return zlib.crc32(("null" if i is None else str(i)).encode()) % n


def exact(docs, largest=True):
    groups = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        left = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and left, hashlib.sha256(t.encode()).hexdigest()))
            left = left and i != keep
    return out


def decontaminated(docs, items, length=10):
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wanted = defaultdict(set)
    for i, t in items:
        w = rule.findall(low(t))
        for k in range(max(1, len(w) - length + 1)) if w else ():
            wanted[tuple(w[k : k + length])].add(str(i) if i is not None else "null")
    sizes = {len(x) for x in wanted}
    out = []
    for i, t in docs:
        w, hit, found = rule.findall(low(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wanted:
                    hit.update(range(k, k + n))
                    found |= wanted[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def shards(docs, n=8):
    rows = sorted(((-1, i) if i is None else (0, i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), i) for i, t in docs)
    total, before, out, slots = sum(r[1] for r in rows), 0, [], Counter()
    for _, size, crc, i in rows:
        k = min((2 * before + size) * n // (2 * total), n - 1)
        out.append((i, size, crc, k, slots[k]))
        slots[k] += 1
        before += size
    return out


def fingerprint(text, size=4):
    w = words(low(text))
    if not w:
        return 0
    grams = [" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(docs, bits=4):
    fp = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, f"{fp[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(docs)]


def without_repeats(docs, window=50):
    least = {}
    inf = float("inf")
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            least[x] = min(least.get(x, inf), inf if i is None else i)
    out = []
    for i, t in docs:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (inf if i is None else i):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def good_turing(counts):
    n = Counter(counts.values())
    for k in range(5, 0, -1):
        if all(n[r] for r in range(1, k + 2)):
            top = (k + 1) * n[k + 1] / n[1]
            if top == 1:
                continue
            d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) for r in range(1, k + 1)}
            if all(0 < x < 1 for x in d.values()):
                return lambda c: c * d.get(c, 1.0)
    a = (n[1] + 0.5) / (n[1] + 2 * n[2] + 1)
    return lambda c: c - a


class Katz:
    """Counts of n-grams as tuples; 0 stands before a text, None ends it."""

    def __init__(self, texts, order):
        self.n = [Counter() for _ in range(order)]
        for t in texts:
            w = [0, *words(low(t)), None]
            for k in range(order):
                self.n[k].update(tuple(w[i - k : i + 1]) for i in range(max(1, k), len(w)))
        self.one = self.n[0]
        self.d = [good_turing(c) for c in self.n]
        self.tokens = sum(self.one.values())
        self.total, self.after, self.memo = Counter(), defaultdict(list), {}
        for c in self.n[1:]:
            for g, k in c.items():
                self.total[g[:-1]] += k
                self.after[g[:-1]].append(g[-1])

    def word(self, w):
        if (w,) in self.one:
            return self.d[0](self.one[w,]) / self.tokens
        return 1 - sum(map(self.d[0], self.one.values())) / self.tokens if self.tokens else 1.0

    def p(self, h, w):
        if not h:
            return self.word(w)
        if not self.total[h]:
            return self.p(h[1:], w)
        if h not in self.memo:
            total, c, d = self.total[h], self.n[len(h)], self.d[len(h)]
            left = 1 - sum(d(c[*h, x]) for x in self.after[h]) / total
            if left < 1e-9:
                total += 1
                left = 1 - sum(d(c[*h, x]) for x in self.after[h]) / total
            self.memo[h] = total, left / (1 - sum(self.p(h[1:], x) for x in self.after[h]))
        total, weight = self.memo[h]
        if (*h, w) in self.n[len(h)]:
            return self.d[len(h)](self.n[len(h)][*h, w]) / total
        return weight * self.p(h[1:], w)


def katz(docs, order=2):
    train = [(i, t) for i, t in docs if fold(i, 5) != 1]
    m = Katz([t for _, t in train], order)
    v, out = len(m.one), []
    for i, t in docs:
        w = [0, *words(low(t)), None]
        score = sum(math.log10(m.p(tuple(w[max(0, k - order + 1) : k]), w[k])) for k in range(1, len(w)))
        base = sum(math.log10((m.one[x,] + 0.5) / (m.tokens + 0.5 * (v + 1))) for x in w[1:])
        out.append((i, fold(i, 5) == 1, len(w) - 1, sum((x,) in m.one for x in w[1:]), m.tokens, base, score))
    return out, m


def toxicity(train, texts, l2=1e-5):
    """Scores by features found gram by gram and a fit by Newton's method in as many unknowns as there are rows."""

    def found(text):
        raw = b" " + (text or "").encode() + b" "
        raw = bytes(x + 32 if 65 <= x <= 90 else 32 if 9 <= x <= 13 else x for x in raw)
        out = set()
        for n in (4, 5, 6):
            for k in range(len(raw) - n + 1):
                h = raw[k]
                for x in raw[k + 1 : k + n]:
                    h = (h * 16777619 + x) % 2**32
                out.add((h + n) % 2**32 * 2654435769 % 2**32 >> 14)
        return out

    rows, y = [found(t) for t, _ in train], np.array([float(v) for _, v in train])
    n1, n0 = Counter(f for r, v in zip(rows, y) if v for f in r), Counter(f for r, v in zip(rows, y) if not v for f in r)
    ratio = {f: math.log((n1[f] + 1) / (y.sum() + 2) / ((n0[f] + 1) / (len(y) - y.sum() + 2))) for f in n1 | n0}
    length = sum(ratio[f] ** 2 for r in rows for f in r) / len(rows)
    # the best weights are sums of rows: w = sum of a[k] * row k, and the penalty is a K a
    gram = np.array([[sum(ratio[f] ** 2 for f in a & b) / length for b in rows] for a in rows])
    a, c, n = np.zeros(len(y)), math.log(y.mean() / (1 - y.mean())), len(y)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(gram @ a + c)))
        v = p * (1 - p) / n
        slope = np.append((p - y) / n + l2 * a, (p - y).sum() / n)
        bend = np.block([[v[:, None] * gram + l2 * np.eye(n), v[:, None]], [v @ gram, v.sum()]])
        step = np.linalg.solve(bend, slope)
        a, c = a - step[:-1], c - step[-1]
    return [1 / (1 + math.exp(-(sum(k * ratio[f] ** 2 / length for r, k in zip(rows, a) for f in own & r) + c))) for own in map(found, texts)]

"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def jump(key, n):
    b, j, key = -1, 0, key & (2**64 - 1)
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def stats(text):
    s = text or ""
    w = WORD.findall(s)
    lines = [x for x in s.split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    again = {i + j for v in seen.values() if len(v) > 1 for i in v for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in s), len(lines) - len(set(lines)), len(again)


def repeats(rows, length=200):
    seen, out = Counter(), []
    texts = [(k, (t or "").encode()) for k, t in rows]
    for _, b in texts:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    for k, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, n):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def of(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.of(a), self.of(b)
        self.up[max(a, b)] = min(a, b)


def near(rows, n, percent):
    sets = {k: shingles(t, n) for k, t in rows}
    groups = Groups(sets)
    ids = sorted(k for k in sets if sets[k])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    return sorted((k, len(s), groups.of(k), groups.of(k) == k) for k, s in sets.items())


def overlaps(docs, items, window=13, least=11):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for i, s in items:
        q = split(s)
        for k, text in docs:
            d = split(text)
            found = []
            for shift in range(window - len(q), len(d) - window + 1):
                for a in range(max(0, -shift), min(len(q), len(d) - shift) - window + 1):
                    n = sum(q[a + x] == d[a + shift + x] for x in range(window))
                    if n >= least:
                        found.append((-n, a + shift, a))
            if found:
                out[k, i] = min(found)
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1]


def records(pages):
    groups = defaultdict(list)
    for i, _, html in pages:
        groups[(html or "").encode()].append(i)
    out = []
    for i, _, html in pages:
        b = (html or "").encode()
        same = groups[b]
        top = max((x for x in same if x is not None), default=None)
        again = len(b) >= 1000 and len(same) > 1 and top is not None and i != top
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return out

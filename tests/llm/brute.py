"""Plain Python versions of the contracts, one document or pair at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def secrets(text):
    text = text or ""
    spans = []
    key = "".join
    words = ["password", "passwd", "secret", "token", "apikey", "api_key"]
    anycase = "|".join(key(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words)
    for m in re.finditer(rf"({anycase})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            spans.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            spans.append((m.start(), 2, "hex", m.end()))
    spans.sort()
    n = Counter(s[2] for s in spans)
    return (n["assign"], n["access"], n["hex"],
            sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)))


def windows(rows, size=13):
    """{row number: (n_words, n_removed, kept sha)} of (doc_id, text) rows."""
    rows = [(float("inf") if i is None else i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in rows:
        for k in range(len(w) - size + 1):
            h = tuple(w[k:k + size])
            least[h] = min(i, least.get(h, i))
    out = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - size + 1):
            if least[tuple(w[k:k + size])] < i:
                gone.update(range(k, k + size))
        out.append((len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def contaminated(rows, items, size=10):
    pats = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text or ""))
        m = min(size, len(w))
        if m and item is not None:
            for k in range(len(w) - m + 1):
                pats[tuple(w[k:k + m])].add(str(item))
    lengths = {len(p) for p in pats}
    out = []
    for _, text in rows:
        w = ALNUM.findall(lower(text or ""))
        hit, found = set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                ids = pats.get(tuple(w[k:k + m]))
                if ids:
                    hit.update(range(k, k + m))
                    found |= ids
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def repeated_bytes(texts, size=200):
    """(n_bytes, n_removed, n_spans, kept sha) of every text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k:k + size] for d in data for k in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - size + 1):
            if seen[d[k:k + size]] > 1:
                gone[k:k + size] = b"\x01" * size
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(d), sum(gone), spans, sha(bytes(b for k, b in enumerate(d) if not gone[k]))))
    return out


def shingles(text, size):
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1))


def near(rows, size=3, percent=85):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {i: shingles(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    posts = defaultdict(list)
    for i in sorted(sets):
        shared = Counter()
        for s in sets[i]:
            for j in posts[s]:
                shared[j] += 1
            posts[s].append(i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    inside = set()
    for k in range(len(w) - 7):
        if seen[tuple(w[k:k + 8])] > 1:
            inside.update(range(k, k + 8))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(inside),
            len(w) < 20 or 100 * len(inside) > 30 * len(w))


def looped(doc_id, text):
    """The words of a text, every tenth document made periodic."""
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def word_runs(w, least=6, times=4):
    """(start, length, period) of every run, each period tried at every place."""
    found = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q) and not any((i, length, d) in found for d in range(1, q)):
                found.add((i, length, q))
            i = max(j, i + 1)
    return sorted(found)


def runs(rows):
    """The columns of the periodic-run contract of (doc_id, text) rows."""
    out = []
    for i, text in rows:
        w = looped(i, text)
        found = word_runs(w)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        out.append((i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                    sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
                    sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def ranked(rows, items, top=50):
    """(item_id, rank, doc_id, score) of the ranked search; rows without an id last among equals."""
    docs = [(i, Counter(ALNUM.findall(lower(t or "")))) for i, t in rows]
    n_docs = sum(1 for _, c in docs if c)
    words = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        terms = set(ALNUM.findall(lower(text or "")))
        found = []
        for i, c in docs:
            n, score = sum(c.values()), 0
            for t in terms & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 50 + (50 * n * n_docs) // words
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort()
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(found[:top])]
    return out

"""Plain Python restatements of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in BLANK.split(text or "") if w]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def exact(rows):
    """rows: (doc_id, text) with distinct ids."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i))
    out = set()
    for norm, members in groups.items():
        keep = min(members)[1]
        out |= {(i, keep, len(members), i == keep, sha(norm)) for _, i in members}
    return out


def covered(sequences, length):
    """For each sequence, the places covered by windows that also start elsewhere."""
    counts = Counter(tuple(s[i : i + length]) if isinstance(s, list) else s[i : i + length] for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        marks = bytearray(len(s))
        for i in range(len(s) - length + 1):
            if counts[tuple(s[i : i + length]) if isinstance(s, list) else s[i : i + length]] > 1:
                marks[i : i + length] = b"\1" * length
        out.append(marks)
    return out


def repeated_bytes(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), t, m in zip(rows, texts, covered(texts, length)):
        runs = len(re.findall(b"\1+", bytes(m)))
        out.append((i, len(t), sum(m), runs, sha(bytes(c for c, x in zip(t, m) if not x))))
    return Counter(out)


def repeated_words(rows, length):
    texts = [words(t) for _, t in rows]
    out = []
    for (i, _), t, m in zip(rows, texts, covered(texts, length)):
        out.append((i, len(t), sum(m), sha(" ".join(w for w, x in zip(t, m) if not x))))
    return Counter(out)


def fingerprint(text, shingle=4):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(lower)
    if not w:
        return 0
    grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows, distance=4):
    prints = {i: fingerprint(t) for i, t in rows}
    parent = {f: f for f in prints.values()}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    some = sorted(parent)
    for x, a in enumerate(some):
        for b in some[:x]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    low = {}
    for i, f in prints.items():
        low[root(f)] = min(i, low.get(root(f), i))
    return {(i, f"{f:016x}", low[root(f)]) for i, f in prints.items()}


def statistics(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), failed


def most_losses(n, risk, error):
    total, best = 0.0, -1
    for k in range(int(n * risk) + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log1p(-risk))
        if total <= error:
            best = k
    return best


def lines(rows, least_documents, least_key=1):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    counts = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= least_key)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(key(x)) >= least_key and counts[key(x)] >= least_documents)]
        out.append((i, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return Counter(out)


def targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        out = {s: most * sizes[s] if s in full else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in full and out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over

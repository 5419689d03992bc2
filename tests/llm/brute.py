"""Plain re-implementations of the operators' definitions, quadratic where that is simplest."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def item_words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s or ""))


def plain_words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def contamination(docs, items, window=10):
    """docs, items: lists of (id, text)."""
    grams = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        if w:
            n = min(len(w), window)
            for k in range(len(w) - n + 1):
                grams[tuple(w[k : k + n])].add(str(i))
    sizes = {len(g) for g in grams}
    out = []
    for d, t in docs:
        w, hit, found = item_words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit.update(range(k, k + n))
                    found |= grams[g]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def longest_matches(docs, items, window=10):
    """doc_id -> (words of the longest match that begins with a window, its first place)."""
    out = {}
    items = [w for _, t in items if (w := item_words(t))]
    for d, t in docs:
        w, best = item_words(t), (0, None)
        starts = {}
        for k, x in enumerate(w):
            starts.setdefault(x, []).append(k)
        for item in items:
            for j in range(max(1, len(item) - window + 1)):
                for k in starts.get(item[j], []):
                    n = 0
                    while k + n < len(w) and j + n < len(item) and w[k + n] == item[j + n]:
                        n += 1
                    if n >= min(window, len(item)) and (n > best[0] or n == best[0] and k < best[1]):
                        best = (n, k)
        out[d] = best
    return out


def repeats(docs, n=13):
    first = {}
    tokens = {d: plain_words(t) for d, t in docs}
    for d in sorted(tokens):
        for k in range(len(tokens[d]) - n + 1):
            first.setdefault(tuple(tokens[d][k : k + n]), d)
    out = []
    for d, w in tokens.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < d:
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def near(docs, similarity=85, shingle=3):
    sets = {}
    for d, t in docs:
        w = plain_words(lower(t or ""))
        sets[d] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    inverted = defaultdict(set)
    for d, s in sets.items():
        for g in s:
            inverted[g].add(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        common = defaultdict(int)
        for g in s:
            for e in inverted[g]:
                if e < d:
                    common[e] += 1
        for e, c in common.items():
            if 100 * c >= similarity * (len(s) + len(sets[e]) - c):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return [(d, len(s), find(d), find(d) == d) for d, s in sets.items()]


def quality_statistics(text):
    """The classifier's statistics of one text, counted one by one."""
    text = text or ""
    raw = text.encode()
    words = [w.encode() for w in plain_words(text)]
    lines = [x for x in raw.split(b"\n") if x]
    share = lambda k, n: math.log((k + 0.5) / (n + 1))
    classes = ["A-Z", "0-9", r"\x20\x09-\x0d", r"\n", ".,:;", "!?", r"|/\\", "#$%&*+<=>@^_`~", r"\"'()\-\[\]{}", r"\xc0-\xff"]
    out = [math.log1p(len(text)), math.log1p(len(words)), math.log((sum(map(len, words)) + 1) / (len(words) + 1))]
    out += [share(len(re.findall(f"[{c}]".encode("latin-1"), raw)), len(text)) for c in classes]
    out.append(share(len(set(words)), len(words)))
    out.append(share(sum(len(w) > 12 for w in words), len(words)))
    out.append(share(sum(len(w) <= 3 for w in words), len(words)))
    out.append(share(sum(not re.search(rb"[0-9A-Za-z\x80-\xff]\Z", w) for w in words), len(words)))
    out.append(share(sum(not re.search(rb"[a-z\x80-\xff]", w) for w in words), len(words)))
    out.append(share(len(lines) - len(set(lines)), len(lines)))
    return out


def _densities(x, y, shrink):
    """A function to the log density of class 1 less that of class 0, per statistic, with inverses and determinants."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    covs = [sum(np.outer(v - z[y == k].mean(axis=0), v - z[y == k].mean(axis=0)) for v in z[y == k]) / (y == k).sum() for k in (0, 1)]
    pooled = covs[0] * (y == 0).mean() + covs[1] * (y == 1).mean()
    models = []
    for k in (0, 1):
        c = (1 - shrink) * covs[k] + shrink * pooled
        c = (1 - shrink) * c + shrink * np.diag(np.diag(c)) + 0.01 * np.eye(len(c))
        models.append((z[y == k].mean(axis=0), np.linalg.inv(c), np.linalg.slogdet(c)[1]))

    def difference(v):
        v = (v - mean) / scale
        logs = [-0.5 * ((v - m) @ inverse @ (v - m) + det) for m, inverse, det in models]
        return min(max((logs[1] - logs[0]) / len(v), -50), 50)

    return difference


def quality_scores(docs, labels, shrinks, folds=5):
    """Scores of all documents by a discriminant that is trained on labelled rows of other folds than 0."""
    known = {}
    for d, v in labels:
        if v is not None:
            known[d] = min(v, known.get(d, v))
    rows = sorted((d, quality_statistics(t), known[d]) for d, t in docs if d in known and zlib.crc32(str(d).encode()) % 5)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    fold = np.empty(len(y), int)
    for k in (0, 1):
        fold[y == k] = np.arange((y == k).sum()) % folds
    best = None
    for shrink in shrinks:
        d = np.empty(len(y))
        for f in range(folds):
            difference = _densities(x[fold != f], y[fold != f], shrink)
            d[fold == f] = [difference(v) for v in x[fold == f]]
        slope, bias = 1.0, 0.0
        for _ in range(200):  # gradient steps on the penalised logistic loss, scaled by its curvature
            p = 1 / (1 + np.exp(-np.clip(slope * d + bias, -30, 30)))
            g = np.array([(d * (p - y)).sum() + 1e-2 * slope, (p - y).sum()])
            w = p * (1 - p)
            h = np.array([[(w * d * d).sum() + 1e-2, (w * d).sum()], [(w * d).sum(), w.sum() + 1e-6]])
            slope, bias = np.array([slope, bias]) - np.clip(np.linalg.solve(h, g), -2, 2)
        p = np.clip(1 / (1 + np.exp(-np.clip(slope * d + bias, -40, 40))), 1e-6, 1 - 1e-6)
        loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
        if best is None or loss < best[0]:
            best = (loss, shrink, slope, bias)
    difference = _densities(x, y, best[1])
    return {d: 1 / (1 + math.exp(-min(max(best[2] * difference(np.array(quality_statistics(t))) + best[3], -40), 40))) for d, t in docs}


def simhash(text, k=3):
    import xxhash

    w = plain_words(lower(text or ""))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fingerprints, limit=2):
    """fingerprints: id -> number. id -> smallest id that links reach."""
    ids = sorted(fingerprints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(fingerprints[i] ^ fingerprints[j]).count("1") <= limit:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def vector_codes(rows, scale=4096, parts=8, entries=16, rounds=6):
    """rows: (id, vector, label). id -> (code, error, label error), and the entries' integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def near(p, x):
        return min((dist(x, e), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(p, cut(v, p))[1]].append(cut(v, p))
            for k, own in groups.items():
                new[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        books = new
    out, by_label = {}, defaultdict(int)
    for i, v, label in kept:
        found = [near(p, cut(v, p)) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label)
        by_label[label] += out[i][1]
    return {i: (c, e, by_label[label]) for i, (c, e, label) in out.items()}, [x for b in books for e in b for x in e]


def phrases(docs, least=100, longest=5, first=2000):
    """docs: (language, text). Rows of language, rank, phrase, a, l, r, n, score."""
    f, n = defaultdict(int), defaultdict(int)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    rows = defaultdict(list)
    for (lang, p), a in candidates.items():
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        longer = (q for (other, q), b in candidates.items() if other == lang and len(q) > len(p) and b >= a)
        if not any(p == q[i : i + len(p)] for q in longer for i in range(len(q) - len(p) + 1)):
            rows[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return [(lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, own in rows.items() for k, (s, a, p, l, r) in enumerate(sorted(own)[:first], 1)]

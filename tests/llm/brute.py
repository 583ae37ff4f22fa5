"""Brute-force versions of the training-data operators, in plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

BLANKS = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def covered(seqs, w):
    count = Counter(s[i : i + w] for s in seqs for i in range(len(s) - w + 1))
    out = []
    for s in seqs:
        flags = [False] * len(s)
        for i in range(len(s) - w + 1):
            if count[s[i : i + w]] > 1:
                flags[i : i + w] = [True] * w
        out.append(flags)
    return out


def suffix_dedup(rows, w):
    seqs = [(t or "").encode() for _, t in rows]
    out = []
    for (d, _), s, f in zip(rows, seqs, covered(seqs, w), strict=True):
        spans = sum(x and (i == 0 or not f[i - 1]) for i, x in enumerate(f))
        out.append((d, len(s), sum(f), spans, sha(bytes(b for b, x in zip(s, f, strict=True) if not x))))
    return out


def word_dedup(rows, w):
    seqs = [tuple(re.findall(BLANKS, t or "")) for _, t in rows]
    return [(d, len(s), sum(f), sha(" ".join(x for x, y in zip(s, f, strict=True) if not y))) for (d, _), s, f in zip(rows, seqs, covered(seqs, w), strict=True)]


def shingles(t, k):
    w = re.findall(BLANKS, lower(t))
    return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def near_dups(rows, k=4, similarity=80):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where, common = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for own in where.values():
        for b in range(len(own)):
            for a in range(b):
                common[own[a], own[b]] += 1
    for (a, b), c in common.items():
        if 100 * c >= similarity * (len(sets[a]) + len(sets[b]) - c):
            parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        comp = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), comp, d == comp))
    return out


def contamination(rows, items, size=13):
    windows = defaultdict(set)
    for item, t in items:
        w = re.findall(ALNUM, lower(t))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w, hit, names = re.findall(ALNUM, lower(t)), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((d, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def fingerprint_texts(rows):
    """(doc_id, text length, sha of the edited text) by descending id."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 2
        out.append((d, len(t), sha(t[: len(t) - k] + n[:k])))
    return out


def spelt_words(rows, least_chars=5, least_count=3, deletes=97):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if deletes and h % deletes == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if n >= least_count and len(w) >= least_chars}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def spellings(words, ratio=2):
    """(word, form, root, n, n_near, form_n) by comparing all words."""
    form, near = {}, {}
    for w, n in words.items():
        others = [(-m, v) for v, m in words.items() if one_edit(w, v)]
        near[w] = len(others)
        best = min(others, default=(0, None))
        form[w] = best[1] if -best[0] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words.get(form[w])))
    return out

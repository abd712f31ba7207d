"""Brute-force versions of the operators, in plain Python on small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def lower_az(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def shingles(text, k=5):
    w = WORD.findall(lower_az(text or ""))
    if not w:
        return frozenset()
    if len(w) < k:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def jaccard_components(rows):
    """{doc_id: (n_shingles, component)} by all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), find(d)) for d in ids}


def substring_removal(rows, k=13):
    """{doc_id: (n_words, n_removed, kept text)}."""
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i:i + k]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < d:
                gone.update(range(i, i + k))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def repeat_words(w):
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    return len({p for i, g in enumerate(grams) if n[g] > 1 for p in (i, i + 1, i + 2)})


def edit_distance_to_any_window(item, words):
    """Least word edits between the item and any stretch of the words."""
    prev = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        cur = [i]
        for j, y in enumerate(words, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)

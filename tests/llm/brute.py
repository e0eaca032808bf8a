"""The contracts in plain Python, for small inputs."""

import hashlib
import re
from collections import Counter

SPACE = " \t\n\x0b\x0c\r"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, width=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", fold(text or "")) if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(docs, percent=80):
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def kept_lines(docs, least_chars=40, least_docs=5):
    key = lambda line: fold(line.strip(SPACE))
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    return out


def leaks(docs, items, width=5, least=0.8):
    """The best similarity of each document and item over all windows of the item's size, cut at the ends of the text."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
    found = {}
    for d, t in docs:
        own = grams(cut(t))
        for i, s in items:
            want = Counter(grams(cut(s)))
            m = want.total()
            if not m or not want.keys() & set(own):
                continue
            for a in range(1 - m, len(own)):
                got = Counter(own[max(0, a) : a + m])
                if (sim := (got & want).total() / (got | want).total()) >= least:
                    found[d, i] = max(found.get((d, i), 0), sim)
    return found

"""Plain-Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def last(doc_id) -> tuple:
    """Order of ids with a null id after all others."""
    return (doc_id is None, doc_id or 0)


def suffix_removal(docs: list[tuple], size: int) -> list[tuple]:
    """op4: (doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row."""
    raws = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + size] for _, b in raws for i in range(len(b) - size + 1))
    out = []
    for d, b in raws:
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def window_removal(docs: list[tuple], size: int) -> list[tuple]:
    """op9: (doc_id, n_words, n_removed, kept_sha256) per row."""
    words = [(d, SPACED.findall(t or "")) for d, t in docs]
    first: dict = {}
    for d, w in sorted(words, key=lambda x: last(x[0])):
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if last(first[tuple(w[i : i + size])]) < last(d):
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text: str | None, size: int) -> set:
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(docs: list[tuple], size: int, percent: int) -> list[tuple]:
    """op10: (doc_id, n_shingles, component_id) per row."""
    sets = [shingles(t, size) for _, t in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[find(i)].append(d)
    names = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return [(d, len(s), names[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def contains(text: str | None, item: str) -> bool:
    def norm(x):
        return " " + " ".join(ALNUM.findall(x.translate(LOWER))) + " "

    return norm(item) in norm(text or "")

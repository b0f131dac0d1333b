"""Licence scans by a generalised suffix automaton.

The automaton holds every run of words of every notice. A text is streamed through it word
by word; at each word the state gives the longest run ending there that some notice holds
(the matching statistics). Runs that cannot be extended and have ``MIN_RUN`` words or more
are matches. A match may stand at several places of a notice; all of them are kept. Per notice, matches in
order of both texts are chained over gaps of at most ``MAX_GAP`` words, by the chain that covers
most; where two matches overlap, the words count once. A notice is found where a chain covers
``MIN_COVER`` of its words.

Words outside the notices' vocabulary reset the automaton; a vectorised lookup finds the
stretches of known words first, and only those are walked. Defined cases: null and empty
texts have no words and no labels; repeated rows give repeated results; very long texts are
streamed like others (a chunk holds at least one text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.arrays import ALNUM, U64, hash_bytes, lower_ascii, text_chunks, word_bounds, word_hashes
from hazardframe.llm.licence_texts import NOTICES, PHRASES

MIN_RUN, MAX_GAP, MIN_COVER = 3, 8, 0.75
SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:int,last_word:int,cover:double>>"


def words_of(text: str) -> list[bytes]:
    buf = lower_ascii(np.frombuffer(text.encode(), np.uint8))
    s, e, _ = word_bounds(buf, np.array([0, len(buf)]), ALNUM)
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist())]


class Automaton:
    """Suffix automaton of several token sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[int, list[int]]] = [{}]  # per state: sequence -> all end places of its runs there
        for number, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                self.places[last].setdefault(number, []).append(place)
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for number, places in self.places[state].items():
                self.places[self.link[state]].setdefault(number, []).extend(places)
        self.ends = [{number: places[0] for number, places in at.items()} for at in self.places]  # one of them each

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.places.append({})
        return len(self.next) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """A state for the shorter runs of ``q`` that continue ``p`` by ``token``."""
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:  # the run is known from an earlier sequence
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return state

    def matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int]]:
        """(end place in ``tokens``, run length, state) of every run that cannot be extended to the right."""
        out, state, size = [], 0, 0
        for i, token in enumerate(tokens):
            if token not in self.next[state]:
                if size >= least:
                    out.append((i - 1, size, state))
                while state and token not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
            if token in self.next[state]:
                state, size = self.next[state][token], size + 1
        if size >= least:
            out.append((len(tokens) - 1, size, state))
        return out


class Scanner:
    """Notices, their automaton, and the base phrases."""

    def __init__(self, notices: list[tuple[str, str]] = NOTICES, phrases: list[tuple[str, str]] = PHRASES):
        texts = [words_of(t) for _, t in notices]
        self.labels = [label for label, _ in notices]
        words = sorted({w for t in texts for w in t})
        token = {w: i for i, w in enumerate(words)}
        self.sizes = [len(t) for t in texts]
        self.automaton = Automaton([[token[w] for w in t] for t in texts])
        hashes = np.array([hash_bytes(w) for w in words], U64)
        order = np.argsort(hashes)
        self.hashes, self.tokens = hashes[order], order
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.hashes & U64(0xFFFF)).astype(np.int64)] = True
        self.phrases = [(np.array([hash_bytes(w) for w in words_of(p)], U64), label) for p, label in phrases]

    def known(self, h: np.ndarray) -> np.ndarray:
        """Token of every word, -1 outside the vocabulary."""
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.table[(h & U64(0xFFFF)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[where] == h[at]
        out[at[same]] = self.tokens[where[same]]
        return out

    def base(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, str]]:
        """(word index in the chunk, label) of every place of a base phrase inside one text."""
        out = []
        for words, label in self.phrases:
            n = len(words)
            at = np.flatnonzero(h[: max(0, len(h) - n + 1)] == words[0])
            for i in range(1, n):
                at = at[h[at + i] == words[i]]
            inside = np.searchsorted(first, at, "right") == np.searchsorted(first, at + n - 1, "right")
            out += [(int(x), label) for x in at[inside]]
        return out

    def spans(self, tokens: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share covered) of every chain in one stretch of words."""
        runs: dict[int, list[tuple[int, int, int]]] = {}
        known = tokens >= 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < MIN_RUN:
                continue
            for end, size, state in self.automaton.matches(tokens[a:b].tolist(), MIN_RUN):
                for number, places in self.automaton.places[state].items():
                    runs.setdefault(number, []).extend((a + end - size + 1, place - size + 1, size) for place in places)
        return [(self.labels[k], start, end - 1, min(1.0, n / self.sizes[k])) for k, found in runs.items() for start, end, n in chains(found)]


def chains(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, words covered) of chains of (place in text, place in notice, words), best first, apart in the text."""
    items = sorted(set(matches))
    widest = max(size for _, _, size in items)
    best, before, low = [], [], 0
    for j, (at, place, size) in enumerate(items):
        while items[low][0] + widest + MAX_GAP < at:
            low += 1
        top, via = size, -1
        for i in range(low, j):
            a, p, s = items[i]
            if at - (a + s) > MAX_GAP or p >= place or a >= at:
                continue
            gain = size - max(0, a + s - at, p + s - place)
            if gain > 0 and best[i] + gain > top:
                top, via = best[i] + gain, i
        best.append(top)
        before.append(via)
    out: list[tuple[int, int, int]] = []
    for j in sorted(range(len(items)), key=lambda j: (-best[j], items[j])):
        end, i = items[j][0] + items[j][2], j
        while before[i] >= 0:
            i = before[i]
        start = items[i][0]
        if all(end <= a or start >= b for a, b, _ in out):
            out.append((start, end, best[j]))
    return out


_SCANNERS: list[Scanner] = []


def scanner() -> Scanner:
    """The worker's scanner of the fixed notices."""
    if not _SCANNERS:
        _SCANNERS.append(Scanner())
    return _SCANNERS[0]


def scan(docs: DataFrame) -> DataFrame:
    """Base phrases, labels, best cover (``score``) and covered spans of every document."""

    def run(batches):
        s = scanner()
        for batch, buf, off in text_chunks(batches):
            low = lower_ascii(buf)
            starts, ends, first = word_bounds(low, off, ALNUM)
            h = word_hashes(low, starts, ends)
            n = len(first) - 1
            base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
            for at, label in s.base(h, first):
                d = int(np.searchsorted(first, at, "right")) - 1
                base[d].append((at - int(first[d]), label))
            tokens = s.known(h)
            # Only texts with MIN_RUN known words in a row are walked.
            row = tokens >= 0
            for i in range(1, MIN_RUN):
                row[:-i] &= tokens[i:] >= 0
                row[-i:] = False
            walk = np.unique(np.searchsorted(first, np.flatnonzero(row), "right") - 1)
            spans: list[list] = [[] for _ in range(n)]
            best = np.zeros(n)
            for d in walk.tolist():
                found = s.spans(tokens[first[d] : first[d + 1]])
                best[d] = max((c[3] for c in found), default=0.0)
                spans[d] = [c for c in found if c[3] >= MIN_COVER]
            places = [[p for p, _ in b] for b in base]
            own = [sorted({label for _, label in b}) for b in base]
            both = [sorted({*o, *(c[0] for c in x)}) for o, x in zip(own, spans)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(first)), pa.array([len(p) for p in places], pa.int64()), pa.array([min(p, default=None) for p in places], pa.int64()),
                    pa.array([max(p, default=None) for p in places], pa.int64()), pa.array([",".join(o) for o in own], pa.string()), pa.array([",".join(b) for b in both], pa.string()), pa.array(best),
                    pa.array([[{"label": c[0], "first_word": c[1], "last_word": c[2], "cover": c[3]} for c in sorted(x, key=lambda c: (c[1], c[0]))] for x in spans], pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("cover", pa.float64())]))),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCAN)

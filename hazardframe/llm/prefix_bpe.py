"""Byte-level BPE by prefix dynamic programming: every byte prefix has one valid last token.

A sequence of tokens is the encoding of its bytes exactly when each adjacent pair of it is:
merging the bytes of the pair gives the pair back. So the encoding of a prefix is the encoding
of a shorter prefix and one last token, and only one token can follow. A table of those last
tokens is filled from left to right; ids are read off it from the end. Appending bytes
continues the table, and after an edit it is filled anew only until the old values come back
over the length of the longest token: from there on they repeat.

Texts are split before by the tokenizer's pattern. The split is done on whole batches from
each character's class; the classes come from the library's own pattern engine, so its Unicode
tables count. Each distinct piece of a batch is encoded once; a worker keeps recent pieces.

Defined cases: null and empty texts give no ids and an empty decoding; a piece that is itself a
token gets that token, as in the library; repeated rows give repeated results; a null id is
kept; further columns are ignored, whatever their names. Long texts and long pieces take time in
proportion to their length. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.arrays import text_chunks

#: A worker forgets its pieces (and pairs) beyond so many.
CACHE_ENTRIES = 400_000
#: Texts are encoded in runs of so many bytes.
RUN_BYTES = 1 << 21

_LETTER, _NUMBER, _BLANK, _WHITE, _SIGN = range(5)
#: The endings that the pattern keeps with an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a rank file (one base64 token and its rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def character_classes() -> np.ndarray:
    """The class of every code point, told by the library: it keeps what a pattern matches."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    everything = "".join(map(chr, points))
    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, _SIGN, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\s+")):
        probe = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        out[[ord(c) for c in bytes(probe.encode_ordinary(everything)).decode()]] = kind
    out[0x20] = _BLANK
    return out


class PrefixTable:
    """Last tokens of all prefixes of one byte string under fixed ranks."""

    def __init__(self, merges: "Merges", data: bytes = b""):
        self.merges, self.data = merges, bytearray()
        self.last: list[int] = [-1]
        self.append(data)

    def _fill(self, at: int) -> int:
        """The only token that can end the prefix of ``at`` bytes."""
        m, last, data = self.merges, self.last, self.data
        for size in range(min(m.longest, at), 0, -1):
            token = m.own.get(bytes(data[at - size : at]))
            if token is not None and (at == size or m.pair(last[at - size], token)) and m.whole(token):
                return token
        raise ValueError("a byte is no token")

    def append(self, more: bytes) -> None:
        """Continue the table; what stands there stays."""
        start = len(self.data) + 1
        self.data += more
        for at in range(start, len(self.data) + 1):
            self.last.append(self._fill(at))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes ``start`` to ``end``; returns how many prefixes were computed anew.

        A last token follows from the bytes and last tokens within the longest token's
        length before it. Once so many values in a row, past the new bytes, equal the old ones
        at their places, all further ones do.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data[start:end] = new
        self.last = old[: start + 1]
        same, at = 0, start
        while at < len(self.data) and (same < self.merges.longest or at < start + len(new) + self.merges.longest):
            at += 1
            self.last.append(self._fill(at))
            before = at - shift
            same = same + 1 if at > start + len(new) and before < len(old) and old[before] == self.last[at] else 0
        self.last += old[at - shift + 1 :]
        return at - start

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.merges.tokens[self.last[at]])
        return out[::-1]


class Merges:
    """Ranks, and which pairs of tokens can stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.own = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}
        self.reached: dict[int, bool] = {}

    @cached_property
    def stems(self) -> set[bytes]:
        """All prefixes of tokens: a search for tokens at a place ends where they end."""
        return {t[:n] for t in self.own for n in range(1, len(t) + 1)}

    def merge(self, data: bytes) -> list[bytes]:
        """Merging by rank, the first of equals first: the definition."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.own.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, token: int) -> bool:
        """Whether the token's bytes merge to it; others never come out of merging."""
        got = self.reached.get(token)
        if got is None:
            got = self.reached[token] = len(self.merge(self.tokens[token])) == 1
        return got

    def pair(self, left: int, right: int) -> bool:
        key = left << 32 | right
        got = self.pairs.get(key)
        if got is None:
            a, b = self.tokens[left], self.tokens[right]
            got = self.pairs[key] = self.merge(a + b) == [a, b]
        return got

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece. The table is filled forwards: tokens that start at a place end later places."""
        token = self.own.get(data)
        if token is not None:
            return [token]
        n, own, stems, pair, whole = len(data), self.own, self.stems, self.pair, self.whole
        last = [-1] * (n + 1)
        for at in range(n):
            before = last[at]
            for end in range(at + 1, n + 1):
                part = data[at:end]
                if part not in stems:
                    break
                if last[end] < 0:
                    token = own.get(part)
                    if token is not None and (at == 0 or pair(before, token)) and whole(token):
                        last[end] = token
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]


class Splitter:
    """The pattern's pieces from character classes.

    Letters, numbers and signs form runs, each with one blank before it; white space before
    anything else gives its last character up, as a blank to that run or as a piece of its own;
    a contraction is cut off where an apostrophe starts a piece.
    """

    def __init__(self):
        self.classes = character_classes()

    def starts(self, points: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where pieces start in the characters of several texts, the first of which starts at ``off[0]``."""
        n = len(points)
        if n == 0:
            return np.zeros(0, np.int64)
        kind = self.classes[points]
        white = (kind == _BLANK) | (kind == _WHITE)
        group = np.where(white, _BLANK, kind)
        first = np.zeros(n + 1, bool)
        first[off] = True
        run = first[:n].copy()
        run[1:] |= group[1:] != group[:-1]
        last_of_run = np.append(run[1:], True)
        begins = run.copy()
        after_blank = np.zeros(n, bool)  # a run that takes the blank before it
        after_blank[1:] = (kind[:-1] == _BLANK) & ~white[1:] & ~first[1:n]
        begins &= ~(run & after_blank)
        begins |= white & last_of_run & ~first[1:]
        self._contractions(points, kind, first, begins)
        return np.flatnonzero(begins)

    @staticmethod
    def _contractions(points: np.ndarray, kind: np.ndarray, first: np.ndarray, begins: np.ndarray) -> None:
        quotes = np.flatnonzero((points == 0x27) & begins)
        n = len(points)
        for ending in CONTRACTIONS:
            size = len(ending)
            fits = quotes[quotes + size < n]
            for i, c in enumerate(ending, 1):
                fits = fits[(points[fits + i] == ord(c)) & ~first[fits + i]]
            begins[fits + 1] = False
            after = fits + size + 1
            after = after[after < n]
            begins[after[(kind[after] == _LETTER) & ~first[after]]] = True


class Encoder:
    """Split, encode each distinct piece, put the pieces together."""

    def __init__(self, path: str):
        self.merges, self.splitter = Merges(read_ranks(path)), Splitter()
        self.known: dict[bytes, list[int]] = {}

    def pieces(self, buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """All pieces as binary values, and the first piece of each text (n + 1 values)."""
        lead = (buf & 0xC0) != 0x80
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        at_byte = np.append(np.flatnonzero(lead), len(buf))
        char_off = np.searchsorted(at_byte, off)
        starts = at_byte[self.splitter.starts(points, char_off)]
        bounds = np.append(starts, len(buf)).astype(np.int32)
        values = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))])
        return values, np.searchsorted(starts, off)

    def ids(self, buf: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of each distinct piece, the distinct piece at each place, and the first place of each text."""
        values, first = self.pieces(buf, off)
        coded = values.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        if len(self.merges.pairs) > 4 * CACHE_ENTRIES:
            self.merges.pairs.clear()
        known, encode = self.known, self.merges.encode
        out = []
        for piece in distinct:
            got = known.get(piece)
            if got is None:
                got = known[piece] = encode(piece)
            out.append(got)
        return out, coded.indices.to_numpy(), first

    def decode(self, ids) -> bytes:
        tokens = self.merges.tokens
        return b"".join([tokens[i] for i in ids])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a rank file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, ranks_file: str) -> DataFrame:
    """(doc_id, ids array<int>)."""

    def run(batches):
        e = encoder(ranks_file)
        for batch, buf, off in text_chunks(batches, limit=RUN_BYTES):
            ids, code, first = e.ids(buf, off)
            places = code.tolist()
            rows = [list(itertools.chain.from_iterable([ids[c] for c in places[a:b]])) for a, b in itertools.pairwise(first.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _narrow(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_file: str) -> DataFrame:
    """(doc_id, raw binary) from (doc_id, ids); null ids count as none."""

    def run(batches):
        e = encoder(ranks_file)
        for batch in batches:
            raw = [e.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def digests(docs: DataFrame, ranks_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids as decimals joined by commas."""

    def run(batches):
        e = encoder(ranks_file)
        for batch, buf, off in text_chunks(batches, limit=RUN_BYTES):
            ids, code, first = e.ids(buf, off)
            said = [b",".join([b"%d" % i for i in x]) for x in ids]
            read = [e.decode(x) for x in ids]
            size = np.array([len(x) for x in ids], np.int64)[code] if len(ids) else np.zeros(0, np.int64)
            upto = np.append(0, np.cumsum(size))
            places, bounds = code.tolist(), list(itertools.pairwise(first.tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(upto[first]), pa.int64()),
                    pa.array([hashlib.sha256(b",".join([said[c] for c in places[a:b]])).hexdigest() for a, b in bounds], pa.string()),
                    pa.array([hashlib.sha256(b"".join([read[c] for c in places[a:b]])).hexdigest() for a, b in bounds], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _narrow(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


class Text:
    """A whole text with the prefix table of each piece: appends and edits keep what they can."""

    def __init__(self, e: Encoder, text: str = ""):
        self.e, self.text = e, text
        self.tables: dict[int, PrefixTable] = {}
        self.starts: list[int] = self._split(text)

    def _split(self, text: str) -> list[int]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return self.e.splitter.starts(points, np.array([0, len(points)])).tolist()

    def _table(self, start: int, end: int) -> PrefixTable:
        if start not in self.tables:
            self.tables[start] = PrefixTable(self.e.merges, self.text[start:end].encode())
        return self.tables[start]

    def ids(self) -> list[int]:
        out, own = [], self.e.merges.own
        for start, end in itertools.pairwise([*self.starts, len(self.text)]):
            whole = own.get(self.text[start:end].encode())
            out += [whole] if whole is not None else self._table(start, end).ids()
        return out

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters ``start`` to ``end``.

        The pattern looks at most two characters past a piece, so pieces that end before that
        stay; pieces after the edit stay from the first start that both splits share. The
        changed piece's own table is edited where it keeps its start.
        """
        shift = len(new) - (end - start)
        old, text = self.starts, self.text[:start] + new + self.text[end:]
        ends = [*old[1:], len(self.text)] if old else []
        keep = 0
        while keep < len(old) and ends[keep] + 2 <= start:
            keep += 1
        base = old[keep] if keep < len(old) else (ends[-1] if old else 0)
        later = {s: i for i, s in enumerate(old) if s >= end}
        # Split from ``base`` on, in growing stretches, until an old start comes back.
        span = max(64, 2 * (start - base + len(new)))
        while True:
            stop = min(len(text), base + span)
            found = [base + s for s in self._split(text[base:stop])]
            sure = found if stop == len(text) else [s for s in found if s + 3 < stop and s != found[-1]]
            back = next((s for s in sure if s >= start + len(new) and s - shift in later), None)
            if back is not None or stop == len(text):
                break
            span *= 2
        middle = [s for s in sure if back is None or s < back]
        tail = [s + shift for s in old[later[back - shift] :]] if back is not None else []
        tables = {s: t for s, t in self.tables.items() if s < base}
        tables |= {s: self.tables[s - shift] for s in tail if s - shift in self.tables}
        old_ends, moved = dict(zip(old, ends)), {s - shift for s in tail}
        new_starts = [*old[:keep], *middle, *tail]
        new_ends = dict(zip(new_starts, [*new_starts[1:], len(text)]))
        for s in middle:
            table = self.tables.get(s) if s not in moved and s <= start else None
            if table is not None:
                was, now = self.text[s : old_ends[s]].encode(), text[s : new_ends[s]].encode()
                same = next((i for i, (a, b) in enumerate(zip(was, now)) if a != b), min(len(was), len(now)))
                ahead = min(len(was), len(now)) - same
                rear = next((i for i in range(ahead) if was[-1 - i] != now[-1 - i]), ahead)
                table.edit(same, len(was) - rear, now[same : len(now) - rear])
                tables[s] = table
        self.text, self.starts, self.tables = text, new_starts, tables


def edited(docs: DataFrame, edits: DataFrame, ranks_file: str) -> DataFrame:
    """(doc_id, text, ids) of the texts after their edits (doc_id, at, start, n, new), taken by ``at``.

    Edits of one document are applied in order to its prefix tables; documents without edits
    are left out. Positions count characters and are clipped to the text; null counts as 0 or "".
    """

    def run(batches):
        e = encoder(ranks_file)
        for batch in batches:
            ids, texts = [], []
            for text, changes in zip(batch.column("text").to_pylist(), batch.column("changes").to_pylist()):
                t = Text(e, text or "")
                t.ids()
                for c in changes:
                    start = min(max(c["start"] or 0, 0), len(t.text))
                    t.edit(start, min(start + max(c["n"] or 0, 0), len(t.text)), c["new"] or "")
                ids.append(t.ids())
                texts.append(t.text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "text", "ids"])

    change = F.struct("at", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"), "new")
    per_doc = edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(change)).alias("changes"))
    return _narrow(docs).join(per_doc, "doc_id").mapInArrow(run, "doc_id long, text string, ids array<int>")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

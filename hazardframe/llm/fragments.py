"""BPE encoding by forced boundaries: texts are cut where no token can reach across.

A byte pair that stands inside no vocabulary token can never be joined by a merge. Where the
tokenizer's own splitting also separates the pair, encoding the two sides on their own and
concatenating gives the ids of the whole. Each distinct fragment of a batch is encoded once
by the library; a worker keeps recent fragments.

Defined cases: null and empty texts have no ids; texts that hold the text of an added token
(such as an end-of-text mark) are encoded whole by the library; very long texts are cut like
any other, their fragments being short.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: A worker forgets its fragments beyond so many.
CACHE_ENTRIES = 300_000
#: Texts are encoded in runs of so many bytes; in longer runs fewer fragments are met again.
ENCODED_BYTES = 1 << 21
_JOIN = 256

_SPACE, _LETTER, _DIGIT, _PUNCT, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _PUNCT
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
_APOSTROPHE = 0x27


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet's characters and the bytes they stand for (a published rule)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """A tokenizer file with its forced cuts, and the fragments met so far."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path) as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.tokens = [""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = token
        self.kind = np.uint16 if len(self.tokens) <= 1 << 16 else np.uint32
        self.ends = np.array([bool(self.suffix) and t.endswith(self.suffix) for t in self.tokens])
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.cut = self._forced_cuts(vocabulary)
        self.drops_space = not self.library.encode(" \t\n\r\x0b\x0c", add_special_tokens=False).ids
        self.joins = spec.get("decoder") is None
        self.ids: dict[bytes, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}

    def _forced_cuts(self, vocabulary) -> np.ndarray:
        """cut[a, b]: the pair stands inside no token, and the tokenizer's splitting separates it.

        Splitting separates ASCII letters, single digits and signs from each other and from
        white space; an apostrophe may open a contraction, so nothing is cut after one.
        """
        byte_of, inside = _byte_of(), np.zeros((256, 256), bool)
        for token in vocabulary:
            body = [byte_of[c] for c in token.removesuffix(self.suffix) if c in byte_of]
            inside[body[:-1], body[1:]] = True
        a, b = _CLASS[:, None], _CLASS[None, :]
        split = ((a != b) | (a == _DIGIT)) & (a != _OTHER) & (b != _OTHER)
        split[_APOSTROPHE] = False
        return ~inside & split

    def forget(self) -> None:
        """Give the known fragments up; a worker that goes on to other work needs the room."""
        self.ids.clear()
        self.decoded.clear()

    def fragments(self, buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """All fragments as binary values, and the first fragment of each text (n + 1 values)."""
        n = len(buf)
        if n == 0:
            return pa.array([], pa.binary()), np.zeros(len(off), np.int64)
        first = np.empty(n, bool)
        first[0] = True
        first[1:] = self.cut[buf[:-1], buf[1:]]
        first[off[:-1][off[:-1] < n]] = True
        keep = np.ones(n, bool)
        if self.drops_space:
            space = _CLASS[buf] == _SPACE
            # A run of white space between two cuts encodes to nothing; other white space stays in its fragment.
            starts = np.flatnonzero(first)
            blank = np.logical_and.reduceat(space, starts)
            sizes = np.diff(starts, append=n)
            keep = ~np.repeat(blank, sizes)
            starts, sizes = starts[~blank], sizes[~blank]
        else:
            starts = np.flatnonzero(first)
            sizes = np.diff(starts, append=n)
        ends = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=ends[1:])
        values = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf[keep]))])
        return values, np.searchsorted(starts, off)

    def _one_word(self, raw: bytes) -> bool:
        """True only for fragments that the tokenizer's splitting keeps as one piece."""
        if raw.isascii():
            return raw.isalpha() or (len(raw) == 1 and raw.isdigit()) or bool(_CLASS[raw[0]] == _PUNCT and b"'" not in raw)
        text = raw.decode()
        return text.isalpha() and text.lower().isalpha() and unicodedata.is_normalized("NFC", text)

    def learn(self, new: list[bytes]) -> None:
        """Encode fragments not met before."""
        simple = [x for x in new if self._one_word(x)] if self.suffix and self.drops_space else []
        lists = [simple[i : i + _JOIN] for i in range(0, len(simple), _JOIN)]
        known = set(simple)
        rest = [x for x in new if x not in known]
        for part, e in zip(lists, self.library.encode_batch_fast([b" ".join(p).decode() for p in lists], add_special_tokens=False) if lists else []):
            ids = np.array(e.ids, self.kind)
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(part):
                rest += part
                continue
            raw, w, begin = ids.tobytes(), ids.itemsize, 0
            for fragment, end in zip(part, (at * w).tolist()):
                self.ids[fragment] = raw[begin:end]
                begin = end
        for x, e in zip(rest, self.library.encode_batch_fast([x.decode() for x in rest], add_special_tokens=False) if rest else []):
            self.ids[x] = np.array(e.ids, self.kind).tobytes()

    def encode(self, buf: np.ndarray, off: np.ndarray) -> "Encoded":
        """Ids of all texts of a batch."""
        values, first = self.fragments(buf, off)
        coded = values.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.ids) > CACHE_ENTRIES:
            self.forget()
        new = [x for x in distinct if x not in self.ids]
        if new:
            self.learn(new)
        parts = [self.ids[x] for x in distinct]
        size = np.array([len(p) for p in parts], np.int64) // np.dtype(self.kind).itemsize
        flat = np.frombuffer(b"".join(parts), self.kind)
        code = coded.indices.to_numpy()
        n = size[code]
        to = np.cumsum(n) - n
        at = np.repeat(np.cumsum(size)[code] - n - to, n) + np.arange(int(n.sum()))
        ids = flat[at]
        ends = np.append(to, len(ids))[first]
        out = Encoded(self, ids, ends, distinct, code, first, size)
        return self._mend(out, buf, off)

    def _mend(self, out: "Encoded", buf: np.ndarray, off: np.ndarray) -> "Encoded":
        """Texts with an added token's text in them, encoded whole."""
        raw = buf.tobytes()
        for mark in self.added:
            if mark.encode() in raw:
                texts = [buf[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:])]
                for i, text in enumerate(texts):
                    if any(m in text for m in self.added):
                        out.whole[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)
                break
        return out

    def decode(self, fragment: bytes) -> bytes:
        got = self.decoded.get(fragment)
        if got is None:
            ids = np.frombuffer(self.ids[fragment], self.kind).tolist()
            got = self.decoded[fragment] = self.library.decode(ids, skip_special_tokens=False).encode()
        return got


class Encoded:
    """Ids of a batch of texts."""

    def __init__(self, encoder, ids, ends, distinct, code, first, size):
        self.encoder, self.flat, self.ends, self.distinct, self.code, self.first, self.size = encoder, ids, ends, distinct, code, first, size
        self.whole: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.ends) - 1

    def ids(self, i: int) -> np.ndarray:
        return self.whole[i] if i in self.whole else self.flat[self.ends[i] : self.ends[i + 1]]

    def decoded(self) -> list[bytes]:
        """Each text's ids decoded as the library does (tokens joined by a space when it has no decoder)."""
        e = self.encoder
        if not e.joins:
            return [e.library.decode(self.ids(i).tolist(), skip_special_tokens=False).encode() for i in range(len(self))]
        words = [e.decode(x) for x in self.distinct]
        full = self.size[self.code] > 0  # a fragment without ids adds nothing, not even a space
        codes, n_before = self.code[full].tolist(), np.append(0, np.cumsum(full))[self.first]
        out = [b" ".join([words[c] for c in codes[a:b]]) for a, b in zip(n_before[:-1].tolist(), n_before[1:].tolist())]
        for i, ids in self.whole.items():
            out[i] = e.library.decode(ids.tolist(), skip_special_tokens=False).encode()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

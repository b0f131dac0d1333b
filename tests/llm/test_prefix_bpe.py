import hashlib
import random

import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hazardframe.llm import prefix_bpe
from hazardframe.llm.arrays import text_buffer
from tests.llm.conftest import tuples, words

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = prefix_bpe.read_ranks(FILE)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
EXTRA = [(900, "it's I'll 's\n's  'sab \t'llx 'S we're"), (901, "x\x85\xa0  y  \n\n z\x1cw "), (902, "<|endoftext|>"), (903, "½²٣中文 12345 ǅ´`á"), (904, "é" * 300_000 + " " + words(3, 150_000))]
ALPHABET = st.one_of(st.sampled_from("ab's trevldm019 \n\t.,é中\xa0\x85"), st.characters(codec="utf-8"))


def _ids(e, texts):
    buf, off = text_buffer(pa.array(texts, pa.string()))
    ids, code, first = e.ids(buf, off)
    return [[i for c in code[a:b] for i in ids[c]] for a, b in zip(first[:-1], first[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=5))
def test_equal_to_the_library(texts):
    assert _ids(prefix_bpe.encoder(FILE), texts) == [LIBRARY.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=60), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 6), st.text(alphabet=ALPHABET, max_size=8)), max_size=4), st.text(alphabet=ALPHABET, max_size=8))
def test_edits_and_appends_equal_encoding_anew(text, edits, more):
    t = prefix_bpe.Text(prefix_bpe.encoder(FILE), text)
    t.ids()
    for at, n, new in edits:
        t.edit(min(at, len(t.text)), min(at + n, len(t.text)), new)
        assert t.ids() == LIBRARY.encode_ordinary(t.text)
    t.append(more)
    assert t.text.endswith(more) and t.ids() == LIBRARY.encode_ordinary(t.text)


def test_an_edit_recomputes_only_its_surroundings():
    merges, r = prefix_bpe.encoder(FILE).merges, random.Random(2)
    table = prefix_bpe.PrefixTable(merges, "".join(r.choice("abcdefgh") for _ in range(4000)).encode())
    for _ in range(20):
        at = r.randrange(len(table.data) - 2)
        anew = table.edit(at, at + 2, b"xyz")
        assert table.ids() == prefix_bpe.PrefixTable(merges, bytes(table.data)).ids() == LIBRARY._core_bpe.encode_single_piece(bytes(table.data))
        assert anew <= 4 * merges.longest


def test_tokens_that_merging_never_reaches():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bcd": 257, b"abcd": 258}  # "bcd" has no parts that merge
    lib = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merges = prefix_bpe.Merges(ranks)
    for piece in ("bcd", "abcd", "xbcd", "abcdab", "bcdabcd"):
        assert merges.encode(piece.encode()) == lib.encode_ordinary(piece)


def test_digests(frame, rows):
    all_rows, want = rows + EXTRA, []
    for d, t in all_rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert tuples(prefix_bpe.digests(frame(all_rows), FILE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_round_trip_and_edits_in_spark(spark, frame, rows):
    unique = list({d: (d, t) for d, t in rows + EXTRA[:4] if d is not None}.values())
    docs = frame(unique)
    back = {r.doc_id: bytes(r.raw) for r in prefix_bpe.decode(prefix_bpe.encode(docs, FILE), FILE).collect()}
    assert back == {d: (t or "").encode() for d, t in unique}
    changes = [(10, 2, 5, 3, "new words"), (10, 1, 0, 0, "x"), (30, 1, 9, 9, "was null"), (50, 1, 20_000, 100_000, None), (-999, 1, 0, 0, "nobody"), (33, None, None, None, None)]
    edits = spark.createDataFrame(changes, "doc_id long, at long, start long, n long, new string")
    got = {r.doc_id: (r.text, r.ids) for r in prefix_bpe.edited(docs, edits, FILE).collect()}
    text = dict(unique)
    first = "x" + text[10]
    assert {d: t for d, (t, _) in got.items()} == {10: first[:5] + "new words" + first[8:], 30: "was null", 50: text[50][:20_000], 33: "one"}
    assert all(ids == LIBRARY.encode_ordinary(t) for t, ids in got.values())


def test_empty_table(frame):
    assert prefix_bpe.digests(frame([(1, "a")]).limit(0), FILE).count() == 0

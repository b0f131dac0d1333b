import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hazardframe.llm import bpe, sequences, store
from hazardframe.llm.arrays import text_buffer
from hazardframe.llm.fragments import encoder
from tests.llm.conftest import tuples

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(FILE)
EXTRA = [(900, "it's don't '' 's a's **'s 12'3 x\ty"), (901, "İstanbul é ΑΣ ΑΣ.a \x1c z q"), (902, "a<|endoftext|>b <|startoftext|>"), (903, "```\n\nfoo_bar(1,2)!=3.14 №5")]


def _ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'st019 \n\t.,*<|>é́İΣ"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=5))
def test_forced_boundaries_equal_the_library(texts):
    got = encoder(FILE).encode(*text_buffer(pa.array(texts)))
    assert [got.ids(i).tolist() for i in range(len(texts))] == [_ids(t) for t in texts]
    assert [d.decode() for d in got.decoded()] == [LIBRARY.decode(_ids(t), skip_special_tokens=False) for t in texts]


def test_digests(frame, rows):
    all_rows = rows + EXTRA
    want = []
    for d, t in all_rows:
        ids = _ids(t)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert tuples(bpe.digests(frame(all_rows), FILE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_encode_then_decode(frame, rows):
    encoded = bpe.encode(frame(rows), FILE)
    got = sorted((r.doc_id, r.text) for r in bpe.decode(encoded, FILE).filter("doc_id >= 100").collect())
    assert got == sorted((d, LIBRARY.decode(_ids(t), skip_special_tokens=False)) for d, t in rows if d is not None and d >= 100)


@pytest.mark.parametrize("shard_bytes", [1 << 30, 2000])
def test_sequences_read_back(spark, frame, rows, shard_bytes):
    unique = [(d, t) for d, t in dict(r for r in rows if r[0] is not None).items()] + EXTRA
    index = sequences.write_sequences(frame(unique).repartition(4), store.shared_uri(spark, "test-sequences"), FILE, 2, shard_bytes)
    got = sorted(tuple(r) for r in sequences.read_documents(index).collect())
    at, want = 0, []
    for d, t in sorted(unique):
        ids = [*_ids(t), 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_any_sequence_is_mapped(spark, frame, rows):
    index = sequences.write_sequences(frame([(1, rows[0][1]), (2, rows[19][1])]), store.shared_uri(spark, "test-sequences"), FILE, 2)
    stream = [*_ids(rows[0][1]), 2, *_ids(rows[19][1]), 2]
    shard = sequences.Shard(index.first().file)
    ids, mask = shard.sequence(1)
    assert ids.base is not None and mask.all() and ids.tolist() == stream[2048:4096]
    ids, mask = shard.sequence(len(stream) // 2048)
    assert mask.sum() == len(stream) % 2048 and ids[mask].tolist() == stream[-(len(stream) % 2048) :]
    shard.close()


def test_repeated_and_null_ids_have_one_order(spark, frame):
    rows = [(5, "b c"), (5, "a"), (5, "a"), (None, "x y z"), (1, None)]
    index = sequences.write_sequences(frame(rows), store.shared_uri(spark, "test-sequences"), FILE, 2)
    got = sorted(tuple(r)[:3] for r in sequences.read_documents(index).fillna(-1).collect())
    assert [g[0] for g in sorted(got, key=lambda g: g[1])] == [-1, 1, 5, 5, 5]
    assert sum(g[2] for g in got) == sum(len(_ids(t)) + 1 for _, t in rows)


def test_empty_table(spark, frame):
    empty = frame([(1, "a")]).limit(0)
    assert bpe.digests(empty, FILE).count() == 0
    assert sequences.read_documents(sequences.write_sequences(empty, store.shared_uri(spark, "test-sequences"), FILE, 2)).count() == 0

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardframe.llm import repeats, sketch_dedup, suffix_dedup
from hazardframe.llm.anchors import byte_symbols
from hazardframe.llm.arrays import Rolling
from tests.llm import brute
from tests.llm.conftest import tuples, words


@pytest.mark.parametrize("bytes_in_task", [32 << 20, 1])
def test_suffix_removal_equals_brute_force(docs, rows, monkeypatch, bytes_in_task):
    monkeypatch.setattr(repeats, "TASK_BYTES", bytes_in_task)
    got = tuples(suffix_dedup.remove(docs, 100), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = brute.suffix_removal(rows, 100)
    assert got == sorted(want, key=repr) and sum(w[2] for w in want) > 0


@pytest.mark.parametrize("size", [16, 2000])
def test_suffix_removal_at_short_and_long_thresholds(frame, rows, size):
    long = " ".join(t or "" for _, t in rows[:8])
    all_rows = [*rows, (500, long * 3), (501, "x" + long[5:]), (502, long)]
    got = tuples(suffix_dedup.remove(frame(all_rows), size), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.suffix_removal(all_rows, size), key=repr)


def test_strings_that_collide_modulo_a_power_of_two(frame):
    """The Thue-Morse string and its complement hash alike modulo 2^64 under any odd base."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    want = brute.suffix_removal([(1, "x" + a), (2, "y" + b)], 2048)
    got = tuples(suffix_dedup.remove(frame([(1, "x" + a), (2, "y" + b)]), 2048), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == want and [w[2] for w in want] == [0, 0]
    symbols = byte_symbols(np.frombuffer((a + b).encode(), np.uint8))
    at = np.array([0, 2048])
    assert len(set(Rolling(symbols, longest=2048).of(at, at + 2048).tolist())) == 2 and len(set(Rolling(symbols).of(at, at + 2048).tolist())) == 1


def test_doubling_ranks_shared_blocks_in_order_and_drops_unique_ones(spark):
    """Blocks in the order of their pieces; a string that stands in one block once makes it leave."""
    blocks = [(1, 2, 3, 4, 2), (1, 2, 3, 5, 3), (0, 9, 9, 9, 2), (7, 7, 7, 7, 1), (1, 2, 8, 8, 1)]
    got = suffix_dedup.double(spark.createDataFrame(blocks, "p0 long, p1 long, p2 long, p3 long, n long")).collect()
    assert [(r.p0, r.p1, r.p2, r.p3) for r in sorted(got, key=lambda r: r.block)] == [b[:4] for b in sorted(blocks) if b[4] > 1]


def test_many_rows_of_one_id_and_text(frame):
    text = words(1, 200)
    many = [(1, text)] * 300 + [(None, text)] * 300 + [(2, words(2, 60) + " " + text)]
    assert tuples(suffix_dedup.remove(frame(many)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix_removal(many, 400), key=repr)
    assert tuples(sketch_dedup.remove(frame(many)), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.window_removal(many, 50), key=repr)


def test_passages(frame, rows):
    docs = frame(rows)
    done = repeats.keyed(docs).select("doc_id", "t")
    got = tuples(suffix_dedup.with_passages(done, docs, 51), "doc_id", "n_passage_words")
    texts = [(d, brute.SPACED.findall(t or "")) for d, t in rows]
    seen = Counter(tuple(x[i : i + 51]) for _, x in texts for i in range(len(x) - 50))
    want = []
    for d, x in texts:
        under = set()
        for i in range(len(x) - 50):
            if seen[tuple(x[i : i + 51])] > 1:
                under |= set(range(i, i + 51))
        want.append((d, len(under)))
    assert got == sorted(want, key=repr) and sum(n for _, n in want) > 0


def test_suffix_removal_at_the_production_threshold(docs, rows):
    got = tuples(suffix_dedup.remove(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.suffix_removal(rows, 400), key=repr)


@pytest.mark.parametrize("bytes_in_task", [32 << 20, 1])
def test_window_removal_equals_brute_force(docs, rows, monkeypatch, bytes_in_task):
    monkeypatch.setattr(repeats, "TASK_BYTES", bytes_in_task)
    got = tuples(sketch_dedup.remove(docs, 50), "doc_id", "n_words", "n_removed", "kept_sha256")
    want = brute.window_removal(rows, 50)
    assert got == sorted(want, key=repr) and sum(w[2] for w in want) > 0


def test_a_full_sketch_loses_nothing(docs, rows, monkeypatch):
    monkeypatch.setattr(sketch_dedup, "MAX_BITS", 9)
    monkeypatch.setattr(sketch_dedup, "MIN_BITS", 9)
    got = tuples(sketch_dedup.remove(docs, 20), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.window_removal(rows, 20), key=repr)


def test_empty_tables(frame):
    empty = frame([(1, "a")]).limit(0)
    assert suffix_dedup.remove(empty).count() == 0
    assert sketch_dedup.remove(empty).count() == 0
    assert suffix_dedup.cleaned(empty).columns == empty.columns


def test_cleaned_keeps_columns_and_cuts_text(docs, rows):
    out = suffix_dedup.cleaned(docs, 100)
    assert out.schema == docs.schema
    got = {(r.doc_id, r.n_chars) for r in out.collect()}
    assert out.count() == len(rows) and (33, 3) in got and (22, 0) in got
    assert out.filter("doc_id = 30").first().text is None


def test_blocks_are_told_apart_whatever_their_number(spark, frame, monkeypatch):
    """Only shared blocks (and a few others) are written, however many unique ones there are."""
    monkeypatch.setattr(suffix_dedup, "MAX_BITS", 12, raising=False)  # a sketch of this size is full after some thousand blocks
    monkeypatch.setattr(suffix_dedup, "PART_BLOCKS", 1000, raising=False)
    passage = words(900, 60)
    docs = repeats.keyed(frame([(i, words(1000 + i, 400) + (" " + passage if i % 20 == 0 else "")) for i in range(200)]).repartition(3))
    w = suffix_dedup.spec(101)
    every = repeats.anchor_table(docs, suffix_dedup._bytes, w).count()
    left = suffix_dedup.candidates(docs, suffix_dedup._bytes, w)
    assert every > 15_000 and left.count() < every / 10
    spans = {r.doc_id: r.spans for r in suffix_dedup.repeated(docs, 101).collect()}
    assert sorted(spans) == list(range(0, 200, 20)) and all(max(s.end for s in x) - min(s.start for s in x) in range(len(passage), len(passage) + 8) for x in spans.values())


def test_shuffle_files_go_with_their_step(spark):
    from hazardframe.operators.common import materialise

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> int:
        return sum(disk.getAllFiles().apply(i).getName().startswith("shuffle_") for i in range(disk.getAllFiles().size()))

    before = files()
    made = materialise(spark.range(0, 100_000, 1, 3).repartition(5, F.col("id") % 7).groupBy("id").count(), "cleaned")
    upto = time.time() + 20
    while files() > before and time.time() < upto:
        time.sleep(0.2)
    assert files() <= before and made.count() == 100_000

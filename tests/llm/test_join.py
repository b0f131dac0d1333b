import pytest

from hazardframe.llm import signature_join
from tests.llm import brute
from tests.llm.conftest import tuples


@pytest.mark.parametrize("page", [4096, 7])
def test_components_equal_brute_force(docs, rows, monkeypatch, page):
    monkeypatch.setattr(signature_join, "PAGE", page)
    got = tuples(signature_join.linked_components(docs), "doc_id", "n_shingles", "component_id")
    want = brute.components(rows, 4, 85)
    assert got == sorted(want, key=repr)
    assert len({w[2] for w in want}) < len(want)


@pytest.mark.parametrize("null_ids", [False, True])
def test_repeated_rows_keep_links(frame, rows, null_ids):
    doubled = rows + [(None if null_ids else d, t) for d, t in rows]
    got = tuples(signature_join.linked_components(frame(doubled).repartition(3)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.components(doubled, 4, 85), key=repr)


def test_one_of_each(docs, rows):
    out = signature_join.one_of_each(docs, 5, 80)
    assert out.columns == docs.columns
    want = brute.components(rows, 5, 80)
    names = {c for _, n, c in want if n and c is not None}
    got = [r.doc_id for r in out.collect()]
    assert {g for g in got if g is not None} - {30, 31, 32} == names
    assert sorted(g for g in got if g in (30, 31, 32)) == [30, 31, 32] and len(got) == len(names) + 3 + sum(g is None for g in got)


def test_bound_never_rejects_a_link():
    import random

    import numpy as np

    r = random.Random(3)
    for _ in range(200):
        base = [r.getrandbits(64) for _ in range(r.randint(1, 80))]
        a = np.unique(np.array(base + [r.getrandbits(64) for _ in range(r.randint(0, 8))], np.uint64))
        b = np.unique(np.array(base + [r.getrandbits(64) for _ in range(r.randint(0, 8))], np.uint64))
        leaves = [signature_join._leaf(i, len(s), *signature_join.bitmap(s, 2)) for i, s in enumerate((a, b))]
        other = signature_join._leaf(2, 5, *signature_join.bitmap(np.unique(np.array([r.getrandbits(64) for _ in range(5)], np.uint64)), 2))
        if signature_join.jaccard_reaches(a, b, 85):
            assert signature_join.possible(leaves[0], leaves[1], 85)
            assert signature_join.possible(signature_join._join([leaves[0], other]), leaves[1], 85)


def test_empty_table(frame):
    assert signature_join.linked_components(frame([(1, "a")]).limit(0)).count() == 0

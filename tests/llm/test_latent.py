import math
import random

import numpy as np
import pytest

from hazardframe.llm import latent
from tests.llm import brute


def subsequence(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def pairs(docs: list[tuple], items: list[tuple]) -> set:
    """Every (document, item) of short texts by exhaustive comparison."""

    def words(text):
        return brute.ALNUM.findall((text or "").translate(brute.LOWER))

    known = {w for _, *both in items for t in both for w in words(t)}
    texts = [(d, [w for w in words(t) if w in known]) for d, t in docs]
    weight = {w: math.log((len(docs) + 1) / (sum(w in x for _, x in texts) + 1)) + 0.05 for w in known}
    out = set()
    for i, text, answer in items:
        own = words(text)
        if not own:
            continue
        wanted = set(words(answer)) or set(own[-max(3, int(len(own) * latent.ANSWER_SHARE)) :])
        for d, x in texts:
            share = subsequence(own, x) / len(own)
            found = sum(weight[w] for w in set(own) & set(x)) / sum(weight[w] for w in set(own))
            said = len(wanted & set(x)) / len(wanted)
            if share >= latent.MIN_LCS and found >= latent.MIN_WEIGHT and (said >= latent.MIN_ANSWER or not answer and share >= latent.SURE_LCS):
                out.add((d, i))
    return out


@pytest.mark.parametrize("parts", [20_000, 7])
def test_pairs_equal_exhaustive_search(spark, monkeypatch, parts):
    monkeypatch.setattr(latent, "PART_ITEMS", parts)
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(4, 30))), r.choice([None, "w1 w2"])) for i in range(25)] + [(90, "", None), (91, None, None), (92, "w5 w6 w7 w8 w9 w10", "absent words")]
    docs = [(None, None), (1, "")]
    for d in range(2, 400):
        _, text, answer = items[r.randrange(25)]
        own = text.split()
        kept = [w for w in own if r.random() > r.choice([0.0, 0.2, 0.4, 0.6])]
        if r.random() < 0.3:
            kept = kept[: int(len(kept) * 0.8)]
        rest = [r.choice(vocabulary) for _ in range(r.randint(0, 25))]
        docs.append((d, " ".join(rest[: len(rest) // 2] + kept + rest[len(rest) // 2 :])))
    docs += [(500 + d, items[3][1]) for d in range(150)]  # an item that a third of all rows hold
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = latent.contaminated(frame, spark.createDataFrame(items, "item_id long, text string, answer string"), "answer")
    assert {(x.doc_id, x.item_id) for x in got.collect()} == pairs(docs, items)


def test_common_words_before_the_rare_ones_count(spark):
    """An item whose rare words all stand blocks after its common ones, far from it in the space: the window starts before them."""
    r = random.Random(5)
    common, rare = [f"c{i}" for i in range(36)], [[f"r{k}x{i}" for i in range(12)] for k in range(6)]
    items = [(k, " ".join(r.sample(common, 36) + rare[k]), None) for k in range(6)]
    docs = [(d, " ".join(common[::-1])) for d in range(40)]
    for k in range(6):
        own, drown = items[k][1].split(), f"r{(k + 1) % 6}x0"
        for d, gap in ((100, 0), (200, 1), (300, 7)):  # blocks of other words between the common and the rare ones
            blocks = [own[:18] + [drown] * 14, own[18:36] + [drown] * 14, *[["other"] * 32] * gap, own[36:] + [drown] * 20]
            docs.append((d + k, " ".join(w for b in [["other"] * 32] * k + blocks + [["other"] * 32] * (k % 3) for w in b)))
    got = latent.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string, answer string")).collect()
    assert {(x.doc_id, x.item_id) for x in got if x.doc_id >= 100} == {(d + k, k) for d in (100, 200) for k in range(6)}
    assert all(x.lcs_share == 1.0 and x.cosine < latent.MIN_COSINE for x in got if x.doc_id >= 100)


def test_rare_windows_are_all_windows_with_enough_weight(monkeypatch):
    r = np.random.default_rng(3)
    weight = r.uniform(0.1, 3.0, 30)
    own = [r.choice(30, int(n), replace=False) for n in r.integers(3, 70, 12).clip(3, 25)]
    reaches = np.array([1, 1, 2, 3] * 3)
    items = type("Held", (), {"terms": own})
    counts = r.integers(0, 4, 400)
    terms, blocks = r.integers(0, 30, counts.sum()), np.array([0, 1, 1, 9, 40, 44, 200, 400])
    row = np.repeat(np.arange(400), counts)
    postings = latent.rarest(items, weight)
    first, item, w, need = postings
    want = set()
    for i, reach in enumerate(reaches.tolist()):
        rare = {t: w[at] for t in range(30) for at in range(first[t], first[t + 1]) if item[at] == i}
        held = [sum(rare.get(t, 0.0) for t in set(terms[row == b].tolist())) for b in range(400)]
        for a, z in zip(blocks[:-1].tolist(), blocks[1:].tolist()):
            want |= {(i, s) for s in range(a, max(a, z - 2 - 2 * reach) + (z > a)) if sum(held[s : min(z, s + 2 + 2 * reach)]) >= need[i]}
    for run in (latent.RUN, 40):
        monkeypatch.setattr(latent, "RUN", run)
        least, last, found = latent._rare_windows(terms, row, blocks, postings, reaches)
        assert {(i, s) for a, b, i in zip(least.tolist(), last.tolist(), found.tolist()) for s in range(a, b + 1)} == want
    assert want


def test_space_is_fitted_on_every_passage(spark):
    """Against the eigenvectors of all blocks' term counts; ``n_passages`` weighs the items and leaves no row out."""
    r, n_passages = random.Random(9), 2_000_000
    items = latent.Items([{"item_id": 1, "text": "a b c d e f", "answer": None}])
    words = [[r.choice("aabbbcdddddefffxyz") for _ in range(r.randint(1, 80))] for _ in range(600)]
    rows = latent.as_terms(spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(words)], "doc_id long, text string").repartition(3), items)
    idf = np.array([1.0, 1.5, 0.7, 2.0, 1.2, 0.9])
    place = {int(h): i for i, h in enumerate(items.vocabulary)}
    at = {w: place[int(latent.Items._hashes(w)[0])] for w in "abcdef"}
    blocks = [w[i : i + latent.BLOCK] for w in words for i in range(0, len(w), latent.BLOCK)]
    counts = np.array([[sum(at.get(x) == k for x in b) for k in range(6)] for b in blocks], float) * idf
    own = np.ones(6) * idf
    _, want = np.linalg.eigh(counts.T @ counts + n_passages * np.outer(own, own))
    got = latent.fit(rows, items, idf, n_passages)
    assert np.allclose(np.abs(got.T @ want[:, ::-1]), np.eye(6), atol=2e-3)

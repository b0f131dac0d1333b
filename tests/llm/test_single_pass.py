import hashlib
import io
import random
import struct
import zipfile

import numpy as np
import pytest

from pyspark.sql import functions as F

from hazardframe.llm import fingerprints, latent, licences, store, toxicity, warc
from hazardframe.llm.arrays import hash_bytes
from tests.llm import brute
from tests.llm.conftest import tuples, words


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


@pytest.mark.parametrize("zip64", [False, True])
def test_members_are_located(zip64):
    out = io.BytesIO()
    warc.write_package(out, iter([({"page_id": 1, "type": "response"}, b"abc"), ({"page_id": 2, "type": "response"}, b"defg")]), zip64)
    data = out.getvalue()
    at, size = warc.members(_File(data))[warc.WARC_MEMBER]
    assert data[at : at + size] == b"abcdefg"
    out.seek(0)
    with zipfile.ZipFile(out, "a") as z:  # a comment with the end mark inside, and a packed member
        z.comment = b"PK\x05\x06" + b"x" * 40
        z.writestr("packed.txt", "y" * 100, zipfile.ZIP_DEFLATED)
    found = warc.members(_File(out.getvalue()))
    assert found[warc.WARC_MEMBER] == (at, size) and "packed.txt" not in found


def test_zip64_end_record_is_followed():
    out = io.BytesIO()
    warc.write_package(out, iter([({"page_id": 1, "type": "response"}, b"abc")]))
    data = out.getvalue()
    end = data.rfind(b"PK\x05\x06")
    count, size, at = struct.unpack_from("<HLL", data, end + 10)
    wide = struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, at) + struct.pack("<4sLQL", b"PK\x06\x07", 0, end, 1)
    short = data[end : end + 8] + b"\xff" * 12 + data[end + 20 :]
    assert warc.members(_File(data[:end] + wide + short)) == warc.members(_File(data))


def test_pages_round_trip(spark):
    big = "<p>" + "é" * 100 + "</p>"
    rows = [(3, "http://a b/\n", big), (1, "u", big), (7, None, big), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (8, "u", "x" * 100), (8, "u", "x" * 100), (None, "u", big), (9, "u", "a\r\n\r\nb" * 30)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    packages = warc.write_packages(warc.classify(df), store.shared_uri(spark, "test-warc"), package_bytes=300)
    listed = warc.list_records(packages)
    got = tuples(warc.read_records(listed), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for p, _, html in rows:
        b = (html or "").encode()
        first = 1 if html == big and p != 1 else None
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if first else "response", first))
    assert got == sorted(want, key=repr)
    one = warc.read_records(listed.filter("page_id = 9")).first()
    assert one.payload.decode() == rows[-1][2] and one.payload_digest == one.declared_digest
    assert warc.read_records(warc.list_records(warc.write_packages(warc.classify(df.limit(0)), store.shared_uri(spark, "test-warc")))).count() == 0


def test_fingerprints_of_edited_texts(frame, rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 4000)
    unique = sorted(dict(r for r in rows if r[0] is not None).items())
    got = {r.doc_id: r for r in fingerprints.edited_report(frame(unique).repartition(3)).collect()}
    assert len(got) == len(unique)
    for i, (d, t) in enumerate(unique):
        t, n = t or "", unique[(i + 1) % len(unique)][1] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for value, other in ((r.near_edited, edited), (r.near_next, n)):
            a, b = brute.shingles(t, 5), brute.shingles(other, 5)
            true = len(a & b) / len(a | b) if a and b else float(a == b)
            assert value == pytest.approx(true, abs=1e-9 if len(a | b) < 128 else 0.2)
    assert got[10].fingerprint == got[11].fingerprint


def test_repeated_and_null_ids_have_successors(frame):
    rows = [(5, "b " * 20), (5, "a " * 20), (None, "n"), (None, "n"), (9, None)]
    got = fingerprints.edited_report(frame(rows)).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(d) for d, _ in rows)
    assert fingerprints.edited_report(frame(rows).limit(0)).count() == 0


def test_successors_over_a_thousand_ranges(spark, monkeypatch):
    """One plan node per range is too deep a plan."""
    docs = spark.createDataFrame([(None, "x")] + [(7 * i, f"text {i}") for i in range(3000)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(fingerprints, "input_bytes", lambda _: 1000 * fingerprints.RANGE_BYTES)
    got = fingerprints.with_next(docs).select("part", "is_tail", "doc_id").collect()
    own = {r.doc_id: r.part for r in got if not r.is_tail}
    assert len(own) == 3001 and max(own.values()) > 900 and own[None] == 0
    order = [own[d] for d in sorted(own, key=lambda d: -1 if d is None else d)]
    assert order == sorted(order)
    firsts = {}
    for d in sorted(own, key=lambda d: -1 if d is None else d):
        firsts.setdefault(own[d], d)
    parts = sorted(firsts)
    assert {(r.part, r.doc_id) for r in got if r.is_tail} == {(parts[i - 1], firsts[p]) for i, p in enumerate(parts)}


def test_merged_fingerprints(spark, frame):
    text = words(1, 800)
    parts = frame([(i, " ".join(text.split()[i * 100 : i * 100 + 104])) for i in range(8)])
    cut = fingerprints.fingerprint(parts).selectExpr("doc_id % 2 * 0 AS key", "fingerprint")
    whole = fingerprints.unpack(fingerprints.fingerprint(frame([(1, text)])).first().fingerprint)
    merged = fingerprints.unpack(fingerprints.merged(cut, "key").first().fingerprint)
    assert merged.tolist() == whole.tolist()
    assert fingerprints.distinct(whole) == pytest.approx(796, rel=0.3)
    small = fingerprints.unpack(fingerprints.fingerprint(frame([(1, " ".join(text.split()[:400]))])).first().fingerprint)
    assert fingerprints.containment(small, whole) == pytest.approx(1.0, abs=0.05) and fingerprints.resemblance(small, whole) == pytest.approx(0.5, abs=0.15)


def test_notices_with_two_changed_words_keep_their_label():
    """Also where a run of words stands twice in a notice and the change is beside one of its places."""
    s, changed = licences.Scanner(), 0
    for number, (label, text) in enumerate(licences.NOTICES):
        own = [int(x) for x in s.known(np.array([hash_bytes(w) for w in licences.words_of(text)], np.uint64))]
        for i in range(0, len(own), 3):
            for j in range(i + 4, len(own), 7):
                tokens = np.array([5, 9, 2, *own, 7, 1], np.int64)
                tokens[[3 + i, 3 + j]] = -1
                left = sum(n for n in (i, j - i - 1, len(own) - j - 1) if n >= licences.MIN_RUN)
                cover = max((c[3] for c in s.spans(tokens) if c[0] == label), default=0.0)
                assert cover >= min(1.0, left / len(own)) - 1e-9
                changed += 1
    assert changed > 500


def test_licence_base_columns(frame, rows):
    extra = [(900, "mit LICENSE apache license MIT License mit"), (901, "licensed under the apache-license, version 2.0 and the GNU general public license"), (902, "mit"), (903, "license"), (904, words(1, 300) + " MIT license"), (905, "Released under the MIT, er, License.")]
    got = {r.doc_id: r for r in licences.scan(frame(rows + extra)).collect() if r.doc_id is not None}
    for d, t in rows + extra:
        if d is None or d == 60:
            continue
        w, places, labels = brute.ALNUM.findall((t or "").translate(brute.LOWER)), [], set()
        for phrase, label in licences.PHRASES:
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licences.scan(frame(rows).limit(0)).count() == 0


def test_every_notice_finds_itself(frame):
    texts = [(i, words(i, 40) + "\n" + t + "\n" + words(i + 50, 40)) for i, (_, t) in enumerate(licences.NOTICES)]
    got = {r.doc_id: r for r in licences.scan(frame(texts)).collect()}
    for i, (label, t) in enumerate(licences.NOTICES):
        assert label in got[i].labels.split(",") and got[i].score == 1.0
        assert any(s.label == label and (s.first_word, s.last_word) == (40, 40 + len(licences.words_of(t)) - 1) for s in got[i].spans)


def test_matching_statistics_against_brute_force():
    r = random.Random(1)
    for _ in range(60):
        seqs = [[r.randint(0, 3) for _ in range(r.randint(1, 15))] for _ in range(3)]
        text = [r.randint(0, 3) for _ in range(30)]
        a = licences.Automaton(seqs)
        have = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        longest = [max((n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in have or n == 0)) for i in range(len(text))]
        want = [(i, n) for i, n in enumerate(longest) if n >= 1 and (i + 1 == len(text) or longest[i + 1] <= n)]
        got = a.matches(text, 1)
        assert [(e, n) for e, n, _ in got] == want
        for e, n, state in got:
            for number, place in a.ends[state].items():
                assert seqs[number][place - n + 1 : place + 1] == text[e - n + 1 : e + 1]


def test_latent_search_finds_copies_and_paraphrases(spark, frame):
    items = [(i, words(100 + i, 20 + i)) for i in range(12)] + [(90, None), (91, ""), (92, "!!")]
    plain = [(i, words(500 + i, 150)) for i in range(40)] + [(80, None), (81, ""), (None, words(3, 30))]
    held = [(200 + i, words(700 + i, 60) + "\n" + t.upper() + ". " + words(800 + i, 60)) for i, t in items[:12]]
    loose = [(300 + i, words(900 + i, 60) + " " + " ".join(w for j, w in enumerate(t.split()) if j % 6 != 1) + " " + words(950 + i, 60)) for i, t in items[:12]]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    docs = frame(plain + held + loose + held[:1]).repartition(3)
    got = {(r.doc_id, r.item_id) for r in latent.contaminated(docs, bench).collect()}
    assert got == {(200 + i, i) for i in range(12)} | {(300 + i, i) for i in range(12)}
    kept = latent.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(d) for d, _ in plain)
    assert latent.contaminated(docs.limit(0), bench).count() == 0 and latent.contaminated(docs, bench.limit(0)).count() == 0


def test_latent_search_finds_an_item_in_a_third_of_the_rows(spark, frame):
    items = [(i, words(2000 + i, 25)) for i in range(60)]
    pool, r = [w for _, t in items for w in t.split()], random.Random(6)
    rows, hot = [], items[0][1].split()
    for i in range(120):
        around = [r.choice(pool) for _ in range(120)]
        if i % 3 == 0:  # every other one leaves out words
            around[50 + i % 40 : 50 + i % 40] = hot if i % 2 else [w for j, w in enumerate(hot) if j % 6 != 1]
        rows.append((i, " ".join(around)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in latent.contaminated(frame(rows).repartition(3), bench).collect()}
    assert got == {(i, 0) for i in range(0, 120, 3)}


def test_subsequence_length():
    r = random.Random(2)
    for _ in range(100):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(1, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        masks: dict = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert latent.lcs_length(masks, len(a), b) == t[-1][-1]


def test_toxicity_is_learnt(spark, frame):
    r, rows, labels = random.Random(4), [], []
    for i in range(400):
        w, toxic = words(i, 60).split(), i % 4 == 0
        if toxic:
            w.insert(r.randrange(60), r.choice(["wretched", "loathsome", "Horrid"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic), 1.0) if i % 9 else (i, None, 1.0))
    rows += [(1000, None), (1001, ""), (None, "wretched loathsome"), (1002, words(5, 50_000))]
    docs = frame(rows).repartition(2)
    marks = spark.createDataFrame(labels + [(5000, 1, 1.0), (None, 1, 1.0)], "doc_id long, toxic int, score double")
    model = toxicity.fit(docs, marks, toxicity.is_held_out())
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(400) if _crc(i) % 3 == 1]
    right = sum((got[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.9 and got[1000] == got[1001] < 0.7 and got[1002] < 0.7
    kept = toxicity.accepted(docs, model)
    assert kept.schema == docs.schema and kept.count() < len(rows) - 60
    none = toxicity.fit(docs, marks.limit(0), toxicity.is_held_out())
    assert toxicity.scores(docs, none).agg({"score": "max"}).first()[0] < 0.01
    assert toxicity.scores(docs.limit(0), model).count() == 0


def test_toxicity_counts_every_labelled_row(spark):
    """Half the clean rows hold the toxic word, and those with the least id hashes do not."""
    ids = [r.id for r in spark.range(6000).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, "plain words only" if n < 3000 else "some loathsome words") for n, i in enumerate(ids)]
    rows += [(i, "some loathsome words") for i in range(6000, 6100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = docs.select("doc_id", (F.col("doc_id") >= 6000).cast("int").alias("toxic"))
    model = toxicity.fit(docs, marks, F.lit(False))
    got = toxicity.scores(docs.filter("doc_id >= 6000"), model).agg({"score": "max"}).first()[0]
    assert 0.5 < got < 0.7  # all toxic rows against half the clean ones; 1 were the clean ones with the word left out


def _crc(i: int) -> int:
    import zlib

    return zlib.crc32(str(i).encode())


def test_held_out_rule(spark):
    got = {r.i: r.h for r in spark.range(50).select("id", toxicity.is_held_out("id").alias("h")).withColumnRenamed("id", "i").collect()}
    assert got == {i: _crc(i) % 3 == 1 for i in range(50)}


def test_packed_arrays_round_trip():
    s = np.arange(5, dtype=np.uint64) ** np.uint64(9)
    assert fingerprints.unpack(fingerprints.pack(s)).tolist() == s.tolist()

import pytest

import corpus_pipeline
from hazardframe.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.llm import brute
from tests.llm.conftest import words

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    passage, item = words(1, 60), words(2, 25)
    docs = [(i, words(1000 + i, 60) + (" wretched loathsome horrid" if i % 4 == 0 else "")) for i in range(120)]
    docs += [(200, words(5, 90)), (201, words(5, 90)), (202, words(5, 90) + " more"), (210, words(6, 40) + " " + passage), (211, passage + " " + words(7, 40))]
    docs += [(220, words(8, 50) + " " + item + " " + words(9, 50)), (230, None), (231, ""), (232, "one")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, words(3, 25))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, item


def test_stages_equal_brute_force(spark, folder):
    path, docs, item = folder
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [(d, t) for d, t in docs if "wretched" not in (t or "")]
    frame = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "bpe_encoding"]

    def check(name, frame, want):
        out = stages[name](spark, frame, path).cache()
        assert out.columns == columns
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)
        return out

    frame = check("toxicity", frame, kept)
    kept = [(d, t) for (d, t), (_, n, c) in zip(kept, brute.components(kept, 5, 80)) if c == d]
    frame = check("ngram_jaccard_join", frame, kept)
    spans = {d: removed for d, _, removed, _, _ in brute.suffix_removal(kept, corpus_pipeline.REPEATED_BYTES)}
    out = stages["suffix_array_dedup"](spark, frame, path).cache()
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert set(got) == {d for d, _ in kept} and spans[210] > 300
    assert all(len((t or "").encode()) - len((got[d][0] or "").encode()) == spans[d] and got[d][1] == len(got[d][0] or "") for d, t in kept)
    kept = [(d, got[d][0]) for d, _ in kept]
    want = [(d, t) for d, t in kept if not brute.contains(t, item)]
    assert len(want) == len(kept) - 1
    frame = check("benchmark_decontamination", out, want)
    last = {r.doc_id: r for r in stages["bpe_encoding"](spark, frame, path).collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.tokenizer_file())
    for d, t in want:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (last[d].ids, last[d].n_tokens, last[d].decoded) == (ids, len(ids), library.decode(ids, skip_special_tokens=False))


def test_passage_of_short_words_is_cut(spark):
    passage = " ".join(w[:1 + i % 2] for i, w in enumerate(words(4, 51).split()))
    assert len(passage) < 256 and len(passage.split()) == 51
    rows = [(i, words(3000 + i, 40) + (" " + passage + " " if i < 2 else " ") + words(3100 + i, 40)) for i in range(4)]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert all(len(got[d]) <= len(t) - len(passage) and passage not in got[d] for d, t in rows[:2])
    assert all(got[d] == t for d, t in rows[2:])


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in LLM_QUERIES) == list(range(1, 11))
    assert set(LLM_ORACLES) <= set(LLM_QUERIES) and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.PIPELINE_QUERIES["pipeline"] is corpus_pipeline.run

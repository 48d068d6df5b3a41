"""The stages' decisions on planted rows, and the registered queries' names."""

import os

import pytest

import corpus_pipeline
from stackwright.llm import pieces, queries

DIR = "/root/testdata/sf0.001"


def test_ten_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "pieces"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = docs.collect()
    base = max(rows, key=lambda r: len(r.text or "") if len(r.text or "") < 9000 and "@" not in (r.text or "") else 0)
    planted = spark.createDataFrame([(10**6 + i, base.text + (" tail" * i), "en", "p", 0) for i in range(2)] + [(10**6 + 7, "Please write to ann.lee@mail.example.org today " + " ".join(f"zq{i}" for i in range(30)), "en", "p", 0)], docs.schema)
    both = docs.unionByName(planted)
    one = corpus_pipeline.keep_one_of_copies(spark, both, DIR)
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    assert base.doc_id in kept or min(kept) < base.doc_id
    assert 10**6 not in kept and 10**6 + 1 not in kept and 10**6 + 7 in kept
    clean = corpus_pipeline.drop_benchmark_leaks(spark, both, DIR)
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first()
    leaking = {r.doc_id for r in both.collect() if item.text in (r.text or "")}
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and not leaking & left and 10**6 + 7 in left
    masked = {r.doc_id: r.text for r in corpus_pipeline.mask_personal_data(spark, planted, DIR).collect()}
    assert "<email>" in masked[10**6 + 7] and "@" not in masked[10**6 + 7]
    ids = corpus_pipeline.encode_pieces(spark, planted, DIR).collect()
    table = pieces.PieceTable(pieces.model_path())
    import numpy as np

    assert {r.doc_id: pieces.Decoder(table).decode([np.frombuffer(r.ids, "<u2")])[0] for r in ids} == {r.doc_id: r.text for r in planted.collect()}


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR) if os.path.isdir(DIR) else docs
    assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_run_against_plain_python(spark):
    """run() on the smallest tables: each stage's decisions, made once more for one document after the other."""
    import sentencepiece
    from test_operators import slow_components

    from stackwright.llm import decontaminate, pii, toxicity

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    net = toxicity.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    scorer = toxicity.Scorer(net)
    left = {i: t for i, t in rows.items() if scorer.scores([t])[0] < toxicity.THRESHOLD}
    group = slow_components(list(left.items()), corpus_pipeline.WORDS, corpus_pipeline.NUM, corpus_pipeline.DEN)
    left = {i: t for i, t in left.items() if group.get(i, i) == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    block = decontaminate.Benchmark(items)

    def leaks(text):
        words = decontaminate.words_of(text)
        for own, answer in zip(block.words, block.answers):
            if len(set(own) & set(words)) < 0.5 * len(set(own)):
                continue
            margin = max(8, len(own) // 4)
            for at in range(-margin, len(words), 2):
                region = words[max(0, at - margin) : max(0, at + len(own) + margin)]
                if decontaminate.lcs(own, region) >= decontaminate.COMMON * len(own) and decontaminate.lcs(answer, region) >= decontaminate.ANSWER * len(answer):
                    return True
        return False

    leaking = {i for i, t in left.items() if leaks(t)}
    decoder = pii.Decoder(pii.train())
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, DIR).collect()}
    assert set(out) <= set(left) and not set(left) - set(out) - leaking
    assert len(leaking & set(out)) <= 0.1 * len(leaking)
    import numpy as np

    for i, r in out.items():
        spans = next(pii.spans_of([left[i]], decoder))
        want = model.encode(pii.masked(left[i], spans) if spans else left[i])
        assert np.frombuffer(r.ids, "<u2").tolist() == want and r.n_pieces == len(want)
